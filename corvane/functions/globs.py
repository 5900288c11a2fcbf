"""Globs as anchored patterns, for columns of paths.

A path is relative, its segments parted by slashes. `*` and `?` stay within a segment, `**` as a whole segment spans
any number of them, also none; `[a-z]` and `[!a-z]` are classes, `{a,b}` and `{1..3}` alternatives, `?(a|b)`, `*(…)`, `+(…)`,
`@(…)` and `!(…)` groups. A backslash takes the next character as it is. Wildcards don't match a segment's leading dot
unless `dot` is set.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = re.compile(r"[*?\[{]|[@+!]\(")
_GROUPS = {"?": "?", "*": "*", "+": "+", "@": ""}


def braces(pattern: str) -> list[str]:
    """The pattern with braces written out; braces without a comma or range, and unclosed ones, are plain text."""
    depth, begin, commas, i = 0, -1, [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
            if depth == 1:
                begin, commas = i, []
        elif c == "," and depth == 1:
            commas.append(i)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                inner = pattern[begin + 1 : i]
                span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", inner)
                if span:
                    low, high = int(span[1]), int(span[2])
                    options = [str(n) for n in range(low, high + (1 if high >= low else -1), 1 if high >= low else -1)]
                elif commas:
                    cuts = [begin, *commas, i]
                    options = [pattern[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                else:
                    tails = braces(pattern[i + 1 :])
                    return [pattern[:begin] + "\\{" + m + "\\}" + t for m in braces(inner) for t in tails]
                tails = braces(pattern[i + 1 :])
                return [pattern[:begin] + o + t for option in options for o in braces(option) for t in tails]
        i += 1
    if depth:  # unclosed
        return [pattern[:begin] + "\\{" + t for t in braces(pattern[begin + 1 :])]
    return [pattern]


def _class(segment: str, at: int) -> tuple[str, int] | None:
    """The class that opens at `at` and the place behind it; None if it isn't closed."""
    end = at + 1
    negated = segment[end : end + 1] in ("!", "^")
    end += negated
    first = end
    while end < len(segment) and (segment[end] != "]" or end == first):
        end += 2 if segment[end] == "\\" else 1
    if end >= len(segment):
        return None
    body = re.sub(r"\\?([\[\]\\^&])", r"\\\1", re.sub(r"\\(.)", r"\1", segment[first:end]))
    return f"[{'^/' if negated else ''}{body}]", end + 1


def _close(segment: str, at: int) -> tuple[list[str], int] | None:
    """Alternatives of the group that opens at `at`, and the place behind it."""
    depth, parts, begin, i = 0, [], at + 1, at
    while i < len(segment):
        c = segment[i]
        if c == "\\":
            i += 1
        elif c == "(":
            depth += 1
        elif c == "|" and depth == 1:
            parts.append(segment[begin:i])
            begin = i + 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*parts, segment[begin:i]], i + 1
        i += 1
    return None


def _segment(segment: str) -> str:
    """One segment, without the rule on dots."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        group = _close(segment, i + 1) if c in "?*+@!" and segment[i + 1 : i + 2] == "(" else None
        if group:
            options, i = group
            any_of = "(?:" + "|".join(map(_segment, options)) + ")"
            if c == "!":  # anything here but what one of these and the rest would match
                rest = _segment(segment[i:])
                return f"{out}(?!{any_of}{rest}(?:/|$))[^/]*{rest}"
            out += any_of + _GROUPS[c]
            continue
        found = _class(segment, i) if c == "[" else None
        if found:
            out += found[0]
            i = found[1]
            continue
        if c == "\\" and i + 1 < len(segment):
            i += 1
            out += re.escape(segment[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return out


def compiled(pattern: str, dot: bool = False) -> str:
    """The pattern as a regular expression of Java and Python, anchored at both ends."""
    hidden = "" if dot else r"(?!\.)"
    whole = rf"{hidden}(?!\.\.?(?:/|$))[^/]+"
    options = []
    for option in braces(pattern):
        segments = [s for s in option.split("/") if s not in ("", ".")]
        segments = [s for i, s in enumerate(segments) if s != "**" or segments[i - 1 : i] != ["**"]]
        out = ""
        for i, s in enumerate(segments):
            last = i == len(segments) - 1
            if s == "**" and last:
                # What the pattern leads to, and all below.
                out = rf"{out[:-1]}(?:/{whole})*" if out else rf"{whole}(?:/{whole})*"
            elif s == "**":
                out += rf"(?:{whole}/)*"
            else:
                wild = MAGIC.match(s) is not None
                guard = (hidden if wild else "") + ("(?=[^/])" if wild else "")
                out += guard + _segment(s) + ("" if last else "/")
        options.append(out)
    return "^(?:" + "|".join(options) + ")$"


def fixed_prefix(pattern: str) -> str:
    """The path that all matches of the pattern are or lie below: its segments before the first with a wildcard, and
    never the last one. Empty if that is the root."""
    segments = [s for s in pattern.split("/") if s not in ("", ".")]
    out = []
    for s in segments[:-1]:
        if MAGIC.search(s) or "\\" in s or "}" in s:
            break
        out.append(s)
    return "/".join(out)


def prefixes(patterns: list[str]) -> list[str]:
    """The fixed prefixes of the patterns, without those that lie below another."""
    found = sorted({fixed_prefix(p) for p in patterns})
    return [p for p in found if not any(q == "" or p.startswith(q + "/") for q in found if q != p)]


def matches(path: Column | str, patterns: list[str], dot: bool = False) -> Column:
    """Whether a path matches one of the patterns. Each is tried only on paths below its fixed prefix."""
    path = F.col(path) if isinstance(path, str) else path

    def one(pattern: str) -> Column:
        prefix, hit = fixed_prefix(pattern), path.rlike(compiled(pattern, dot))
        return (F.startswith(path, F.lit(prefix + "/")) | (path == prefix)) & hit if prefix else hit

    return reduce(Column.__or__, map(one, patterns), F.lit(False))

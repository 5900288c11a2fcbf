"""Column functions over names and labels. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c: str | Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def diagram_id(c: str | Column) -> Column:
    return F.translate(slug(c), "-", "_")


def last_segment(c: str | Column) -> Column:
    """The part after the last dot, else after the last slash."""
    c = _col(c)
    return F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", -1)).when(F.contains(c, F.lit("/")), F.substring_index(c, "/", -1)).otherwise(c)


def humanize(c: str | Column) -> Column:
    """Last dot segment in title case; dashes, underscores and camel case become spaces."""
    last = F.substring_index(_col(c), ".", -1)
    spaced = F.regexp_replace(F.regexp_replace(last, "[-_]+", " "), "([a-z])([A-Z])", "$1 $2")
    words = F.split(spaced, r"\s+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def capitalized(c: str | Column) -> Column:
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def wrap(c: str | Column, width: int = 50, lines: int = 2, newline: str = "\n", ellipsis: str = "...") -> Column:
    """Greedy wrapping at white space; beyond `lines` lines the last one ends in an ellipsis."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        line = acc["line"]
        fits = (F.length(line) == 0) | (F.length(line) + 1 + F.length(word) <= width)
        longer = F.when(F.length(line) == 0, word).otherwise(F.concat(line, F.lit(" "), word))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(line))).alias("done"),
            F.when(fits, longer).otherwise(word).alias("line"),
        )

    words = F.filter(F.split(F.trim(_col(c)), r"\s+"), lambda w: F.length(w) > 0)
    wrapped = F.aggregate(words, start, step, lambda a: F.concat(a["done"], F.array(a["line"])))
    cut = F.slice(wrapped, 1, lines)
    return F.when(F.size(wrapped) > lines, F.concat(F.array_join(cut, newline), F.lit(ellipsis))).otherwise(F.array_join(wrapped, newline))


def quoted(c: str | Column) -> Column:
    """Diagram text: quoted only if it holds reserved characters or an escaped line break."""
    c = _col(c)
    need = c.rlike(r"""[{}:;|#\[\]()'"\\]""")
    return F.when(need, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def file_format(path: str | Column) -> Column:
    ext = F.lower(F.substring_index(_col(path), ".", -1))
    return (
        F.when(ext.isin("yml", "yaml"), "yaml")
        .when(ext == "xml", "xml")
        .when(ext == "json", "json")
        .when(ext == "toml", "toml")
        .when(ext.isin("ini", "cfg", "conf"), "ini")
        .otherwise("properties")
    )


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "^[\"']|[\"']$", "")


def _after(line: Column, mark: str) -> Column:
    return F.trim(F.substr(line, F.instr(line, mark) + 1))


def config_value(line: str | Column, fmt: str | Column) -> Column:
    """The value that a configuration line holds, by format; a line without a separator is its own value."""
    line, fmt = _col(line), _col(fmt)
    bare, colon, equals = F.trim(line), F.instr(line, ":"), F.instr(line, "=")
    either = F.when((colon > 0) & (equals > 0), F.least(colon, equals)).otherwise(F.greatest(colon, equals))
    yaml = F.when(line.rlike(r"^\s*-\s"), _unquoted(F.trim(F.regexp_replace(line, r"^\s*-\s*", "")))).when(colon > 0, _unquoted(_after(line, ":"))).otherwise(bare)
    xml = F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (">([^<]+)<", "value=[\"']([^\"']+)[\"']", "=[\"']([^\"']+)[\"']")))
    json = F.when(colon > 0, _unquoted(F.regexp_replace(_after(line, ":"), r",\s*$", ""))).otherwise(bare)
    return (
        F.when(fmt == "yaml", yaml)
        .when(fmt == "xml", F.coalesce(F.trim(xml), bare))
        .when(fmt == "json", json)
        .when(fmt == "toml", F.when(equals > 0, _unquoted(_after(line, "="))).otherwise(bare))
        .when(fmt == "ini", F.when(equals > 0, _after(line, "=")).otherwise(bare))
        .otherwise(F.when(either > 0, F.trim(F.substr(line, either + 1))).otherwise(bare))
    )


def relative_path(start: Column, target: Column) -> Column:
    """The way from a directory to a path, both below one root."""
    a, b = F.split(start, "/"), F.split(target, "/")
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    up = F.repeat(F.lit("../"), F.size(a) - n)
    return F.concat(up, F.array_join(F.slice(b, n + 1, F.size(b)), "/"))


def in_locale(c: str | Column) -> Column:
    """A column that sorts, compares and groups as readers of most languages expect: letters before their case and
    accents, small before capital ones."""
    return F.collate(_col(c), "UNICODE")


def by_letters(c: str | Column) -> Column:
    """A column in which names that differ only in case or accents are equal, also in joins and groups."""
    return F.collate(_col(c), "UNICODE_CI_AI")

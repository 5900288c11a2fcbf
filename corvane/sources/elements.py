"""Code elements of source files.

Python is parsed with the standard library's `ast`. For the languages with braces a scanner blanks comments and
texts, pairs the brackets in one pass, and cuts each body into its statements; members and types are read from
those. Each file is parsed by itself in an Arrow batch; a file that can't be parsed gives one row with its error
and no elements.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMBER = "struct<name:string,kind:string,signature:string,visibility:string>"
REFERENCE = "struct<name:string,qualified_name:string,kind:string>"
SCHEMA = f"project string, module string, rel string, language string, name string, kind string, qualified_name string, visibility string, members array<{MEMBER}>, refs array<{REFERENCE}>, line int, error string"

# Types that are no references, by language.
JAVA_BUILTINS = frozenset(
    "String Object Integer Long Short Byte Boolean Character Float Double Number Void Class Enum Throwable Exception RuntimeException Error Thread Runnable System Math "
    "Iterable Comparable CharSequence StringBuilder StringBuffer int long short byte boolean char float double void".split()
)
TS_BUILTINS = frozenset(
    "string number boolean void any unknown never object symbol bigint null undefined this Promise Array ReadonlyArray Map Set WeakMap WeakSet Date Error RegExp Record Partial "
    "Readonly Required Pick Omit Exclude Extract NonNullable ReturnType Parameters Awaited Function".split()
)
C_BUILTINS = frozenset(
    "void char short int long float double signed unsigned size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t bool _Bool FILE "
    "wchar_t time_t clock_t off_t".split()
)
PY_BUILTINS = frozenset(
    "str int bool float complex bytes bytearray memoryview list dict tuple set frozenset object type None NoneType Ellipsis Any Optional Union Literal Final ClassVar Annotated List Dict "
    "Tuple Set FrozenSet Iterable Iterator Generator AsyncIterable AsyncIterator Callable Awaitable Coroutine Mapping MutableMapping Sequence MutableSequence Type".split()
)

_HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_JAVA_TYPE = re.compile(r"(?<![\w.@])(class|interface|enum)\s+(\w+)")
_TS_TYPE = re.compile(r"(?<![\w.$])(class|interface|type|function)\s*\*?\s+([\w$]+)")
_C_STRUCT = re.compile(r"\bstruct\s+(\w+)\s*\{")
_C_WORDS = frozenset("if for while switch return else do sizeof".split())
_C_MARKS = r"\b(?:const|volatile|static|extern|inline|register|restrict)\b"
_JAVA_MARKS = r"\b(?:public|protected|private|static|final|abstract|synchronized|native|transient|volatile|default|strictfp|sealed)\b"


# --- text ----------------------------------------------------------------------------------------
class Source:
    """A text with comments and quoted texts blanked, and its brackets paired, both in one pass."""

    def __init__(self, text: str):
        self.text = text
        self.clean = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self.close: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[()\[\]{}]", self.clean):
            c = m[0]
            if c in "([{":
                stack.append(({"(": ")", "[": "]", "{": "}"}[c], m.start()))
            else:
                while stack and stack[-1][0] != c:  # what isn't closed ends here
                    self.close[stack.pop()[1]] = m.start()
                if stack:
                    self.close[stack.pop()[1]] = m.start()
        for _, at in stack:
            self.close[at] = len(text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        low, high = 0, len(self.breaks)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.breaks[mid] < at else (low, mid)
        return low + 1

    def statements(self, start: int, end: int, lines: bool = False) -> Iterator[tuple[int, int]]:
        """[start, end) of the statements of a body, without the blocks that follow their heads; with `lines` a line's
        end closes one too, if neither side goes on."""
        at = begin = start
        while at < end:
            c = self.clean[at]
            if c in "([":
                at = self.close.get(at, end) + 1
            elif c == "{":
                over = self.close.get(at, end) + 1
                if re.search(r"=>?\s*$|[(,]\s*$", self.clean[begin:at]) or lines and re.search(r":\s*$|[|&]\s*$", self.clean[begin:at]):
                    at = over  # a value or a type, not a body
                    continue
                if self.clean[begin:at].strip():
                    yield begin, at
                at = begin = over
            elif c in ";," and (c == ";" or lines and not _open_angle(self.clean[begin:at])) or c == "\n" and lines and self._ends(begin, at):
                if self.clean[begin:at].strip():
                    yield begin, at
                at = begin = at + 1
            else:
                at += 1
        if self.clean[begin:end].strip():
            yield begin, min(end, len(self.clean))

    def _ends(self, begin: int, at: int) -> bool:
        before, after = self.clean[begin:at].strip(), self.clean[at : at + 200].lstrip()
        return bool(before) and before[-1] not in ",|&=:(+<?." and not (after and after[0] in "|&=:?.{") and not before.startswith("@")


def _open_angle(text: str) -> bool:
    return text.count("<") > text.count(">") - text.count("=>")


def _split(text: str, mark: str = ",") -> list[str]:
    """Parts at marks outside of all brackets."""
    depth, out, begin = 0, [], 0
    for i, c in enumerate(text):
        depth += c in "<([{"
        depth -= c in ")]}" or c == ">" and text[i - 1 : i] != "="
        if c == mark and depth <= 0:
            out.append(text[begin:i])
            begin = i + 1
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _row(name, kind, visibility, members, refs, line, qualified=None) -> dict:
    return {"name": name, "kind": kind, "qualified_name": qualified, "visibility": visibility, "members": members, "refs": refs, "line": line}


def _member(name: str, kind: str, signature: str, visibility: str | None) -> dict:
    return {"name": name, "kind": kind, "signature": _squeezed(signature), "visibility": visibility}


def _uses(names: list[str], kinds: list[tuple[str, str]], builtins: frozenset, qualify=lambda n: None) -> list[dict]:
    """References: those of `kinds` (name, kind) as they come, then the other names as uses, each once."""
    seen = {n for n, _ in kinds}
    rest = [n for n in dict.fromkeys(names) if n not in builtins and n not in seen]
    return [{"name": n, "qualified_name": qualify(n), "kind": k} for n, k in [*kinds, *((n, "uses") for n in rest)]]


# --- Python --------------------------------------------------------------------------------------
def _base(node: ast.AST) -> str | None:
    if isinstance(node, ast.Subscript):
        return _base(node.value)
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _annotated(node: ast.AST | None) -> list[str]:
    """Type names of an annotation, from left to right; a quoted dotted name counts by its last part."""
    if node is None:
        return []
    if isinstance(node, ast.Name | ast.Attribute):
        return [_base(node)]
    if isinstance(node, ast.Constant):
        quoted = isinstance(node.value, str) and re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", node.value)
        return ["None"] if node.value is None else [node.value.split(".")[-1]] if quoted else []
    return [n for child in ast.iter_child_nodes(node) for n in _annotated(child)]


def python_elements(text: str) -> Iterator[dict]:
    """Every class, and functions at the top level; a leading underscore is private."""
    tree = ast.parse(text)
    hidden = lambda n: "private" if n.startswith("_") else "public"
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, functions)]
            members, names = [], []
            for m in methods:
                returns = f" -> {ast.unparse(m.returns)}" if m.returns else ""
                members.append(_member(m.name, "method", f"{m.name}({ast.unparse(m.args)}){returns}", hidden(m.name)))
                every = [*m.args.posonlyargs, *m.args.args, *filter(None, [m.args.vararg]), *m.args.kwonlyargs, *filter(None, [m.args.kwarg])]
                names += [n for a in every for n in _annotated(a.annotation)] + _annotated(m.returns)
            bases = dict.fromkeys(n for b in node.bases if (n := _base(b)))
            yield _row(node.name, "class", hidden(node.name), members, _uses(names, [(n, "extends") for n in bases], PY_BUILTINS), node.lineno)
    for node in tree.body:
        if isinstance(node, functions):
            yield _row(node.name, "function", hidden(node.name), [], [], node.lineno)


# --- Java ----------------------------------------------------------------------------------------
def _visibility(marks: str) -> str:
    return "public" if re.search(r"\bpublic\b", marks) else "private" if re.search(r"\bprivate\b", marks) else "internal"


def _java_types(text: str) -> list[str]:
    """Names of a type expression in order; a dotted one counts by its last part."""
    found = re.findall(r"[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*", re.sub(r"@\w+(?:\([^)]*\))?", " ", text))
    return [n.split(".")[-1].strip() for n in found if n not in ("extends", "super", "final", "var")]


def _java_heritage(head: str) -> list[tuple[str, str]]:
    marks = [(m.start(), m.end(), m[1]) for m in re.finditer(r"\b(extends|implements|permits)\b", head) if not _open_angle(head[: m.start()])]
    out = []
    for (_, begin, word), end in zip(marks, [*(m[0] for m in marks[1:]), len(head)], strict=False):
        for part in _split(head[begin:end]) if word != "permits" else []:
            name = re.match(r"[\w$]+(?=\s*(?:<|$))", part)  # a dotted name is no simple type
            if name:
                out.append((name[0], word))
    return out


def java_elements(text: str) -> Iterator[dict]:
    """Classes, interfaces and enums, nested ones too. Types of fields, parameters and results are used; names are
    qualified by the imports, else by the package."""
    s = Source(text)
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", s.clean)
    imports = {i.rsplit(".", 1)[-1]: i for i in re.findall(r"(?m)^\s*import\s+([\w.]+)\s*;", s.clean) if i != "static"}
    qualify = lambda n: imports.get(n) or (f"{package[1]}.{n}" if package else None)
    for m in _JAVA_TYPE.finditer(s.clean):
        body = s.clean.find("{", m.end())
        if body < 0:
            continue
        kind, name, head = m[1], m[2], s.clean[m.end() : body]
        before = re.split(r"[;{}]", s.clean[max(0, m.start() - 2000) : m.start()])[-1]
        members, names = [], []
        for a, b in s.statements(body + 1, s.close.get(body, len(text))) if kind != "enum" else ():
            bare = re.sub(r"@\w[\w.]*(?:\s*\((?:[^()]|\([^()]*\))*\))?", lambda x: " " * len(x[0]), s.clean[a:b])
            marks = " ".join(re.findall(_JAVA_MARKS, bare.split("=")[0].split("(")[0]))
            plain = re.sub(_JAVA_MARKS, lambda x: " " * len(x[0]), bare)
            if re.match(r"\s*(?:@?interface|class|enum|record)\b", plain) or not plain.strip():
                continue
            method = re.match(r"\s*(?:<[^(]*?>\s*)?((?:[\w$.]+(?:\s*<[^(=]*>)?(?:\s*\[\s*\])*)\s+)?([\w$]+)\s*\(", plain)
            if method and "=" not in plain[: method.end()]:
                begin = method.end() - 1
                stop = s.close.get(a + begin, b) - a
                params, returned = s.text[a + begin : a + stop + 1], (method[1] or "").strip()
                if returned:
                    members.append(_member(method[2], "method", f"{method[2]}{params}: {returned}", _visibility(marks)))
                    names += _java_types(returned)
                names += [n for p in _split(plain[begin + 1 : stop]) for n in _java_types(re.sub(r"\s+[\w$]+(?:\s*\[\s*\])*\s*$", "", p.replace("...", " ")))]
                continue
            field = re.match(r"\s*([\w$.]+(?:\s*<[^=;]*>)?(?:\s*\[\s*\])*)\s+([\w$]+)\s*(?=[=,\[]|$)", plain.rstrip())
            if field:
                names += _java_types(field[1])
                if kind == "class":
                    members.append(_member(field[2], "field", f"{field[2]}: {field[1]}", _visibility(marks)))
        refs = _uses(names, _java_heritage(head), JAVA_BUILTINS, qualify) if kind != "enum" else []
        yield _row(name, kind, _visibility(before), members, refs, s.line(m.start() - len(before.lstrip())), qualify(name) if package and name not in imports else f"{package[1]}.{name}" if package else None)


# --- TypeScript ----------------------------------------------------------------------------------
def _ts_types(text: str) -> list[str]:
    """Names of a type expression in order: of function and object types none, of dotted ones the last part."""
    text = re.sub(r"\b(?:readonly|keyof|typeof|infer|is|asserts)\b", " ", text)
    if "=>" in text or "{" in text:
        return []
    return [n.split(".")[-1] for n in re.findall(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", text)]


def _after_colon(text: str) -> str:
    """What stands after the first colon outside of brackets, colon included."""
    depth = 0
    for i, c in enumerate(text):
        depth += c in "<([{"
        depth -= c in ")]}" or c == ">" and text[i - 1 : i] != "="
        if c == ":" and not depth:
            return text[i:]
    return ""


def _before_value(text: str) -> str:
    """The text up to an assignment outside of brackets."""
    m = re.search(r"(?<![=!<>])=(?![=>])", text)
    return text[: m.start()] if m else text


_TS_MARKS = re.compile(r"\s*(?:@\w+(?:\([^)]*\))?\s*)*((?:(?:public|private|protected|static|readonly|abstract|async|override|declare|get|set)\s+(?=[\w$#\[*]))*)")


def typescript_elements(text: str) -> Iterator[dict]:
    """Classes, interfaces, type aliases and functions, all public. A parameter of a constructor that states its
    visibility is a field."""
    s = Source(text)
    seen = {"private": "private", "protected": "internal"}
    shown = lambda marks: next((v for k, v in seen.items() if k in marks.split()), "public")
    for m in _TS_TYPE.finditer(s.clean):
        kind, name = m[1], m[2]
        rest = s.clean[m.end() : m.end() + 400].lstrip()
        if kind == "type" and not re.match(r"(?:<[^=]*>\s*)?=", rest) or kind == "function" and rest[:1] not in "(<":
            continue
        if kind in ("type", "function"):
            yield _row(name, kind, "public", [], [], s.line(m.start()))
            continue
        body = s.clean.find("{", m.end())
        if body < 0:
            continue
        members, names = [], []
        for a, b in s.statements(body + 1, s.close.get(body, len(text)), lines=True):
            marks = _TS_MARKS.match(s.clean[a:b])
            at = a + marks.end()
            part = s.clean[at:b]
            method = re.match(r"\*?\s*(#?[\w$]+)\??\s*(?:<[^(]*>)?\s*\(", part)
            if method and method[1] not in ("if", "for", "while", "return"):
                begin = at + method.end() - 1
                stop = s.close.get(begin, b)
                params = _split(s.clean[begin + 1 : stop])
                returned = _squeezed(s.text[stop + 1 : b]) if s.clean[stop + 1 : b].lstrip().startswith(":") else ""
                if method[1] == "constructor":
                    for p in params:
                        field = re.match(r"(?:@\w+(?:\([^)]*\))?\s*)*(public|private|protected)\s+(?:readonly\s+)?([\w$]+)", p)
                        if field:
                            members.append(_member(field[2], "field", field[2] + _after_colon(_before_value(p)).strip(), shown(field[1])))
                members.append(_member(method[1], "method", f"{method[1]}{s.text[begin : stop + 1]}{returned}", shown(marks[1])))
                names += [n for p in params for n in _ts_types(_after_colon(_before_value(p))[1:])] + _ts_types(returned[1:])
                continue
            field = re.match(r"(#?[\w$]+)[?!]?\s*(?=[:=;]|$)", part.rstrip())
            if field:
                kept = _squeezed(_after_colon(_before_value(s.text[at:b]) if "=>" not in part else part))
                members.append(_member(field[1], "field", field[1] + kept, shown(marks[1])))
                names += _ts_types(_after_colon(_before_value(part))[1:])
        heritage = []
        for word, part in _ts_heritage(s.clean[m.end() : body]):
            dotted = re.match(r"[\w$.]+", part)
            if dotted and ("." not in dotted[0] or not (kind == "class" and word == "extends")):
                heritage.append((dotted[0].split(".")[-1], word))
        yield _row(name, kind, "public", members, _uses(names, heritage, TS_BUILTINS), s.line(m.start()))


def _ts_heritage(head: str) -> list[tuple[str, str]]:
    """(extends or implements, type) of the head of a declaration."""
    marks = [(m.start(), m.end(), m[1]) for m in re.finditer(r"\b(extends|implements)\b", head) if not _open_angle(head[: m.start()])]
    return [(word, p) for (_, begin, word), end in zip(marks, [*(m[0] for m in marks[1:]), len(head)], strict=False) for p in _split(head[begin:end])]


# --- C -------------------------------------------------------------------------------------------
def _c_type(text: str) -> str | None:
    """The name of a declaration's type: the tag of a struct, else its last word before the declarator."""
    text = re.sub(_C_MARKS, " ", text)
    tag = re.match(r"\s*(?:struct|union)\s+(\w+)", text)
    if tag:
        return tag[1]
    words = re.findall(r"\w+", text.split("*")[0].split("[")[0])
    if not words:
        return None
    plain = [w for w in words if w in C_BUILTINS]
    return plain[-1] if plain else words[0]


def _c_parts(text: str) -> tuple[str, str] | None:
    """(type as written without marks, name) of a field or parameter."""
    text = re.sub(r"\s+", " ", re.sub(_C_MARKS, " ", text)).strip()
    pointer = re.match(r"(.+?)\(\s*\*\s*(\w+)\s*\)\s*\(", text)  # a pointer to a function
    if pointer:
        return pointer[1].strip(), pointer[2]
    m = re.match(r"((?:struct |union |enum )?\w+(?: (?:int|char|long|short|double|unsigned|signed)\b)*)[ *]*?\**\s*(\w+)\s*(?:\[[^\]]*\]\s*)*(?::\s*\w+\s*)?$", _split(text)[0] if text else "")
    return (m[1], m[2]) if m else None


def c_elements(text: str) -> Iterator[dict]:
    """Structs, typedefs and functions. A definition beats a prototype, and a static definition a public one; static
    is private. Structs contain the types of their fields, functions use those of results and parameters."""
    s = Source(text)
    found: dict[str, tuple[bool, dict]] = {}
    for a, b in _c_statements(s):
        head = s.clean[a:b]
        start = a + len(head) - len(head.lstrip())
        for m in _C_STRUCT.finditer(head):
            if m[1] in found:
                continue
            body = a + m.end() - 1
            members, kinds = [], []
            for x, y in s.statements(body + 1, s.close.get(body, b)):
                parts = _c_parts(s.clean[x:y])
                if parts:
                    members.append(_member(parts[1], "field", f"{parts[1]}: {parts[0]}", None))
                    used = _c_type(s.clean[x:y])
                    if used and used not in C_BUILTINS and (used, "contains") not in kinds:
                        kinds.append((used, "contains"))
            found[m[1]] = (True, _row(m[1], "struct", "public", members, _uses([], kinds, C_BUILTINS), s.line(a + m.start())))
        flat = _flat(s, a, b)
        if re.match(r"\s*typedef\b", flat):
            name = re.search(r"[\w}]\s+(\w+)\s*$", flat)
            if name and "*" not in flat.split("}")[-1] and "(" not in flat and name[1] not in found:
                found[name[1]] = (True, _row(name[1], "typedef", "public", [], [], s.line(start)))
            continue
        function = re.match(r"\s*((?:[A-Za-z_]\w*[\s*]+)+)(\w+)\s*\(", flat)
        if not function or function[2] in _C_WORDS or function[1].split()[0] in (*_C_WORDS, "typedef") or "=" in flat.split("(")[0]:
            continue
        begin = a + function.end() - 1
        stop = s.close.get(begin, b)
        if s.clean[stop + 1 : b].strip():
            continue
        defined, name, static = s.clean[b : b + 1] == "{", function[2], bool(re.search(r"\bstatic\b", function[1]))
        types = [_c_type(function[1])] + [_c_type(p) for p in _split(s.clean[begin + 1 : stop]) if p != "..."]
        row = _row(name, "function", "private" if static else "public", [], _uses([t for t in types if t], [], C_BUILTINS), s.line(start))
        old = found.get(name)
        if not old or defined and (not old[0] or old[1]["visibility"] == "public" and static):
            found[name] = (defined, row)
    for _, row in found.values():
        yield row


def _flat(s: Source, a: int, b: int) -> str:
    """A statement with the bodies in it blanked, so that only its own words are left."""
    out, at = [], a
    while at < b:
        if s.clean[at] == "{":
            stop = min(s.close.get(at, b), b)
            out.append("{" + " " * (stop - at - 1) + ("}" if stop < b else ""))
            at = stop + 1
        else:
            out.append(s.clean[at] if s.clean[at] != "#" else " ")
            at += 1
    return re.sub(r"\{ *\}", lambda m: " " * len(m[0]), "".join(out))


def _c_statements(s: Source) -> Iterator[tuple[int, int]]:
    """Top-level statements: up to a semicolon, with the bodies of types inside, or up to a function's body.
    Preprocessor lines belong to none; blocks of `extern "C"` are looked into."""
    at = begin = 0
    while at < len(s.clean):
        c = s.clean[at]
        if c == "#" and not s.clean[begin:at].strip():
            while True:  # to the end of the line, and on after a backslash
                stop = s.clean.find("\n", at)
                if stop < 0 or not s.clean[at:stop].rstrip().endswith("\\"):
                    break
                at = stop + 1
            at = begin = len(s.clean) if stop < 0 else stop + 1
        elif c == "{":
            head = s.clean[begin:at]
            if re.search(r"\bextern\s*$", head):
                at = begin = at + 1
            elif re.search(r"\)\s*$", head):
                yield begin, at
                at = begin = s.close.get(at, len(s.clean)) + 1
            else:
                at = s.close.get(at, len(s.clean)) + 1
        elif c in "([":
            at = s.close.get(at, len(s.clean)) + 1
        elif c == ";":
            if s.clean[begin:at].strip():
                yield begin, at
            at = begin = at + 1
        else:
            at += 1
            if c == "}":
                begin = at


# --- tables --------------------------------------------------------------------------------------
PARSERS = {"python": python_elements, "java": java_elements, "typescript": typescript_elements, "c": c_elements}


def elements(files: DataFrame) -> DataFrame:
    """files: project, module, rel, language, content -> one row per element, or one with the error of a file.

    A null or empty file and one of another language has no elements."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                head = {k: r[k] for k in ("project", "module", "rel", "language")}
                if not r["content"] or r["language"] not in PARSERS:
                    continue
                try:
                    out += [head | e | {"error": None} for e in PARSERS[r["language"]](r["content"])]
                except Exception as x:  # noqa: BLE001  whatever a file does to its parser, the others go on
                    out.append(head | dict.fromkeys(("name", "kind", "qualified_name", "visibility", "members", "refs", "line")) | {"error": f"{type(x).__name__}: {x}"})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.select("project", "module", "rel", "language", "content").mapInArrow(run, SCHEMA)


def failures(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """language, files, failed, systemic: a language of which every file fails has a broken parser, not broken files."""
    bad = parsed.where("error IS NOT NULL").select("project", "rel").distinct().withColumn("bad", F.lit(1))
    counts = files.join(bad, ["project", "rel"], "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"))
    return counts.withColumn("systemic", F.col("files") == F.col("failed"))


def merged_c(parsed: DataFrame) -> DataFrame:
    """Elements with those of a C module merged across its files: a public name counts once, from a .c file before a
    header, else from the first file; static ones count by file."""
    key = F.when((F.col("language") == "c") & (F.col("visibility") != "private"), F.lit("")).otherwise(F.col("rel"))
    rows = parsed.where("error IS NULL").withColumn("_key", key)
    order = Window.partitionBy("project", "module", "_key", "language", "name").orderBy(F.col("rel").endswith(".h"), "rel", "line", "kind")
    first = rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1 OR language <> 'c'")
    return first.drop("_key", "_rn")


_MEMBER = pa.struct([(c, pa.string()) for c in ("name", "kind", "signature", "visibility")])
_REFERENCE = pa.struct([(c, pa.string()) for c in ("name", "qualified_name", "kind")])
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("project", "module", "rel", "language", "name", "kind", "qualified_name", "visibility")]
    + [("members", pa.list_(_MEMBER)), ("refs", pa.list_(_REFERENCE)), ("line", pa.int32()), ("error", pa.string())]
)

"""Readers of model files and diagrams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.keys import joined_by
from .store import stored

_S = T.StringType()
_text = lambda *names: [T.StructField(c, _S) for c in names]
_MEMBER = T.StructType(_text("name", "kind", "signature", "visibility"))
MODEL = {
    "system": T.StructType(_text("name", "description")),
    "actors": T.StructType(_text("id", "name", "description")),
    "external_systems": T.StructType([*_text("id", "name", "description", "technology"), T.StructField("tags", T.ArrayType(_S))]),
    "containers": T.StructType(_text("id", "application_id", "name", "description", "technology", "path")),
    "components": T.StructType([*_text("id", "container_id", "name", "description", "technology"), T.StructField("module_ids", T.ArrayType(_S))]),
    "relationships": T.StructType(_text("source_id", "target_id", "label", "technology")),
    "code_elements": T.StructType(
        [*_text("id", "component_id", "container_id", "name", "qualified_name", "language", "visibility", "kind", "signature"), T.StructField("tags", T.ArrayType(_S)), T.StructField("members", T.ArrayType(_MEMBER))]
    ),
    "code_relationships": T.StructType(_text("source_id", "target_id", "target_name", "kind", "label")),
}
# What a row of each collection must state, and the kinds of code elements and links.
REQUIRED = {
    "system": ("name",),
    "actors": ("id", "name"),
    "external_systems": ("id", "name"),
    "containers": ("id", "application_id", "name"),
    "components": ("id", "container_id", "name"),
    "relationships": ("source_id", "target_id", "label"),
    "code_elements": ("id", "component_id", "container_id", "kind", "name"),
    "code_relationships": ("source_id", "target_id", "kind"),
}
CONTAINER_KINDS = frozenset("class interface enum struct".split())
SYMBOL_KINDS = frozenset("type typedef function".split())
LINK_KINDS = frozenset("inherits implements uses contains".split())


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def _snake(name: str) -> str:
    return re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name)


def _faults(name: str, row: dict) -> Iterator[str]:
    """What is wrong with a row's fields."""
    if unknown := sorted(set(row) - set(MODEL[name].fieldNames())):
        yield f"unknown fields {unknown}"
    if missing := [c for c in REQUIRED[name] if row.get(c) is None]:
        yield f"lacks {missing}"


def _kind_faults(name: str, row: dict) -> Iterator[str]:
    """What is wrong with the kind of a code element or link."""
    kind = row.get("kind")
    if kind not in {"code_elements": CONTAINER_KINDS | SYMBOL_KINDS, "code_relationships": LINK_KINDS}.get(name, {kind}):
        yield f"unknown kind {kind}"
    elif name == "code_elements" and row.get("members" if kind in SYMBOL_KINDS else "signature") is not None:
        yield f"a {kind} has no {'members' if kind in SYMBOL_KINDS else 'signature'}"


def _problems(rows: dict[str, list[dict]]) -> Iterator[str]:
    """What is wrong with a model's rows, in order."""
    for name, found in rows.items():
        known = set(MODEL[name].fieldNames())
        first: dict[str, int] = {}
        for i, row in enumerate(found):
            yield from (f"{name}[{i}]: {fault}" for fault in _faults(name, row))
            if "id" in known and row.get("id") is not None:
                if row["id"] in first:
                    yield f"{name}[{i}]: id {row['id']} is taken by {name}[{first[row['id']]}]"
                first.setdefault(row["id"], i)
    home = {r.get("id"): r.get("container_id") for r in rows["components"]}
    for i, e in enumerate(rows["code_elements"]):
        if e.get("component_id") not in home:
            yield f"code_elements[{i}]: unknown component {e.get('component_id')}"
        elif home[e["component_id"]] != e.get("container_id"):
            yield f"code_elements[{i}]: component {e['component_id']} is not in container {e.get('container_id')}"
        yield from (f"code_elements[{i}]: {fault}" for fault in _kind_faults("code_elements", e))
    ids = {e.get("id") for e in rows["code_elements"]}
    for i, r in enumerate(rows["code_relationships"]):
        for end in ("source_id", "target_id"):
            if r.get(end) not in ids:
                yield f"code_relationships[{i}]: unknown {end} {r.get(end)}"
        yield from (f"code_relationships[{i}]: {fault}" for fault in _kind_faults("code_relationships", r))


def _named(row: dict) -> dict:
    """A row of the model file under the names of columns."""
    return {_snake(k): [{_snake(x): y for x, y in m.items()} for m in v] if k == "members" and v is not None else v for k, v in row.items()}


def load_model(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The collections of a model in YAML, code elements and links among them. Missing collections are empty. Unknown
    keys and rows that break the model's rules are an error that names all of them."""
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("the model is no mapping")
    known = {_camel(c) for c in MODEL} | {"version"}
    if unknown := set(data) - known:
        raise ValueError(f"unknown keys in the model: {sorted(unknown)}")
    rows = {}
    for name in MODEL:
        found = data.get(_camel(name)) or []
        found = [found] if isinstance(found, dict) else found
        rows[name] = [_named(r) for r in found]
    if problems := list(_problems(rows)):
        raise ValueError("the model is invalid:\n" + "\n".join(problems))
    out = {}
    for name, schema in MODEL.items():
        values = [tuple([tuple(m.get(c) for c in _MEMBER.fieldNames()) for m in r["members"]] if f.name == "members" and r.get("members") is not None else r.get(f.name) for f in schema) for r in rows[name]]
        out[name] = spark.createDataFrame(values, schema)
    return out


def dump_model(collections: dict[str, DataFrame]) -> str:
    """A small model as YAML text on the driver; `dump_pieces` writes one of any size. Empty code collections are left out."""
    data: dict = {"version": 1}
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else {_camel(k): plain(x) for k, x in v.asDict().items() if x is not None} if isinstance(v, Row) else v
    for name, df in collections.items():
        rows = [plain(r) for r in df.collect()]
        if name == "system":
            data["system"] = rows[0] if rows else None
        elif rows or not name.startswith("code_"):
            data[_camel(name)] = rows
    return yaml.safe_dump({k: v for k, v in data.items() if v is not None}, sort_keys=False, allow_unicode=True)


# A model of any size: its text in pieces, the head of a collection or an item each, that tasks write and read alike.
_SECTIONS = {2 * i + 2: name for i, name in enumerate(MODEL)}
_LOADED = T.StructType([T.StructField("problems", T.ArrayType(_S)), *(T.StructField(name, schema) for name, schema in MODEL.items())])
_DUMPER, _LOADER = getattr(yaml, "CSafeDumper", yaml.SafeDumper), getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_PIECE = [("section", pa.int32()), ("k", pa.string()), ("line", pa.string())]
SHOWN = 100


def _plain(v):
    if isinstance(v, dict):
        return {_camel(k): _plain(x) for k, x in v.items() if x is not None}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _texts(v):
    """Values of an item as columns hold them: all are text."""
    if isinstance(v, dict):
        return {k: _texts(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_texts(x) for x in v]
    return v if v is None or isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def dump_pieces(collections: dict[str, DataFrame]) -> DataFrame:
    """section, k, line: the pieces of a model's YAML text, which is their lines in this order (see `render.joined`). A
    collection's items are in the order of their ids; an empty one is a key without a value."""
    spark = next(iter(collections.values())).sparkSession
    heads, parts = [(0, "", "version: 1")], []
    for section, name in _SECTIONS.items():
        if name not in collections:
            continue
        df = collections[name]
        if name == "system":
            df = df.limit(1)
        else:
            heads.append((section - 1, "", f"{_camel(name)}:"))

        def run(batches, section=section, name=name):
            for batch in batches:
                found = batch.to_pylist()
                items = [{"system": _plain(r)} if name == "system" else [_plain(r)] for r in found]
                lines = [yaml.dump(x, Dumper=_DUMPER, sort_keys=False, allow_unicode=True).rstrip("\n") for x in items]
                yield pa.RecordBatch.from_pydict({"section": [section] * len(found), "k": [r.get("id") or "" for r in found], "line": lines}, schema=pa.schema(_PIECE))

        parts.append(df.mapInArrow(run, "section int, k string, line string"))
    out = spark.createDataFrame(heads, "section int, k string, line string")
    for part in parts:
        out = out.unionByName(part)
    return out



def _parsed(pieces: DataFrame) -> DataFrame:
    """problems and the item's row in the column of its collection; the others are null."""

    def run(batches):
        schema = to_arrow_schema(_LOADED)
        for batch in batches:
            rows = []
            for piece in batch.to_pylist():
                name = _SECTIONS[piece["section"]]
                item = yaml.load(piece["line"], Loader=_LOADER)
                item = item[name] if name == "system" else item[0]
                if not isinstance(item, dict):
                    rows.append({"problems": [f"{name} {piece['k']}: no mapping"]})
                    continue
                row = _named(item)
                problems = [f"{name} {piece['k']}: {fault}" for fault in (*_faults(name, row), *_kind_faults(name, row))]
                rows.append({"problems": problems, name: _texts(row)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pieces.where(F.col("section").isin(*_SECTIONS)).select("section", "k", "line").mapInArrow(run, _LOADED)


def _invalid(rows: DataFrame, loaded: dict[str, DataFrame]) -> DataFrame:
    """problem: what is wrong with the items of a model, by themselves and together."""
    said = lambda df, *parts: df.select(F.concat(*(F.coalesce(p, F.lit("None")) for p in parts)).alias("problem"))
    c, lit = F.col, F.lit
    out = rows.select(F.explode("problems").alias("problem"))
    ids = [df.where("id IS NOT NULL").select(lit(name).alias("name"), "id") for name, df in loaded.items() if "id" in df.columns]
    taken = ids[0]
    for more in ids[1:]:
        taken = taken.unionByName(more)
    taken = taken.groupBy("name", "id").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(said(taken, c("name"), lit(" "), c("id"), lit(": id is taken by "), c("n").cast("string"), lit(" items")))
    # The smallest container of an id that is taken twice, which is a problem already.
    home = loaded["components"].groupBy(c("id").alias("component_id")).agg(F.min("container_id").alias("home"), lit(True).alias("known"))
    elements = joined_by(loaded["code_elements"].select("id", "component_id", "container_id"), home, ["component_id"], "left")
    elsewhere = elements.where(c("known") & ~c("home").eqNullSafe(c("container_id")))
    named = lit("code_elements "), c("id")
    out = out.unionByName(said(elements.where("known IS NULL"), *named, lit(": unknown component "), c("component_id")))
    out = out.unionByName(said(elsewhere, *named, lit(": component "), c("component_id"), lit(" is not in container "), c("container_id")))
    known = loaded["code_elements"].select("id").distinct()
    for end in ("source_id", "target_id"):
        lost = joined_by(loaded["code_relationships"].select("source_id", "target_id"), known.withColumnRenamed("id", end), [end], "left_anti")
        out = out.unionByName(said(lost, lit("code_relationships "), c("source_id"), lit(" -> "), c("target_id"), lit(f": unknown {end} "), c(end)))
    return out


def load_pieces(pieces: DataFrame) -> dict[str, DataFrame]:
    """The collections of a model from the pieces of its text: each piece is read once, by the task that has it. The
    rules are `load_model`'s; items are named by their ids, and the error shows the first hundred problems."""
    rows = stored(_parsed(pieces), "model")
    loaded = {name: rows.where(F.col(name).isNotNull()).select(f"{name}.*") for name in MODEL}
    problems = [r.problem for r in _invalid(rows, loaded).orderBy("problem").limit(SHOWN + 1).collect()]
    if problems:
        raise ValueError("the model is invalid:\n" + "\n".join([*problems[:SHOWN], *["and more"][: len(problems) > SHOWN]]))
    return loaded


_CELL = [(c, pa.string()) for c in ("file", "id", "value", "tooltip", "style", "parent", "source", "target")]
_CELL += [("is_edge", pa.bool_()), *((c, pa.float64()) for c in ("x", "y", "width", "height")), ("points", pa.string()), ("managed", pa.bool_()), ("error", pa.string())]


def _cells_of(file: str, content: str) -> Iterator[dict]:
    """The cells of a diagram. A wrapper gives its cell the id, the label and a tooltip, and wins over a plain cell
    of the same id."""
    found: dict[str, tuple[int, dict]] = {}
    for parent in ElementTree.fromstring(content).iter():
        for cell in parent:
            if cell.tag != "mxCell":
                continue
            wrapped = parent.tag == "UserObject"
            head = parent if wrapped else cell
            name, style = head.get("id"), cell.get("style")
            if not name or (name in found and (found[name][0] or not wrapped)):
                continue
            box = cell.find("mxGeometry")
            number = lambda k, box=box: float(box.get(k)) if box is not None and box.get(k) not in (None, "") else None
            points = [f"{p.get('x')},{p.get('y')}" for p in box.iterfind("Array[@as='points']/mxPoint")] if box is not None else []
            row = {"file": file, "id": name, "value": head.get("label" if wrapped else "value"), "tooltip": head.get("tooltip"), "style": style, "parent": cell.get("parent"), "source": cell.get("source"), "target": cell.get("target")}
            row |= {"is_edge": cell.get("edge") == "1", "x": number("x"), "y": number("y"), "width": number("width"), "height": number("height"), "points": " ".join(points) or None}
            managed = "managed=1" in (style or "").split(";") or head.get("managed") == "1" or cell.get("managed") == "1"
            found[name] = (int(wrapped), row | {"managed": managed, "error": None})
    for _, row in found.values():
        yield row


def diagram_cells(files: DataFrame) -> DataFrame:
    """file, content (diagram XML) -> file, id, value, tooltip, style, parent, source, target, is_edge, x, y, width,
    height, points, managed, error. Null and empty files have no cells; one that isn't XML gives a row with its error."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    rows += _cells_of(r["file"], r["content"]) if r["content"] else []
                except (ElementTree.ParseError, ValueError) as x:
                    rows.append({"file": r["file"], "error": f"{type(x).__name__}: {x}"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_CELL))

    kinds = {pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
    return files.select("file", "content").mapInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in _CELL))

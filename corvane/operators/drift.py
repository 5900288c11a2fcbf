"""References of diagrams that the model no longer knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names at the end of a reference that are properties, and names that every diagram knows.
PROPERTIES = (
    "class shape label style icon tooltip link near width height top left grid-rows grid-columns grid-gap vertical-gap horizontal-gap font-size font-color fill stroke stroke-width stroke-dash "
    "border-radius opacity shadow 3d multiple animated bold italic underline text-transform source-arrowhead target-arrowhead"
).split()
KEYWORDS = ("direction", "classes")
IMPORT = "...@"


def _pattern(code: bool) -> str:
    return "[A-Za-z0-9_][A-Za-z0-9_.-]*" if code else "[a-z0-9][a-z0-9.-]*"


def _without_properties(ref: Column) -> Column:
    """The reference without the property names at its end; empty, if nothing else is left."""
    parts = F.split(ref, r"\.")
    last = F.array_max(F.transform(parts, lambda p, i: F.when(~p.isin(*PROPERTIES), i + 1).otherwise(0)))
    return F.array_join(F.slice(parts, 1, last), ".")


def references(lines: DataFrame, code: bool = False) -> DataFrame:
    """file, line, text -> file, line, ref: the ends of connections, and names that lines begin with, after a file's
    last import. Comments and blank lines have none; property names at the end are cut."""
    bare = lines.select("file", "line", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))
    imports = bare.where(F.startswith("text", F.lit(IMPORT))).groupBy("file").agg(F.max("line").alias("last"))
    rows = bare.join(imports, "file", "left").where("line > coalesce(last, 0) AND text <> '' AND text NOT LIKE '#%'")
    name = _pattern(code)
    pair = rf"^({name})\s*->\s*({name})"
    found = F.when(F.col("text").rlike(pair), F.array(F.regexp_extract("text", pair, 1), F.regexp_extract("text", pair, 2))).otherwise(F.array(F.regexp_extract("text", f"^({name})", 1)))
    rows = rows.select("file", "line", F.explode(found).alias("raw")).where("raw <> ''")
    return rows.select("file", "line", _without_properties(F.col("raw")).alias("ref")).where("ref <> ''")


def text_drift(lines: DataFrame, known: DataFrame, code: bool = False) -> DataFrame:
    """file, line, ref of references of which neither the whole nor a dotted prefix is known (id). Code names are
    compared without regard to case. Prefixes are exploded, so the join is on equal keys."""
    refs = references(lines, code).distinct()
    seen = F.lower("ref") if code else F.col("ref")
    parts = F.split(seen, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    ids = known.select((F.lower("id") if code else F.col("id")).alias("id")).distinct()
    ids = reduce(DataFrame.unionByName, [ids, *(known.sparkSession.range(1).select(F.lit(k).alias("id")) for k in KEYWORDS)]).distinct()
    good = refs.select("file", "line", "ref", F.explode(prefixes).alias("id")).join(ids, "id", "left_semi").select("file", "line", "ref").distinct()
    return refs.join(good, ["file", "line", "ref"], "left_anti")


def cell_drift(cells: DataFrame, known: DataFrame) -> DataFrame:
    """file, cell, ref, severity: ends of edges that are neither known (id) nor a cell of the file that isn't managed.
    Files that couldn't be read (error) are errors of their own."""
    edges = cells.where("is_edge").select("file", F.col("id").alias("cell"), F.explode(F.array("source", "target")).alias("ref")).where("ref <> ''")
    free = cells.where("NOT managed").select("file", F.col("id").alias("ref")).distinct()
    rows = edges.join(known.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").join(free, ["file", "ref"], "left_anti")
    out = rows.select("file", "cell", "ref", F.lit("warning").alias("severity"))
    if "error" in cells.columns:
        none = F.lit(None).cast("string")
        out = out.unionByName(cells.where("error IS NOT NULL").select("file", none.alias("cell"), none.alias("ref"), F.lit("error").alias("severity")))
    return out

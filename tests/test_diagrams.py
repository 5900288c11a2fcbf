"""Geometry, changes by group, analyzers as plug-ins, ordinals, warnings and isolation: against brute force and stated results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import build, geometry, groups, model, projection
from corvane.sources import analyzers, elements, project

# --- geometry ------------------------------------------------------------------------------------


def middle(points):
    """Walk half of the way."""
    if not points:
        return None
    lengths = [math.dist(a, b) for a, b in zip(points[:-1], points[1:], strict=True)]
    left = sum(lengths) / 2
    for (x, y), (u, v), d in zip(points[:-1], points[1:], lengths, strict=True):
        if left <= d:
            t = left / d if d else 0
            return (x + t * (u - x), y + t * (v - y))
        left -= d
    return points[-1]


def test_midpoints_equal_a_walk(spark):
    rng = random.Random(4)
    lines = [[], [(1.0, 2.0)], [(1.0, 1.0)] * 3, [(0.0, 0.0), (0.0, 0.0), (4.0, 0.0)], [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]]
    lines += [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([*enumerate(lines), (999, None)], "id int, points array<struct<x:double,y:double>>")
    found = {r.id: r.m for r in df.select("id", geometry.midpoint(F.col("points")).alias("m")).collect()}
    assert found.pop(999) is None
    for i, line in enumerate(lines):
        want = middle(line)
        assert (found[i] is None) == (want is None) and (want is None or found[i] == pytest.approx(want))


def test_label_bounds_and_offsets(spark):
    row = spark.createDataFrame([("ab<br>cdef\nx", [(0.0, 0.0), (10.0, 0.0)]), ("y" * 99, [(0.0, 0.0)]), (None, [])], "t string, p array<struct<x:double,y:double>>")
    at = lambda x: F.lit(float(x))
    found = row.select(geometry.label_bounds(F.col("t")).alias("b"), geometry.label_offset(F.col("p"), at(4), at(-1), at(4), at(2)).alias("near"), geometry.label_offset(F.col("p"), at(-1.5), at(0), at(0), at(0)).alias("o"), geometry.label_offset(F.col("p"), at("nan"), at(0), at(0), at(0)).alias("nan")).collect()
    assert [tuple(r.b) for r in found] == [(36, 54), (240, 18), (8, 18)]
    assert found[0].near is None and tuple(found[0].o) == (-6, 0) and tuple(found[1].near) == (6, 0) and found[2].o is None
    assert all(r.nan is None for r in found)


# --- changes by group ----------------------------------------------------------------------------
def test_groups_are_taken_whole_or_not_at_all(spark):
    rel = spark.createDataFrame([("a", "b", "old", "T"), ("b", "c", "old", None), ("c", "a", "old", "T")], "source string, target string, label string, technology string")
    el = "group string, id string, component_id string, container_id string, kind string, members array<string>, signature string"
    anchor = spark.createDataFrame([(g, "e", "a", "C", "function", None, "old()") for g in ("good", "twice", "lost", "shape", "owner", "quiet")], el)
    up = [("good", "a", "b", "new", "", 1), ("twice", "b", "c", "x", "", 1), ("twice", "b", "c", "y", "", 2), ("lost", "b", "c", "new", "", 1), ("lost", "b", "ghost", "new", "", 1), ("shape", "c", "a", "new", "", 1), ("quiet", "c", "a", "", "New", 1)]
    updates = spark.createDataFrame(up, "group string, source string, target string, new_label string, new_technology string, ord int")
    new = [("good", "e", "a", "C", "function", None, "new()"), ("good", "f", "b", "C", "class", ["m"], None), ("shape", "e", "a", "C", "class", None, "x"), ("owner", "e", "zz", "C", "function", None, "n()"), ("lost", "e", "a", "C", "function", None, "new()")]
    parts = spark.createDataFrame([("a", "C"), ("b", "C"), ("c", "D")], "component_id string, container_id string")
    out = groups.all_or_nothing(rel, anchor, updates, spark.createDataFrame(new, el), parts, parts.select(F.col("component_id").alias("id")))
    verdicts = {r.group: (r.taken, list(r.problems)) for r in out.verdicts.collect()}
    assert verdicts == {"good": (True, []), "quiet": (True, []), "twice": (False, ["updated twice: b -> c"]), "lost": (False, ["unknown target: ghost"]), "shape": (False, ["wrong shape: e"]), "owner": (False, ["unknown component: e"])}
    assert {tuple(r) for r in out.relationships.collect()} == {("a", "b", "new", "T"), ("b", "c", "old", None), ("c", "a", "old", "New")}
    assert {(r.group, r.id, r.signature) for r in out.elements.collect()} == {("good", "e", "new()"), ("good", "f", None)} | {(g, "e", "old()") for g in ("twice", "lost", "shape", "owner", "quiet")}


# --- analyzers as plug-ins -----------------------------------------------------------------------
def test_a_fifth_language_needs_no_change_of_the_library(spark):
    def go_functions(text):
        for i, line in enumerate(text.split("\n"), 1):
            if line.startswith("panic"):
                raise MemoryError("too deep")
            if line.startswith("func "):
                yield {"name": line[5:].split("(")[0], "kind": "function", "line": i}

    analyzers.register_own(spark)
    analyzers.register(spark, analyzers.Analyzer("go", ("go.mod", "main.go"), r"[.]go$", go_functions))
    try:
        rows = [("svc/go.mod", ""), ("svc/a.go", "package a\nfunc One() {}\nfunc Two() {}"), ("svc/b.go", "panic"), ("svc/c.py", "def no(): pass"), ("py/pyproject.toml", ""), ("py/main.go", ""), ("py/m.py", "def yes(): pass"), ("svc/empty.go", None)]
        files = spark.createDataFrame(rows, "path string, content string")
        projects = analyzers.discover(files)
        assert {tuple(r) for r in projects.collect()} == {("svc", "go.mod", "go"), ("py", "pyproject.toml", "python")}
        found = analyzers.elements(project.owned_files(files, projects), projects).collect()
        assert {(r.rel, r.name, r.line, r.error) for r in found} == {("a.go", "One", 2, None), ("a.go", "Two", 3, None), ("b.go", None, None, "MemoryError: too deep"), ("m.py", "yes", 1, None)}
        files.where("path LIKE '%.go'").createOrReplaceTempView("go_files")
        sql = spark.sql("SELECT path, e.name FROM go_files, LATERAL analyze_go(content) e WHERE e.error IS NULL")
        assert {tuple(r) for r in sql.collect()} == {("svc/a.go", "One"), ("svc/a.go", "Two")}
    finally:
        analyzers.unregister("go")
    with pytest.raises(ValueError, match="name of a language"):
        analyzers.register(spark, analyzers.Analyzer("C++", (), "", go_functions))


# --- parsers, warnings, ordinals, order ----------------------------------------------------------
def test_one_file_never_ends_the_job(spark):
    odd = "x = " + "-" * 200_000 + "1"
    rows = [("p", "m", "odd.py", "python", odd), ("p", "m", "nul.py", "python", "a\0b"), ("p", "m", "ok.py", "python", "def f(): pass")]
    found = elements.elements(spark.createDataFrame(rows, "project string, module string, rel string, language string, content string")).collect()
    assert {(r.rel, r.name, r.error is not None) for r in found} == {("odd.py", None, True), ("nul.py", None, True), ("ok.py", "f", False)}


def test_code_warns_of_what_it_drops(spark):
    home = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "gone")], "id string, component_id string")
    links = spark.createDataFrame([(s, t, "uses", None) for s, t in (("a", "b"), ("a", "x"), ("x", "a"), ("a", "c"), ("x", "y"))], "source string, target string, kind string, label string")
    known = spark.createDataFrame([("A",), ("B",)], "id string")
    p = projection.code(home, links, known)
    assert {r.warning for r in p.warnings.collect()} == {"L4: unknown source x", "L4 A: unknown target x", "L4 A: target of unknown component c"}
    assert [(r.source, r.target) for r in p.edges.collect()] == [("a", "b")]
    assert {r.warning for r in projection.code(home, links).warnings.collect()} == {"L4: unknown source x", "L4 A: unknown target x"}


def scan(spark):
    table = spark.createDataFrame
    apps = table([(f"app{i}", f"p{i}", f"App {i}", "java", i) for i in (9, 10)], "app_id string, path string, name string, language string, ord int")
    modules = table([(f"app{i}", f"m{i}", f"com.m{i}", "", None, i) for i in (9, 10)], "app_id string, module_id string, name string, annotations string, framework string, ord int")
    imports = table([], "app_id string, module_id string, source string, is_external boolean, resolved string, ord int")
    internal = table([("app9", "app10", 10)], "app_id string, target_app string, ord int")
    deps = table([("app9", "org.postgresql:postgresql", 1)], "app_id string, name string, ord int")
    return build.Scan(apps, modules, imports, internal, deps)


def test_ordinals_keep_their_type(spark):
    """Of two declared systems of one id the one of ordinal 9 counts, also where text would put 10 first."""
    declared = spark.createDataFrame([("Redis", "late", ["app9"], 10), ("redis", "early", ["app9"], 9)], "name string, technology string, used_by array<string>, ord int")
    b = build.Builder(scan(spark), declared, spark.createDataFrame([], "id string, name string, language string"))
    found = {(r.source, r.target): (r.label, r.technology) for r in b.relationships.collect()}
    assert found == {("app9", "app10"): ("Uses", None), ("app9", "redis"): ("Uses redis", "early"), ("app9", "postgresql"): ("Reads/writes data in", "PostgreSQL")}
    assert {r.id: r.technology for r in b.externals.collect()}["redis"] == "early"


def test_phases_of_other_ordinals(spark):
    one = spark.createDataFrame([("a", "b", "x", None, 10), ("a", "b", "y", None, 9)], "source string, target string, label string, technology string, ord int")
    two = spark.createDataFrame([("a", "b", "z", "T", "0"), ("b", "c", "w", "T", "0"), ("c", "c", "w", "T", "0")], "source string, target string, label string, technology string, ord string")
    assert {tuple(r) for r in model.derive_relationships([one, two]).collect()} == {("a", "b", "y", None), ("b", "c", "w", "T")}


def test_order_of_the_locale(spark):
    names = ["b", "A", "a", "B", "ä", "az", "Äz", "Z", "z", "éa", "eb", "E"]
    found = projection.in_order(spark.createDataFrame([(1, n) for n in names], "g int, name string"), ["g"], "name").orderBy("position").collect()
    assert [r.name for r in found] == ["a", "A", "ä", "az", "Äz", "b", "B", "E", "éa", "eb", "z", "Z"] and {r.first for r in found} == {"a"}
    df = spark.createDataFrame([("Ängel",), ("angel",), ("other",)], "name string")
    assert {tuple(r) for r in projection.same_letters(df, df, "name").collect()} == {("Ängel", "angel"), ("angel", "Ängel")}


def test_externals_come_in_order(spark):
    rows = spark.createDataFrame([("c", "A"), ("a", "B"), ("b", "A")], "id string, name string")
    assert [r.id for r in model.ordered_externals(rows).collect()] == ["b", "c", "a"]

"""Written trees of files, hierarchies and globs, against brute force."""

from __future__ import annotations

import fnmatch
import random
import re
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import globs
from corvane.operators import hierarchy, outputs
from corvane.sources import files, project


# --- files ---------------------------------------------------------------------------------------
def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file()}


def nothing_but(root, wanted):
    """No other file is in place, nor staged once all tasks have ended; the mark of a failed job goes last."""
    assert {p: c for p, c in tree(root).items() if not p.startswith(files.STAGING)} == wanted
    for _ in range(50):
        if all(p.endswith(files._ABORTED) for p in tree(root) if p.startswith(files.STAGING)):
            break
        time.sleep(0.2)
    files.recover(str(root))
    assert tree(root) == wanted


def rows(spark, *r):
    return spark.createDataFrame([(*x, None)[:3] for x in r], "path string, content string, once boolean")


def test_files_are_written_where_they_differ(spark, tmp_path):
    files.write_tree(rows(spark, ("a/b.txt", "one"), ("c.txt", "é"), ("own.txt", "first", True), ("empty", None)), str(tmp_path))
    assert tree(tmp_path) == {"a/b.txt": "one", "c.txt": "é", "own.txt": "first", "empty": ""}
    (tmp_path / "own.txt").write_text("mine")
    before = {p: (tmp_path / p).stat().st_mtime_ns for p in tree(tmp_path)}
    files.write_tree(rows(spark, ("a/b.txt", "two"), ("c.txt", "é"), ("own.txt", "second", True), ("empty", "")), f"file://{tmp_path}")
    assert tree(tmp_path) == {"a/b.txt": "two", "c.txt": "é", "own.txt": "mine", "empty": ""}
    assert {p for p, t in before.items() if (tmp_path / p).stat().st_mtime_ns != t} == {"a/b.txt"}
    back = files.read_files(spark, str(tmp_path)).collect()
    assert {r.path: r.content for r in back} == tree(tmp_path)
    few = spark.read.format(files.FORMAT).option("mostBytes", 1).load(str(tmp_path))
    assert few.rdd.getNumPartitions() == 4 and few.count() == 4


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    files.write_tree(rows(spark, ("a", "old")), str(tmp_path))
    many = spark.range(0, 40, 1, 8).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise("new").alias("content"))
    many = many.unionByName(rows(spark, ("a", "new")).drop("once"))
    with pytest.raises(Exception, match="lost"):
        spark.dataSource.register(files.FileTree)
        many.write.format(files.FORMAT).mode("append").save(str(tmp_path))
    nothing_but(tmp_path, {"a": "old"})


@pytest.mark.parametrize("path", ["/etc/x", "../x", "a/../../x", "a//b", "_staging/x", "", None, "."])
def test_paths_stay_below_the_root(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a path"):
        files.write_tree(rows(spark, ("good", "x"), (path, "y")), str(tmp_path / "root"))
    nothing_but(tmp_path / "root", {})


def test_a_path_comes_once(spark, tmp_path):
    with pytest.raises(ValueError, match="two files"):
        files.write_tree(rows(spark, ("a", "x"), ("a", "y")), str(tmp_path))


def test_interrupted_jobs_are_finished_or_cleared(tmp_path):
    for job, committed in (("one", True), ("two", False)):
        attempt = tmp_path / files.STAGING / job / "t"
        attempt.mkdir(parents=True)
        (attempt / "1").write_text(job)
        (attempt / files._MANIFEST).write_text(f'["0", "done"]\n["1", "sub/{job}"]')
        if committed:
            (attempt.parent / files._COMMITTED).write_text("t")
    (tmp_path / "done").write_text("moved before")
    files.recover(str(tmp_path))
    assert tree(tmp_path) == {"done": "moved before", "sub/one": "one"}


def test_submodule_files_of_few(spark):
    homes = spark.createDataFrame([("a", "A", "apps/a")], "id string, name string, path string")
    diagrams = spark.createDataFrame([("a", "d")], "container_id string, diagram string")
    parts = spark.createDataFrame([("a", "p")], "container_id string, content string")
    code = spark.createDataFrame([("a", "x", "X", "cx", 2), ("a", "y", "Y", "cy", 1)], "container_id string, component_id string, name string, diagram string, n long")
    found = {r.path: r for r in outputs.submodule_files(homes, diagrams, parts, "s", "own.yaml", "apps/docs", code, 2, "doc").collect()}
    below = "apps/a/doc/architecture/"
    assert set(found) == {"apps/a/own.yaml", *(below + n for n in ("_generated/c3-component.d2", "styles.d2", "c3-component.d2", "architecture-model.yaml", "components/x/_generated/c4-code.d2", "components/x/c4-code.d2"))}
    assert "../../../docs/c2-container.svg" in found[below + "c3-component.d2"].content
    assert {p.removeprefix(below) for p, r in found.items() if r.once} == {"apps/a/own.yaml", "c3-component.d2", "components/x/c4-code.d2"}


# --- hierarchies ---------------------------------------------------------------------------------
def brute_owner(parent, a, b):
    def up(n):
        out = []
        while n is not None and n not in out:
            out.append(n)
            n = parent.get(n)
        return out, n is not None

    known = set(parent) | {p for p in parent.values() if p is not None}
    if a not in known or b not in known:
        return None, "unknown"
    (x, xc), (y, yc) = up(a), up(b)
    if xc or yc:
        return None, "cycle"
    common = [n for n in x if n in y]
    return (common[0], "found") if common else (None, "apart")


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    parent = {i: i - 1 if i % 40 else (rng.randrange(i) if i else None) for i in range(120)}
    parent |= {200: 201, 201: 200, 202: 201, 203: 203, 300: 301}
    df = spark.createDataFrame([*parent.items(), (None, 5)], "node long, parent long")
    t = hierarchy.hierarchy(df)
    nodes = [*range(0, 120, 7), 119, 39, 200, 202, 203, 300, 301, 999]
    pairs = [(a, b) for a in nodes for b in nodes]
    found = hierarchy.lowest_common_ancestors(spark.createDataFrame(pairs, "a long, b long"), t).collect()
    assert {(r.a, r.b): (r.owner, r.status) for r in found} == {p: brute_owner(parent, *p) for p in pairs} and len(found) == len(pairs)
    assert {r.node for r in t.cyclic.collect()} == {200, 201, 202, 203}


def test_hierarchy_of_little(spark):
    empty = spark.createDataFrame([], "node string, parent string")
    t = hierarchy.hierarchy(empty)
    assert t.nodes.count() == 0 and not t.jumps
    roots = hierarchy.hierarchy(spark.createDataFrame([("a", None), ("b", None)], "node string, parent string"))
    found = hierarchy.lowest_common_ancestors(spark.createDataFrame([("a", "a"), ("a", "b")], "a string, b string"), roots).collect()
    assert {(r.a, r.b, r.owner, r.status) for r in found} == {("a", "a", "a", "found"), ("a", "b", None, "apart")}


# --- globs ---------------------------------------------------------------------------------------
def matched(pattern, path, dot=False):
    """Segment by segment, by backtracking."""

    def segments(ps, ss):
        if not ps:
            return not ss
        if ps[0] == "**":
            hidden = bool(ss) and ss[0].startswith(".") and not dot
            if len(ps) == 1:
                return all(dot or not s.startswith(".") for s in ss)
            return segments(ps[1:], ss) or (bool(ss) and not hidden and segments(ps, ss[1:]))
        if not ss or (ss[0].startswith(".") and not dot and ps[0][0] in "*?["):
            return False
        return fnmatch.fnmatchcase(ss[0], ps[0]) and segments(ps[1:], ss[1:])

    parts = [p for p in pattern.split("/") if p]
    return bool(path) and segments(parts, path.split("/"))


PIECES = st.sampled_from(["a", "b", "ab", "*", "?", "a*", "*b", "[ab]", "[!a]", "**", ".a", "?b", "*a*"])


@settings(deadline=None, max_examples=600)
@given(st.lists(PIECES, min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "ab", "aab", ".a", ".ab", "ba"]), min_size=1, max_size=4), st.booleans())
def test_globs_equal_backtracking(pattern, path, dot):
    glob, text = "/".join(pattern), "/".join(path)
    assert (re.match(globs.compiled(glob, dot), text) is not None) == matched(glob, text, dot), (glob, text)


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("src/**", ["src/a", "src/a/b.py", "src"], ["src/.git/a", "srcs/a", "a/src/b"]),
        ("**/node_modules/**", ["node_modules/x", "a/b/node_modules/c/d"], ["a/node_module/x"]),
        ("*.{js,ts}", ["a.js", "b.ts"], ["a/b.ts", "a.tsx", ".a.js"]),
        ("a{1..3}/x", ["a1/x", "a3/x"], ["a4/x"]),
        ("a{b,c{d,e}}f", ["abf", "acdf", "acef"], ["af", "acf"]),
        ("a{b}", ["a{b}"], ["ab"]),
        ("a{b,c", ["a{b,c"], ["ab"]),
        ("!(a|b).py", ["c.py", "ab.py", "aa.py"], ["a.py", "b.py", ".c.py"]),
        ("@(a|b)+(c)?(d)", ["ac", "bccd"], ["a", "cd"]),
        ("*(a|b)x", ["x", "abax"], ["acx"]),
        ("[[]x", ["[x"], ["x"]),
        ("[x", ["[x"], ["x"]),
        ("a\\*", ["a*"], ["ab"]),
        ("a.b+c(d)$", ["a.b+c(d)$"], ["aXb+c(d)$"]),
        ("./a//b", ["a/b"], ["a"]),
        ("[!a-c]&[&-]", ["d&&", "e&-"], ["a&&"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    for path, want in [*((y, True) for y in yes), *((n, False) for n in no)]:
        assert (re.match(globs.compiled(pattern), path) is not None) is want, (pattern, path, globs.compiled(pattern))
    found = spark.createDataFrame([(p,) for p in yes + no], "path string").where(globs.matches("path", [pattern])).collect()
    assert {r.path for r in found} == set(yes)


def test_fixed_prefixes():
    assert [globs.fixed_prefix(p) for p in ("a/b/*.py", "**/x", "a/b", "./a/{b,c}/d", "a\\*/b/c", "x")] == ["a/b", "", "a", "a", "", ""]
    assert globs.prefixes(["a/*", "a/b/*", "c/d/**"]) == ["a", "c/d"] and globs.prefixes(["a/*", "*"]) == [""]


def test_only_folders_of_globs_are_listed(spark, tmp_path):
    for p in ("a/x/m.py", "a/y/n.txt", "b/z/o.py", "top.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    df = project.read_tree(spark, str(tmp_path), include=("a/**/*.py",))
    assert [r.path for r in df.collect()] == ["a/x/m.py"] and all("/a/" in f for f in df.inputFiles())
    assert {r.path for r in project.read_tree(spark, str(tmp_path)).collect()} == {"a/x/m.py", "a/y/n.txt", "b/z/o.py", "top.py"}


def test_discovery_by_globs(spark):
    paths = ["pom.xml", "apps/a/pom.xml", "apps/a/deep/pom.xml", "apps/.h/pom.xml", "libs/b/setup.py", "apps/c/node_modules/d/tsconfig.json", "other/e/pom.xml"]
    df = spark.createDataFrame([(p, "") for p in paths], "path string, content string")
    found = project.discover_within(df, ("apps", "lib?"), ("**/node_modules/**",))
    assert {r.path for r in found.collect()} == {".", "apps/a", "apps/a/deep", "libs/b"}

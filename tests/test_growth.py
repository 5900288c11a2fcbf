"""Steps that many queries share: what a row carries doesn't grow with the input, and costly parts are made once."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.operators import codemodel, history, keys, outputs, projection, render
from corvane.plans import adapters
from corvane.sources import files
from corvane.streaming import incremental

ELEMENTS = "id string, component_id string, container_id string, name string, qualified_name string"
REFERENCES = "element_id string, target_name string, target_qualified string, kind string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_resolve_carries_no_other_components(spark):
    rows = [(f"k{i % 3}.c{c}.e{i}", f"c{c}", f"k{i % 3}" if i % 11 else None, f"n{i % 5}", f"q{i % 9}" if i % 2 else None) for i in range(60) for c in (i % 4, 4)]
    rows += [("lone", None, "k0", "n1", "q1")]
    refs = [(r[0], f"n{i % 7}" if i % 13 else None, f"q{i % 12}" if i % 3 else None, "uses") for i, r in enumerate(rows)] + [("nobody", "n1", None, "uses")]
    df = codemodel.resolve(spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame(refs, REFERENCES))

    def look(key, at, value, place):
        hits = [r[0] for r in rows if None not in (value, place) and r[2] is not None and r[key] == value and r[at] == place]
        return (min(hits), len(hits)) if hits else None

    expected, by_id = [], {r[0]: r for r in rows}
    for element, name, qualified, kind in refs:
        if element in by_id:
            _, component, container, *_ = by_id[element]
            tries = [("qualified-component", 4, 1, qualified, component), ("qualified-container", 4, 2, qualified, container), ("name-component", 3, 1, name, component), ("name-container", 3, 2, name, container)]
            # Components lie within one container each, so a look-up by component keeps to the container as well.
            tries = [(label, [r for r in rows if r[2] == container and container is not None and value is not None and r[key] == value and place is not None and r[at] == place]) for label, key, at, value, place in tries]
            label, hits = next(((label, hits) for label, hits in tries if hits), ("unresolved", []))
            expected.append((element, component, container, name, qualified, kind, min((h[0] for h in hits), default=None), label, len(hits)))
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, expected))
    assert "collect_list" not in plan(df) and "map_from_entries" not in plan(df)


def test_resolution_by_keys_takes_one_shuffle(spark):
    """Ids are compared as texts, repeats count once."""
    s = spark.createDataFrame
    rows = [((9, 1), 9, 1, "n", "q.n"), ((10, 1), 10, 1, "n", "q.n"), ((10, 1), 10, 1, "n", "q.n"), ((10, 2), 10, 1, "m", "q.m"), ((7, 5), 7, 2, "n", "r.n")]
    elements = s(rows, "id struct<supplier: long, part: long>, component_id long, container_id int, name string, qualified_name string")
    refs = s([((10, 2), 10, 1, "n", None, "uses")] * 2 + [((9, 1), 9, 1, "n", "r.n", "uses"), ((7, 5), 7, 2, "n", "q.n", "uses"), ((7, 5), 7, 2, None, None, "uses"), ((10, 2), 10, 1, "n", "q.n", "uses")],
             "element_id struct<supplier: long, part: long>, component_id long, container_id int, target_name string, target_qualified string, kind string")
    df = codemodel.resolve(elements, refs, nested=True, order=adapters.element_text, repeated=True)
    found = {(r.element_id.supplier, r.target_name, r.target_qualified): (r.target_id and tuple(r.target_id), r.resolved_by, r.collisions) for r in df.collect()}
    assert df.count() == 5 and found == {
        (10, "n", None): ((10, 1), "name-component", 1), (9, "n", "r.n"): ((9, 1), "name-component", 1), (7, "n", "q.n"): ((7, 5), "name-component", 1),
        (7, None, None): (None, "unresolved", 0), (10, "n", "q.n"): ((10, 1), "qualified-component", 1),
    }
    far = codemodel.resolve(elements, s([((10, 2), 8, 1, "n", None, "uses")], refs.schema), nested=True, order=adapters.element_text, repeated=True).first()
    assert (tuple(far.target_id), far.collisions) == ((10, 1), 2)  # "supplier-10.part-1" stands before "supplier-9.part-1"
    lines = s([(1, 1, 5), (1, 2, 6), (1, 2, 7), (1, 4, 8), (2, 1, 9), (None, 1, 1), (None, 2, 2), (3, None, 3)], "l_orderkey long, l_linenumber int, p int")
    assert sorted((r.p, r.next.p) for r in adapters.next_lines(lines, F.col("p")).collect()) == [(5, 6), (5, 7)]
    assert df._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2].count("Exchange hashpartitioning") == 1


def test_placed_pieces_are_not_shuffled(spark, tmp_path):
    """Lines of level 4 stand by component, so files of components are written from there; edges keep their number."""
    s, seen = spark.createDataFrame, []
    elements = s([(i, i % 5) for i in range(40)], "id long, component_id long")
    links = s([(i, (i * 7 + j) % 40, "uses", None, i % 5, (i * 7 + j) % 40 % 5) for i in range(40) for j in (0, 1, 1)], "source long, target long, kind string, label string, component_id long, target_component long")
    text = lambda c: F.concat(F.lit("x"), c.cast("string"))
    others = s([(i, f"k{i % 2}") for i in range(4)], "component_id long, container_id string")
    lines = render.code_lines(projection.code(elements, links, text=(text, text)), (), others)
    sections = {r.section: r["count"] for r in lines.groupBy("section").count().collect()}
    assert sections[0] == 4 and sections[1] == 32 and sections[3] + sections[4] == 96
    homes = s([("k0", "a"), ("k1", "b")], "id string, path string")
    placed = outputs.component_pieces(homes, lines)
    assert placed.select("path", F.spark_partition_id().alias("p")).distinct().groupBy("path").count().where("count > 1").count() == 0
    rest = s([("own", 0, "", "one", "\n", False, True)], PIECES)
    files.write_lines(rest, str(tmp_path / "a"), placed)
    files.write_lines(rest.unionByName(placed.select(*rest.columns)), str(tmp_path / "b"))
    for root in ("a", "b"):
        seen.append({str(f.relative_to(tmp_path / root)): f.read_bytes() for f in (tmp_path / root).rglob("*") if f.is_file()})
    assert seen[0] == seen[1] and len(seen[0]) == 5


def test_joins_spread_rows_without_a_key(spark):
    left = spark.createDataFrame([(None if i % 2 else f"supplier-{i % 6}", i) for i in range(40)], "id string, n int")
    right = spark.createDataFrame([("supplier-0", "a"), ("supplier-2", "b"), (None, "c")], "id string, x string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        mine, theirs = keys.joined_by(left, right, ["id"], how), left.join(right, "id", how)
        assert mine.columns == theirs.columns and sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))
    assert left.where("id IS NULL").select(keys.spread(["id"], ["n"])).distinct().count() == 20


def test_kept_links_are_made_once(spark):
    elements = spark.createDataFrame([("a.x", "a"), ("b.y", "b")], "id string, component_id string")
    links = spark.createDataFrame([("a.x", "b.y", "uses", None), ("a.x", "gone", "uses", None)], "source string, target string, kind string, label string")
    kept, plain = projection.code(elements, links, keep=True), projection.code(elements, links)
    for part in ("vertices", "edges", "warnings"):
        assert "Join" not in plan(getattr(kept, part)) and "Join" in plan(plain.edges)
        assert sorted(map(str, getattr(kept, part).collect())) == sorted(map(str, getattr(plain, part).collect()))


PIECES = "path string, section int, k string, line string, end string, once boolean, first boolean"


def test_files_from_pieces(spark, tmp_path):
    root = str(tmp_path)
    body = [("a/b.txt", 1, f"{i:06}", f"line {i} é", "\n", False, False) for i in range(25_000)]  # several Arrow batches
    pieces = [*reversed(body), ("a/b.txt", 0, "", "head", "\n", False, True), ("own", -1, "", "mine", "", True, True), ("empty", -1, "", "", "", False, True)]
    files.write_lines(spark.createDataFrame(pieces, PIECES), root)
    whole = "head\n" + "".join(r[3] + "\n" for r in body)
    assert (tmp_path / "a/b.txt").read_text() == whole and (tmp_path / "own").read_text() == "mine" and (tmp_path / "empty").read_text() == ""
    times = {p: (tmp_path / p).stat().st_mtime_ns for p in ("a/b.txt", "own", "empty")}
    changed = [r if r[0] != "own" else (*r[:3], "other", *r[4:]) for r in pieces]
    files.write_lines(spark.createDataFrame(changed, PIECES), f"file://{root}")
    assert times == {p: (tmp_path / p).stat().st_mtime_ns for p in times} and (tmp_path / "own").read_text() == "mine"
    assert {r.path: r.hash for r in files.read_hashes(spark, root).collect()} == {p: hashlib.sha256(t.encode()).hexdigest() for p, t in (("a/b.txt", whole), ("own", "mine"), ("empty", ""))}
    for bad in ([("own", -1, "", "x", "", False, True)] * 2, [("../own", -1, "", "x", "", False, True)], [(None, -1, "", "x", "", False, True)]):
        with pytest.raises(Exception, match="two files of one path|not a path below"):
            files.write_lines(spark.createDataFrame([("new", -1, "", "x", "", False, True), *bad], PIECES), root)
    assert not (tmp_path / "new").exists() and (tmp_path / "own").read_text() == "mine"


def test_documents_are_never_rows(spark):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    homes, components = s([("c", "C", "apps/c")], "id string, name string, path string"), s([("p", "c", "P")], "id string, container_id string, name string")
    level3 = s([("c", 0, "", "head"), ("c", 2, "", "tail")], "container_id string, section int, k string, line string")
    code = s([("p", "c", "P", 0, "", "# p")], "component_id string, container_id string, name string, section int, k string, line string")
    parts = outputs.fragment_lines(homes, components, s([("p", "x", "calls")], "source string, target string, label string"))
    lines = outputs.submodule_lines(homes, level3, parts, "styles\n", "own.yaml", "docs", code)
    assert "collect_list" not in plan(lines)
    texts = {}
    for r in sorted(lines.collect(), key=lambda r: (r.path, r.section, r.k, r.line)):
        texts[r.path] = texts.get(r.path, "") + r.line + r.end
    joined = lambda df, by: render.joined(df, by, "diagram")
    old = outputs.submodule_files(homes, joined(level3, ["container_id"]), outputs.fragments(homes, components, s([("p", "x", "calls")], "source string, target string, label string")), "styles\n", "own.yaml", "docs", joined(code, ["component_id", "container_id", "name"]).withColumn("n", F.lit(1)))
    assert texts == {r.path: r.content for r in old.collect()} and len(texts) == 7


def test_state_is_shared_by_projects(spark, tmp_path):
    """Projects of one bucket keep their own caches, over batches; each access of state serves many of them."""
    rows = [(f"p{i}", s, f"s{(i + s // 3) % 2}", f"m{(i * s) % 3}") for i in range(300) for s in range(6)]
    events = spark.createDataFrame(rows, "project string, seq long, scan_checksum string, model_checksum string")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    old, incremental.BUCKETS = incremental.BUCKETS, 4
    try:
        incremental.use_keyed_state(spark)
        for part in ("seq < 3", "seq >= 2"):  # the second batch repeats one of each
            events.where(part).coalesce(1).write.mode("append").parquet(source)
            stream = incremental.staleness(spark.readStream.schema(events.schema).parquet(source))
            run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            run.awaitTermination()
        states = sum(o.numRowsTotal for o in run.lastProgress.stateOperators)
    finally:
        incremental.BUCKETS = old
    assert states == 4
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted(map(tuple, incremental.staleness_of(events).collect()))


def test_dangling_reads_references_once(spark):
    refs = spark.range(240).selectExpr("CASE WHEN id % 40 <> 7 THEN concat('f', id % 12) END AS file", "CASE WHEN id % 30 <> 1 THEN concat_ws('.', concat('a', id % 5), nullif('b', concat('b', id % 2)), concat('c', id % 4)) END AS ref")
    refs = refs.selectExpr("file", "CASE WHEN hash(file, ref) % 3 = 0 THEN split(ref, '[.]')[0] ELSE replace(ref, '.c', '.b.c') END AS ref")
    known = ["a0", "a1.b", "a2.b.c1", "a3.c1", None]
    df = history.dangling(refs, spark.createDataFrame([(k,) for k in known + ["a0"]], "id string"))
    good = lambda ref: any(".".join(ref.split(".")[:i]) in known for i in range(1, ref.count(".") + 2))
    expected = {(r.file, r.ref) for r in refs.collect() if r.ref is None or not good(r.ref)}
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected)) and len(expected) > 20
    assert plan(df).count("Range (0, 240") == 1


def test_first_of_a_pair_sorts_by_hash(spark):
    rows = [(f"nation-{i % 3}" if i % 7 else None, f"nation-{i % 4}", f"s{i % 5}", f"t{i % 6}", f"l{i}", None) for i in range(200)]
    edges = spark.createDataFrame(rows, "s string, t string, source string, target string, label string, technology string")
    first = projection._first_by_pair(edges)
    groups = {(r[0], r[1]): min((x for x in rows if x[:2] == r[:2]), key=lambda x: x[2:5])[4] for r in rows}
    assert {(r.source, r.target): r.label for r in first.collect()} == groups and first.columns == ["source", "target", "label", "technology"]
    sort = first._jdf.queryExecution().sparkPlan().toString().split("SortAggregate(key=[")[1]
    assert not sort.startswith("s#")  # ids begin alike; the hash tells most of them apart

"""Queries that compare a model or text with an earlier state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from . import adapters
from .adapters import GRAPH_SQL, table
from .registry import register


# Versions: parts are diagram cells; the earlier diagram lacks every seventh and holds some that are gone.
def _cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cell = F.concat(F.lit("part-"), "p_partkey").alias("id")
    existing = p.where("p_partkey % 7 <> 0").select(
        cell, F.concat(F.lit("old "), "p_name").alias("value"), F.concat(F.lit("s"), F.col("p_size")).alias("style"), F.concat(F.lit("brand-"), F.col("p_partkey") % 9).alias("parent"),
        (F.col("p_partkey") % 4 != 1).alias("managed"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")).alias("x"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") * 2).alias("y"),
    )
    parents = spark.range(6).select(F.concat(F.lit("brand-"), "id").alias("id"), F.lit("brand").alias("value"), F.lit("box").alias("style"), F.lit(None).cast("string").alias("parent"))
    fresh = p.where("p_partkey % 5 <> 0").select(cell, F.col("p_name").alias("value"), F.lit("new").alias("style"), F.concat(F.lit("brand-"), F.col("p_partkey") % 6).alias("parent")).unionByName(parents)
    layout = p.where("p_partkey % 3 <> 0").select(cell, (F.col("p_size") + 100).alias("x"), (F.col("p_size") + 200).alias("y"))
    return existing, fresh, layout


_CELLS = """existing AS (SELECT 'part-' || p_partkey AS id, 'old ' || p_name AS value, 's' || p_size AS style, 'brand-' || (p_partkey % 9) AS parent, p_partkey % 4 <> 1 AS managed,
  CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS x, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 2 END AS y FROM part WHERE p_partkey % 7 <> 0),
fresh AS (SELECT 'part-' || p_partkey AS id, p_name AS value, 'new' AS style, 'brand-' || (p_partkey % 6) AS parent FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT 'brand-' || range, 'brand', 'box', NULL FROM range(6)),
layout AS (SELECT 'part-' || p_partkey AS id, p_size + 100 AS x, p_size + 200 AS y FROM part WHERE p_partkey % 3 <> 0),
joined AS (SELECT coalesce(e.id, f.id) AS id, e.value AS ev, e.style AS es, e.parent AS ep, e.managed, e.x AS ex, e.y AS ey, f.id IS NOT NULL AS fr, f.value AS fv, f.style AS fs, f.parent AS fp,
  e.parent IN (SELECT id FROM fresh) AS pf, l.x AS lx, l.y AS ly FROM existing e FULL JOIN fresh f ON f.id = e.id LEFT JOIN layout l ON l.id = coalesce(e.id, f.id)),
acted AS (SELECT *, CASE WHEN fr AND coalesce(managed, false) AND ex IS NOT NULL AND (ep IS NULL OR ep = '1' OR coalesce(pf, false)) THEN 'kept' WHEN fr THEN CASE WHEN lx IS NULL THEN 'default' ELSE 'placed' END
  WHEN NOT coalesce(managed, false) AND ex IS NOT NULL THEN 'foreign' ELSE 'deleted' END AS action FROM joined),
vertices AS (SELECT id, CASE WHEN fr THEN fv ELSE ev END AS value, CASE WHEN action IN ('kept', 'foreign') THEN es ELSE fs END AS style,
  CASE action WHEN 'kept' THEN CASE WHEN coalesce(pf, false) THEN ep ELSE coalesce(fp, '1') END WHEN 'foreign' THEN ep ELSE coalesce(fp, '1') END AS parent,
  CAST(CASE WHEN action IN ('kept', 'foreign') THEN ex ELSE coalesce(lx, 0) END AS INTEGER) AS x, CAST(CASE WHEN action IN ('kept', 'foreign') THEN ey ELSE coalesce(ly, 0) END AS INTEGER) AS y, action FROM acted WHERE action <> 'deleted')"""
register("reconcile_vertices", lambda s, d: history.reconcile_vertices(*_cells(s, d)), f"WITH {_CELLS} SELECT * FROM vertices")


def _warned(spark, sf_dir):
    existing, fresh, layout = _cells(spark, sf_dir)
    return history.reconcile_warnings(existing, fresh, history.reconcile_vertices(existing, fresh, layout))


register(
    "reconcile_warnings",
    _warned,
    f"""WITH {_CELLS} SELECT id, 'has no place and is put at 0, 0' AS warning FROM vertices WHERE action = 'default'
UNION ALL SELECT id, 'leaves its parent ' || parent || ', which is gone' FROM existing WHERE managed AND id IN (SELECT id FROM fresh) AND parent NOT IN (SELECT id FROM fresh)""",
)


def _lines(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("a"), F.max("l_suppkey").alias("s"))
    n = table(spark, sf_dir, "part").count()
    edge = F.concat(F.lit("edge-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id")
    ends = [F.concat(F.lit("part-"), "a").alias("source"), F.concat(F.lit("part-"), (F.col("a") + F.col("s")) % n + 1).alias("target")]
    existing = o.where("l_orderkey % 3 <> 0").select(edge, *ends, (F.col("l_orderkey") % 4 != 0).alias("managed"), F.concat(F.lit("w"), "s").alias("waypoints"))
    fresh = o.where("l_orderkey % 5 <> 0").select(edge, *ends)
    return existing, fresh


def _reconciled_edges(spark, sf_dir):
    return history.reconcile_edges(*_lines(spark, sf_dir), history.reconcile_vertices(*_cells(spark, sf_dir)))


register(
    "reconcile_edges",
    _reconciled_edges,
    f"""WITH {_CELLS}, o AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS a, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
e AS (SELECT l_orderkey, 'edge-' || l_orderkey || '-' || l_linenumber AS id, 'part-' || a AS source, 'part-' || ((a + s) % (SELECT count(*) FROM part) + 1) AS target, 'w' || s AS waypoints FROM o),
r AS (SELECT e.id, source, target, waypoints, l_orderkey % 3 <> 0 AS was, l_orderkey % 5 <> 0 AS fr, l_orderkey % 3 <> 0 AND l_orderkey % 4 <> 0 AS managed, x.action AS sa, y.action AS ta
  FROM e LEFT JOIN vertices x ON x.id = source LEFT JOIN vertices y ON y.id = target WHERE l_orderkey % 3 <> 0 OR l_orderkey % 5 <> 0),
a AS (SELECT *, CASE WHEN fr THEN CASE WHEN managed AND sa = 'kept' AND ta = 'kept' THEN 'kept' ELSE 'routed' END WHEN managed THEN 'deleted' WHEN sa IS NOT NULL AND ta IS NOT NULL THEN 'foreign' ELSE 'warning' END AS action FROM r)
SELECT id, source, target, CASE WHEN action = 'kept' THEN waypoints END AS waypoints, action FROM a WHERE action <> 'deleted'""",
)


def _hashes(spark, sf_dir, skip=0):
    docs = table(spark, sf_dir, "documents")
    body = F.when((F.col("doc_id") % 17 == 0) & F.lit(bool(skip)), "").otherwise(F.col("text"))
    return history.content_hash(docs.select(F.concat_ws("/", "source", "lang").alias("project"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), body.alias("body")))


_HASH = "SELECT project, sha256(string_agg(path || ':' || h || chr(10), '' ORDER BY path)) AS hash FROM (SELECT source || '/' || lang AS project, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256({}) AS h FROM documents) GROUP BY project"
_NOW, _BEFORE = _HASH.format("text"), _HASH.format("CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END")
register("content_hash", lambda s, d: _hashes(s, d), _NOW)
register(
    "cache_key",
    lambda s, d: history.cache_key(_hashes(s, d).withColumn("app", F.substring_index("project", "/", 1)), "app"),
    f"WITH h AS ({_NOW}) SELECT string_split(project, '/')[1] AS app, count(*) || ':' || string_agg(hash, ',' ORDER BY hash) AS key FROM h GROUP BY app",
)
register(
    "stale_projects",
    lambda s, d: history.stale(_hashes(s, d).where("project NOT LIKE 'src3/%'"), _hashes(s, d, 1).where("project NOT LIKE 'src4/%'")),
    f"""WITH n AS (SELECT * FROM ({_NOW}) WHERE project NOT LIKE 'src3/%'), b AS (SELECT * FROM ({_BEFORE}) WHERE project NOT LIKE 'src4/%')
SELECT coalesce(n.project, b.project) AS project, CASE WHEN b.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'removed' WHEN n.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS state FROM n FULL JOIN b ON n.project = b.project""",
)
register(
    "render_up_to_date",
    lambda s, d: history.up_to_date(
        table(s, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("mtime")),
        table(s, d, "orders").where("o_orderpriority LIKE '1%'").groupBy(F.col("o_custkey").alias("project")).agg(F.max("o_orderdate").alias("mtime")),
    ),
    """SELECT o_custkey AS project, coalesce(max(o_orderdate) <= max(o_orderdate) FILTER (o_orderpriority LIKE '1%'), false) AS fresh FROM orders GROUP BY o_custkey""",
)
register(
    "write_if_changed",
    lambda s, d: history.write_plan(
        table(s, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), F.col("text").alias("body")),
        table(s, d, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")), 256).alias("hash")),
    ).select("path"),
    "SELECT 'doc-' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 7 = 0 AND text <> '')",
)


def _drift(spark, sf_dir):
    m = adapters.graph(spark, sf_dir)
    refs = m.relationships.select(F.col("source").alias("file"), F.concat("target", F.when(F.col("label").like("O%"), ".label").otherwise("")).alias("ref"))
    return history.dangling(refs, m.components.select("id").unionByName(m.externals.where("is_library").select("id")))


register(
    "drift_references",
    _drift,
    f"""WITH {GRAPH_SQL} SELECT DISTINCT source AS file, target || CASE WHEN label LIKE 'O%' THEN '.label' ELSE '' END AS ref FROM relationships
WHERE target NOT IN (SELECT id FROM components UNION SELECT id FROM externals WHERE is_library)""",
)
_MARK = "License"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.col("text").alias("content"))


_MODIFIED = "SELECT 'doc-' || doc_id AS file, instr(text, 'License') = 0 OR regexp_replace(text[instr(text, 'License') + 7:], '\\s+', '', 'g') <> '' AS modified FROM documents"
register("user_modified", lambda s, d: history.user_modified(_files(s, d), _MARK), _MODIFIED)
register(
    "inert_stubs",
    lambda s, d: history.inert(table(s, d, "events").groupBy(F.col("user_id").alias("file")).agg(F.array_join(F.collect_set(F.when(F.col("event_type") == "error", "# note").when(F.col("value") > 50, "").otherwise("key = 1")), "\n").alias("content"))),
    "SELECT user_id AS file, count(*) FILTER (event_type <> 'error' AND (value IS NULL OR value <= 50)) = 0 AS inert FROM events GROUP BY user_id",
)


def _stale_outputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    outputs = docs.select(F.concat(F.lit("doc-"), "doc_id").alias("path"), F.col("source").alias("owner"))
    live = docs.where("source NOT LIKE 'src1%'").select(F.col("source").alias("id")).distinct()
    return history.removal_plan(outputs, live, history.user_modified(_files(spark, sf_dir), _MARK))


register("stale_outputs", _stale_outputs, f"WITH m AS ({_MODIFIED}) SELECT 'doc-' || doc_id AS path, CASE WHEN modified THEN 'keep' ELSE 'remove' END AS action FROM documents JOIN m ON m.file = 'doc-' || doc_id WHERE source LIKE 'src1%'")


def _metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return history.set_metrics(labels.where("quality = 1"), labels.where("toxic = 0"), "lang", "doc_id")


_METRICS = """WITH l AS (SELECT lang, doc_id, quality = 1 AS f, toxic = 0 AS e FROM labels JOIN documents USING (doc_id)),
n AS (SELECT lang, count(DISTINCT doc_id) FILTER (f AND e) AS tp, count(DISTINCT doc_id) FILTER (f) AS nf, count(DISTINCT doc_id) FILTER (e) AS ne FROM l WHERE f OR e GROUP BY lang),
m AS (SELECT *, CASE WHEN nf = 0 THEN 1.0 ELSE tp / nf END AS p, CASE WHEN ne = 0 THEN 1.0 ELSE tp / ne END AS r FROM n),
metrics AS (SELECT lang, tp, nf - tp AS fp, ne - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m)
"""
register("set_metrics", _metrics, _METRICS + "SELECT * FROM metrics")
register("macro_f1", lambda s, d: history.macro_f1(_metrics(s, d)), _METRICS + "SELECT round(avg(f1), 6) AS macro_f1 FROM metrics")


def _churn(spark, sf_dir):
    """All documents before, and after an edit of the lines of every third."""
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return history.line_churn(lines, lines.withColumn("line", F.when(F.col("doc_id") % 3 == 0, F.concat("line", F.lit(" edited"))).otherwise(F.col("line"))))


register(
    "line_churn",
    _churn,
    """WITH l AS (SELECT source AS key, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT key, line, 1 AS b, 0 AS a FROM l UNION ALL SELECT key, CASE WHEN doc_id % 3 = 0 THEN line || ' edited' ELSE line END, 0, 1 FROM l),
n AS (SELECT key, line, sum(b) AS nb, sum(a) AS na FROM b GROUP BY ALL),
s AS (SELECT key, CAST(sum(CASE WHEN nb = 0 THEN na ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN na = 0 THEN nb ELSE 0 END) AS BIGINT) AS removed, greatest(sum(nb), sum(na)) AS most FROM n GROUP BY key)
SELECT key, added, removed, round((added + removed) / most, 6) AS churn FROM s""",
)


def _entities(spark, sf_dir):
    m = adapters.graph(spark, sf_dir)
    return history.entity_counts({"actors": m.actors, "externals": m.externals, "containers": m.containers, "components": m.components, "relationships": m.relationships})


register(
    "entity_counts",
    _entities,
    f"WITH {GRAPH_SQL} SELECT 'actors' AS entity, count(*) AS n FROM actors UNION ALL SELECT 'externals', count(*) FROM externals UNION ALL SELECT 'containers', count(*) FROM containers UNION ALL SELECT 'components', count(*) FROM components UNION ALL SELECT 'relationships', count(*) FROM relationships",
)

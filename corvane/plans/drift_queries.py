"""Queries of drift, staleness, removal, languages and the code-level outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codemodel, drift, history, outputs, projection, render
from ..sources import documents
from ..sources.store import stored
from . import adapters, trees
from .adapters import CODE_SQL, table
from .graph_queries import _ID, _Q, L4, level4
from .registry import register
from .trees import SUPPLIERS_SQL, _text

# Diagrams: a file a nation, with a cell and an edge per supplier.
CELL = (
    '<mxCell id="s{k}" value="S &amp;amp; {k}" style="box{mark}" vertex="1" parent="1"><mxGeometry x="{k}" y="2.5" width="30" height="4"/></mxCell>'
    '<UserObject id="e{k}" label="uses &lt;{k}&gt;" tooltip="t{k}"><mxCell style="edge;managed=1" edge="1" parent="1" source="s{k}" target="{to}"><mxGeometry><Array as="points"><mxPoint x="1" y="{k}"/></Array></mxGeometry></mxCell></UserObject>'
    '<mxCell id="e{k}" value="hidden by its wrapper" edge="1"/>'
)


def _cells(spark, sf_dir):
    s = trees.suppliers(spark, sf_dir)
    c = F.col
    to = F.when(c("k") % 5 == 0, F.concat(F.lit("x"), c("nk").cast("string"))).otherwise(F.concat(F.lit("s"), c("nk").cast("string")))
    cell = _text(CELL, k=c("k"), mark=F.when(c("k") % 3 != 0, ";managed=1").otherwise(""), to=to)
    rows = s.groupBy("n").agg(F.array_join(F.array_sort(F.collect_list(cell)), "").alias("cells"))
    files = rows.select(F.concat(F.lit("n"), "n", F.lit(".drawio")).alias("file"), F.concat(F.lit("<root>"), "cells", F.lit("</root>")).alias("content"))
    broken = rows.select(F.concat(F.lit("bad"), "n").alias("file"), F.lit("<root><mxCell").alias("content"))
    return documents.diagram_cells(files.unionByName(broken))


_CELLS = f"""WITH {SUPPLIERS_SQL}, cells AS (
  SELECT 'n' || n || '.drawio' AS file, 's' || k AS id, 'S &amp; ' || k AS value, CAST(NULL AS VARCHAR) AS tooltip, 'box' || CASE WHEN k % 3 <> 0 THEN ';managed=1' ELSE '' END AS style, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target,
    false AS is_edge, CAST(k AS DOUBLE) AS x, 2.5 AS y, 30.0 AS width, CAST(NULL AS VARCHAR) AS points, k % 3 <> 0 AS managed FROM sup
  UNION ALL SELECT 'n' || n || '.drawio', 'e' || k, 'uses <' || k || '>', 't' || k, 'edge;managed=1', 's' || k, CASE WHEN k % 5 = 0 THEN 'x' ELSE 's' END || nk, true, NULL, NULL, NULL, '1,' || k, true FROM sup)
"""
register(
    "diagram_cells",
    lambda s, d: _cells(s, d).where("error IS NULL").select("file", "id", "value", "tooltip", "style", "source", "target", "is_edge", "x", "y", "width", "points", "managed"),
    _CELLS + "SELECT * FROM cells",
)


def _cell_drift(spark, sf_dir):
    known = trees.suppliers(spark, sf_dir).where("k % 7 <> 0").select(F.concat(F.lit("s"), "k").alias("id"))
    return drift.cell_drift(_cells(spark, sf_dir), known)


register(
    "diagram_drift",
    _cell_drift,
    _CELLS + """, ends AS (SELECT file, id AS cell, unnest([source, target]) AS ref FROM cells WHERE is_edge)
SELECT file, cell, ref, 'warning' AS severity FROM ends e WHERE ref NOT IN (SELECT 's' || k FROM sup WHERE k % 7 <> 0) AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.file = e.file AND c.id = e.ref AND NOT c.managed)
UNION ALL SELECT DISTINCT 'bad' || n, NULL, NULL, 'error' FROM sup""",
)


# Diagram text: a file a nation; what stands before the last import doesn't count.
def _diagram_lines(spark, sf_dir):
    s = trees.suppliers(spark, sf_dir)
    c = F.col
    v = {x: c(x) for x in ("k", "n", "nk")}
    templates = ("old{k} -> gone{k}", "  n{n}.s{k}.style: x", "s{k} -> s{nk}.shape: uses", "missing{k}.label: y", "  # note{k}", "direction: right", "shape: box", "S{k} -> x")
    each = F.posexplode(F.array(*(_text(t, **v) for t in templates)))
    rows = s.select("n", "k", each.alias("pos", "text"))
    text = rows.select(F.concat(F.lit("n"), "n").alias("file"), (c("k") * 10 + c("pos") + F.when(c("pos") > 0, 1_000_000).otherwise(0)).alias("line"), "text")
    return text.unionByName(s.select(F.concat(F.lit("n"), "n").alias("file"), F.lit(999_999).cast("long").alias("line"), F.lit("  ...@base.d2").alias("text")).distinct())


def _known(spark, sf_dir):
    s = trees.suppliers(spark, sf_dir)
    return s.where("k % 4 <> 0").select(F.concat(F.lit("s"), "k").alias("id")).unionByName(s.where("n % 2 = 0").select(F.concat(F.lit("n"), "n").alias("id")).distinct())


_REFS = f"""WITH {SUPPLIERS_SQL}, known AS (SELECT 's' || k AS id FROM sup WHERE k % 4 <> 0 UNION SELECT 'n' || n FROM sup WHERE n % 2 = 0),
refs AS (SELECT 'n' || n AS file, unnest([k * 10 + 1, k * 10 + 2, k * 10 + 2, k * 10 + 3, k * 10 + 5]) + 1000000 AS line, unnest(['n' || n || '.s' || k, 's' || k, 's' || nk, 'missing' || k, 'direction']) AS ref FROM sup)
"""
register("diagram_references", lambda s, d: drift.references(_diagram_lines(s, d)), _REFS + "SELECT * FROM refs")
register("text_drift", lambda s, d: drift.text_drift(_diagram_lines(s, d), _known(s, d)), _REFS + "SELECT DISTINCT file, line, ref FROM refs WHERE ref NOT IN (FROM known) AND string_split(ref, '.')[1] NOT IN (FROM known) AND ref <> 'direction'")
register(
    "code_text_drift",
    lambda s, d: drift.text_drift(_diagram_lines(s, d), _known(s, d), code=True),
    _REFS + """, more AS (FROM refs UNION ALL SELECT 'n' || n, k * 10 + 1000007, unnest(['S' || k, 'x']) FROM sup)
SELECT DISTINCT file, line, ref FROM more WHERE lower(ref) NOT IN (FROM known) AND string_split(lower(ref), '.')[1] NOT IN (FROM known) AND ref <> 'direction'""",
)


# Staleness: sources are projects, and years the earlier and the present state.
def _hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.concat(F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body"))
    return history.content_hash(docs)


_HASHES = "hashes AS (SELECT source AS project, sha256(string_agg(doc_id || ':' || sha256(coalesce(text, '')) || chr(10), '' ORDER BY CAST(doc_id AS VARCHAR))) AS hash FROM documents GROUP BY source)"
_MIX = "'sha256:' || sha256({} || chr(10) || hash)"
register("mixed_checksum", lambda s, d: history.mixed(_hashes(s, d), F.lit("levels=all")), f"WITH {_HASHES} SELECT project, {_MIX.format(repr('levels=all'))} AS checksum FROM hashes")


def _levels(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    scan, model = (history.mixed(h, F.lit(x)).withColumnRenamed("checksum", x) for x in ("scan", "model"))
    now = scan.join(model, "project")
    n = F.regexp_extract("project", "([0-9]+)$", 1).cast("int")
    before = now.withColumn("scan", F.when(n % 2 == 0, "other").otherwise(F.col("scan"))).withColumn("model", F.when(n % 3 == 0, F.lit(None)).otherwise(F.col("model"))).where(n % 5 != 4)
    return history.stale_levels(now, before)


register(
    "stale_levels",
    _levels,
    """WITH p AS (SELECT DISTINCT source AS project, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents)
SELECT project, n % 2 = 0 OR n % 5 = 4 AS scan_stale, n % 3 = 0 OR n % 5 = 4 AS model_stale FROM p""",
)


def _removal(everything):
    def query(spark, sf_dir):
        paths = table(spark, sf_dir, "nation").select(F.concat(F.lit("apps/n"), "n_nationkey").alias("path"), F.col("n_nationkey").alias("n"))
        there = paths.select(F.explode(F.array(F.when(F.col("n") % 2 == 0, F.concat("path", F.lit("/.cache"))), F.when(F.col("n") % 3 == 0, F.concat("path", F.lit("/settings.yaml"))), F.concat("path", F.lit("/docs/architecture")))).alias("path")).where("path IS NOT NULL")
        root = spark.createDataFrame([("settings.yaml",), ("architecture-model.yaml",), ("docs/architecture",), ("src",)], "path string")
        return outputs.removal_candidates(paths.select("path"), there.unionByName(root), everything, "settings.yaml", ".cache", "architecture-model.yaml")

    return query


_REMOVAL = "SELECT unnest(['settings.yaml', 'architecture-model.yaml'{}]) AS path UNION ALL SELECT 'apps/n' || n_nationkey || '/.cache' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'apps/n' || n_nationkey || '/settings.yaml' FROM nation WHERE n_nationkey % 3 = 0"
register("removal_candidates", _removal(False), _REMOVAL.format(""))
register("removal_of_everything", _removal(True), _REMOVAL.format(", 'docs/architecture'") + " UNION ALL SELECT 'apps/n' || n_nationkey || '/docs/architecture' FROM nation")


# Languages: brands are components, parts their elements and modules.
def _languages(spark, sf_dir):
    p, c = table(spark, sf_dir, "part"), F.col
    pick = lambda v, x: F.element_at(F.array(*map(F.lit, v)), (x % len(v) + 1).cast("int"))
    n = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    parts = p.select(c("p_brand").alias("component_id"), "p_partkey", "p_size", n.alias("n"))
    elements = parts.select("component_id", F.when(c("n") % 4 == 0, pick(codemodel.LANGUAGES, c("p_partkey"))).alias("language"), pick(("class", "struct", "type", "enum"), c("p_size").cast("long")).alias("kind"), "n").where("n % 5 <> 1")
    files = parts.where("n % 3 = 0").select(F.concat(F.lit("m"), "p_partkey").alias("module_id"), pick(codemodel.LANGUAGES, c("p_size").cast("long")).alias("language"), (c("p_partkey") % 3).alias("files"))
    components = parts.groupBy("component_id").agg(F.collect_list(F.concat(F.lit("m"), "p_partkey")).alias("module_ids"))
    return codemodel.dominant_language(components, elements, files)


register(
    "dominant_language",
    _languages,
    """WITH p AS (SELECT p_brand AS component_id, p_partkey, p_size, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS n, ['java', 'typescript', 'python', 'c'] AS v FROM part),
c AS (SELECT component_id, 0 AS rank, v[p_partkey % 4 + 1] AS language, p_partkey % 4 AS o, 1 AS w FROM p WHERE n % 4 = 0 AND n % 5 <> 1
  UNION ALL SELECT component_id, 1, v[p_size % 4 + 1], p_size % 4, p_partkey % 3 FROM p WHERE n % 3 = 0 AND p_partkey % 3 > 0
  UNION ALL SELECT component_id, 2, ['', 'c', 'typescript', 'java'][p_size % 4 + 1], [9, 3, 1, 0][p_size % 4 + 1], 1 FROM p WHERE n % 5 <> 1 AND p_size % 4 > 0),
s AS (SELECT component_id, rank, language, o, sum(w) AS n FROM c GROUP BY ALL), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY rank, n DESC, o) = 1)
SELECT DISTINCT p.component_id, coalesce(language, 'java') AS language, coalesce(['elements', 'files', 'kinds'][rank + 1], 'default') AS source FROM p LEFT JOIN best USING (component_id)""",
)

# Code-level outputs.
register(
    "code_cells",
    lambda s, d: render.code_cells(level4(s, d, keep=True)),
    L4 + """SELECT DISTINCT component_id, component_id AS id, component_id AS value, 'boundary;managed=1' AS style, '1' AS parent, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target FROM elements
UNION ALL SELECT component_id, id, id, 'element;managed=1', '1', NULL, NULL FROM elements
UNION ALL SELECT DISTINCT component_id, tc, tc, 'boundary;managed=1;dashed=2', '1', NULL, NULL FROM far
UNION ALL SELECT DISTINCT component_id, target, target, 'element;managed=1;dashed=2', '1', NULL, NULL FROM far
UNION ALL SELECT component_id, source || '->' || target || ':' || kind, kind, 'edge;managed=1', '1', source, target FROM good""",
)
_ESCAPED = "regexp_replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), '\\r?\\n', ' ', 'g')"
register(
    "member_lines",
    lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(render.member_line("text"), 256).alias("h")),
    f"""WITH t AS (SELECT doc_id, {_ESCAPED.format("text")} AS t FROM documents), h AS (SELECT doc_id, t, t[1:515] AS head FROM t)
SELECT doc_id, sha256('"' || CASE WHEN length(t) <= 518 THEN t WHEN length(regexp_extract(head, '(\\\\+)$', 1)) % 2 = 1 THEN t[1:514] || '...' ELSE head || '...' END || '"') AS h FROM h""",
)


def _c_diagrams(spark, sf_dir):
    of_component, of_element = adapters.CODE_TEXT
    rows = adapters.code_keys(spark, sf_dir).elements.distinct()
    rows = rows.select(of_component(F.col("component_id")).alias("component_id"), of_element(F.col("id")).alias("id"), "name", "kind", "visibility", F.array("name", "qualified_name").alias("members"))
    return render.c_diagrams(rows, level4(spark, sf_dir).edges)


_PLACE = "CASE WHEN kind = 'struct' THEN 1 WHEN visibility = 'private' THEN 3 ELSE 2 END"
register(
    "render_c_d2",
    _c_diagrams,
    L4 + f""", drawn AS (SELECT *, {_PLACE} AS place FROM elements WHERE kind IN ('struct', 'function')),
lines AS (SELECT DISTINCT component_id, 0 AS section, '' AS k, '# Component: ' || component_id AS line FROM elements
  UNION ALL SELECT DISTINCT component_id, place * 3, '', ['types: Types {{', 'public: Public API {{', 'internal: Internal {{'][place] FROM drawn
  UNION ALL SELECT component_id, place * 3 + 1, id, '  ' || {_ID.format("id")} || ': ' || {_Q.format("name")} || CASE WHEN place = 1 THEN ' {{' || chr(10) || '    shape: class' || chr(10) || '    "' || name || '"' || chr(10) || '    "' || qualified_name || '"' || chr(10) || '  }}' ELSE '' END FROM drawn
  UNION ALL SELECT DISTINCT component_id, place * 3 + 2, '', '}}' FROM drawn
  UNION ALL SELECT component_id, 12, source || '->' || target || ':' || kind, {_ID.format("source")} || ' -> ' || {_ID.format("target")} || ': ' || kind FROM good WHERE kind NOT IN ('inherits', 'implements'))
SELECT component_id, string_agg(line, chr(10) ORDER BY section, k, line) || chr(10) AS diagram FROM lines GROUP BY component_id""",
)


def _round_trip(spark, sf_dir):
    """A model of nations and suppliers, written as pieces of YAML and read back."""
    m, code = adapters.graph(spark, sf_dir), adapters.code(spark, sf_dir)
    containers = m.containers.select("id", F.col("id").alias("application_id"), "name", "path")
    components = m.components.select("id", "container_id", "name", F.array(F.col("id")).alias("module_ids"))
    elements = code.elements.groupBy("component_id", "container_id").agg(F.min(F.struct("id", "name", "qualified_name")).alias("e"))
    elements = elements.select("e.id", "component_id", "container_id", "e.name", "e.qualified_name", F.lit("class").alias("kind"), F.array(F.struct(F.col("e.name").alias("name"), F.lit("field").alias("kind"))).alias("members"))
    pieces = documents.dump_pieces({"containers": containers, "components": components, "code_elements": elements})
    loaded = documents.load_pieces(stored(pieces, "pieces"))
    return loaded["code_elements"].select("id", "component_id", "container_id", "qualified_name", "kind", F.get("members", 0)["name"].alias("member"))


register(
    "model_round_trip",
    _round_trip,
    f"""WITH {CODE_SQL}, e AS (SELECT * FROM elements QUALIFY row_number() OVER (PARTITION BY component_id, container_id ORDER BY id) = 1)
SELECT id, component_id, container_id, qualified_name, 'class' AS kind, name AS member FROM e""",
)


_XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
register(
    "cell_lines",
    lambda s, d: render.cell_lines(_cells(s, d).where("error IS NULL").withColumn("id", F.concat("file", F.lit("/"), "id"))),
    _CELLS + f"""SELECT 0 AS section, '' AS k, '<root>' AS line UNION ALL SELECT 3, '', '</root>'
UNION ALL SELECT 1, file || '/' || id, '<mxCell id="' || file || '/' || id || '" value="' || {_XML.format("value")} || '" style="' || style || '" parent="1" vertex="1"><mxGeometry x="' || CAST(x AS VARCHAR) || '" y="2.5" width="30.0" height="4.0" as="geometry"/></mxCell>' FROM cells WHERE NOT is_edge
UNION ALL SELECT 2, file || '/' || id, '<UserObject label="' || {_XML.format("value")} || '" tooltip="' || tooltip || '" id="' || file || '/' || id || '"><mxCell style="' || style || '" parent="1" edge="1" source="' || source || '" target="' || target || '"/></UserObject>' FROM cells WHERE is_edge""",
)


def _blocks(spark, sf_dir):
    """Nations as containers of their suppliers, with properties."""
    s = trees.suppliers(spark, sf_dir).groupBy("n").agg(F.array_sort(F.collect_list(F.concat(F.lit("s"), "k", F.lit(": S")))).alias("children"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name").join(s, "n", "left")
    properties = F.create_map(F.lit("shape"), F.when(F.col("n") % 2 == 0, "box"), F.lit("link"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("a#"), "n")))
    return n.select("n", render.block(F.concat(F.lit("N "), "n"), F.col("n_name"), properties, F.col("children")).alias("text"))


register(
    "diagram_blocks",
    _blocks,
    f"""WITH {SUPPLIERS_SQL}, c AS (SELECT n, string_agg('  s' || k || ': S', chr(10) ORDER BY 's' || k || ': S') AS kids FROM sup GROUP BY n),
x AS (SELECT CAST(n_nationkey AS BIGINT) AS n, n_name, concat_ws(chr(10), CASE WHEN n_nationkey % 3 = 0 THEN '  link: "a#' || n_nationkey || '"' END, CASE WHEN n_nationkey % 2 = 0 THEN '  shape: box' END, kids) AS inner_lines FROM nation LEFT JOIN c ON c.n = n_nationkey)
SELECT n, 'n_' || n || ': ' || n_name || CASE WHEN inner_lines <> '' THEN ' {{' || chr(10) || inner_lines || chr(10) || '}}' ELSE '' END AS text FROM x""",
)

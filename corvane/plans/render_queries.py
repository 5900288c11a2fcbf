"""Queries of the renderers and of sources over the page and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import projection, render
from ..sources import project
from . import adapters
from .adapters import table
from .graph_queries import _ID, _Q, L1, L2, L3, L4, _PAIRS, level4
from .registry import register


def _level(level, draw, keep=False):
    def query(spark, sf_dir):
        m = adapters.graph(spark, sf_dir, keep)
        return draw(m, level(m.actors, m.externals, m.containers, m.components, m.relationships))

    return query


register(
    "render_l1_d2",
    _level(projection.context, render.context_diagram),
    L1
    + f""", edges AS ({_PAIRS.format("s IS NOT NULL AND t IS NOT NULL AND NOT (sk = 'external' AND tk = 'external') AND s <> t")}),
lines AS (SELECT 0 AS section, '' AS k, '# Context diagram' AS line
  UNION ALL SELECT 1, id, {_ID.format("id")} || ': ' || {_Q.format("name || '\\n[Person]'")} FROM actors
  UNION ALL SELECT 2, '', 'system: "System\\n[Software System]"'
  UNION ALL SELECT 3, id, {_ID.format("id")} || ': ' || {_Q.format("name || '\\n[External System]'")} FROM externals WHERE NOT is_library
  UNION ALL SELECT 4, source || ' -> ' || target, {_ID.format("source")} || ' -> ' || {_ID.format("target")} || ': ' || {_Q.format("label")} FROM edges)
SELECT string_agg(line, chr(10) ORDER BY section, k) || chr(10) AS diagram FROM lines""",
)
register(
    "render_l3_d2",
    _level(projection.component, lambda m, p: render.component_diagrams(p), keep=True),
    L3
    + f""", good AS (SELECT * FROM known WHERE foreign_id IS NULL OR kind IS NOT NULL),
lines AS (SELECT id AS container_id, 0 AS section, '' AS k, {_ID.format("id")} || ': ' || {_Q.format("id || '\\n[boundary]'")} || ' {{' AS line FROM containers
  UNION ALL SELECT container_id, 1, id, '  ' || {_ID.format("id")} || ': ' || {_Q.format("id || '\\n[component]'")} FROM components
  UNION ALL SELECT id, 2, '', '}}' FROM containers
  UNION ALL SELECT container_id, 3, foreign_id, {_ID.format("foreign_id")} || ': ' || {_Q.format("foreign_id || '\\n[reference-' || kind || ']'")} FROM (SELECT DISTINCT container_id, foreign_id, kind FROM good WHERE foreign_id IS NOT NULL)
  UNION ALL SELECT container_id, 4, source || ' -> ' || target,
    CASE WHEN sc IS NOT DISTINCT FROM container_id THEN {_ID.format("container_id")} || '.' ELSE '' END || {_ID.format("source")} || ' -> ' ||
    CASE WHEN tc IS NOT DISTINCT FROM container_id THEN {_ID.format("container_id")} || '.' ELSE '' END || {_ID.format("target")} || ': ' || {_Q.format("label || ' [' || technology || ']'")} FROM good)
SELECT container_id, string_agg(line, chr(10) ORDER BY section, k, line) || chr(10) AS diagram FROM lines GROUP BY container_id""",
)
register(
    "render_l4_d2",
    lambda s, d: render.code_diagrams(level4(s, d, keep=True), ("inherits",)),
    L4
    + f""", lines AS (SELECT DISTINCT component_id, 0 AS section, '' AS k, '# ' || component_id AS line FROM elements
  UNION ALL SELECT component_id, 1, id, {_ID.format("id")} || ': ' || {_Q.format("id")} FROM elements
  UNION ALL SELECT component_id, 2, target, {_ID.format("target")} || ': ' || {_Q.format("target || '\\n[cross-component]'")} FROM (SELECT DISTINCT component_id, target FROM far)
  UNION ALL SELECT component_id, CASE WHEN component_id <> tc THEN 4 ELSE 3 END, source || '->' || target || ':' || kind, {_ID.format("source")} || ' -> ' || {_ID.format("target")} || ': ' || kind FROM good WHERE kind <> 'inherits')
SELECT component_id, string_agg(line, chr(10) ORDER BY section, k, line) || chr(10) AS diagram FROM lines GROUP BY component_id""",
)
_CELLS = (
    L2
    + """, v AS (SELECT id, 'actor' AS kind, NULL AS parent_id FROM actors UNION ALL SELECT 'system', 'boundary', NULL UNION ALL SELECT id, 'external', NULL FROM externals
  UNION ALL SELECT id, 'container', 'system' FROM containers WHERE id IN (SELECT source FROM edges UNION SELECT target FROM edges)),
cells AS (SELECT id, id AS value, kind || ';managed=1' AS style, coalesce(parent_id, '1') AS parent, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target FROM v
  UNION ALL SELECT 'edge:' || source || '->' || target, label, 'edge;managed=1', '1', source, target FROM edges)
"""
)
register("drawio_cells", _level(projection.container, lambda m, p: render.cells(p.vertices, p.edges)), _CELLS + "SELECT * FROM cells")
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
register(
    "drawio_xml",
    _level(projection.container, lambda m, p: render.cells_xml(render.cells(p.vertices, p.edges))),
    _CELLS
    + f""", lines AS (SELECT 0 AS section, '' AS k, '<root>' AS line UNION ALL SELECT 3, '', '</root>'
  UNION ALL SELECT CASE WHEN source IS NULL THEN 1 ELSE 2 END, id, '<mxCell id="' || {_ESC.format("id")} || '" value="' || {_ESC.format("value")} || '" style="' || style || '" parent="' || parent || '"' ||
    CASE WHEN source IS NULL THEN ' vertex="1"' ELSE ' edge="1" source="' || source || '" target="' || target || '"' END || '/>' FROM cells)
SELECT string_agg(line, chr(10) ORDER BY section, k) || chr(10) AS xml FROM lines""",
)
register(
    "inject_once",
    lambda s, d: table(s, d, "pages").select("page_id", F.sha2(render.inject_once("html", "<i/>", "</article>"), 256).alias("h")),
    "SELECT page_id, sha256(CASE WHEN contains(html, '</article>') AND NOT contains(html, '<i/>') THEN regexp_replace(html, '^((?s:.*))</article>', '\\1<i/></article>') ELSE html END) AS h FROM pages",
)


# Technologies: languages by brand, dependencies by part.
_LANGS, _LIBS = ("java", "python", "typescript"), ("org.x:spring-boot-starter", "fastapi", "express", "lodash", "django-rest", "Flask")


def _technologies(spark, sf_dir):
    pick = lambda v, c: F.element_at(F.array(*map(F.lit, v)), (c % len(v) + 1).cast("int"))
    p = table(spark, sf_dir, "part")
    deps = F.array(pick(_LIBS, F.col("p_partkey")), pick(_LIBS, F.col("p_size").cast("long")))
    return p.select(F.col("p_partkey").alias("id"), rules.technology(pick(_LANGS, F.col("p_partkey")), deps).alias("technology"))


register(
    "technologies",
    _technologies,
    f"""WITH p AS (SELECT p_partkey AS id, {list(_LANGS)!r}[CAST(p_partkey % 3 + 1 AS INTEGER)] AS lang, list_transform([{list(_LIBS)!r}[CAST(p_partkey % 6 + 1 AS INTEGER)], {list(_LIBS)!r}[p_size % 6 + 1]], lambda d: lower(d)) AS deps FROM part)
SELECT id, upper(lang[1:1]) || lang[2:] || CASE WHEN len(list_filter(deps, lambda d: contains(d, 'spring-boot'))) > 0 THEN ' / Spring Boot' WHEN list_contains(deps, 'fastapi') THEN ' / FastAPI' WHEN list_contains(deps, 'flask') THEN ' / Flask'
  WHEN len(list_filter(deps, lambda d: starts_with(d, 'django'))) > 0 THEN ' / Django' WHEN list_contains(deps, 'express') THEN ' / Express' ELSE '' END AS technology FROM p""",
)


# Discovery: documents are files; some are build files.
def _discovered(spark, sf_dir):
    names = ("pom.xml", "build.gradle", "pyproject.toml", "CMakeLists.txt", "tsconfig.json", "notes.txt", "readme.md")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 7 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.floor(F.col("doc_id") / 9)), name).alias("path"))
    return project.discover(files, "(^|/)src3/")


register(
    "discover_projects",
    _discovered,
    """WITH f AS (SELECT source || '/' || lang || '/d' || (doc_id // 9) AS path, CAST(doc_id % 7 AS INTEGER) AS k FROM documents WHERE source <> 'src3'), r AS (SELECT path, min(k) AS k FROM f WHERE k < 5 GROUP BY path)
SELECT path, ['pom.xml', 'build.gradle', 'pyproject.toml', 'CMakeLists.txt', 'tsconfig.json'][k + 1] AS build_file, ['java', 'java', 'python', 'c', 'typescript'][k + 1] AS language FROM r""",
)


def _links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "source"))
    return projection.first_edges(hrefs, ["page_id", "source"], ["pos"])


register(
    "page_imports",
    _links,
    """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages), e AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS source FROM l)
SELECT page_id, CAST(min(pos) AS INTEGER) AS pos, source FROM e GROUP BY page_id, source""",
)

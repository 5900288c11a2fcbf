"""Queries of diagram geometry, order by locale, changes by group and analyzers as table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, groups, projection
from ..sources import analyzers, project
from . import adapters, trees
from .adapters import GRAPH_SQL, table
from .graph_queries import L2, L4, code_links
from .registry import register
from .source_queries import _FILES, _sql


# Polylines: an order's lines are the points, so some have one point, some points come twice in a row.
def _edges(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 500).cast("double").alias("x"), F.floor(F.col("l_suppkey") % 7 * 10).cast("double").alias("y"), "l_returnflag")
    points = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = line.groupBy("l_orderkey").agg(points.alias("points"), F.min("l_returnflag").alias("flag"))
    text = F.concat(F.repeat("flag", F.lit(1) + (F.col("l_orderkey") % 60).cast("int")), F.when(F.col("l_orderkey") % 3 == 0, "<br/>x").when(F.col("l_orderkey") % 3 == 1, "\nline\n").otherwise(""))
    rows = rows.withColumn("bounds", geometry.label_bounds(text)).withColumn("mid", geometry.midpoint(F.col("points")))
    x, y = (F.col("l_orderkey") % 97).cast("double") + 0.3, (F.col("l_orderkey") % 13).cast("double") + 0.3
    offset = geometry.label_offset(F.col("points"), x, y, F.col("bounds.width").cast("double"), F.col("bounds.height").cast("double"))
    return rows.withColumn("o", offset).select("l_orderkey", F.round("mid.x", 3).alias("x"), F.round("mid.y", 3).alias("y"), "bounds.width", "bounds.height", F.coalesce("o.dx", F.lit(0)).alias("dx"), F.coalesce("o.dy", F.lit(0)).alias("dy"))


register(
    "edge_geometry",
    _edges,
    """WITH r AS (SELECT l_orderkey, l_linenumber AS place, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey % 7 * 10 AS DOUBLE) AS y, l_returnflag FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, x, y) AS l_linenumber FROM r),
s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
d AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d FROM s),
c AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(d) OVER (PARTITION BY l_orderkey) / 2 AS half FROM d),
m AS (SELECT l_orderkey, arg_min({'x': CASE WHEN d IS NULL THEN x WHEN d = 0 THEN x ELSE x + (half - before) / d * (x2 - x) END, 'y': CASE WHEN d IS NULL OR d = 0 THEN y ELSE y + (half - before) / d * (y2 - y) END}, l_linenumber) FILTER (d IS NULL OR half <= before + d + 1e-9) AS mid FROM c GROUP BY l_orderkey),
t AS (SELECT l_orderkey, string_split(repeat(min(l_returnflag), CAST(1 + l_orderkey % 60 AS INTEGER)) || CASE l_orderkey % 3 WHEN 0 THEN chr(10) || 'x' WHEN 1 THEN chr(10) || 'line' || chr(10) ELSE '' END, chr(10)) AS lines FROM p GROUP BY l_orderkey),
b AS (SELECT l_orderkey, least(240, 7 * list_max(list_transform(lines, lambda l: len(l))) + 8) AS width, 18 * len(lines) AS height FROM t),
o AS (SELECT l_orderkey, mid, width, height, CAST(floor(l_orderkey % 97 + 0.3 + width / 2.0 - mid.x + 0.5) AS BIGINT) AS dx, CAST(floor(l_orderkey % 13 + 0.3 + height / 2.0 - mid.y + 0.5) AS BIGINT) AS dy FROM m JOIN b USING (l_orderkey))
SELECT l_orderkey, round(mid.x, 3) AS x, round(mid.y, 3) AS y, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height,
  CASE WHEN abs(dx) > 1 OR abs(dy) > 1 THEN dx ELSE 0 END AS dx, CASE WHEN abs(dx) > 1 OR abs(dy) > 1 THEN dy ELSE 0 END AS dy FROM o""",
)


def _sizes(spark, sf_dir):
    """The vertices of the level-2 diagram with the components inside of their containers."""
    m = adapters.graph(spark, sf_dir)
    p = projection.container(m.actors, m.externals, m.containers, m.components, m.relationships)
    parts = m.components.select("id", F.col("container_id").alias("parent"), F.lit(160).alias("width"), F.lit(60).alias("height"))
    kinds = F.col("kind")
    width = F.when(kinds == "boundary", 0).when(kinds == "actor", 120).otherwise(200)
    vertices = p.vertices.select("id", F.when(kinds == "container", "system").alias("parent"), width.alias("width"), F.when(kinds == "boundary", 0).otherwise(80).alias("height"))
    return geometry.vertex_sizes(vertices.unionByName(parts), p.edges)


register(
    "vertex_sizes",
    _sizes,
    L2
    + """, v AS (SELECT id, NULL AS parent, 120 AS w, 80 AS h FROM actors UNION ALL SELECT 'system', NULL, 200, 80 UNION ALL SELECT id, NULL, 200, 80 FROM externals
  UNION ALL SELECT id, 'system', 200, 80 FROM containers WHERE id IN (SELECT source FROM edges UNION SELECT target FROM edges) UNION ALL SELECT id, container_id, 160, 60 FROM components),
k AS (SELECT parent AS id, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY parent), g AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)
SELECT id, CAST(greatest(CASE WHEN k.n > 0 THEN greatest(2 * w, k.n * w) ELSE w END, CASE WHEN g.n >= 2 THEN floor(g.n * (w * 0.55) + 0.5) ELSE 0 END) AS BIGINT) AS width, CAST(CASE WHEN k.n > 0 THEN 3 * h ELSE h END AS BIGINT) AS height
FROM v LEFT JOIN k USING (id) LEFT JOIN g USING (id)""",
)


# Warnings of level 4: an element also refers to its part as the next line's supplier has it, who may not sell it.
def _l4_warnings(spark, sf_dir):
    elements_, links = code_links(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    id_ = lambda supplier: F.struct(F.col(supplier).alias("supplier"), F.col("l_partkey").alias("part"))
    after = adapters.next_lines(line, F.col("l_suppkey"))
    loose = after.select(id_("l_suppkey").alias("source"), id_("next.l_suppkey").alias("target")).distinct()
    loose = loose.select("source", "target", F.lit("uses").alias("kind"), F.lit(None).cast("string").alias("label"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    parts = [projection.code(elements_, each, known, keep=True, text=adapters.CODE_TEXT).warnings for each in (links, loose)]
    return parts[0].unionByName(parts[1]).distinct()


register(
    "project_l4_warnings",
    _l4_warnings,
    L4
    + """, loose AS (SELECT DISTINCT a.l_suppkey AS s, b.l_suppkey AS t, a.l_partkey AS p FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1),
every AS (SELECT source, target FROM good UNION SELECT 'supplier-' || s || '.part-' || p, 'supplier-' || t || '.part-' || p FROM loose)
SELECT DISTINCT CASE WHEN x.id IS NULL THEN 'L4: unknown source ' || source ELSE 'L4 ' || x.component_id || CASE WHEN y.id IS NULL THEN ': unknown target ' ELSE ': target of unknown component ' END || target END AS warning
FROM every LEFT JOIN elements x ON x.id = source LEFT JOIN elements y ON y.id = target
WHERE x.id IS NULL OR y.id IS NULL OR y.component_id NOT IN (SELECT 'supplier-' || c_custkey FROM customer)""",
)


# Names of parts as they are, in capitals, with capital first letters, and in capitals with accents.
def _names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = F.array("p_name", F.upper("p_name"), F.initcap("p_name"), F.translate(F.upper("p_name"), "AEU", "ÄÉÜ"))
    return p.select("p_brand", "p_size", F.explode(forms).alias("name")).distinct()


_NAMES = """f AS (SELECT DISTINCT p_brand, p_size, unnest([p_name, upper(p_name), array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' '), translate(upper(p_name), 'AEU', 'ÄÉÜ')]) AS name FROM part),
k AS (SELECT *, lower(strip_accents(name)) AS letters, translate(strip_accents(name), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS capitals FROM f)
"""
register(
    "names_in_locale",
    lambda s, d: projection.in_order(_names(s, d), ["p_brand", "p_size"], "name"),
    f"""WITH {_NAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY letters, name <> strip_accents(name), capitals) AS position FROM k)
SELECT p_brand, p_size, name, CAST(position AS INTEGER) AS position, first_value(name) OVER (PARTITION BY p_brand, p_size ORDER BY position) AS first FROM r""",
)
register(
    "names_of_same_letters",
    lambda s, d: projection.same_letters(_names(s, d), _names(s, d), "name"),
    f"""WITH {_NAMES}, n AS (SELECT DISTINCT name, letters FROM k) SELECT a.name, b.name AS other FROM n a JOIN n b ON a.letters = b.letters AND a.name <> b.name""",
)


# Updates of relationships by the nation of the line's supplier; some name ends that nobody knows, some come twice.
def _changes(spark, sf_dir):
    m, t = adapters.graph(spark, sf_dir), lambda n: table(spark, sf_dir, n)
    line = t("lineitem").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    group, brand = F.concat(F.lit("nation-"), "s_nationkey").alias("group"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    updates = line.select(group, F.concat(F.lit("supplier-"), "l_suppkey").alias("source"), brand.alias("target"), F.concat(F.lit("Sells "), F.when(F.col("l_suppkey") % 29 == 28, F.col("l_returnflag")).otherwise("all")).alias("new_label"), F.lit("").alias("new_technology")).distinct()
    elements_ = m.components.select(F.col("container_id").alias("group"), F.concat("id", F.lit(".main")).alias("id"), F.col("id").alias("component_id"), "container_id", F.lit("function").alias("kind"), F.lit(None).cast("array<string>").alias("members"), F.lit("main()").alias("signature"))
    n = F.regexp_extract("id", "-([0-9]+)[.]", 1).cast("int")
    proposed = elements_.withColumn("signature", F.when(n % 31 != 30, F.lit("main(args)"))).withColumn("container_id", F.when(n % 23 == 22, "nowhere").otherwise(F.col("container_id")))
    owners = m.components.select(F.col("id").alias("component_id"), "container_id")
    return m, groups.all_or_nothing(m.relationships, elements_, updates, proposed, owners, m.components.select("id").unionByName(m.externals.select("id")))


_CHANGES = f"""WITH {GRAPH_SQL}, u AS (SELECT DISTINCT 'nation-' || s_nationkey AS g, 'supplier-' || l_suppkey AS source, lower(replace(p_brand, '#', '-')) AS target, 'Sells ' || CASE WHEN l_suppkey % 29 = 28 THEN l_returnflag ELSE 'all' END AS label
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT *, CAST(id[10:] AS INTEGER) AS n FROM components),
bad AS (SELECT g, 'updated twice: ' || source || ' -> ' || target AS problem FROM u GROUP BY g, source, target HAVING count(*) > 1
  UNION SELECT container_id, 'other container: ' || id || '.main' FROM c WHERE n % 23 = 22 UNION SELECT container_id, 'wrong shape: ' || id || '.main' FROM c WHERE n % 31 = 30),
v AS (SELECT g, count(problem) = 0 AS taken, coalesce(string_agg(problem, '; ' ORDER BY problem), '') AS problems FROM (SELECT DISTINCT g FROM u UNION SELECT container_id FROM c) LEFT JOIN bad USING (g) GROUP BY g)
"""
register(
    "change_verdicts",
    lambda s, d: _changes(s, d)[1].verdicts.select("group", "taken", F.array_join("problems", "; ").alias("problems")),
    _CHANGES + """SELECT g AS "group", taken, problems FROM v""",
)
register(
    "changed_relationships",
    lambda s, d: _changes(s, d)[1].relationships,
    _CHANGES + "SELECT r.source, r.target, coalesce(x.label, r.label) AS label, r.technology FROM relationships r LEFT JOIN (SELECT u.* FROM u JOIN v USING (g) WHERE taken) x ON x.source = r.source AND x.target = r.target",
)
register(
    "changed_elements",
    lambda s, d: _changes(s, d)[1].elements.select("group", "id", "container_id", "signature"),
    _CHANGES + """SELECT container_id AS "group", id || '.main' AS id, container_id, CASE WHEN taken THEN 'main(args)' ELSE 'main()' END AS signature FROM c JOIN v ON g = container_id""",
)


# The library's languages as table functions.
def _plugged(spark, sf_dir):
    analyzers.register_own(spark)
    files = trees.files(spark, sf_dir)
    projects = analyzers.discover(files)
    found = analyzers.elements(project.owned_files(files, projects), projects)
    return found.select("project", "language", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce("line", F.lit(-1)).alias("line"), F.col("error").isNotNull().alias("failed"))


register(
    "plugin_elements",
    _plugged,
    _sql(_FILES + """SELECT project, 'java' AS language, 'S' || k AS name, 'class' AS kind, 5 AS line, false AS failed FROM x WHERE n % 4 = 0 UNION ALL SELECT project, 'java', 'Mode' || k, 'enum', 12, false FROM x WHERE n % 4 = 0
UNION ALL SELECT project, 'python', 'S' || k, 'class', 5, false FROM x WHERE n % 4 = 1 AND k IS NOT NULL UNION ALL SELECT project, 'python', '_helper' || k, 'function', 9, false FROM x WHERE n % 4 = 1 AND k IS NOT NULL
UNION ALL SELECT project, 'python', '-', '-', -1, true FROM x WHERE rel = 'bad.py'
UNION ALL SELECT project, 'typescript', 'S' || k, 'class', 3, false FROM x WHERE n % 4 = 2 UNION ALL SELECT project, 'typescript', 'make' || k, 'function', 8, false FROM x WHERE n % 4 = 2
UNION ALL SELECT project, 'typescript', 'Outside', 'class', 1, false FROM x WHERE n % 4 = 2
UNION ALL SELECT project, 'c', 'S' || k, 'struct', 1, false FROM x WHERE n % 4 = 3 AND module = 'include' UNION ALL SELECT project, 'c', 'make_' || k, 'function', CASE WHEN module = 'include' THEN 2 ELSE 6 END, false FROM x WHERE n % 4 = 3
UNION ALL SELECT project, 'c', 'own', 'function', 5, false FROM x WHERE n % 4 = 3 AND module = 'src'"""),
)

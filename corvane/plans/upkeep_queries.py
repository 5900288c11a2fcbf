"""Queries of what keeps a model whole: injection across applications, re-attached code, visible members, repaired text,
ordered outputs, and build files of trees that the nation table stands for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from ..operators import build, codemodel, model, outputs
from ..sources import project
from . import adapters
from .adapters import GRAPH_SQL, table
from .registry import register


# What applications tell of themselves is there (labels that end in F), the rest is derived, for containers too.
def _injected(spark, sf_dir):
    m = adapters.graph(spark, sf_dir, True)
    home = m.components.select(F.col("id").alias("part"), "container_id")
    calls = m.relationships.join(home.select(F.col("part").alias("source"), F.col("container_id").alias("s")), "source").join(home.select(F.col("part").alias("target"), F.col("container_id").alias("t")), "target")
    between = calls.where("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target"), F.lit("Uses").alias("label"), F.lit(None).cast("string").alias("technology")).distinct()
    there = m.relationships.where(F.endswith("label", F.lit("N")))
    return build.inject_cross_app(there, m.relationships.unionByName(between), m.containers, m.components).na.fill("-", ["technology"])


register(
    "inject_cross_app",
    _injected,
    f"""WITH {GRAPH_SQL}, calls AS (SELECT r.*, s.container_id AS s, t.container_id AS t FROM relationships r JOIN components s ON s.id = source JOIN components t ON t.id = target),
derived AS (SELECT source, target, label, technology FROM calls WHERE s <> t UNION ALL SELECT DISTINCT s, t, 'Uses', '-' FROM calls WHERE s <> t),
there AS (SELECT * FROM relationships WHERE label LIKE '%N')
SELECT source, target, label, coalesce(technology, '-') AS technology FROM there
UNION ALL SELECT source, target, label, coalesce(technology, '-') FROM derived d WHERE NOT EXISTS (FROM there t WHERE t.source = d.source AND t.target = d.target)""",
)


# Suppliers are modules; the components of a nation hold those of one letter of their balance's last digit each, and some hold none.
def _attached(spark, sf_dir):
    elements = adapters.code(spark, sf_dir).elements.withColumnRenamed("component_id", "module_id").withColumn("component_id", F.lit("old"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    nation = F.concat(F.lit("nation-"), "s_nationkey")
    parts = s.groupBy(nation.alias("container_id"), (F.col("s_suppkey") % 3).alias("k")).agg(F.collect_list(F.concat(F.lit("supplier-"), "s_suppkey")).alias("module_ids"))
    parts = parts.select(F.concat_ws("-", "container_id", F.col("k").cast("string")).alias("id"), "container_id", "module_ids")
    return build.attach_code(elements, parts).select("id", "module_id", "component_id", "container_id")


register(
    "attach_code",
    _attached,
    """SELECT DISTINCT 'supplier-' || l_suppkey || '.part-' || l_partkey AS id, 'supplier-' || l_suppkey AS module_id, 'nation-' || s_nationkey || '-' || (l_suppkey % 3) AS component_id, 'nation-' || s_nationkey AS container_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0""",
)


# A line's flag tells the visibility of a member of its order.
def _members(spark, sf_dir):
    shown = F.when(F.col("l_returnflag") == "R", "private").when(F.col("l_returnflag") == "A", "public")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("name"), shown.alias("visibility")))).alias("members"))
    own = codemodel.visible_members(F.col("members"))
    return rows.select("l_orderkey", F.array_join(F.transform(own, lambda m: m["name"].cast("string")), ",").alias("shown"), F.size(codemodel.visible_members(F.col("members"), True)).alias("n"))


register(
    "visible_members",
    _members,
    "SELECT l_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) FILTER (l_returnflag <> 'R'), '') AS shown, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey",
)


# Model text in which items ran together on a line, and whose tail may be unfinished.
def _repaired(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# model\ncomponents:\n  - id: a"), k, F.when(F.col("s_suppkey") % 2 == 0, F.lit(" - id: b")).otherwise(F.lit("\n  - id: b")), k, F.lit("\n    name: x"), F.when(F.col("s_suppkey") % 3 == 0, F.lit('\n    text: "cut o')).when(F.col("s_suppkey") % 3 == 1, F.lit("\n    descr")).otherwise(""))
    return outputs.repaired_yaml(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("content")))


register(
    "repaired_yaml",
    _repaired,
    """SELECT s_suppkey AS id, '# model' || chr(10) || 'components:' || chr(10) || '  - id: a' || s_suppkey || chr(10) || '  - id: b' || s_suppkey || chr(10) || '    name: x' AS content FROM supplier""",
)


# Outputs in their order.
register(
    "ordered_externals",
    lambda s, d: model.ordered_externals(adapters.graph(s, d).externals.select("id", "name")),
    f"WITH {GRAPH_SQL} SELECT id, name FROM externals ORDER BY name, id",
)


def _ordered_signals(spark, sf_dir):
    """For every file the lines of its signals, as a reader of the written rows meets them."""
    rows = signals.ordered(signals.detect(adapters.config_lines(spark, sf_dir))).withColumn("_at", F.monotonically_increasing_id())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_at", "line", "type"))), lambda r: F.concat_ws(" ", r["line"].cast("string"), r["type"]))
    return rows.groupBy("file").agg(F.array_join(lines, ";").alias("lines"))


def _signals_sql():
    from .config_queries import _SIGNALS

    return f"WITH {_SIGNALS} SELECT file, string_agg(line || ' ' || type, ';' ORDER BY line, type, pattern) AS lines FROM signals GROUP BY file"


register("ordered_signals", _ordered_signals, _signals_sql())


# A Gradle build a region with its nations as modules, some in folders of other names; requirements a nation.
def _builds(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    c, key = F.col, lambda x: F.col(x).cast("string")
    include = F.concat(F.lit("include ':n"), key("n"), F.lit("'\n"), F.when(c("n") % 3 == 0, F.concat(F.lit("project(':n"), key("n"), F.lit("').projectDir = file('modules/x"), key("n"), F.lit("')\n"))).otherwise(""))
    settings = n.groupBy("r").agg(F.concat(F.lit("rootProject.name = 'top'\n"), F.array_join(F.array_sort(F.collect_list(include)), "")).alias("content"))
    settings = settings.select(F.concat(F.lit("region-"), "r").alias("project"), F.lit("settings.gradle").alias("rel"), "content")
    lines = F.concat_ws("\n", F.lit("# tools"), F.concat(F.lit("lib-a=="), key("n"), F.lit(".1")), F.when(c("n") % 2 == 0, F.lit("  flask>=2 ")).otherwise(F.lit("-r other.txt")), F.lit(""), F.lit("plain"))
    requirements = n.select(F.concat(F.lit("nation-"), "n").alias("project"), F.lit("requirements.txt").alias("rel"), lines.alias("content"))
    return settings, requirements


register(
    "gradle_modules",
    lambda s, d: project.gradle_modules(_builds(s, d)[0]),
    "SELECT 'region-' || n_regionkey AS project, 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'modules/x' ELSE 'n' END || n_nationkey AS dir FROM nation",
)
register(
    "requirements",
    lambda s, d: project.dependencies(_builds(s, d)[1]).na.fill("-", ["version"]),
    """SELECT 'nation-' || n_nationkey AS project, 'lib-a' AS name, false AS internal, n_nationkey || '.1' AS version FROM nation
UNION ALL SELECT 'nation-' || n_nationkey, 'flask', false, '2' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'nation-' || n_nationkey, 'plain', false, '-' FROM nation""",
)

"""Queries of planned outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import model, outputs
from . import adapters
from .adapters import CONFIG_SQL, GRAPH_SQL, table
from .model_queries import _ANNOTATED, _ROLE, _annotated
from .registry import register


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.floor(F.col("doc_id") / 4)), F.col("doc_id").cast("string")).alias("path"), "doc_id")


_PATHS = "p AS (SELECT source || '/' || lang || '/d' || (doc_id // 4) || '/' || doc_id AS path, doc_id FROM documents)"
register("create_once", lambda s, d: outputs.create_once(_paths(s, d), _paths(s, d).where("doc_id % 3 = 0")).select("path"), f"WITH {_PATHS} SELECT path FROM p WHERE doc_id % 3 <> 0")
register(
    "prune_plan",
    lambda s, d: outputs.prune(_paths(s, d).select("path"), _paths(s, d).where("doc_id % 5 <> 0").select("path")),
    f"""WITH {_PATHS}, d AS (SELECT doc_id, unnest(range(1, len(string_split(path, '/')))) AS depth, string_split(path, '/') AS s FROM p)
SELECT array_to_string(s[1:depth], '/') AS dir, CAST(depth AS INTEGER) AS depth FROM d GROUP BY ALL HAVING count(*) FILTER (doc_id % 5 = 0) = 0""",
)


def _containers(spark, sf_dir):
    c = adapters.graph(spark, sf_dir).containers
    top = c.select(F.substring_index("path", "/", 1).alias("id"), F.substring_index("path", "/", 1).alias("path")).distinct()
    every = c.select("id", "path").unionByName(top)
    return outputs.container_outputs(every, c.where("name LIKE 'NATION_1%'").select("id"), model.aggregators(every))


register(
    "container_outputs",
    _containers,
    f"WITH {GRAPH_SQL} SELECT id, path, path || '/docs/' || lower(id) AS output FROM containers WHERE NOT name LIKE 'NATION_1%'",
)
register(
    "customised_lines",
    lambda s, d: outputs.customised(adapters.config_lines(s, d), r"^\[section"),
    f"WITH {CONFIG_SQL}, l AS (SELECT *, coalesce(max(CASE WHEN starts_with(text, '[section') THEN line END) OVER (PARTITION BY file), 0) AS last FROM config) SELECT file, line, text FROM l WHERE line > last",
)


def _summary(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    notes = F.when(F.col("p_partkey") % 2 == 0, F.col("annotations")).otherwise("")
    exports = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), "p_partkey")))
    return outputs.lean_summary(rows.select(F.col("p_brand").alias("app_id"), "module_id", exports.alias("exports"), notes.alias("notes")))


register(
    "lean_summary",
    _summary,
    f"""WITH {_ANNOTATED} SELECT p_brand AS app_id, '[' || string_agg('{{"module_id":"' || module_id || '"' || CASE WHEN p_partkey % 5 <> 0 THEN ',"exports":["E' || p_partkey || '"]' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN ',"notes":"' || annotations || '"' ELSE '' END || '}}', ',' ORDER BY module_id) || ']' AS summary FROM a GROUP BY p_brand""",
)


def _labels(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    role = rules.role(F.col("annotations"))
    return rows.select("module_id", rules.relationship_label(role, F.lit("repository")).alias("label"), rules.component_technology(F.col("annotations"), F.lit(""), F.lit("java")).alias("technology"), rules.role_description(F.col("module_id"), F.col("annotations")).alias("description"))


register(
    "component_labels",
    _labels,
    f"""WITH {_ANNOTATED}, {_ROLE} SELECT module_id, CASE WHEN role = 'controller' THEN 'Delegates to' ELSE 'Persists via' END AS label,
  'Java' || CASE role WHEN 'controller' THEN ' REST Controller' WHEN 'listener' THEN ' Message Listener' WHEN 'repository' THEN ' Repository' WHEN 'service' THEN ' Service' ELSE '' END AS technology,
  CASE role WHEN 'controller' THEN 'REST API controller for ' || module_id WHEN 'service' THEN 'Business logic service for ' || module_id WHEN 'repository' THEN 'Data access layer for ' || module_id
    WHEN 'listener' THEN 'Message listener for ' || module_id ELSE module_id || ' module' END AS description FROM roles""",
)

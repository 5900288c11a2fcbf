"""Queries of the code model: resolution, visibility, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codemodel, validate
from . import adapters
from .adapters import CODE_SQL, GRAPH_SQL
from .graph_queries import RESOLVE_SQL, resolved
from .registry import register


def _on(f):
    return lambda spark, sf_dir: f(adapters.code(spark, sf_dir))


def _references(spark, sf_dir):
    rows = resolved(adapters.code_keys(spark, sf_dir))
    ids = {c: adapters.element_text(F.col(c)) for c in ("element_id", "target_id")}
    return rows.withColumns(ids | {"component_id": adapters.component_text(F.col("component_id")), "container_id": F.concat(F.lit("nation-"), "container_id")})


def _breakdown(spark, sf_dir):
    c = adapters.code_keys(spark, sf_dir)
    return codemodel.unresolved_breakdown(c.elements, resolved(c)).withColumn("component_id", adapters.component_text(F.col("component_id")))


register("resolve_references", _references, f"WITH {RESOLVE_SQL} SELECT * FROM resolved")
register(
    "unresolved_breakdown",
    _breakdown,
    f"""WITH {RESOLVE_SQL}, owners AS (SELECT name, min(container_id) AS c0, max(container_id) AS c1 FROM elements GROUP BY name),
causes AS (SELECT r.component_id, CASE WHEN o.c0 IS NOT NULL AND (o.c0 <> r.container_id OR o.c1 <> r.container_id) THEN 'cross-container' ELSE 'outside' END AS cause
           FROM resolved r LEFT JOIN owners o ON o.name = r.target_name WHERE r.target_id IS NULL)
SELECT component_id, cause, count(*) AS n FROM causes GROUP BY component_id, cause UNION ALL SELECT NULL, cause, count(*) FROM causes GROUP BY cause""",
)
register(
    "code_min_elements",
    _on(lambda c: codemodel.enough(codemodel.visible(c.elements), 150).select("id", "component_id", "visibility")),
    f"WITH {CODE_SQL}, v AS (SELECT * FROM elements WHERE visibility = 'public') SELECT id, component_id, visibility FROM v QUALIFY count(*) OVER (PARTITION BY component_id) >= 150",
)
register(
    "dominant_kind",
    _on(lambda c: codemodel.dominant(c.elements, "component_id", "kind", list(adapters.KINDS))),
    f"""WITH {CODE_SQL}, n AS (SELECT component_id, kind, count(*) AS n FROM elements GROUP BY ALL)
SELECT component_id, kind AS dominant, n FROM n QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY n DESC, list_position(['class', 'interface', 'function', 'struct', 'enum'], kind)) = 1""",
)
register(
    "element_ids",
    _on(lambda c: codemodel.disambiguated(c.elements)),
    f"""WITH {CODE_SQL}, p AS (SELECT *, component_id || '.' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS plain FROM elements),
u AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY plain) > 1 THEN plain || '-' || regexp_replace(lower(qualified_name), '[^a-z0-9]+', '-', 'g') ELSE plain END AS u FROM p),
r AS (SELECT id, u, row_number() OVER (PARTITION BY u ORDER BY id) AS rn FROM u)
SELECT id, CASE WHEN rn > 1 THEN u || '-' || rn ELSE u END AS unique_id FROM r""",
)
register(
    "validate_duplicates",
    _on(lambda c: validate.duplicates(c.elements.select("name", "id"), "name", "id")),
    f"WITH {CODE_SQL} SELECT name AS key, n, first_id FROM (SELECT name, count(*) AS n, min(id) AS first_id FROM elements GROUP BY name) WHERE n > 1",
)


def _foreign(spark, sf_dir):
    m = adapters.graph(spark, sf_dir)
    known = m.actors.select("id").unionByName(m.externals.select("id")).unionByName(m.containers.select("id")).unionByName(m.components.select("id"))
    return validate.missing_ends(m.relationships, known)


register(
    "validate_foreign_keys",
    _foreign,
    f"""WITH {GRAPH_SQL}, known AS (SELECT id FROM actors UNION SELECT id FROM externals UNION SELECT id FROM containers UNION SELECT id FROM components)
SELECT source, target, 'source' AS missing FROM relationships WHERE source NOT IN (FROM known) UNION ALL SELECT source, target, 'target' FROM relationships WHERE target NOT IN (FROM known)""",
)


def _owners(spark, sf_dir):
    m, c = adapters.graph(spark, sf_dir), adapters.code(spark, sf_dir)
    return validate.owner_mismatches(c.elements, m.components.where("NOT id LIKE '%7'").withColumnRenamed("id", "component_id"))


register(
    "validate_owners",
    _owners,
    f"""WITH {GRAPH_SQL}, {CODE_SQL}, known AS (SELECT * FROM components WHERE NOT id LIKE '%7')
SELECT e.id, CASE WHEN k.id IS NULL THEN 'unknown component' ELSE 'other container' END AS problem FROM elements e LEFT JOIN known k ON k.id = e.component_id
WHERE (k.id IS NULL OR k.container_id <> e.container_id)""",
)
register(
    "validate_shapes",
    _on(lambda c: validate.wrong_shapes(c.elements.selectExpr("id", "kind", "if(visibility = 'public', array(name), null) AS members", "if(visibility = 'private', null, name) AS signature"))),
    f"""WITH {CODE_SQL}, s AS (SELECT id, kind, CASE WHEN visibility = 'public' THEN [name] END AS members, CASE WHEN visibility = 'private' THEN NULL ELSE name END AS signature FROM elements)
SELECT id, kind FROM s WHERE CASE WHEN kind IN ('class', 'interface', 'struct', 'enum') THEN members IS NULL ELSE signature IS NULL END""",
)

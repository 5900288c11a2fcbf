"""Queries that write documents into the shared folder, read them back, and discover projects by globs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outputs, projection, render
from ..sources import files as trees_of_files
from ..sources import project
from ..sources.store import scratch, stored
from . import adapters, render_queries, trees  # noqa: F401  their SQL is part of this one
from .adapters import table
from .graph_queries import _ID, _Q, level4
from .registry import ORACLES, register

STYLES = "classes: {\\n  component: { shape: rectangle }\\n}\\n".replace("\\n", "\n")
SETTINGS, ROOT_OUTPUT = "settings.yaml", "docs/architecture"
LEAST_ELEMENTS = 3


def _documents(spark, sf_dir):
    """The documents of all containers, written twice and read back: the second time nothing differs."""
    m, code = adapters.graph(spark, sf_dir, keep=True), level4(spark, sf_dir, keep=True)
    level3 = render.component_lines(projection.component(m.actors, m.externals, m.containers, m.components, m.relationships))
    counts = code.elements.groupBy("component_id").agg(F.count("*").alias("n"))
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("component_id"), F.concat(F.lit("nation-"), "s_nationkey").alias("container_id"), F.col("s_name").alias("name"))
    large = counts.where(F.col("n") >= LEAST_ELEMENTS).join(home, "component_id").drop("n")
    drawn = render.code_lines(code, ("inherits",), large)
    parts = outputs.fragment_lines(m.containers, m.components, m.relationships)
    # What is read by both runs and takes several shuffles is made once; diagrams of components are written where they are.
    lines = stored(outputs.common_lines(m.containers, level3, parts, STYLES, SETTINGS, ROOT_OUTPUT, drawn), "lines")
    placed = outputs.component_pieces(m.containers, drawn)
    root = scratch(spark, "documents")
    for _ in range(2):
        trees_of_files.write_lines(lines, root, placed)
    return trees_of_files.read_hashes(spark, root)


_HEAD = "c.path || '/docs/architecture/"
register(
    "write_documents",
    _documents,
    f"""WITH {adapters.GRAPH_SQL}, {adapters.CODE_SQL},
level3 AS MATERIALIZED (SELECT * FROM ({ORACLES["render_l3_d2"]})), level4 AS MATERIALIZED (SELECT * FROM ({ORACLES["render_l4_d2"]})),
sizes AS (SELECT component_id, count(*) AS n FROM elements GROUP BY component_id),
ends AS (SELECT DISTINCT h.container_id, r.source, r.target, r.label FROM relationships r JOIN components h ON h.id = r.source OR h.id = r.target),
rows AS (SELECT id AS container_id, 0 AS s, '' AS k, 'containers:' AS line FROM containers
  UNION ALL SELECT id, 1, id, '  - id: ' || {_Q.format("id")} || chr(10) || '    name: ' || {_Q.format("name")} FROM containers
  UNION ALL SELECT id, 2, '', 'components:' FROM containers
  UNION ALL SELECT container_id, 3, id, '  - id: ' || {_Q.format("id")} || chr(10) || '    name: ' || {_Q.format("name")} FROM components
  UNION ALL SELECT id, 4, '', 'relationships:' FROM containers
  UNION ALL SELECT container_id, 5, source || chr(1) || target, '  - source: ' || {_Q.format("source")} || chr(10) || '    target: ' || {_Q.format("target")} || chr(10) || '    label: ' || {_Q.format("label")} FROM ends),
parts AS (SELECT container_id, string_agg(line, chr(10) ORDER BY s, k) || chr(10) AS content FROM rows GROUP BY container_id),
files AS (
  SELECT path || '/{SETTINGS}' AS path, '# Settings of this folder; they go before those of folders above.' || chr(10) AS content FROM containers
  UNION ALL SELECT {_HEAD}_generated/c3-component.d2', diagram FROM containers c JOIN level3 ON container_id = id
  UNION ALL SELECT {_HEAD}styles.d2', 'classes: {{' || chr(10) || '  component: {{ shape: rectangle }}' || chr(10) || '}}' || chr(10) FROM containers c
  UNION ALL SELECT {_HEAD}c3-component.d2', array_to_string(['# Components of ' || name, '# The whole system: ../../../../docs/architecture/c2-container.svg', '', '...@_generated/c3-component.d2', '...@styles.d2', '', '# Your own additions go below this line', ''], chr(10))
    FROM containers c JOIN level3 ON container_id = id
  UNION ALL SELECT {_HEAD}architecture-model.yaml', '# The part of the model that concerns this folder; written anew at every run.' || chr(10) || content FROM containers c JOIN parts ON container_id = id
  UNION ALL SELECT {_HEAD}components/' || p.id || '/_generated/c4-code.d2', diagram FROM containers c JOIN components p ON p.container_id = c.id JOIN sizes ON sizes.component_id = p.id AND n >= {LEAST_ELEMENTS} JOIN level4 l ON l.component_id = p.id
  UNION ALL SELECT {_HEAD}components/' || p.id || '/c4-code.d2', array_to_string(['# Code of ' || p.name || ' in ' || c.name, '', '...@_generated/c4-code.d2', '...@../../styles.d2', '', '# Your own additions go below this line', ''], chr(10))
    FROM containers c JOIN components p ON p.container_id = c.id JOIN sizes ON sizes.component_id = p.id AND n >= {LEAST_ELEMENTS} JOIN level4 l ON l.component_id = p.id)
SELECT path, sha256(content) AS hash FROM files""",
)

INCLUDE, EXCLUDE = ("apps/n{1,2}*", "apps/n@(4|7)", "./apps/n[0-35]"), ("**/n1[!5-9]/**", "apps/n2/tsconfig.json", "apps/*/setup.py")
register(
    "discover_by_globs",
    lambda s, d: project.discover_within(trees.files(s, d), INCLUDE, EXCLUDE),
    """WITH n AS (SELECT n_nationkey AS n FROM nation WHERE n_nationkey IN (0, 1, 3, 4, 5, 7) OR n_nationkey BETWEEN 15 AND 24)
SELECT 'apps/n' || n AS path, CASE WHEN n % 8 = 0 THEN 'pom.xml' WHEN n % 8 = 4 THEN 'build.gradle' WHEN n % 4 = 1 THEN 'pyproject.toml' WHEN n % 4 = 2 THEN 'tsconfig.json' ELSE 'CMakeLists.txt' END AS build_file,
  ['java', 'python', 'typescript', 'c'][CAST(n % 4 + 1 AS INTEGER)] AS language FROM n""",
)

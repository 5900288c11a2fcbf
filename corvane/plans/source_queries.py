"""Queries over the source trees that the supplier table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import build
from ..sources import elements, project
from ..sources.store import stored
from . import trees
from .registry import register
from .trees import SUPPLIERS_SQL


class _Tree:
    """The files of the trees, their projects, and the files with their project."""

    def __init__(self, spark, sf_dir):
        self.files = stored(trees.files(spark, sf_dir), "files")
        self.projects = project.discover(self.files)
        self.owned = project.owned_files(self.files, self.projects)

    @property
    def sources(self) -> DataFrame:
        return project.sources(self.owned, self.projects)


def _on(f):
    return lambda spark, sf_dir: f(_Tree(spark, sf_dir))


def _sql(query: str) -> str:
    return f"WITH {SUPPLIERS_SQL}, {query}" if query.startswith("x ") else f"WITH {SUPPLIERS_SQL} {query}"


register(
    "tree_projects",
    _on(lambda t: t.projects),
    _sql("""SELECT project AS path, CASE WHEN n % 8 = 0 THEN 'pom.xml' WHEN n % 8 = 4 THEN 'build.gradle' WHEN n % 4 = 1 THEN 'pyproject.toml' WHEN n % 4 = 2 THEN 'tsconfig.json' ELSE 'CMakeLists.txt' END AS build_file,
  ['java', 'python', 'typescript', 'c'][n % 4 + 1] AS language FROM nat"""),
)
register(
    "tree_classify",
    _on(lambda t: project.classify(t.projects, t.owned)),
    _sql("""SELECT project AS path, CASE WHEN n % 16 = 8 OR n % 8 = 5 OR n % 8 = 3 THEN 'library' ELSE 'container' END AS type FROM nat"""),
)
register(
    "tree_config_files",
    _on(lambda t: project.config_files(t.owned).select("project", "file", F.length("content").alias("size"))),
    _sql("""SELECT project, 'config/app.properties' AS file, CAST(length('db.url=jdbc:mysql://h' || n || '/db') + 1 AS INTEGER) AS size FROM nat
  UNION ALL SELECT project, 'pom.xml', CAST(length('<project><parent><artifactId>top</artifactId></parent><artifactId>svc-' || n || '</artifactId><packaging>war</packaging><dependencies><dependency><groupId>org.lib</groupId><artifactId>l0</artifactId><version>1.' || n || '</version></dependency><dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId></dependency></dependencies></project>') + 3 AS INTEGER) FROM nat WHERE n % 8 = 0
  UNION ALL SELECT project, 'pyproject.toml', CAST(length('[project]dependencies = [  "fastapi>=0.' || n || '",  "kafka-lib0"]' || CASE WHEN n % 8 = 1 THEN '[project.scripts]run = "x:main"' ELSE '' END) + CASE WHEN n % 8 = 1 THEN 7 ELSE 6 END AS INTEGER) FROM nat WHERE n % 4 = 1
  UNION ALL SELECT project, 'tsconfig.json', CAST(CASE WHEN n % 8 = 2 THEN length('{ // root "compilerOptions": {"rootDir": "./src"} }') + 1 ELSE length('{"include": ["lib/*"]}') END AS INTEGER) FROM nat WHERE n % 4 = 2
  UNION ALL SELECT project, 'package.json', CAST(length('{"name": "@org/n' || n || '", "dependencies": {"express": "^4.' || n || '", "shared": "file:../n' || (n + 4) || '"}, "devDependencies": {"jest": "1"}, "scripts": {"start": "node 0server.js"}}') AS INTEGER) FROM nat WHERE n % 4 = 2"""),
)
register("tree_source_roots", _on(lambda t: project.source_roots(t.owned, t.projects)), _sql("SELECT project, CASE WHEN NOT EXISTS (SELECT 1 FROM sup WHERE sup.n = nat.n) THEN '' WHEN n % 8 = 2 THEN 'src' ELSE 'lib' END AS root FROM nat WHERE n % 4 = 2"))

#: A row per source file: project, rel, module.
_FILES = """x AS (
  SELECT k, n, nk, nn, 'apps/n' || n AS project, 'src/main/java/com/n' || n || '/p' || (k % 3) || '/S' || k || '.java' AS rel, 'com.n' || n || '.p' || (k % 3) AS module, 'S' || k AS exports FROM sup WHERE n % 4 = 0
  UNION ALL SELECT k, n, nk, nn, 'apps/n' || n, 'pkg' || (k % 2) || '/m' || k || '.py', 'pkg' || (k % 2), 'S' || k FROM sup WHERE n % 4 = 1
  UNION ALL SELECT k, n, nk, nn, 'apps/n' || n, CASE WHEN n % 8 = 2 THEN 'src' ELSE 'lib' END || '/f' || (k % 2) || '/s' || k || '.ts', 'f' || (k % 2), 'S' || k || ',make' || k FROM sup WHERE n % 4 = 2
  UNION ALL SELECT k, n, nk, nn, 'apps/n' || n, 'include/s' || k || '.h', 'include', 's' || k FROM sup WHERE n % 4 = 3
  UNION ALL SELECT k, n, nk, nn, 'apps/n' || n, 'src/s' || k || '.c', 'src', NULL FROM sup WHERE n % 4 = 3
  UNION ALL SELECT NULL, n, NULL, NULL, project, 'bad.py', 'bad', NULL FROM nat WHERE n % 8 = 1)
"""
_joined = lambda c, mark=",": F.array_join(c, mark)
register(
    "tree_modules",
    _on(lambda t: project.modules(t.sources).select("project", "module", _joined("files").alias("files"), _joined("exports").alias("exports"), "annotations", "framework")),
    _sql(_FILES + """SELECT project, module, string_agg(rel, ',' ORDER BY rel) AS files, coalesce(string_agg(exports, ',' ORDER BY rel), '') AS exports,
  CASE WHEN n % 4 = 0 THEN 'Service' ELSE '' END AS annotations, CASE WHEN n % 4 = 1 AND bool_or(coalesce(k % 3 = 0, false)) THEN 'fastapi' END AS framework FROM x GROUP BY project, module, n"""),
)
register(
    "tree_imports",
    _on(lambda t: project.module_imports(t.sources)),
    _sql(_FILES + """, i AS (
  SELECT project, module, 'com.n' || nn || '.p' || (nk % 3) || '.S' || nk AS source, nn <> n AS is_external FROM x WHERE n % 4 = 0
  UNION ALL SELECT project, module, 'org.lib.L' || (k % 5), true FROM x WHERE n % 4 = 0
  UNION ALL SELECT project, module, unnest(['os', 'lib' || (k % 5) || '.x']), true FROM x WHERE n % 4 = 1 AND k IS NOT NULL
  UNION ALL SELECT project, module, 'fastapi', true FROM x WHERE n % 4 = 1 AND k % 3 = 0
  UNION ALL SELECT project, module, 'pkg' || (nk % 2) || '.m' || nk, NOT EXISTS (SELECT 1 FROM sup WHERE sup.n = x.n AND sup.k % 2 = x.nk % 2) FROM x WHERE n % 4 = 1 AND k IS NOT NULL
  UNION ALL SELECT project, module, './s' || nk, false FROM x WHERE n % 4 = 2
  UNION ALL SELECT project, module, CASE WHEN k % 2 = 0 THEN 'express/lib' ELSE 'koa' END, true FROM x WHERE n % 4 = 2
  UNION ALL SELECT project, module, unnest(['s' || k || '.h', 'stdio.h', 's' || nk || '.h']), unnest([false, true, nn <> n]) FROM x WHERE n % 4 = 3 AND module = 'src')
SELECT DISTINCT project, module, source, is_external FROM i"""),
)
register("tree_frameworks", _on(lambda t: project.ts_frameworks(t.sources, project.dependencies(t.owned))), _sql("SELECT DISTINCT 'apps/n' || n AS project, 'f0' AS module, 'Express' AS framework FROM sup WHERE n % 4 = 2 AND k % 2 = 0"))
register(
    "tree_c_structure",
    _on(lambda t: project.c_structure(t.sources).select("project", "path", "name", _joined("headers").alias("headers"), _joined("sources").alias("sources"))),
    _sql(_FILES + "SELECT project, module AS path, module AS name, coalesce(string_agg(rel, ',' ORDER BY rel) FILTER (module = 'include'), '') AS headers, coalesce(string_agg(rel, ',' ORDER BY rel) FILTER (module = 'src'), '') AS sources FROM x WHERE n % 4 = 3 GROUP BY project, module"),
)
register(
    "tree_dependencies",
    _on(lambda t: project.dependencies(t.owned)),
    _sql("""SELECT project, 'org.lib:l' || (n % 2) AS name, false AS internal, CASE WHEN n % 8 = 0 THEN '1.' ELSE '2.' END || n AS version FROM nat WHERE n % 4 = 0
  UNION ALL SELECT project, CASE WHEN n % 8 = 0 THEN 'org.postgresql:postgresql' ELSE 'redis:jedis' END, false, NULL FROM nat WHERE n % 4 = 0
  UNION ALL SELECT project, unnest(['fastapi', 'kafka-lib' || (n % 2)]), false, NULL FROM nat WHERE n % 4 = 1
  UNION ALL SELECT project, 'express', false, '4.' || n FROM nat WHERE n % 4 = 2 UNION ALL SELECT project, 'shared', true, NULL FROM nat WHERE n % 4 = 2"""),
)
register("tree_internal_imports", _on(lambda t: project.internal_imports(t.owned, t.projects)), _sql("SELECT project, 'apps/n' || (n + 4) AS target FROM nat WHERE n % 4 = 2 OR n % 8 = 4"))
register(
    "tree_applications",
    _on(lambda t: project.applications(t.owned, t.projects)),
    _sql("""SELECT project, 'apps-n' || n AS app_id, CASE WHEN n % 8 = 0 THEN 'svc-' || n WHEN n % 4 = 2 THEN '@org/n' || n ELSE 'n' || n END AS name, ['java', 'python', 'typescript', 'c'][n % 4 + 1] AS language,
  CASE WHEN n % 8 = 0 THEN 'pom.xml' WHEN n % 8 = 4 THEN 'build.gradle' WHEN n % 4 = 1 THEN 'pyproject.toml' WHEN n % 4 = 2 THEN 'tsconfig.json' ELSE 'CMakeLists.txt' END AS build_file,
  CASE WHEN n % 8 = 4 THEN 'com.org:n' || n WHEN n % 4 = 2 THEN '@org/n' || n END AS published_as FROM nat"""),
)


def _shown(parsed: DataFrame) -> DataFrame:
    words = lambda *c: F.concat_ws(" ", *c)  # noqa: E731  leaves nulls out
    members = F.transform("members", lambda m: words(m["kind"], m["visibility"], m["signature"]))
    refs = F.transform("refs", lambda r: words(r["kind"], r["name"], r["qualified_name"]))
    return parsed.where("error IS NULL").select("project", "rel", "module", "name", "kind", "qualified_name", "visibility", _joined(members, ";").alias("members"), _joined(refs, ";").alias("refs"), "line")


def _elements(language):
    return _on(lambda t: _shown(elements.merged_c(elements.elements(t.sources.where(F.col("language") == language)))))


_HEAD = "SELECT project, rel, module, "
register(
    "java_elements",
    _elements("java"),
    _sql(_FILES + _HEAD + """'S' || k AS name, 'class' AS kind, module || '.S' || k AS qualified_name, 'public' AS visibility,
  'field private next: S' || nk || ';field internal name: String;method public find(S' || nk || ' other, int n): List<Item' || (k % 4) || '>;method internal reset(): void' AS members,
  'extends Base' || (k % 2) || ' ' || module || '.Base' || (k % 2) || ';implements Api' || (k % 3) || ' ' || module || '.Api' || (k % 3) || ';uses S' || nk || ' com.n' || nn || '.p' || (nk % 3) || '.S' || nk
    || ';uses List ' || module || '.List;uses Item' || (k % 4) || ' ' || module || '.Item' || (k % 4) AS refs, CAST(5 AS INTEGER) AS line FROM x WHERE n % 4 = 0
UNION ALL """ + _HEAD + "'Mode' || k, 'enum', module || '.Mode' || k, 'internal', '', '', 12 FROM x WHERE n % 4 = 0"),
)
register(
    "python_elements",
    _elements("python"),
    _sql(_FILES + _HEAD + """'S' || k AS name, 'class' AS kind, CAST(NULL AS VARCHAR) AS qualified_name, 'public' AS visibility, 'method public find(self, other: S' || nk || ', n: int) -> ''m.Item' || (k % 4) || '''' AS members,
  'extends Base' || (k % 2) || ';uses S' || nk || ';uses Item' || (k % 4) AS refs, CAST(5 AS INTEGER) AS line FROM x WHERE n % 4 = 1 AND k IS NOT NULL
UNION ALL """ + _HEAD + "'_helper' || k, 'function', NULL, 'private', '', '', 9 FROM x WHERE n % 4 = 1 AND k IS NOT NULL"),
)
register(
    "typescript_elements",
    _elements("typescript"),
    _sql(_FILES + _HEAD + """'S' || k AS name, 'class' AS kind, CAST(NULL AS VARCHAR) AS qualified_name, 'public' AS visibility,
  'field private next: S' || nk || ';field private db: Db' || (k % 3) || ';method public constructor(private readonly db: Db' || (k % 3) || ', n: number);method public find(id: string): Promise<Item' || (k % 4) || '>' AS members,
  'extends Base' || (k % 2) || ';uses S' || nk || ';uses Db' || (k % 3) || ';uses Item' || (k % 4) AS refs, CAST(3 AS INTEGER) AS line FROM x WHERE n % 4 = 2
UNION ALL """ + _HEAD + "'make' || k, 'function', NULL, 'public', '', '', 8 FROM x WHERE n % 4 = 2"),
)
register(
    "c_elements",
    _elements("c"),
    _sql(_FILES + _HEAD + """'S' || k AS name, 'struct' AS kind, CAST(NULL AS VARCHAR) AS qualified_name, 'public' AS visibility, 'field id: int;field next: struct S' || nk || ';field item: Item' || (k % 4) AS members,
  'contains S' || nk || ';contains Item' || (k % 4) AS refs, CAST(1 AS INTEGER) AS line FROM x WHERE n % 4 = 3 AND module = 'include'
UNION ALL """ + _HEAD + "'make_' || k, 'function', NULL, 'public', '', '', CASE WHEN module = 'include' THEN 2 ELSE 6 END FROM x WHERE n % 4 = 3 UNION ALL " + _HEAD + "'own', 'function', NULL, 'private', '', 'uses S' || k, 5 FROM x WHERE n % 4 = 3 AND module = 'src'"),
)
register(
    "element_failures",
    _on(lambda t: elements.failures(elements.elements(t.sources), t.sources)),
    _sql(_FILES + "SELECT ['java', 'python', 'typescript', 'c'][n % 4 + 1] AS language, count(*) AS files, count(*) FILTER (rel = 'bad.py') AS failed, count(*) = count(*) FILTER (rel = 'bad.py') AS systemic FROM x GROUP BY n % 4"),
)


# Models built from the trees: container projects are applications, library projects are libraries.
def _built(part, granularity="balanced"):
    def query(t):
        spark = t.files.sparkSession
        kinds = project.classify(t.projects, t.owned)
        main = t.projects.join(kinds.where("type = 'container'").select("path"), "path", "left_semi")
        shared = project.applications(t.owned, t.projects).join(kinds.where("type = 'library'").select(F.col("path").alias("project")), "project", "left_semi")
        declared = spark.createDataFrame([("Redis", "Cache", ["apps-n4", "ghost"], 0)], "name string, technology string, used_by array<string>, ord int")
        main, owned = stored(main, "projects"), stored(t.owned, "owned")
        scan = build.scan_tree(owned.join(main.select(F.col("path").alias("project")), "project", "left_semi"), main)
        return getattr(build.Builder(scan, declared, shared.select(F.col("app_id").alias("id"), "name", "language"), granularity), part)

    return _on(query)


_MODEL = _FILES + """, app AS (SELECT n, project, 'apps-n' || n AS id, ['java', 'python', 'typescript', 'c'][n % 4 + 1] AS language, CASE WHEN n % 8 = 0 THEN 'Svc ' || n WHEN n % 4 = 2 THEN '@org/n' || n ELSE 'N' || n END AS shown,
  NOT (n % 16 = 8 OR n % 8 = 5 OR n % 8 = 3) AS main FROM nat),
m AS (SELECT x.n, a.id AS container_id, a.language, x.project, x.module, a.id || '-' || replace(x.module, '.', '-') AS id, string_split(x.module, '.')[-1] AS last,
  bool_or(coalesce(x.k % 3 = 0, false)) AS fast, bool_or(coalesce(x.k % 2 = 0, false)) AS even FROM x JOIN app a ON a.n = x.n AND a.main GROUP BY ALL)
"""
register(
    "build_model_containers",
    _built("containers"),
    _sql(_MODEL + """SELECT id, id AS application_id, shown AS name, shown || ' application' AS description, upper(language[1:1]) || language[2:] || CASE language WHEN 'python' THEN ' / FastAPI' WHEN 'typescript' THEN ' / Express' ELSE '' END AS technology,
  project AS path FROM app WHERE main"""),
)
register(
    "build_model_components",
    _built("components"),
    _sql(_MODEL + """SELECT id, container_id, upper(last[1:1]) || last[2:] AS name, CASE language WHEN 'java' THEN 'Business logic service for ' ELSE '' END || upper(last[1:1]) || last[2:] || CASE language WHEN 'java' THEN '' ELSE ' module' END AS description,
  CASE WHEN language = 'java' THEN 'Java Service' WHEN language = 'python' THEN CASE WHEN fast THEN 'fastapi' ELSE 'Python' END WHEN language = 'typescript' THEN CASE WHEN even THEN 'Express' ELSE 'Typescript' END ELSE 'C' END AS technology,
  [id] AS module_ids FROM m"""),
)
register(
    "build_model_overview",
    _built("components", "overview"),
    _sql(_MODEL + """SELECT m.container_id || '-core' AS id, m.container_id, shown AS name, 'Core logic of ' || shown AS description,
  upper(a.language[1:1]) || a.language[2:] || CASE a.language WHEN 'python' THEN ' / FastAPI' WHEN 'typescript' THEN ' / Express' ELSE '' END AS technology, list(m.id ORDER BY module) AS module_ids FROM m JOIN app a ON a.id = m.container_id GROUP BY ALL"""),
)
register(
    "build_model_externals",
    _built("externals"),
    _sql(_MODEL + """SELECT 'redis' AS id, 'Redis' AS name, 'External cache' AS description, 'Cache' AS technology, false AS is_library
  UNION ALL SELECT 'postgresql', 'PostgreSQL', 'Database used by the system', 'PostgreSQL', false WHERE EXISTS (FROM app WHERE main AND n % 8 = 0)
  UNION ALL SELECT 'apache-kafka', 'Apache Kafka', 'Message Broker used by the system', 'Apache Kafka', false WHERE EXISTS (FROM app WHERE main AND n % 4 = 1)
  UNION ALL SELECT id, shown, 'Shared ' || language || ' library', language, true FROM app WHERE NOT main"""),
)
register(
    "build_model_relationships",
    _built("relationships"),
    _sql(_MODEL + """, used AS (SELECT x.n, a.id AS container_id, a.id || '-' || replace(x.module, '.', '-') AS source,
    CASE WHEN x.n % 4 = 0 THEN CASE WHEN nn = x.n THEN 'com.n' || nn || '.p' || (nk % 3) END ELSE CASE WHEN EXISTS (SELECT 1 FROM sup WHERE sup.n = x.n AND sup.k % 2 = x.nk % 2) THEN 'pkg' || (nk % 2) END END AS name
    FROM x JOIN app a ON a.n = x.n AND a.main WHERE x.n % 4 IN (0, 1) AND x.k IS NOT NULL),
named AS (SELECT module AS name, arg_max(id, project || '|' || module) AS target, arg_max(container_id, project || '|' || module) AS target_container FROM m GROUP BY module),
calls AS (SELECT DISTINCT source, target, container_id, target_container FROM used JOIN named USING (name) WHERE source <> target)
SELECT source, target, 'Uses' AS label, CAST(NULL AS VARCHAR) AS technology FROM calls
UNION SELECT container_id, target_container, 'Uses', NULL FROM calls WHERE container_id <> target_container
UNION SELECT a.id, b.id, 'Uses', NULL FROM app a JOIN app b ON b.n = a.n + 4 AND b.main WHERE a.main AND (a.n % 4 = 2 OR a.n % 8 = 4)
UNION SELECT unnest(['apps-n4', 'ghost']), 'redis', 'Uses Redis', 'Cache'
UNION SELECT id, 'postgresql', 'Reads/writes data in', 'PostgreSQL' FROM app WHERE main AND n % 8 = 0
UNION SELECT id, 'apache-kafka', 'Publishes/consumes messages via', 'Apache Kafka' FROM app WHERE main AND n % 4 = 1"""),
)

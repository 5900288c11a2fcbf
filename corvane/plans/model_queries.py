"""Queries of model derivation: imports, trees, groups, roles, relationships, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, model
from . import adapters
from .adapters import CODE_SQL, GRAPH_SQL, table
from .registry import register


# Coordinates: brands are published by the nation of the last supplier (by key) that sells them.
def _coordinates(part):
    def query(spark, sf_dir):
        line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        line = line.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        app = F.concat(F.lit("nation-"), "s_nationkey")
        deps = line.select(app.alias("app_id"), F.col("p_brand").alias("name")).distinct()
        last = line.groupBy(F.col("p_brand").alias("coordinate")).agg(F.max_by(app, F.struct("s_suppkey", "s_nationkey")).alias("app_id"), F.max("s_suppkey").alias("ord"))
        return model.match_coordinates(deps, last)[part]

    return query


_COORD = """WITH line AS (SELECT 'nation-' || s_nationkey AS app_id, p_brand AS name, s_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
last AS (SELECT name, arg_max(app_id, s_suppkey) AS target_app FROM line GROUP BY name), deps AS (SELECT DISTINCT app_id, name FROM line)
"""
register("cross_app_coordinates", _coordinates(0), _COORD + "SELECT app_id, target_app, name FROM deps JOIN last USING (name) WHERE target_app <> app_id")
register("cross_app_remaining", _coordinates(1), _COORD + "SELECT app_id, name FROM deps JOIN last USING (name) WHERE target_app = app_id")


def _imports(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "https?://([^/?#]+)", 1).alias("host"))
    modules = pages.select(F.concat(F.lit("page-"), "page_id").alias("module_id"), F.col("host").alias("name"), F.col("page_id").alias("ord"))
    imports = pages.select(F.concat(F.lit("page-"), "page_id").alias("module_id"), F.concat("host", F.when(F.col("page_id") % 3 == 0, ".Index").otherwise("")).alias("source"))
    return model.resolve_imports(imports, modules)


register(
    "import_resolution",
    _imports,
    """WITH p AS (SELECT page_id, 'page-' || page_id AS module_id, regexp_extract(url, 'https?://([^/?#]+)', 1) AS host FROM pages),
i AS (SELECT module_id, host || CASE WHEN page_id % 3 = 0 THEN '.Index' ELSE '' END AS source FROM p), m AS (SELECT host, arg_max(module_id, page_id) AS target_id FROM p GROUP BY host)
SELECT module_id, source, target_id FROM i LEFT JOIN m ON m.host = regexp_replace(i.source, '\\.[^.]*$', '')""",
)


def _apps(spark, sf_dir):
    """Customers as applications below their nation and region."""
    path = F.concat(F.lit("region-"), "n_regionkey", F.lit("/nation-"), "n_nationkey")
    apps = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return apps.select(
        F.concat(path, F.lit("/customer-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("path"),
        F.array("c_mktsegment", F.concat(F.lit("tier-"), F.floor(F.col("c_acctbal") / 1000))).alias("deps"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("published_as"),
        F.col("c_mktsegment").alias("language"),
    )


_APPS = """WITH apps AS (SELECT 'region-' || n_regionkey || '/nation-' || n_nationkey AS parent, 'region-' || n_regionkey || '/nation-' || n_nationkey || '/customer-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS path,
  [c_mktsegment, 'tier-' || CAST(floor(c_acctbal / 1000) AS BIGINT)] AS deps, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS published_as, c_mktsegment AS language
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""
register(
    "shell_rollup",
    lambda s, d: model.roll_up(_apps(s, d)),
    _APPS
    + """, dep AS (SELECT parent, dep, min(path || '#' || pos) AS o FROM (SELECT parent, path, unnest(deps) AS dep, unnest([0, 1]) AS pos FROM apps) GROUP BY parent, dep)
SELECT a.parent AS path, a.children, a.language, a.published_as, d.deps FROM
 (SELECT parent, count(*) AS children, arg_min(language, path) AS language, arg_min(published_as, path) FILTER (published_as IS NOT NULL) AS published_as FROM apps GROUP BY parent) a
 LEFT JOIN (SELECT parent, list(dep ORDER BY o) AS deps FROM dep GROUP BY parent) d USING (parent)""",
)


def _shells(spark, sf_dir):
    """Nations without modules take their customers in; those with modules, every third, don't."""
    apps = _apps(spark, sf_dir).select(F.col("path").alias("app_id"), "path")
    nations = apps.select(model.parent("path").alias("path")).distinct().select(F.col("path").alias("app_id"), "path")
    modules = nations.where(F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 3 == 0).select("app_id").unionByName(apps.select("app_id"))
    deps = _apps(spark, sf_dir).select(F.col("path").alias("app_id"), F.explode("deps").alias("name"))
    return model.rolled_up(deps, model.shell_children(apps.unionByName(nations), modules)).distinct()


register("shell_children", _shells, _APPS + "SELECT DISTINCT CASE WHEN CAST(regexp_extract(parent, '([0-9]+)$', 1) AS INTEGER) % 3 = 0 THEN path ELSE parent END AS app_id, name FROM (SELECT parent, path, unnest(deps) AS name FROM apps)")


def _tree(spark, sf_dir):
    apps = _apps(spark, sf_dir).select("path")
    up = apps.select(model.parent("path").alias("path")).distinct()
    top = up.select(model.parent("path").alias("path")).distinct()
    return apps.unionByName(up).unionByName(top).select(F.col("path").alias("id"), "path")


register("aggregators", lambda s, d: model.aggregators(_tree(s, d)), _APPS + "SELECT DISTINCT parent AS id, parent AS path FROM apps UNION SELECT DISTINCT string_split(parent, '/')[1], string_split(parent, '/')[1] FROM apps")


def _lca(spark, sf_dir):
    m = adapters.graph(spark, sf_dir)
    at = m.components.join(m.containers.select(F.col("id").alias("container_id"), "path"), "container_id").select("id", F.concat_ws("/", "path", "id").alias("path"))
    pairs = m.relationships.join(at.select(F.col("id").alias("source"), F.col("path").alias("path_a")), "source").join(at.select(F.col("id").alias("target"), F.col("path").alias("path_b")), "target")
    return model.lowest_common_ancestor(pairs.select(F.col("source").alias("a"), F.col("target").alias("b"), "path_a", "path_b"))


register(
    "edge_owner_lca",
    _lca,
    f"""WITH RECURSIVE {GRAPH_SQL},
homes AS (SELECT c.id, n.path || '/' || c.id AS path FROM components c JOIN containers n ON n.id = c.container_id),
pairs AS (SELECT r.source AS a, r.target AS b, string_split(x.path, '/') AS pa, string_split(y.path, '/') AS pb FROM relationships r JOIN homes x ON x.id = r.source JOIN homes y ON y.id = r.target),
depth(a, b, n) AS (SELECT a, b, 0 FROM pairs UNION ALL SELECT d.a, d.b, d.n + 1 FROM depth d JOIN pairs p ON p.a = d.a AND p.b = d.b WHERE d.n < 3 AND p.pa[d.n + 1] = p.pb[d.n + 1])
SELECT p.a, p.b, array_to_string(p.pa[1:max(d.n)], '/') AS owner FROM depth d JOIN pairs p ON p.a = d.a AND p.b = d.b GROUP BY p.a, p.b, p.pa""",
)


# A forest of parts: chains of fifty, of which every seventh part leaves out two, hang below parts of smaller numbers;
# in some chains two parts are each other's parent.
def _forest(spark, sf_dir):
    k, head = F.col("p_partkey"), F.col("p_partkey") - F.col("p_partkey") % 50
    parent = F.when(k % 50 == 0, F.floor(k / 50)).when((k % 50 == 47) & (F.floor(k / 50) % 4 == 3), k + 1).when(k % 7 == 0, F.greatest(k - 3, head)).otherwise(k - 1)
    name = lambda c: F.concat(F.lit("part-"), c.cast("string"))
    parts = table(spark, sf_dir, "part").select(name(k).alias("node"), name(F.when(k > 1, F.greatest(parent, F.lit(1)))).alias("parent"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    pairs = line.join(after, ["l_orderkey", "l_linenumber"]).select(name(F.col("l_partkey")).alias("a"), name(F.when(F.col("b") % 31 == 0, -F.col("b")).otherwise(F.col("b"))).alias("b"))
    return hierarchy.hierarchy(parts), pairs.distinct()


_FOREST = """RECURSIVE f AS (
  SELECT p_partkey AS node, CASE WHEN p_partkey <= 1 THEN NULL ELSE greatest(1, CASE WHEN p_partkey % 50 = 0 THEN p_partkey // 50 WHEN p_partkey % 50 = 47 AND (p_partkey // 50) % 4 = 3 THEN p_partkey + 1
    WHEN p_partkey % 7 = 0 THEN greatest(p_partkey - 3, p_partkey - p_partkey % 50) ELSE p_partkey - 1 END) END AS parent FROM part),
n AS (SELECT node, parent FROM f UNION ALL SELECT DISTINCT parent, NULL FROM f WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM f)),
up(node, anc, d) AS (SELECT node, node, 0 FROM n UNION ALL SELECT up.node, n.parent, d + 1 FROM up JOIN n ON n.node = up.anc WHERE n.parent IS NOT NULL AND d < 400),
deep AS (SELECT node, CASE WHEN max(d) < 400 THEN max(d) END AS depth, CASE WHEN max(d) < 400 THEN arg_max(anc, d) END AS root FROM up GROUP BY node)
"""
register(
    "hierarchy_depths",
    lambda s, d: _forest(s, d)[0].nodes.select("node", F.coalesce("depth", F.lit(-1)).alias("depth"), "root"),
    f"WITH {_FOREST} SELECT 'part-' || node AS node, CAST(coalesce(depth, -1) AS BIGINT) AS depth, 'part-' || root AS root FROM deep",
)


def _owners(spark, sf_dir):
    tree, pairs = _forest(spark, sf_dir)
    return hierarchy.lowest_common_ancestors(pairs, tree)


register(
    "hierarchy_owners",
    _owners,
    f"""WITH {_FOREST}, pairs AS (SELECT DISTINCT x.l_partkey AS a, CASE WHEN y.l_partkey % 31 = 0 THEN -y.l_partkey ELSE y.l_partkey END AS b FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1),
s AS (SELECT a, b, CASE WHEN x.node IS NULL OR y.node IS NULL THEN 'unknown' WHEN x.depth IS NULL OR y.depth IS NULL THEN 'cycle' WHEN x.root <> y.root THEN 'apart' ELSE 'found' END AS status
  FROM pairs LEFT JOIN deep x ON x.node = a LEFT JOIN deep y ON y.node = b),
c AS (SELECT s.a, s.b, arg_min(x.anc, x.d) AS owner FROM s JOIN up x ON x.node = s.a JOIN up y ON y.node = s.b AND y.anc = x.anc WHERE status = 'found' GROUP BY s.a, s.b)
SELECT 'part-' || a AS a, 'part-' || b AS b, 'part-' || owner AS owner, status FROM s LEFT JOIN c USING (a, b)""",
)


# Grouping: parts are modules of their brand, named by type and name.
def _modules(spark, sf_dir):
    name = F.concat_ws(".", F.lit("com"), F.lit("shop"), F.translate("p_type", " ", "."), F.translate("p_name", " ", "."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("app_id"), F.concat(F.lit("part-"), "p_partkey").alias("module_id"), name.alias("name"))


_MODULES = "modules AS (SELECT p_brand AS app_id, 'part-' || p_partkey AS module_id, 'com.shop.' || replace(p_type, ' ', '.') || '.' || replace(p_name, ' ', '.') || '.' || p_partkey AS name FROM part)"
register(
    "balanced_grouping",
    lambda s, d: model.balanced_groups(_modules(s, d)),
    f"""WITH {_MODULES}, m AS (SELECT *, string_split(name, '.') AS parts FROM modules),
pos AS (SELECT app_id, i, count(DISTINCT parts[i]) AS v, count(*) AS c FROM (SELECT app_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM m) GROUP BY app_id, i),
n AS (SELECT app_id, count(*) AS n FROM m GROUP BY app_id),
common AS (SELECT n.app_id, n.n, coalesce(min(i) FILTER (v > 1 OR c < n.n), max(i) + 1) - 1 AS common FROM pos JOIN n USING (app_id) GROUP BY n.app_id, n.n),
depths AS (SELECT DISTINCT c.app_id, i AS depth FROM pos p JOIN common c USING (app_id) WHERE i > common),
k AS (SELECT m.app_id, depth, count(DISTINCT array_to_string(parts[1:depth], '.')) AS k FROM m JOIN depths USING (app_id) GROUP BY ALL),
best AS (SELECT app_id, max(depth) AS best FROM k WHERE k <= 20 GROUP BY app_id)
SELECT m.app_id, module_id, CASE WHEN n <= 20 THEN name ELSE array_to_string(parts[1:coalesce(best, common + 1)], '.') END AS component
FROM m JOIN common USING (app_id) LEFT JOIN best USING (app_id)""",
)
register("overview_grouping", lambda s, d: model.overview(_modules(s, d)), f"WITH {_MODULES} SELECT app_id, list(module_id ORDER BY module_id) AS module_ids FROM modules GROUP BY app_id")
register(
    "filter_modules",
    lambda s, d: model.without(_modules(s, d), ["steel", "brass"]).select("module_id", "name"),
    f"WITH {_MODULES} SELECT module_id, name FROM modules WHERE NOT contains(lower(name), 'steel') AND NOT contains(lower(name), 'brass')",
)


def _display(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("component_id"), F.col("p_brand").alias("app_id"), F.concat_ws(".", F.lower("p_type"), F.translate("p_name", " ", "-")).alias("name"))
    return model.display_names(rows)


_HUMAN = "array_to_string(list_transform(string_split(regexp_replace({}, '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
register(
    "detailed_names",
    _display,
    f"""WITH c AS (SELECT 'part-' || p_partkey AS component_id, p_brand AS app_id, lower(p_type) AS t, replace(p_name, ' ', '-') AS l FROM part)
SELECT component_id, CASE WHEN count(*) OVER (PARTITION BY app_id, l) > 1 THEN {_HUMAN.format("t")} || ' ' || {_HUMAN.format("l")} ELSE {_HUMAN.format("l")} END AS display FROM c""",
)

# Roles: element kinds and visibilities become annotations.
_WORDS = ("RestController", "Service,Transactional", "OrderRepository", "KafkaListener", "Resource", "ResourceConfig", "Entity", "handler", "ExceptionHandler", "UserDao,Service")


def _annotated(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % len(_WORDS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("module_id"), pick.alias("annotations"), "p_brand", "p_partkey")


_ANNOTATED = f"a AS (SELECT 'part-' || p_partkey AS module_id, p_brand, p_partkey, {list(_WORDS)!r}[CAST(p_partkey % {len(_WORDS)} + 1 AS INTEGER)] AS annotations FROM part)"
_ROLE = """roles AS (SELECT module_id, p_brand, p_partkey, arg_min(role, i) FILTER (role IS NOT NULL) AS role FROM (
  SELECT module_id, p_brand, p_partkey, i, CASE WHEN contains(t, 'controller') OR t = 'resource' OR contains(t, 'endpoint') OR contains(t, 'route') OR contains(t, 'requesthandler') OR contains(t, 'lambdahandler') OR t = 'handler' THEN 'controller'
    WHEN contains(t, 'listener') OR contains(t, 'consumer') OR contains(t, 'subscriber') THEN 'listener' WHEN contains(t, 'repository') OR contains(t, 'dao') THEN 'repository' WHEN contains(t, 'service') THEN 'service' END AS role
  FROM (SELECT *, trim(lower(string_split(annotations, ',')[i])) AS t FROM (SELECT *, unnest(range(1, len(string_split(annotations, ',')) + 1)) AS i FROM a))) GROUP BY ALL)"""
register("detect_roles", lambda s, d: model.detect_roles(_annotated(s, d)), f"WITH {_ANNOTATED}, {_ROLE} SELECT module_id, role FROM roles")
register(
    "infer_actors",
    lambda s, d: model.infer_actors(model.detect_roles(_annotated(s, d))),
    f"WITH {_ANNOTATED}, {_ROLE} SELECT 'api-consumer' AS id, 'API Consumer' AS name WHERE EXISTS (FROM roles WHERE role = 'controller') UNION ALL SELECT 'upstream-system', 'Upstream System' WHERE EXISTS (FROM roles WHERE role = 'listener')",
)


def _component_roles(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    roles = model.detect_roles(rows).join(rows.select("module_id", F.col("p_brand").alias("component_id"), F.col("p_partkey").alias("pos")), "module_id")
    return model.component_role(roles)


register("component_roles", _component_roles, f"WITH {_ANNOTATED}, {_ROLE} SELECT p_brand AS component_id, arg_min(role, p_partkey) FILTER (role IS NOT NULL) AS role FROM roles GROUP BY p_brand")

_DEPS = ("org.postgresql:postgresql", "spring-kafka", "aws-java-sdk-s3", "css3-mediaqueries", "jedis", "ojdbc8", "lodash", "amqp-client", "auth2-client", "opensearch-java")


def _dependencies(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, _DEPS)), (F.col("event_id") % len(_DEPS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), "user_id").alias("app_id"), pick.alias("name"), F.col("event_id").alias("ord"))


_DETECT = f"""d AS (SELECT DISTINCT {list(_DEPS)!r}[CAST(event_id % {len(_DEPS)} + 1 AS INTEGER)] AS name FROM events),
hit AS (SELECT CASE WHEN contains(name, 'postgresql') THEN 'PostgreSQL' WHEN contains(name, 'ojdbc') THEN 'Oracle' WHEN contains(name, 'kafka') THEN 'Apache Kafka' WHEN contains(name, 'amqp') THEN 'RabbitMQ'
  WHEN contains(name, 'jedis') THEN 'Redis' WHEN contains(name, 'opensearch') THEN 'OpenSearch' WHEN regexp_matches(name, '(?i)(^|[^a-z])s3($|[^a-z0-9])') THEN 'S3' END AS technology FROM d),
detected AS (SELECT DISTINCT regexp_replace(lower(technology), '[^a-z0-9]+', '-', 'g') AS id, technology,
  CASE technology WHEN 'Apache Kafka' THEN 'Message Broker' WHEN 'RabbitMQ' THEN 'Message Broker' WHEN 'Redis' THEN 'Cache' WHEN 'OpenSearch' THEN 'Search Engine' WHEN 'S3' THEN 'Object Storage' ELSE 'Database' END AS type FROM hit WHERE technology IS NOT NULL)
"""
register(
    "detect_external_systems",
    lambda s, d: model.detect_externals(_dependencies(s, d)),
    f"WITH {_DETECT} SELECT *, CASE type WHEN 'Database' THEN 'Reads/writes data in' WHEN 'Message Broker' THEN 'Publishes/consumes messages via' WHEN 'Cache' THEN 'Caches data in' WHEN 'Search Engine' THEN 'Indexes/queries' ELSE 'Stores objects in' END AS label FROM detected",
)


def _merged_externals(spark, sf_dir):
    declared = adapters.graph(spark, sf_dir).externals.select("id", "name").unionByName(spark.sql("SELECT 'redis' AS id, 'Session store' AS name"))
    return model.merge_externals(declared, model.detect_externals(_dependencies(spark, sf_dir)).select("id", F.col("technology").alias("name")))


register(
    "merge_external_systems",
    _merged_externals,
    f"WITH {_DETECT}, declared AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS id, p_brand AS name FROM part UNION ALL SELECT 'redis', 'Session store') SELECT id, name FROM declared UNION ALL SELECT id, technology FROM detected WHERE id NOT IN (SELECT id FROM declared)",
)


def _derived(spark, sf_dir):
    """Phases: cross-nation calls, component calls, use of brands by usedBy, use by nations."""
    m = adapters.graph(spark, sf_dir, True)
    home = m.components.select("id", "container_id")
    calls = m.relationships.join(home.select(F.col("id").alias("source"), F.col("container_id").alias("sc")), "source").join(home.select(F.col("id").alias("target"), F.col("container_id").alias("tc")), "target")
    uses, none = F.lit("Uses").alias("label"), F.lit(None).cast("string").alias("technology")
    ord_ = F.concat_ws("|", "source", "target").alias("ord")
    cross = calls.select(F.col("sc").alias("source"), F.col("tc").alias("target"), uses, none, ord_)
    own = calls.select("source", "target", "label", "technology", ord_)
    brands = m.relationships.join(m.externals.select(F.col("id").alias("target")), "target")
    used = brands.where("target LIKE '%3'").join(home.select(F.col("id").alias("source"), "container_id"), "source")
    declared = used.select(F.col("container_id").alias("source"), "target", F.lit("Declared").alias("label"), none, ord_)
    direct = brands.join(home.select(F.col("id").alias("source"), "container_id"), "source").select(F.col("container_id").alias("source"), "target", "label", "technology", ord_)
    return model.derive_relationships([cross, own, declared, direct])


register(
    "derive_relationships",
    _derived,
    f"""WITH {GRAPH_SQL},
calls AS (SELECT r.*, a.container_id AS sc, b.container_id AS tc FROM relationships r JOIN components a ON a.id = r.source JOIN components b ON b.id = r.target),
brands AS (SELECT r.*, c.container_id FROM relationships r JOIN externals x ON x.id = r.target JOIN components c ON c.id = r.source),
phases AS (SELECT 0 AS phase, sc AS source, tc AS target, 'Uses' AS label, CAST(NULL AS VARCHAR) AS technology, source || '|' || target AS ord FROM calls
  UNION ALL SELECT 1, source, target, label, technology, source || '|' || target FROM calls
  UNION ALL SELECT 2, container_id, target, 'Declared', NULL, source || '|' || target FROM brands WHERE target LIKE '%3'
  UNION ALL SELECT 3, container_id, target, label, technology, source || '|' || target FROM brands)
SELECT source, target, label, technology FROM phases WHERE source <> target QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY phase, ord) = 1""",
)


# Partial models: one per order year. Suppliers and customers of a year are its components and people.
def _partials(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.year("o_orderdate").alias("year"), F.concat(F.lit("customer-"), F.col("o_custkey") % 50).alias("source"), F.concat(F.lit("supplier-"), F.col("l_suppkey") % 40).alias("target"), "o_orderpriority", "o_orderkey")
    edges = rows.groupBy("year", "source", "target").agg(F.min("o_orderpriority").alias("label")).withColumn("ord", F.col("year"))
    people = rows.groupBy("year", F.col("source").alias("id")).agg(F.max("o_orderpriority").alias("description")).withColumn("ord", F.col("year"))
    names = rows.select(F.concat(F.lit("model-"), "year").alias("partial"), F.col("target").alias("id"), F.concat(F.lit("group-"), F.col("year") % 2).alias("container_id"), F.col("year").alias("ord")).distinct()
    return edges, people, names


_PARTIALS = """rows AS (SELECT year(o_orderdate) AS year, 'customer-' || (o_custkey % 50) AS source, 'supplier-' || (l_suppkey % 40) AS target, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edges AS (SELECT year, source, target, min(o_orderpriority) AS label FROM rows GROUP BY ALL)"""
register("merge_partial_edges", lambda s, d: model.merge_partials(*_partials(s, d)[:2])[0], f"WITH {_PARTIALS} SELECT source, target, arg_min(label, year) AS label FROM edges GROUP BY source, target")
register(
    "merge_partial_people",
    lambda s, d: model.merge_partials(*_partials(s, d)[:2])[1],
    f"WITH {_PARTIALS}, p AS (SELECT year, source AS id, max(o_orderpriority) AS description FROM rows GROUP BY ALL) SELECT id, description FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(description) DESC, year) = 1",
)
_RENAMED = """names AS (SELECT DISTINCT 'model-' || year AS partial, target AS id, 'group-' || (year % 2) AS container_id, year AS ord FROM rows),
nth AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS nth FROM names), new AS (SELECT *, CASE WHEN nth > 1 THEN container_id || '-' || id ELSE id END AS new FROM nth),
renamed AS (SELECT partial, id, CASE WHEN c > 1 THEN new || '-' || c ELSE new END AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY new ORDER BY nth > 1, ord) AS c FROM new))"""
register("merge_partial_ids", lambda s, d: model.renamed(_partials(s, d)[2]), f"WITH {_PARTIALS}, {_RENAMED} SELECT * FROM renamed")


def _remapped(spark, sf_dir):
    edges, _, names = _partials(spark, sf_dir)
    return model.remapped(edges.select(F.concat(F.lit("model-"), "year").alias("partial"), "source", "target", "label"), model.renamed(names))


register(
    "merge_partial_remap",
    _remapped,
    f"WITH {_PARTIALS}, {_RENAMED} SELECT 'model-' || year AS partial, source, coalesce(r.new_id, target) AS target, label FROM edges LEFT JOIN renamed r ON r.partial = 'model-' || year AND r.id = target",
)


def _override(spark, sf_dir):
    rel = adapters.graph(spark, sf_dir).relationships
    updates = rel.where("target LIKE '%1'").select("source", "target", F.when(F.col("source").like("%2"), "").otherwise("Orders from").alias("new_label"), F.when(F.col("source").like("%3"), "EDI").alias("new_technology"))
    return model.override(rel, updates)


register(
    "override_labels",
    _override,
    f"""WITH {GRAPH_SQL} SELECT source, target, CASE WHEN target LIKE '%1' AND source NOT LIKE '%2' THEN 'Orders from' ELSE label END AS label,
  CASE WHEN target LIKE '%1' AND source LIKE '%3' THEN 'EDI' ELSE technology END AS technology FROM relationships""",
)

"""Queries of configuration text, settings and page classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from ..operators import documents, settings
from . import adapters
from .adapters import CONFIG_SQL, table
from .registry import register


def _on(f):
    return lambda spark, sf_dir: f(adapters.config_lines(spark, sf_dir))


_SIGNALS = CONFIG_SQL + r""",
p(ord, pattern, type, re) AS (VALUES (0, 'jdbc-postgresql', 'database-url', '(?i)jdbc:postgresql://[^\s''"`,)}>]+'), (10, 'redis-host', 'cache-endpoint', '(?i)[\w.-]+:\s*6379\b'),
  (15, 'service-url', 'service-endpoint', '(?i)https?://[^\s''"`,{}<>]+'), (17, 'env-infra-ref', 'env-infrastructure', '(?i)\$\{?\s*(?:DATABASE|DB|REDIS|KAFKA|RABBIT|AMQP|ELASTICSEARCH|MONGO|MEMCACHED|S3)[A-Z_]*\s*\}?')),
found AS (SELECT file, line, type, pattern, ord, regexp_extract(text, re) AS value FROM config, p WHERE NOT regexp_matches(text, '^\s*([#!]|<!--)') AND regexp_extract(text, re) <> ''),
signals AS (SELECT file, line, type, pattern, value FROM found WHERE NOT regexp_matches(value, '(?i)https?://docs\.|https?://localhost[:/]') QUALIFY row_number() OVER (PARTITION BY file, type, value ORDER BY line, ord) = 1)
"""
register("config_signals", _on(signals.detect), f"WITH {_SIGNALS} SELECT * FROM signals")


def _pages(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("file"), F.lit(1).alias("line"), F.col("url").alias("text"))
    return signals.detect(lines)


register(
    "page_signals",
    _pages,
    """SELECT 'page-' || page_id AS file, 1 AS line, 'service-endpoint' AS type, 'service-url' AS pattern, regexp_extract(url, '(?i)https?://[^\\s''"`,{}<>]+') AS value FROM pages
    WHERE NOT regexp_matches(url, '(?i)/actuator\\b|/health\\b|/info\\b|https?://docs\\.')""",
)
register(
    "config_filter",
    _on(lambda c: signals.signal_files(c.groupBy("file").agg(F.count("*").alias("lines")), signals.detect(c))),
    f"WITH {_SIGNALS} SELECT file, count(*) AS lines FROM config WHERE file IN (SELECT file FROM signals) GROUP BY file",
)
register(
    "toml_key_paths",
    _on(lambda c: signals.toml_keys(c.where("file LIKE '%.toml'"))),
    f"""WITH {CONFIG_SQL}, h AS (SELECT *, last_value(nullif(regexp_extract(text, '^\\s*\\[+([^\\]]+)\\]+', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS section,
  regexp_extract(text, '^\\s*([\\w.-]+)\\s*=', 1) AS name FROM config WHERE file LIKE '%.toml')
SELECT file, line, CASE WHEN section IS NULL THEN name ELSE section || '.' || name END AS key, regexp_replace(trim(text[instr(text, '=') + 1:]), '^["'']|["'']$', '') AS value FROM h WHERE name <> ''""",
)


def _yaml(spark, sf_dir):
    """Conversations as YAML: a document per conversation, a key per turn, nested by role."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, "").otherwise("  "), F.col("role"), F.lit(":")).alias("l"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda s: s["l"]), "\n").alias("content"))
    return signals.yaml_keys(files.select(F.concat(F.lit("c-"), "conv_id", F.lit(".yaml")).alias("file"), "content"))


register(
    "yaml_key_paths",
    _yaml,
    """WITH l AS (SELECT conv_id, turn, role, row_number() OVER w AS line, last_value(CASE WHEN turn % 2 = 0 THEN role END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS above FROM conversations WHERE role IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, CASE WHEN turn % 2 = 0 THEN '' ELSE '  ' END || role))
SELECT 'c-' || conv_id || '.yaml' AS file, CAST(line AS INTEGER) AS line, CASE WHEN turn % 2 <> 0 AND above IS NOT NULL THEN above || '.' ELSE '' END || role AS key FROM l""",
)


def _contents(lines):
    """file, content of lines (file, line, text)."""
    rows = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    return rows.select("file", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("content"))


register(
    "config_summary",
    _on(lambda c: signals.signal_summary(_contents(c), signals.detect(c))),
    f"""WITH {_SIGNALS}, keyed AS (SELECT file, line, text, regexp_extract(text, '^\\s*([\\w.-]+)\\s*[=:]', 1) AS name, instr(text, '=') AS e, instr(text, ':') AS c,
    last_value(nullif(regexp_extract(text, '^\\[([\\w.-]+)\\]$', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM config),
k AS (SELECT file, line, CASE WHEN file LIKE '%.toml' THEN CASE WHEN section IS NULL THEN name ELSE section || '.' || name END ELSE name END AS key,
    CASE WHEN file LIKE '%.toml' THEN regexp_replace(trim(text[e + 1:]), '^["'']|["'']$', '') ELSE trim(text[CASE WHEN e > 0 AND c > 0 THEN least(e, c) ELSE greatest(e, c) END + 1:]) END AS value
  FROM keyed WHERE (file LIKE '%.toml' OR file LIKE '%.properties') AND name <> '' AND (file, line) IN (SELECT (file, line) FROM signals)),
joined AS (SELECT file, string_agg(key || ': ' || value, chr(10) ORDER BY key, line) AS found FROM k GROUP BY file),
whole AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS content FROM config WHERE file IN (SELECT file FROM signals) GROUP BY file)
SELECT file, coalesce(found, content) AS summary FROM whole LEFT JOIN joined USING (file)""",
)


# Every pattern and every noise rule, by lines of their kinds.
_EACH = (
    "a: jdbc:postgresql://h{n}/db", "b=jdbc:mysql://h{n}/db", "c: jdbc:oracle:thin:@h{n}", "jdbc:sqlite:f{n}.db", "jdbc:h2:mem:m{n}", "mongodb+srv://m{n}/x", "k{n}.local:9092", "topic: orders.{n}", "destination=q{n}",
    "amqps://r{n}/v", "rediss://c{n}:1", "cache-{n}:6379", "mem{n}: 11211", "es-{n}:9200", "s3.eu-{n}.amazonaws.com", "bucket = 'b-{n}'", "https://api.{n}.example.com/v1", "server.port={n}", "listen: 80{n}", "${DB_URL}", "${ KAFKA_HOST }",
    "http://www.w3.org/{n}", "http://xmlns.jcp.org/{n}", "http://schemas.x.org/{n}", "https://xml.apache.org/{n}", "https://repo.maven.apache.org/{n}", "https://repo1.maven.org/{n}", "https://plugins.gradle.org/{n}",
    "https://registry.npmjs.org/{n}", "https://docs.x.org/{n}", "https://javadoc.io/{n}", "https://tools.ietf.org/{n}", "http://www.oracle.com/{n}/x.dtd", "http://hibernate.org/dtd/{n}", "https://a{n}.io/actuator", "https://a{n}.io/health",
    "https://a{n}.io/info", "http://localhost:{n}", "http://127.0.0.1:{n}", "http://0.0.0.0/{n}", "http://[::1]:{n}", "# jdbc:mysql://no/{n}", "! https://no.{n}", "<!-- https://no.{n} -->", "   ", "JDBC:MYSQL://UP{n}/x", "plain words {n}",
)


def _each(spark, sf_dir):
    text = F.replace(F.element_at(F.array(*map(F.lit, _EACH)), (F.col("event_id") % len(_EACH) + 1).cast("int")), F.lit("{n}"), (F.col("event_id") % 9).cast("string"))
    return signals.detect(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").cast("int").alias("line"), text.alias("text")))


_quote = lambda x: "'" + x.replace("'", "''") + "'"
register(
    "config_signals_each",
    _each,
    f"""WITH p(ord, pattern, type, re) AS (VALUES {", ".join(f"({i}, {_quote(n)}, {_quote(t)}, {_quote('(?i)' + r)})" for i, (n, t, r) in enumerate(signals.PATTERNS))}),
l AS (SELECT 'u' || user_id AS file, CAST(event_id AS INTEGER) AS line, replace([{", ".join(map(_quote, _EACH))}][CAST(event_id % {len(_EACH)} + 1 AS INTEGER)], '{{n}}', CAST(event_id % 9 AS VARCHAR)) AS text FROM events),
f AS (SELECT file, line, type, pattern, ord, regexp_extract(text, re) AS value FROM l, p WHERE NOT regexp_matches(text, '^\\s*([#!]|<!--)') AND trim(text) <> '' AND regexp_extract(text, re) <> '')
SELECT file, line, type, pattern, value FROM f WHERE NOT regexp_matches(value, {_quote("(?i)" + "|".join(signals.NOISE))}) QUALIFY row_number() OVER (PARTITION BY file, type, value ORDER BY line, ord) = 1""",
)


def _condense(spark, sf_dir):
    """Documents as configuration files of applications of fifty documents each."""
    app = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("app")
    docs = table(spark, sf_dir, "documents").select(app, F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return signals.condense(docs)


register(
    "condense_config",
    _condense,
    """WITH l AS (SELECT source || '-' || (doc_id // 50) AS app, doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS parts FROM documents),
t AS (SELECT app, doc_id, i, trim(parts[i]) AS line FROM l), f AS (SELECT * FROM t WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY app, line ORDER BY doc_id, i) = 1),
s AS (SELECT app, doc_id, '# ' || doc_id || chr(10) || string_agg(line, chr(10) ORDER BY i) AS part FROM f GROUP BY app, doc_id)
SELECT app, string_agg(part, chr(10) ORDER BY doc_id) AS condensed FROM s GROUP BY app""",
)


def _cascade(spark, sf_dir):
    """Settings at three depths: region, nation and customer override each other."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    target = F.concat(F.lit("customer-"), "c_custkey").alias("target")
    rows = [
        customer.select(target, F.lit(0).alias("depth"), F.lit("output.dir").alias("key"), F.concat(F.lit("region-"), "n_regionkey").alias("value")),
        customer.select(target, F.lit(0).alias("depth"), F.lit("levels").alias("key"), F.lit("all").alias("value")),
        customer.where("n_nationkey % 2 = 0").select(target, F.lit(1).alias("depth"), F.lit("output.dir").alias("key"), F.concat(F.lit("nation-"), "n_nationkey").alias("value")),
        customer.where("n_nationkey % 3 = 0").select(target, F.lit(1).alias("depth"), F.lit("levels.code").alias("key"), F.lit("false").alias("value")),
        customer.where("c_custkey % 4 = 0").select(target, F.lit(2).alias("depth"), F.lit("output.dir").alias("key"), F.col("c_mktsegment").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return settings.cascade(out)


register(
    "config_cascade",
    _cascade,
    """WITH c AS (SELECT 'customer-' || c_custkey AS target, * FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT target, 0 AS depth, 'output.dir' AS key, 'region-' || n_regionkey AS value FROM c UNION ALL SELECT target, 0, 'levels', 'all' FROM c
  UNION ALL SELECT target, 1, 'output.dir', 'nation-' || n_nationkey FROM c WHERE n_nationkey % 2 = 0 UNION ALL SELECT target, 1, 'levels.code', 'false' FROM c WHERE n_nationkey % 3 = 0
  UNION ALL SELECT target, 2, 'output.dir', c_mktsegment FROM c WHERE c_custkey % 4 = 0),
top AS (SELECT target, key, arg_max(value, depth) AS value, max(depth) AS depth FROM s GROUP BY target, key)
SELECT target, key, value FROM top t WHERE NOT EXISTS (SELECT 1 FROM top o WHERE o.target = t.target AND o.depth > t.depth AND (starts_with(o.key, t.key || '.') OR starts_with(t.key, o.key || '.')))""",
)


def _excludes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("user"))
    return rows.select("user_id", settings.effective_excludes(F.col("user"), F.array(F.lit("node_modules"), F.lit("view"), F.lit("target")), F.array(F.lit("click"), F.lit("target"))).alias("excludes"))


register(
    "effective_excludes",
    _excludes,
    """WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS u FROM events GROUP BY user_id)
SELECT user_id, list_filter(u || list_filter(['node_modules', 'view', 'target'], lambda x: NOT list_contains(u, x)), lambda x: x NOT IN ('click', 'target')) AS excludes FROM u""",
)


def _classified(spark, sf_dir):
    return settings.classify_pages(table(spark, sf_dir, "pages"))


register(
    "classify_pages",
    _classified,
    """SELECT page_id, CASE WHEN contains(html, '<form') THEN 'form' WHEN regexp_matches(url, '^https?://blog\\.') THEN 'blog' WHEN regexp_matches(url, '[?&]page=') THEN 'listing'
  WHEN contains(html, '<article') THEN 'article' ELSE 'other' END AS kind FROM pages""",
)


# Nested documents of folders: the root's, one a region, one a nation, one a supplier.
def _folders(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    doc = lambda df, path, json: df.select(path.alias("dir"), F.parse_json(json).alias("doc"))
    region, nation = F.concat(F.lit("region-"), "n_regionkey"), F.concat(F.lit("nation-"), "n_nationkey")
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    at = t("supplier").join(t("nation"), F.col("s_nationkey") == n)
    home = F.concat_ws("/", region, nation, F.concat(F.lit("supplier-"), s))
    r = F.col("r_regionkey")
    json = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    docs = doc(spark.range(1), F.lit("."), F.lit('{"scan": {"exclude": ["a", {"b": 1}], "include": ["**"]}, "levels": {"context": true, "code": false}, "output": {"dir": "docs"}, "none": {}}'))
    docs = docs.unionByName(doc(t("region"), F.concat(F.lit("region-"), r), json(F.concat(F.lit('"output": {"dir": "region-'), r, F.lit('", "format": "svg"}')), F.when(r % 2 == 1, F.lit('"levels": "all"')))))
    docs = docs.unionByName(doc(t("nation"), F.concat_ws("/", region, nation), json(F.when(n % 3 == 0, F.lit('"levels": {"code": true}')), F.when(n % 2 == 0, F.lit('"scan": {"exclude": []}')), F.when(n % 5 == 0, F.lit('"output": null')))))
    docs = docs.unionByName(doc(at, home, json(F.when(s % 4 == 0, F.concat(F.lit('"output": {"extra": {"deep": {"key": '), s, F.lit("}}}"))), F.concat(F.lit('"none": {"id": '), s, F.lit("}")))))
    return documents.in_force(docs, at.select(home.alias("dir")))


register(
    "settings_in_force",
    _folders,
    """SELECT 'region-' || n_regionkey || '/nation-' || n_nationkey || '/supplier-' || s_suppkey AS dir,
  '{"levels":' || CASE WHEN n_regionkey % 2 = 1 AND n_nationkey % 3 = 0 THEN '{"code":true}' WHEN n_regionkey % 2 = 1 THEN '"all"' WHEN n_nationkey % 3 = 0 THEN '{"code":true,"context":true}' ELSE '{"code":false,"context":true}' END
  || ',"none":{"id":' || s_suppkey || '},"output":' || CASE WHEN n_nationkey % 5 = 0 AND s_suppkey % 4 = 0 THEN '{"extra":{"deep":{"key":' || s_suppkey || '}}}' WHEN n_nationkey % 5 = 0 THEN 'null'
    ELSE '{"dir":"region-' || n_regionkey || '"' || CASE WHEN s_suppkey % 4 = 0 THEN ',"extra":{"deep":{"key":' || s_suppkey || '}}' ELSE '' END || ',"format":"svg"}' END
  || ',"scan":{"exclude":' || CASE WHEN n_nationkey % 2 = 0 THEN '[]' ELSE '["a",{"b":1}]' END || ',"include":["**"]}}' AS json
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)

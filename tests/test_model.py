from __future__ import annotations

import pytest

from corvane.functions import rules, signals, text
from corvane.operators import codemodel, history, model, projection, settings
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def small(spark):
    """Two containers, three components, an actor, a library and an e-mail provider."""
    make = spark.createDataFrame
    return {
        "actors": make([("user", "User")], "id string, name string"),
        "externals": make([("email-provider", "E-mail", False), ("lib", "Lib", True)], "id string, name string, is_library boolean"),
        "containers": make([("order-service", "Orders"), ("user-api", "Users"), ("idle", "Idle")], "id string, name string"),
        "components": make([("user-controller", "user-api", "C"), ("user-repository", "user-api", "R"), ("order-handler", "order-service", "H")], "id string, container_id string, name string"),
        "relationships": make(
            [
                ("user", "user-api", "Uses", "HTTP"),
                ("user", "order-service", "Places orders via", "HTTP"),
                ("user-api", "email-provider", "Sends welcome emails", "SMTP"),
                ("order-handler", "user-api", "Fetches user details", "REST"),
                ("order-handler", "user-controller", "Calls", "REST"),
                ("user-controller", "user-repository", "Reads", None),
                ("order-service", "user-api", "Later", None),
                ("user-api", "lib", "Links", None),
                ("ghost", "user-api", "Haunts", None),
            ],
            "source string, target string, label string, technology string",
        ),
    }


def test_context(small):
    p = projection.context(**small)
    assert rows(p.edges, "source", "target", "label") == [("system", "email-provider", "Sends welcome emails"), ("user", "system", "Places orders via")]
    assert rows(p.vertices, "id") == [("email-provider",), ("system",), ("user",)]
    assert rows(p.warnings) == [("L1: unknown source ghost of ghost -> user-api",), ("L1: unknown target lib of user-api -> lib",)]


def test_container(small):
    p = projection.container(**small)
    assert ("order-service", "user-api", "Fetches user details") in rows(p.edges, "source", "target", "label")
    assert len(rows(p.edges)) == 5
    assert ("idle",) not in rows(p.vertices, "id")
    assert rows(p.warnings) == [("L2: unknown source ghost of ghost -> user-api",)]


def test_component(small):
    p = projection.component(**small)
    assert rows(p.edges, "container_id", "source", "target") == [
        ("order-service", "order-handler", "user-api"),
        ("order-service", "order-handler", "user-controller"),
        ("user-api", "order-handler", "user-controller"),
        ("user-api", "user-controller", "user-repository"),
    ]
    kinds = rows(p.vertices.where("container_id = 'order-service'"), "id", "kind")
    assert kinds == [("order-handler", "component"), ("order-service", "boundary"), ("user-api", "reference-container"), ("user-controller", "reference-component")]


def test_code_edges_end_at_vertices(spark):
    elements = spark.createDataFrame([("a", "c1", "k1", "A", "x.A", "class", "public"), ("b", "c2", "k1", "B", "x.B", "class", "public")], "id string, component_id string, container_id string, name string, qualified_name string, kind string, visibility string")
    refs = spark.createDataFrame([("a", "B", None, "extends"), ("a", "A", "x.nope", "uses"), ("b", "Zed", None, "uses")], "element_id string, target_name string, target_qualified string, kind string")
    resolved = codemodel.resolve(elements, refs)
    assert rows(resolved, "target_name", "resolved_by") == [("A", "name-component"), ("B", "name-container"), ("Zed", "unresolved")]
    p = projection.code(elements, codemodel.links(resolved))
    known = set(rows(p.vertices, "component_id", "id"))
    assert all((c, s) in known and (c, t) in known for c, s, t in rows(p.edges, "component_id", "source", "target"))
    assert rows(p.edges, "id", "label") == [("a->a:uses", "uses"), ("a->b:inherits", "inherits")]


@pytest.mark.parametrize("annotations, expected", [("RestController", "controller"), ("Resource", "controller"), ("ResourceConfig", None), ("ExceptionHandler", None), ("Entity, KafkaListener", "listener"), ("Service,RestController", "service"), ("", None), (None, None)])
def test_roles(spark, annotations, expected):
    df = spark.createDataFrame([(annotations,)], "a string")
    assert df.select(rules.role(F.col("a"))).first()[0] == expected


@pytest.mark.parametrize("name, expected", [("aws-java-sdk-s3", "S3"), ("css3-x", None), ("org.postgresql:postgresql", "PostgreSQL"), ("auth2-client", None), ("jedis", "Redis")])
def test_external_rules(spark, name, expected):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(rules.external_technology(rules.external_rule(F.col("n")))).first()[0] == expected


@pytest.mark.parametrize("given, slug, human, last", [("com.example.UserAPI", "com-example-userapi", "User Api", "UserAPI"), ("user-service_v2", "user-service-v2", "User Service V2", "user-service_v2"), ("@a/é-x", "a-x", "@a/é X", "é-x"), ("", "", "", "")])
def test_names(spark, given, slug, human, last):
    df = spark.createDataFrame([(given,)], "n string")
    assert tuple(df.select(text.slug("n"), text.humanize("n"), text.last_segment("n")).first()) == (slug, human, last)


def test_wrap(spark):
    df = spark.createDataFrame([("one two three four",), ("",), ("extraordinarily long",)], "t string")
    assert [r[0] for r in df.select(text.wrap("t", 8, 2)).collect()] == ["one two\nthree...", "", "extraordinarily\nlong"]


def test_signals(spark):
    content = "# jdbc:mysql://x/y\nurl: jdbc:mysql://db/app\nurl: jdbc:mysql://db/app\ndoc: https://docs.x.org/\ncache: h:6379 ${REDIS_URL}\nhttp://localhost:80/x"
    found = signals.detect(signals.lines(spark.createDataFrame([("a.yml", content)], "file string, content string")))
    assert rows(found, "line", "pattern", "value") == [(2, "jdbc-mysql", "jdbc:mysql://db/app"), (5, "env-infra-ref", "${REDIS_URL}"), (5, "redis-host", "h:6379")]


def test_yaml_keys(spark):
    content = "spring:\n  kafka:\n    topic: x\n  # note\n  items:\n    - a\nserver:\n  port: 1"
    found = signals.yaml_keys(spark.createDataFrame([("a.yml", content)], "file string, content string"))
    assert [r[2] for r in sorted(tuple(r) for r in found.collect())] == ["spring", "spring.kafka", "spring.kafka.topic", "spring.items", "server", "server.port"]


@pytest.mark.parametrize("line, fmt, expected", [("a: 'b'", "yaml", "b"), ("- c", "yaml", "c"), ("k=v:w", "properties", "v:w"), ("<a>t</a>", "xml", "t"), ('<p value="v"/>', "xml", "v"), ('"a": "b",', "json", "b"), ('x = "y"', "toml", "y"), ("bare", "ini", "bare")])
def test_config_values(spark, line, fmt, expected):
    df = spark.createDataFrame([(line, fmt)], "l string, f string")
    assert df.select(text.config_value("l", "f")).first()[0] == expected


def test_cascade_replaces_sub_paths(spark):
    df = spark.createDataFrame([("t", 0, "levels", "all"), ("t", 1, "levels.code", "false"), ("t", 0, "out.dir", "a"), ("t", 2, "out", "none"), ("t", 0, "x", "1"), ("t", 1, "x", "2")], "target string, depth int, key string, value string")
    assert rows(settings.cascade(df)) == [("t", "levels.code", "false"), ("t", "out", "none"), ("t", "x", "2")]


def test_balanced_groups(spark):
    few = [("a", f"m{i}", f"com.x.p{i}") for i in range(5)]
    many = [("b", f"n{i}", f"com.y.g{i % 3}.k{i}") for i in range(30)]
    wide = [("c", f"o{i}", f"com.z.w{i}.k") for i in range(25)]
    out = model.balanced_groups(spark.createDataFrame(few + many + wide, "app_id string, module_id string, name string"))
    assert {r.component for r in out.where("app_id = 'b'").collect()} == {"com.y.g0", "com.y.g1", "com.y.g2"}
    assert out.where("app_id = 'a'").select("component").distinct().count() == 5
    assert out.where("app_id = 'c'").select("component").distinct().count() == 25


def test_merge_renames(spark):
    names = spark.createDataFrame([("p1", "api", "a", 1), ("p2", "api", "b", 2), ("p3", "api", "b", 3), ("p4", "db", "a", 4)], "partial string, id string, container_id string, ord int")
    assert rows(model.renamed(names)) == [("p1", "api", "api"), ("p2", "api", "b-api"), ("p3", "api", "b-api-2"), ("p4", "db", "db")]


def test_derive_relationships_takes_the_first_phase(spark):
    schema = "source string, target string, label string, technology string, ord string"
    a = spark.createDataFrame([("x", "y", "first", None, "1"), ("x", "x", "self", None, "0")], schema)
    b = spark.createDataFrame([("x", "y", "second", None, "0"), ("y", "x", "back", None, "0")], schema)
    assert rows(model.derive_relationships([a, b]), "source", "target", "label") == [("x", "y", "first"), ("y", "x", "back")]


def test_reconcile_is_idempotent(spark):
    cell = "id string, value string, style string, parent string, managed boolean, x int, y int"
    old = spark.createDataFrame([("a", "old", "s", "1", True, 5, 6), ("note", "n", "s", "1", False, 1, 2), ("gone", "g", "s", "1", True, 3, 4)], cell)
    new = spark.createDataFrame([("a", "new", "t", "1"), ("b", "b", "t", None)], "id string, value string, style string, parent string")
    layout = spark.createDataFrame([("b", 7, 8)], "id string, x int, y int")
    once = history.reconcile_vertices(old, new, layout)
    assert rows(once, "id", "value", "style", "x", "action") == [("a", "new", "s", 5, "kept"), ("b", "b", "t", 7, "placed"), ("note", "n", "s", 1, "foreign")]
    again = history.reconcile_vertices(once.select("id", "value", "style", "parent", (F.col("action") != "foreign").alias("managed"), "x", "y"), new, layout)
    assert rows(again, "id", "value", "style", "x", "y") == rows(once, "id", "value", "style", "x", "y")


def test_metrics_of_empty_sides(spark):
    a = spark.createDataFrame([("en", 1), ("en", 2)], "lang string, k int")
    out = history.set_metrics(a, a.where("k = 2"), "lang", "k").first()
    assert (out.tp, out.fp, out.fn, out.precision, out.recall) == (1, 1, 0, 0.5, 1.0)


def test_line_churn_keeps_repeats(spark):
    schema = "key string, line string"
    out = history.line_churn(spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "b")], schema), spark.createDataFrame([("k", "b"), ("k", "c")], schema)).first()
    assert (out.added, out.removed, out.churn) == (1, 2, 1.0)


def test_repaired_yaml(spark):
    from corvane.operators import outputs

    text = 'actors:\n  - id: a - id: b\n    name: "cut of'
    out = outputs.repaired_yaml(spark.createDataFrame([(1, text), (2, "a: b\n")], "id int, content string"))
    assert rows(out) == [(1, "actors:\n  - id: a\n  - id: b"), (2, "a: b\n")]

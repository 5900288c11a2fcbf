from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import render
from corvane.plans import catalog
from corvane.sources import documents, elements, project
from corvane.streaming.signals import stream_signals, windowed_counts

TREE = {
    "services/user/pom.xml": "<project><parent><groupId>p</groupId></parent><packaging>war</packaging><dependencies><dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId></dependency></dependencies></project>",
    "services/user/src/main/java/com/ex/user/UserController.java": "package com.ex.user;\nimport com.ex.repo.UserRepository;\nimport org.spring.RestController;\n@RestController\npublic class UserController {\n  private UserRepository r;\n  public String get(String id) { return id; }\n}",
    "services/user/src/main/java/com/ex/repo/UserRepository.java": "package com.ex.repo;\npublic class UserRepository {\n}",
    "services/order/pyproject.toml": '[project]\ndependencies = [\n  "fastapi>=0.1",\n  "sqlalchemy"\n]\n[project.scripts]\nx = "orders:main"\n',
    "services/order/orders/models.py": "import fastapi\nfrom orders.db import Base\nclass Order(Base):\n    id: int\n    def total(self, tax: Tax): ...\ndef _hidden(): ...\n",
    "services/order/orders/bad.py": "def (:\n",
    "libs/math/CMakeLists.txt": "add_library(m m.c)",
    "libs/math/include/math_ops.h": "int add(int a, int b);",
    "libs/math/src/m.c": '#include "math_ops.h"\n#include <stdio.h>\nstatic int hid(struct Node *n) {\n}\nint add(int a, int b) {\n}\n',
    "web/tsconfig.json": '{"compilerOptions": {"rootDir": "src"}}',
    "web/package.json": '{"dependencies": {"express": "^4", "shared": "file:../shared"}, "devDependencies": {"jest": "1"}}',
    "web/src/routes/index.ts": "import express from 'express';\nimport { u } from './users';\nexport class Router extends Base {\n}\nexport function go() {}\n",
    "web/big.yaml": "x" * 20_000,
    "web/app.yaml": "a: 1",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    files = project.read_tree(spark, str(root)).cache()
    projects = project.discover(files).cache()
    return files, projects, project.owned_files(files, projects).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_discover_and_classify(tree):
    files, projects, owned = tree
    assert {r.path: r.language for r in projects.collect()} == {"services/user": "java", "services/order": "python", "libs/math": "c", "web": "typescript"}
    assert {r.path: r.type for r in project.classify(projects, owned).collect()} == {"services/user": "container", "services/order": "container", "libs/math": "library", "web": "container"}
    assert len(TREE) == files.count()


def test_large_sources_are_read(spark, tmp_path):
    (tmp_path / "pom.xml").write_text("<project/>")
    (tmp_path / "Big.java").write_text("package a.b;\nimport c.D;\npublic class Big {\n" + "// generated\n" * 100_000 + "}\n")
    (tmp_path / "big.yaml").write_text("x" * 20_000)
    files = project.read_tree(spark, str(tmp_path))
    projects = project.discover(files)
    owned = project.owned_files(files, projects)
    assert [(r.module, r.exports) for r in project.modules(project.sources(owned, projects)).collect()] == [("a.b", ["Big"])]
    assert [r.file for r in project.config_files(owned).collect()] == ["pom.xml"]
    assert project.read_tree(spark, str(tmp_path), 1 << 20).count() == 2


def test_dependencies(tree):
    assert rows(project.dependencies(tree[2]).select("project", "name", "internal")) == [
        ("services/order", "fastapi", False),
        ("services/order", "sqlalchemy", False),
        ("services/user", "org.postgresql:postgresql", False),
        ("web", "express", False),
        ("web", "shared", True),
    ]


def test_dependency_versions(spark):
    files = [
        ("a", "pom.xml", "<dependency><groupId>g</groupId><artifactId>x</artifactId><version>1.2</version></dependency>"),
        ("b", "build.gradle", "dependencies {\n  implementation 'g:y:2.0'\n  api(\"g:z\")\n  implementation 't:t:1'\n  testImplementation 't:t:1'\n}"),
        ("c", "requirements.txt", "# note\n-r other.txt\nflask==2.0\n requests \n"),
        ("d", "package.json", '{"dependencies": {"express": "^4.1", "w": "workspace:*", "l": "link:../l"}}'),
    ]
    owned = spark.createDataFrame(files, "project string, rel string, content string")
    got = rows(project.dependencies(owned))
    assert got == [("a", "g:x", False, "1.2"), ("b", "g:y", False, "2.0"), ("b", "g:z", False, None), ("c", "flask", False, "2.0"), ("c", "requests", False, None), ("d", "express", False, "4.1"), ("d", "l", True, None), ("d", "w", False, "*")]


def test_source_roots_and_applications(spark):
    files = {
        "web/tsconfig.json": '{ // where\n "compilerOptions": {"rootDir": "./app/"}, /* x */ "include": ["src/**"] }',
        "web/package.json": '{"name": "@x/web", "dependencies": {"express": "1", "@nestjs/core": "2", "shared": "file:../shared"}}',
        "web/app/routes/a.ts": "import e from 'express/lib';\nimport n from '@nestjs/core';",
        "web/app/main.ts": "import k from 'koa';",
        "web/src/other.ts": "import e from 'express';",
        "web/app/types.d.ts": "export const x = 1;",
        "two/tsconfig.json": '{"compilerOptions": {"rootDir": "none"}, "include": ["src/*"]}',
        "two/src/x/y.ts": "export class Y {}",
        "three/tsconfig.json": "not json",
        "three/z.ts": "",
        "j/settings.gradle": "rootProject.name = 'all'\ninclude ':core', ':web:api'\nproject(':core').projectDir = file('lib')",
        "j/build.gradle": "group 'com.j'",
        "j/lib/build.gradle.kts": "group = \"com.j\"\ndependencies { implementation(project(\":web:api\")) }",
        "j/web/api/build.gradle": "dependencies { api project(':core') }",
        "m/pom.xml": "<project><parent><artifactId>top</artifactId></parent><artifactId>shop</artifactId></project>",
    }
    tree = spark.createDataFrame([(k, v, len(v)) for k, v in files.items()], "path string, content string, length int")
    projects = project.discover(tree)
    owned = project.owned_files(tree, projects)
    assert rows(project.source_roots(owned, projects)) == [("three", ""), ("two", "src"), ("web", "app")]
    found = project.sources(owned, projects)
    assert sorted((r.project, r.rel, r.module) for r in found.where("language = 'typescript'").collect()) == [("three", "z.ts", "three"), ("two", "src/x/y.ts", "x"), ("web", "app/main.ts", "web"), ("web", "app/routes/a.ts", "routes")]
    assert rows(project.ts_frameworks(found, project.dependencies(owned))) == [("web", "routes", "Express,NestJS")]
    apps = {r.project: (r.app_id, r.name, r.published_as) for r in project.applications(owned, projects).collect()}
    assert apps["web"] == ("web", "@x/web", "@x/web") and apps["m"] == ("m", "shop", None)
    assert apps["j"] == ("j", "all", "com.j:all") and apps["j/lib"] == ("j-lib", "core", "com.j:core") and apps["j/web/api"][1] == "api"
    assert rows(project.internal_imports(owned, projects)) == [("j/lib", "j/web/api"), ("j/web/api", "j/web/core"), ("web", "shared")]


def test_c_structure_and_system_headers(spark):
    files = [("l", "c", "inc/stdio.h", "inc", ""), ("l", "c", "src/a.c", "src", '#include <stdio.h>\n#include "stdio.h"\n#include "inc/stdio.h"\n#include "gone.h"'), ("l", "c", "b.c", "", "")]
    df = spark.createDataFrame(files, "project string, language string, rel string, module string, content string")
    assert sorted((r.path, r.name, r.headers, r.sources) for r in project.c_structure(df).collect()) == [(".", "l", [], ["b.c"]), ("inc", "inc", ["inc/stdio.h"], []), ("src", "src", [], ["src/a.c"])]
    assert rows(project.module_imports(df).select("source", "is_external")) == [("gone.h", True), ("inc/stdio.h", False), ("stdio.h", True)]


def test_modules_and_imports(tree):
    files = project.sources(tree[2], tree[1])
    mods = {(r.project, r.module): r for r in project.modules(files).collect()}
    assert mods["services/user", "com.ex.user"].exports == ["UserController"]
    assert mods["services/user", "com.ex.user"].annotations == "RestController"
    assert mods["services/order", "orders"].framework == "fastapi"
    imports = {(r.module, r.source): r.is_external for r in project.module_imports(files).collect()}
    assert imports == {
        ("com.ex.user", "com.ex.repo.UserRepository"): False,
        ("com.ex.user", "org.spring.RestController"): True,
        ("orders", "fastapi"): True,
        ("orders", "orders.db"): False,
        ("src", "math_ops.h"): False,
        ("src", "stdio.h"): True,
        ("routes", "express"): True,
        ("routes", "./users"): False,
    }


def test_config_files(tree):
    assert [r.file for r in project.config_files(tree[2]).where("project = 'web'").orderBy("file").collect()] == ["app.yaml", "package.json", "tsconfig.json"]


def test_elements(tree):
    found = {(r.name, r.kind): r for r in elements.elements(project.sources(tree[2], tree[1])).collect()}
    names = lambda r: [m.name for m in r.members]
    refs = lambda r: [(x.name, x.kind) for x in r.refs]
    assert names(found["Order", "class"]) == ["total"] and refs(found["Order", "class"]) == [("Base", "extends"), ("Tax", "uses")]
    assert found["_hidden", "function"].visibility == "private"
    assert found["hid", "function"].visibility == "private" and refs(found["hid", "function"]) == [("Node", "uses")]
    assert names(found["UserController", "class"]) == ["r", "get"] and found["UserController", "class"].refs[0].qualified_name == "com.ex.repo.UserRepository"
    assert refs(found["Router", "class"]) == [("Base", "extends")]
    assert [r.error.split(":")[0] for r in found.values() if r.error] == ["SyntaxError"]


def _java(text):
    return {e["name"]: e for e in elements.java_elements(text)}


def test_java_elements():
    found = _java(
        "package p.q;\nimport o.Repo;\nimport w.*;\n// class No {\n@A(\"class X {\")\npublic class B<T extends F> extends Base<T> implements I, J<K> {\n"
        "  private final Repo repo = new Repo() { int q; };\n  int[] a = {1, 2};\n  Map<String, List<Bar>> m;\n  public B(Qux... q) { if (x) { go(); } }\n"
        "  @Get(v = \"x\")\n  public List<Item> get(@P String id, Opt o) throws E { return null; }\n  static { init(); }\n  enum Color { RED; Foo f; }\n}\n"
        "interface I extends C<D> { Res find(Key k); int MAX = 3; }\nclass Z { private void zed() {} }\n"
    )
    assert [(m["name"], m["kind"], m["signature"], m["visibility"]) for m in found["B"]["members"]] == [
        ("repo", "field", "repo: Repo", "private"),
        ("a", "field", "a: int[]", "internal"),
        ("m", "field", "m: Map<String, List<Bar>>", "internal"),
        ("get", "method", "get(@P String id, Opt o): List<Item>", "public"),
    ]
    assert [(r["name"], r["qualified_name"], r["kind"]) for r in found["B"]["refs"]] == [
        ("Base", "p.q.Base", "extends"), ("I", "p.q.I", "implements"), ("J", "p.q.J", "implements"), ("Repo", "o.Repo", "uses"), ("Map", "p.q.Map", "uses"),
        ("List", "p.q.List", "uses"), ("Bar", "p.q.Bar", "uses"), ("Qux", "p.q.Qux", "uses"), ("Item", "p.q.Item", "uses"), ("Opt", "p.q.Opt", "uses"),
    ]
    assert found["B"]["qualified_name"] == "p.q.B" and found["B"]["visibility"] == "public" and "No" not in found and "X" not in found
    assert [m["name"] for m in found["I"]["members"]] == ["find"] and [(r["name"], r["kind"]) for r in found["I"]["refs"]] == [("C", "extends"), ("Res", "uses"), ("Key", "uses")]
    assert found["Color"]["members"] == [] and found["Color"]["refs"] == [] and [m["name"] for m in found["Z"]["members"]] == ["zed"]
    assert _java("class A { void a() {} }\nclass B { void b() {} }")["A"]["members"][0]["name"] == "a"
    assert _java("class A {") and not _java("") and len(_java("".join(f"class C{i} {{ void m{i}() {{}} }}\n" for i in range(3000)))) == 3000


def test_typescript_elements():
    found = {e["name"]: e for e in elements.typescript_elements(
        "export abstract class Svc<T> extends Base<T> implements A, ns.B {\n  private repo: Repo;\n  static count = 0\n  run = (e: Event) => { return 1; }\n"
        "  constructor(private readonly db: Db, log: Log, protected x = 3) { super(); }\n  async find(id: string, f?: Filter): Promise<Item[]> { return q({a: 1}); }\n}\n"
        "interface Shape extends Other { area(): number; kind: Kind | null\n  w: Map<string, Widget> }\nexport type Id = string | Foo;\nasync function main(a: X) {}\nconst f = function () {};\n"
    )}
    assert [(m["name"], m["kind"], m["visibility"]) for m in found["Svc"]["members"]] == [
        ("repo", "field", "private"), ("count", "field", "public"), ("run", "field", "public"), ("db", "field", "private"), ("x", "field", "internal"), ("constructor", "method", "public"), ("find", "method", "public"),
    ]
    assert found["Svc"]["members"][-1]["signature"] == "find(id: string, f?: Filter): Promise<Item[]>"
    assert [(r["name"], r["kind"]) for r in found["Svc"]["refs"]] == [("Base", "extends"), ("A", "implements"), ("B", "implements"), ("Repo", "uses"), ("Db", "uses"), ("Log", "uses"), ("Filter", "uses"), ("Item", "uses")]
    assert [m["name"] for m in found["Shape"]["members"]] == ["area", "kind", "w"] and [r["name"] for r in found["Shape"]["refs"]] == ["Other", "Kind", "Widget"]
    assert found["Id"]["kind"] == "type" and found["main"]["kind"] == "function" and set(found) == {"Svc", "Shape", "Id", "main"}


def test_c_elements(spark):
    text = (
        "#include <stdio.h>\n#define M(a) do { \\\n } while (0)\ntypedef struct node { int v; struct node *next; Tree *t; Color c[3]; } Node;\ntypedef unsigned long ulong_t;\ntypedef int (*fn)(int);\n"
        "int add(int a, int b);\nint add(int a, int b) { if (a) { return add(1, 2); } return a; }\nstatic Node *make(struct point *p, const Conf *c) { return 0; }\nint table[] = {1, 2};\n"
    )
    found = {e["name"]: e for e in elements.c_elements(text)}
    assert {n: (e["kind"], e["visibility"], e["line"]) for n, e in found.items()} == {"node": ("struct", "public", 4), "Node": ("typedef", "public", 4), "ulong_t": ("typedef", "public", 5), "add": ("function", "public", 8), "make": ("function", "private", 9)}
    assert [m["signature"] for m in found["node"]["members"]] == ["v: int", "next: struct node", "t: Tree", "c: Color"]
    assert [(r["name"], r["kind"]) for r in found["node"]["refs"]] == [("node", "contains"), ("Tree", "contains"), ("Color", "contains")]
    assert [r["name"] for r in found["make"]["refs"]] == ["Node", "point", "Conf"]
    files = [("l", "src", r, "c", c) for r, c in (("a.h", "int add(int a);"), ("z.c", "int add(int a) { return a; }\nstatic int own(void) { return 1; }"), ("y.c", "static int own(void) { return 2; }"))]
    df = spark.createDataFrame([*files, ("p", "m", "x.py", "python", "def ("), ("p", "m", "y.py", "python", "def (")], "project string, module string, rel string, language string, content string")
    parsed = elements.elements(df)
    assert rows(elements.merged_c(parsed).select("rel", "name")) == [("y.c", "own"), ("z.c", "add"), ("z.c", "own")]
    assert rows(elements.failures(parsed, df)) == [("c", 3, 0, False), ("python", 2, 2, True)]


def test_package_type(spark):
    df = spark.createDataFrame([('{"scripts": {"start": "node server.js"}}',), ('{"scripts": {"dev": "vitest app"}}',), ('{"bin": "x"}',), ("not json",)], "c string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(project.package_type(F.col("c"), F.lit("package.json"))).collect()] == ["container", "library", "container", "container"]


def test_gradle(spark):
    df = spark.createDataFrame([("p", "include ':core', ':web:api'\nproject(':core').projectDir = file('lib/core')")], "project string, content string")
    assert rows(project.gradle_modules(df)) == [("p", "core", "lib/core"), ("p", "web:api", "web/api")]


def test_model_round_trip(spark):
    text = "actors:\n- id: u\n  name: U\ncontainers:\n- id: c\n  applicationId: a\n  name: C\n"
    loaded = documents.load_model(spark, text)
    assert loaded["containers"].first().application_id == "a" and loaded["components"].count() == 0
    assert documents.load_model(spark, documents.dump_model(loaded))["actors"].first().name == "U"
    text += "system: {name: S, description: d}\ncomponents:\n- {id: p, containerId: c, name: P, moduleIds: [m]}\n"
    text += "codeElements:\n- {id: e, componentId: p, containerId: c, kind: class, name: E, members: [{name: f, kind: field, visibility: public}]}\n- {id: g, componentId: p, containerId: c, kind: function, name: G, signature: g()}\n"
    text += "codeRelationships:\n- {sourceId: e, targetId: g, kind: uses}\n"
    loaded = documents.load_model(spark, text)
    again = documents.load_model(spark, documents.dump_model(loaded))
    for name in documents.MODEL:
        assert loaded[name].collect() == again[name].collect()
    assert again["code_elements"].first().members[0].name == "f" and again["system"].first().name == "S" and again["code_relationships"].count() == 1


@pytest.mark.parametrize(
    "text, problem",
    [
        ("containers:\n- {id: c, applicationId: a, name: C}\n- {id: c, applicationId: a, name: D}\n", "containers[1]: id c is taken by containers[0]"),
        ("actors:\n- {id: a}\n", "actors[0]: lacks ['name']"),
        ("actors:\n- {id: a, name: A, age: 3}\n", "actors[0]: unknown fields ['age']"),
        ("codeElements:\n- {id: e, componentId: p, containerId: c, kind: class, name: E}\n", "unknown component p"),
        ("components:\n- {id: p, containerId: d, name: P}\ncodeElements:\n- {id: e, componentId: p, containerId: c, kind: class, name: E}\n", "component p is not in container c"),
        ("components:\n- {id: p, containerId: c, name: P}\ncodeElements:\n- {id: e, componentId: p, containerId: c, kind: function, name: E, members: []}\n", "a function has no members"),
        ("codeRelationships:\n- {sourceId: e, targetId: g, kind: uses}\n", "unknown source_id e"),
        ("- a\n- b\n", "no mapping"),
    ],
)
def test_invalid_models(spark, text, problem):
    with pytest.raises(ValueError, match=re.escape(problem)):
        documents.load_model(spark, text)


def test_model_keys(spark):
    with pytest.raises(ValueError):
        documents.load_model(spark, "actrs: []")


def test_diagram_cells(spark):
    xml = '<root><mxCell id="a" value="A" style="s;managed=1" vertex="1" parent="1"><mxGeometry x="1" y="2"/></mxCell><UserObject id="a" label="B"><mxCell style="t" vertex="1" parent="1"/></UserObject><mxCell id="e" edge="1" source="a" target="b"/></root>'
    got = {r.id: r for r in documents.diagram_cells(spark.createDataFrame([("f", xml)], "file string, content string")).collect()}
    assert got["a"].value == "B" and not got["a"].managed and got["e"].is_edge and got["e"].target == "b"
    more = [("g", '<m><mxCell id="p" value="A &amp;lt; &quot;B&quot;&#10;c" style="x;managed=1" vertex="1"><mxGeometry x="1" y="2.5" width="30" height="4"/></mxCell>'
             '<UserObject id="u" label="L" tooltip="t &lt;"><mxCell edge="1" source="p" target="q"><mxGeometry><Array as="points"><mxPoint x="1" y="2"/><mxPoint x="3" y="4"/></Array></mxGeometry></mxCell></UserObject></m>'),
            ("h", "<root><mxCell"), ("i", None), ("j", "")]
    got = {(r.file, r.id): r for r in documents.diagram_cells(spark.createDataFrame(more, "file string, content string")).collect()}
    assert got["g", "p"].value == 'A &lt; "B"\nc' and (got["g", "p"].x, got["g", "p"].width, got["g", "p"].managed) == (1.0, 30.0, True)
    assert (got["g", "u"].tooltip, got["g", "u"].points, got["g", "u"].is_edge) == ("t <", "1,2 3,4", True)
    assert got["h", None].error.startswith("ParseError") and len(got) == 3


def test_stream_equals_batch(spark, tmp_path):
    lines = [("2024-01-01 00:00:00", "f", 1, "u: jdbc:mysql://d/x"), ("2024-01-01 00:01:00", "f", 2, "u: jdbc:mysql://d/x"), ("2024-01-01 00:02:00", "g", 1, "c: h:6379")]
    df = spark.createDataFrame(lines, "ts string, file string, line int, text string").selectExpr("cast(ts AS timestamp) AS ts", "file", "line", "text")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_signals(stream).writeStream.format("memory").queryName("sig").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("SELECT file, value FROM sig")) == [("f", "jdbc:mysql://d/x"), ("g", "h:6379")]


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "view", 1.0), ("2024-01-01 00:50:00", "view", 2.0), ("2024-01-01 01:10:00", "view", 4.0)], "ts string, event_type string, value double")
    out = windowed_counts(df.selectExpr("cast(ts AS timestamp) AS ts", "event_type", "value"))
    assert rows(out.select("n", "total")) == [(1, 4.0), (2, 3.0)]


def test_model_in_pieces(spark):
    """A model's text is made and read piece by piece: joined, the pieces are the model file; the driver holds none of it."""
    text = "system: {name: S, description: 'a: b'}\nactors:\n- {id: u, name: 'é\n\n  - x', description: '3'}\ncontainers:\n- {id: c, applicationId: a, name: C}\ncomponents:\n- {id: p, containerId: c, name: P, moduleIds: [m, 'n: 1']}\n"
    text += "codeElements:\n- {id: e, componentId: p, containerId: c, kind: class, name: E, members: [{name: f, kind: field, visibility: public}]}\n- {id: g, componentId: p, containerId: c, kind: function, name: G, signature: g()}\n"
    text += "codeRelationships:\n- {sourceId: e, targetId: g, kind: uses}\n- {sourceId: g, targetId: e, kind: uses}\n"
    loaded = documents.load_model(spark, text)
    pieces = documents.dump_pieces(loaded)
    by_row = lambda m: {name: sorted(map(str, df.collect())) for name, df in m.items()}
    again, whole = documents.load_pieces(pieces), documents.load_model(spark, render.joined(pieces, [], "text").first().text)
    assert by_row(loaded) == by_row(again) == by_row(whole) and loaded["actors"].first().name == "é\n- x"
    assert all(again[name].schema == loaded[name].schema for name in documents.MODEL)


def test_a_piece_holds_one_item(spark, monkeypatch):
    components = spark.range(3000).selectExpr("concat('p', id) AS id", "'c' AS container_id", "concat('P', id) AS name")
    monkeypatch.setattr(documents, "dump_model", None)  # neither text nor rows of the whole model are made
    monkeypatch.setattr(documents, "load_model", None)
    pieces = documents.dump_pieces({"components": components})
    assert pieces.agg(F.max(F.length("line"))).first()[0] < 80
    assert documents.load_pieces(pieces)["components"].exceptAll(components.selectExpr("id", "container_id", "name", "NULL AS description", "NULL AS technology", "NULL AS module_ids")).count() == 0
    trip = catalog.queries()["model_round_trip"](spark, "/root/testdata/sf0.001")
    assert trip.count() > 0


@pytest.mark.parametrize(
    "rows, problem",
    [
        ([(8, "c", "- {id: c, applicationId: a, name: C}"), (8, "c", "- {id: c, applicationId: a, name: D}")], "containers c: id is taken by 2 items"),
        ([(4, "a", "- {id: a}")], "actors a: lacks ['name']"),
        ([(4, "a", "- {id: a, name: A, age: 3}")], "actors a: unknown fields ['age']"),
        ([(4, "", "- 5")], "actors : no mapping"),
        ([(14, "e", "- {id: e, componentId: p, containerId: c, kind: class, name: E}")], "code_elements e: unknown component p"),
        ([(10, "p", "- {id: p, containerId: d, name: P}"), (14, "e", "- {id: e, componentId: p, containerId: c, kind: class, name: E}")], "component p is not in container c"),
        ([(10, "p", "- {id: p, containerId: c, name: P}"), (14, "e", "- {id: e, componentId: p, containerId: c, kind: function, name: E, members: []}")], "code_elements e: a function has no members"),
        ([(16, "", "- {sourceId: e, targetId: g, kind: odd}")], "e -> g: unknown target_id g"),
    ],
)
def test_invalid_pieces(spark, rows, problem):
    with pytest.raises(ValueError, match=re.escape(problem)):
        documents.load_pieces(spark.createDataFrame(rows, "section int, k string, line string"))

"""The supplier table as source trees: a project per nation, in four languages, with a file or two per supplier.

The checking SQL doesn't read the files: it derives from the same rows what a reader of the files has to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import table

LANGUAGES = ("java", "python", "typescript", "c")


def _text(template: str, **values: Column) -> Column:
    """A template whose {names} stand for columns."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        name, _, after = tail.partition("}")
        if brace and name in values:
            parts += [F.lit(head), values[name].cast("string")]
            rest = after
        else:
            parts.append(F.lit(head + brace))
            rest = tail
    return F.concat(*parts)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n: supplier and nation; nk, nn: those of the next supplier, or its own."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("n"))
    after = s.select((F.col("k") - 1).alias("k"), F.col("k").alias("nk"), F.col("n").alias("nn"))
    return s.join(after, "k", "left").select("k", "n", F.coalesce("nk", "k").alias("nk"), F.coalesce("nn", "n").alias("nn"))


SUPPLIERS_SQL = """
sup AS (SELECT s.s_suppkey AS k, CAST(s.s_nationkey AS BIGINT) AS n, coalesce(t.s_suppkey, s.s_suppkey) AS nk, CAST(coalesce(t.s_nationkey, s.s_nationkey) AS BIGINT) AS nn
        FROM supplier s LEFT JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1),
nat AS (SELECT CAST(n_nationkey AS BIGINT) AS n, 'apps/n' || n_nationkey AS project FROM nation)
"""

JAVA = """package com.n{n}.p{p};
import com.n{nn}.p{np}.S{nk};
import org.lib.L{l};
// class Hidden { }
@Service
public class S{k} extends Base{b} implements Api{p} {
  private S{nk} next;
  protected String name = "class X {";
  public List<Item{i}> find(S{nk} other, int n) { if (n > 0) { return null; } return null; }
  void reset() { }
}
enum Mode{k} { ON, OFF }
"""
PYTHON = """import os
import pkg{nb}.m{nk}
from lib{l}.x import y
{extra}
class S{k}(Base{b}):
    def find(self, other: S{nk}, n: int) -> "m.Item{i}":
        return None

def _helper{k}():
    pass
"""
TYPESCRIPT = """import { S{nk} } from './s{nk}';
{extra}
export class S{k} extends Base{b} {
  private next: S{nk};
  constructor(private readonly db: Db{p}, n: number) { }
  find(id: string): Promise<Item{i}> { return null; }
}
export function make{k}() { return 1; }
"""
HEADER = """struct S{k} { int id; struct S{nk} *next; Item{i} item; };
int make_{k}(int a);
"""
SOURCE = """#include "s{k}.h"
#include <stdio.h>
#include <s{k}.h>
#include "s{nk}.h"
static int own(struct S{k} *s) { return 1; }
int make_{k}(int a) { return a; }
"""
POM = """<project><parent><artifactId>top</artifactId></parent><artifactId>svc-{n}</artifactId><packaging>{kind}</packaging>
<dependencies><dependency><groupId>org.lib</groupId><artifactId>l{b}</artifactId><version>1.{n}</version></dependency>
<dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId></dependency></dependencies></project>
"""
GRADLE = """plugins { id 'application' }
group = 'com.org'
dependencies {
  implementation 'org.lib:l{b}:2.{n}'
  api("redis:jedis")
  implementation 't:t:1'
  testImplementation 't:t:1'
  implementation project(':n{m}')
}
"""
PYPROJECT = """[project]
dependencies = [
  "fastapi>=0.{n}",
  "kafka-lib{b}"
]
{extra}
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, length of all trees."""
    s = suppliers(spark, sf_dir)
    c = F.col
    v = {x: c(x) for x in ("k", "n", "nk", "nn")} | {"p": c("k") % 3, "np": c("nk") % 3, "b": c("k") % 2, "nb": c("nk") % 2, "l": c("k") % 5, "i": c("k") % 4}
    of = lambda r: s.where(c("n") % 4 == r)
    row = lambda df, path, content: df.select(path.alias("path"), content.alias("content"))
    web = F.when(c("k") % 2 == 0, "import express from 'express/lib';").otherwise("import k from 'koa';")
    fast = F.when(c("k") % 3 == 0, "from fastapi import X").otherwise("")
    parts = [
        row(of(0), _text("apps/n{n}/src/main/java/com/n{n}/p{p}/S{k}.java", **v), _text(JAVA, **v)),
        row(of(1), _text("apps/n{n}/pkg{b}/m{k}.py", **v), _text(PYTHON, extra=fast, **v)),
        row(of(2), _text("apps/n{n}/{root}/f{b}/s{k}.ts", root=_root(c("n")), **v), _text(TYPESCRIPT, extra=web, **v)),
        row(of(2), _text("apps/n{n}/other/x{k}.ts", **v), F.lit("export class Outside {}")),
        row(of(3), _text("apps/n{n}/include/s{k}.h", **v), _text(HEADER, **v)),
        row(of(3), _text("apps/n{n}/src/s{k}.c", **v), _text(SOURCE, **v)),
    ]
    nations = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("n"))
    m = {"n": c("n"), "m": c("n") + 4, "b": c("n") % 2}
    scripts = F.when(c("n") % 8 == 1, '[project.scripts]\nrun = "x:main"').otherwise("")
    at = lambda r, eight: nations.where(c("n") % (8 if eight else 4) == r)
    parts += [
        row(at(0, True), _text("apps/n{n}/pom.xml", **m), _text(POM, kind=F.when(c("n") % 16 == 0, "war").otherwise("jar"), **m)),
        row(at(4, True), _text("apps/n{n}/build.gradle", **m), _text(GRADLE, **m)),
        row(at(1, False), _text("apps/n{n}/pyproject.toml", **m), _text(PYPROJECT, extra=scripts, **m)),
        row(at(1, True), _text("apps/n{n}/bad.py", **m), F.lit("def (:\n")),
        row(at(2, False), _text("apps/n{n}/tsconfig.json", **m), F.when(c("n") % 8 == 2, '{ // root\n "compilerOptions": {"rootDir": "./src"} }').otherwise('{"include": ["lib/*"]}')),
        row(at(2, False), _text("apps/n{n}/package.json", **m), _text('{"name": "@org/n{n}", "dependencies": {"express": "^4.{n}", "shared": "file:../n{m}"}, "devDependencies": {"jest": "1"}, "scripts": {"start": "node {b}server.js"}}', **m)),
        row(at(3, False), _text("apps/n{n}/CMakeLists.txt", **m), F.when(c("n") % 8 == 3, "add_library(m m.c)").otherwise("add_executable(m m.c)")),
        row(nations, _text("apps/n{n}/config/app.properties", **m), _text("db.url=jdbc:mysql://h{n}/db\n", **m)),
        row(nations, _text("apps/n{n}/config/big.yaml", **m), F.repeat(F.lit("x: y\n"), 4000)),
        row(nations, _text("apps/n{n}/config/keystore.properties", **m), F.lit("a=b")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("length", F.length("content").cast("long"))


def _root(n: Column) -> Column:
    return F.when(n % 8 == 2, "src").otherwise("lib")

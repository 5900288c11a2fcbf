"""Languages as plug-ins: an analyzer is a Python table function, with the build files and sources that belong to it.

    analyzers.register(spark, analyzers.Analyzer("go", ("go.mod",), r"[.]go$", parse))
    spark.sql("SELECT path, e.* FROM files, LATERAL analyze_go(content) e")

Priority is the order of registration: of several build files in a folder that of the earlier analyzer counts, and of
one analyzer's the earlier file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elements import PARSERS
from .project import BUILD_FILES, SOURCES, base, directory

ELEMENT = "name string, kind string, visibility string, line int, error string"


@dataclass(frozen=True)
class Analyzer:
    """parse: the text of a file -> dicts with name, kind and, if known, visibility and line."""

    language: str
    build_files: tuple[str, ...]
    sources: str
    parse: Callable[[str], Iterable[dict]]

    @property
    def function(self) -> str:
        return f"analyze_{self.language}"


#: In the order of registration.
_registered: dict[str, Analyzer] = {}


def _table_function(parse: Callable[[str], Iterable[dict]]):
    class Elements:
        def eval(self, content: str):
            if not content:
                return
            try:
                found = [(e["name"], e["kind"], e.get("visibility"), e.get("line"), None) for e in parse(content)]
            except Exception as x:  # noqa: BLE001  one file must not end the job
                found = [(None, None, None, None, f"{type(x).__name__}: {x}"[:1000])]
            yield from found

    return F.udtf(Elements, returnType=ELEMENT)


def register(spark: SparkSession, analyzer: Analyzer) -> None:
    """Make an analyzer known; one of the same language takes the other's place in the order."""
    if not re.fullmatch("[a-z][a-z0-9_]*", analyzer.language):
        raise ValueError(f"not a name of a language: {analyzer.language!r}")
    _registered[analyzer.language] = analyzer
    spark.udtf.register(analyzer.function, _table_function(analyzer.parse))


def unregister(language: str) -> None:
    _registered.pop(language, None)


def registered() -> list[Analyzer]:
    return list(_registered.values())


def register_own(spark: SparkSession) -> None:
    """The library's own languages, in the order of their build files."""
    for language in dict.fromkeys(name for name, _ in BUILD_FILES):
        register(spark, Analyzer(language, tuple(f for name, f in BUILD_FILES if name == language), SOURCES[language], PARSERS[language]))


def discover(files: DataFrame) -> DataFrame:
    """path (directory), build_file, language of the registered analyzers' projects."""
    order = [(a.language, f) for a in registered() for f in a.build_files]
    rank = reduce(lambda other, i: F.when(base("path") == order[i][1], i).otherwise(other), reversed(range(len(order))), F.lit(None).cast("int"))
    first = files.select("path", rank.alias("rank")).where("rank IS NOT NULL").groupBy(directory("path").alias("dir")).agg(F.min("rank").alias("rank"))
    pick = lambda k: F.get(F.array(*(F.lit(o[k]) for o in order)), F.col("rank"))
    return first.select(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("path"), pick(1).alias("build_file"), pick(0).alias("language"))


def elements(owned: DataFrame, projects: DataFrame) -> DataFrame:
    """project, language, rel, name, kind, visibility, line, error of the files (project, rel, content) whose name belongs to
    their project's analyzer. Each analyzer's table function is joined laterally to the files of its language."""
    rows = owned.select("project", "rel", "content").join(projects.select(F.col("path").alias("project"), "language"), "project")
    out = None
    for a in registered():
        mine = rows.where((F.col("language") == a.language) & F.col("rel").rlike(a.sources))
        each = mine.lateralJoin(_table_function(a.parse)(F.col("content").outer()))
        each = each.drop("content").where("name IS NOT NULL OR error IS NOT NULL")
        out = each if out is None else out.unionByName(each)
    if out is None:
        raise ValueError("no analyzer is registered")
    return out.select("project", "language", "rel", "name", "kind", "visibility", "line", "error")

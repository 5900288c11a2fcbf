"""Infrastructure signals in configuration text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import config_value, file_format

_URL_END = r"""[^\s'"`,)}>]+"""
# Signal patterns (name, type, pattern), in order, without regard to case.
PATTERNS = (
    ("jdbc-postgresql", "database-url", "jdbc:postgresql://" + _URL_END),
    ("jdbc-mysql", "database-url", "jdbc:mysql://" + _URL_END),
    ("jdbc-oracle", "database-url", "jdbc:oracle:" + _URL_END),
    ("jdbc-sqlite", "database-url", "jdbc:sqlite:" + _URL_END),
    ("jdbc-h2", "database-url", "jdbc:h2:" + _URL_END),
    ("mongodb-url", "database-url", r"mongodb(\+srv)?://" + _URL_END),
    ("kafka-bootstrap", "message-broker", r"[\w.-]+:\s*(?:9092|9093|9094)\b"),
    ("kafka-topic", "message-broker", r"""(?:topic|destination)[=:\s]+\s*["']?[\w.-]+["']?"""),
    ("amqp-url", "message-broker", "amqps?://" + _URL_END),
    ("redis-url", "cache-endpoint", "rediss?://" + _URL_END),
    ("redis-host", "cache-endpoint", r"[\w.-]+:\s*6379\b"),
    ("memcached-host", "cache-endpoint", r"[\w.-]+:\s*11211\b"),
    ("elasticsearch-url", "search-endpoint", r"[\w.-]+:\s*9200\b"),
    ("s3-endpoint", "object-storage", r"s3[.:/][\w.-]*amazonaws\.com"),
    ("s3-bucket", "object-storage", r"""(?:bucket)[=:\s]+\s*["']?[\w.-]+["']?"""),
    ("service-url", "service-endpoint", r"""https?://[^\s'"`,{}<>]+"""),
    ("server-port", "server-config", r"(?:server[._-]?port|listen)[=:\s]+\s*\d+"),
    ("env-infra-ref", "env-infrastructure", r"\$\{?\s*(?:DATABASE|DB|REDIS|KAFKA|RABBIT|AMQP|ELASTICSEARCH|MONGO|MEMCACHED|S3)[A-Z_]*\s*\}?"),
)
# Matched values that are noise.
NOISE = (
    r"https?://www\.w3\.org/",
    r"https?://xmlns\.jcp\.org/",
    r"https?://schemas\.",
    r"https?://xml\.apache\.org/",
    r"https?://repo\.maven\.apache\.org/",
    r"https?://repo1\.maven\.org/",
    r"https?://plugins\.gradle\.org/",
    r"https?://registry\.npmjs\.org/",
    r"https?://docs\.",
    r"https?://javadoc\.",
    r"https?://tools\.ietf\.org/",
    r"https?://www\.oracle\.com/.*\.dtd",
    r"https?://hibernate\.org/dtd/",
    r"/actuator\b",
    r"/health\b",
    r"/info\b",
    r"https?://localhost[:/]",
    r"https?://127\.0\.0\.1[:/]",
    r"https?://0\.0\.0\.0[:/]",
    r"https?://\[::1\][:/]",
)
COMMENT = r"^\s*([#!]|<!--)"


def noise(value: Column) -> Column:
    return value.rlike("(?i)" + "|".join(NOISE))


def lines(files: DataFrame) -> DataFrame:
    """files: file, content -> file, line (from 1), text."""
    return files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def detect(text_lines: DataFrame) -> DataFrame:
    """file, line, text -> file, line, type, pattern, value: each line against each pattern, the first match of
    a pattern on a line; comments, blank lines and noise give none. Of equal (file, type, value) the first by
    line, then by pattern, stays. One pass builds an array per line, so rows are made for matches only."""
    tests = [
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("pattern"), F.lit(t).alias("type"), F.regexp_extract("text", "(?i)" + p, 0).alias("value"))
        for i, (n, t, p) in enumerate(PATTERNS)
    ]
    usable = text_lines.where((F.trim("text") != "") & ~F.col("text").rlike(COMMENT))
    found = usable.select("file", "line", F.explode(F.filter(F.array(*tests), lambda s: s["value"] != "")).alias("s"))
    found = found.select("file", "line", "s.*").where(~noise(F.col("value")))
    first = Window.partitionBy("file", "type", "value").orderBy("line", "ord")
    return found.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("file", "line", "type", "pattern", "value")


def ordered(signals: DataFrame) -> DataFrame:
    """Signals by file, line and type: a sort by ranges, for writing them out."""
    return signals.orderBy("file", "line", "type", "pattern")


def signal_files(files: DataFrame, signals: DataFrame) -> DataFrame:
    """Files with at least one signal."""
    return files.join(signals.select("file").distinct(), "file", "left_semi")


def toml_keys(text_lines: DataFrame) -> DataFrame:
    """file, line, key, value of the assignments under their last section header."""
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.nullif(F.regexp_extract("text", r"^\s*\[+([^\]]+)\]+", 1), F.lit(""))
    keyed = text_lines.withColumn("section", F.last(header, ignorenulls=True).over(so_far))
    name = F.regexp_extract("text", r"^\s*([\w.-]+)\s*=", 1)
    keyed = keyed.withColumn("name", name).where("name <> ''")
    key = F.when(F.col("section").isNull(), F.col("name")).otherwise(F.concat_ws(".", "section", "name"))
    return keyed.select("file", "line", key.alias("key"), config_value("text", F.lit("toml")).alias("value"))


# Patterns of a line's own key, by format.
_OWN = {
    "yaml": re.compile(r"\s*([\w.-]+)\s*:", re.A),
    "json": re.compile(r"""\s*"([\w.-]+)"\s*:""", re.A),
    "xml": re.compile(r"[^<]*<([\w.-]+)[\s>]|.*?<([\w.-]+)[\s>]", re.A),
    "properties": re.compile(r"\s*([\w.-]+)\s*[=:]", re.A),
    "toml": re.compile(r"\s*([\w.-]+)\s*=", re.A),
}
_SECTION = re.compile(r"\[([\w.-]+)\]", re.A)
_ITEM = re.compile(r"\s*-\s")


def paths_of(content: str, fmt: str) -> Iterator[tuple[int, str]]:
    """(line from 1, dotted key path) of the lines that have one.

    Where indentation nests keys (YAML, JSON, XML) a stack holds the keys still open: a line lies in those of a
    smaller indent, and a key closes those of its own indent or more. List items have no key of their own. In
    TOML and INI the last section header counts."""
    own = _OWN["toml" if fmt == "ini" else fmt]
    stack: list[tuple[int, str]] = []
    section = None
    for number, line in enumerate(content.split("\n"), 1):
        bare = line.strip()
        if not bare:
            continue
        if fmt in ("toml", "ini"):
            header, found = _SECTION.fullmatch(bare), own.match(line)
            if found:
                yield number, f"{section}.{found[1]}" if section else found[1]
            section = header[1] if header else section
            continue
        found = own.match(bare if fmt == "xml" else line)
        key = next(filter(None, found.groups()), None) if found else None
        if fmt == "properties":
            if key:
                yield number, key
            continue
        indent = len(line) - len(line.lstrip())
        shown = key if not (fmt == "yaml" and _ITEM.match(line)) else None
        path = [k for i, k in stack if i < indent] + [shown] * bool(shown)
        if path:
            yield number, ".".join(path)
        if key and not (fmt == "xml" and bare.startswith(("</", "<?"))):
            while stack and stack[-1][0] >= indent:
                stack.pop()
            stack.append((indent, key))


def key_paths(files: DataFrame) -> DataFrame:
    """file, line, key: the key paths of the lines of files (file, content, format). Each file is read by itself, in
    one pass; null contents have no lines."""

    def run(batches):
        for batch in batches:
            rows = [(f, n, k) for f, text, fmt in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if text is not None for n, k in paths_of(text, fmt)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], ["file", "line", "key"])

    return files.select("file", "content", "format").mapInArrow(run, "file string, line int, key string")


def yaml_keys(files: DataFrame) -> DataFrame:
    """file, line, key of every keyed YAML line, with its enclosing keys."""
    paths = key_paths(files.withColumn("format", F.lit("yaml")))
    keyed = lines(files).where(F.col("text").rlike(r"^\s*[\w.-]+\s*:") & ~F.col("text").rlike(r"^\s*-\s")).select("file", "line")
    return paths.join(keyed, ["file", "line"], "left_semi")


def signal_summary(files: DataFrame, signals: DataFrame) -> DataFrame:
    """file, summary: `key: value` of each line of a file (file, content) with a signal, by key and line; the whole
    content, if no such line has a key. Files without signals have no row."""
    hit = signals.select("file", "line").distinct()
    texts = files.join(hit.select("file").distinct(), "file", "left_semi").withColumn("format", file_format("file"))
    rows = key_paths(texts).join(hit, ["file", "line"], "left_semi").join(lines(texts), ["file", "line"])
    shown = F.struct("key", "line", F.concat("key", F.lit(": "), config_value("text", file_format("file"))).alias("shown"))
    found = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda r: r["shown"]), "\n").alias("found"))
    return texts.join(found, "file", "left").select("file", F.coalesce("found", "content").alias("summary"))


def condense(text_lines: DataFrame) -> DataFrame:
    """app, file, line, text -> app, condensed: of equal trimmed lines of an app the first by file and line, under a
    header with the name of its file, in that order. Blank lines go, and so do files of which nothing is left."""
    trimmed = text_lines.withColumn("text", F.trim("text")).where("text <> ''")
    first = trimmed.groupBy("app", "text").agg(F.min(F.struct("file", "line")).alias("at"))
    parts = first.groupBy("app", F.col("at.file").alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col("at.line").alias("line"), "text"))).alias("rows"))
    head = F.concat(F.lit("# "), F.substring_index(F.col("file").cast("string"), "/", -1), F.lit("\n"))
    parts = parts.select("app", "file", F.concat(head, F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("part"))
    ordered = parts.groupBy("app").agg(F.array_sort(F.collect_list(F.struct("file", "part"))).alias("parts"))
    return ordered.select("app", F.array_join(F.transform("parts", lambda r: r["part"]), "\n").alias("condensed"))

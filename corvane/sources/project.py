"""Source trees as tables: files, discovered projects, build files, imports, modules and elements.

`read_tree` gives one row per file (path, content, length). Everything else is a function of such rows, so it
runs on any store that Spark reads and is tested on small frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs
from ..functions.text import slug

# Build files by language, in order of priority.
BUILD_FILES = (
    ("java", "pom.xml"),
    ("java", "build.gradle"),
    ("java", "build.gradle.kts"),
    ("python", "pyproject.toml"),
    ("python", "setup.py"),
    ("python", "requirements.txt"),
    ("c", "CMakeLists.txt"),
    ("c", "Makefile"),
    ("typescript", "tsconfig.json"),
)
# Extensions of configuration files, names left out, greatest size.
CONFIG_EXTENSIONS = ("yml", "yaml", "properties", "xml", "json", "toml", "cfg", "ini", "conf")
CONFIG_LEFT_OUT = r"(^|/)(keystore|truststore|cacerts)[^/]*$|\.(jks|p12|pfx|pem|crt|key)$|(^|/)node_modules/"
CONFIG_MOST_BYTES = 10 * 1024
ENTRY_POINTS = ("__main__.py", "app.py", "main.py")


def read_tree(spark: SparkSession, root: str, most_bytes: int | None = None, include: tuple[str, ...] = ("**",)) -> DataFrame:
    """path (relative), content, length of the files below root that match a glob of `include`, of `most_bytes` at most
    if given. The size filter reaches the listing, and only folders that a glob can lead to are listed."""
    top = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{top}/{p}" if p else top for p in globs.prefixes(list(include))])
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    below = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    start = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rows = files.select(F.substr(below, F.lit(len(start) + 1)).alias("path"), F.decode("content", "UTF-8").alias("content"), "length")
    return rows if tuple(include) == ("**",) else rows.where(globs.matches("path", list(include)))


def directory(path: Column | str) -> Column:
    return F.regexp_extract(path, "^(.*?)/?[^/]*$", 1)


def base(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def discover(files: DataFrame, exclude: str | None = None) -> DataFrame:
    """path (directory), build_file, language: the first build file by priority claims a directory. `exclude`
    is a pattern over file paths."""
    name = base("path")
    rank = F.lit(None).cast("int")
    for i, (_, b) in reversed(list(enumerate(BUILD_FILES))):
        rank = F.when(name == b, i).otherwise(rank)
    rows = files.select("path", rank.alias("rank")).where("rank IS NOT NULL")
    if exclude:
        rows = rows.where(~F.col("path").rlike(exclude))
    first = rows.groupBy(directory("path").alias("dir")).agg(F.min("rank").alias("rank"))
    pick = lambda k: F.get(F.array(*(F.lit(b[k]) for b in BUILD_FILES)), F.col("rank"))
    return first.select(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("path"), pick(1).alias("build_file"), pick(0).alias("language"))


def discover_within(files: DataFrame, include: tuple[str, ...] = ("**",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """`discover` among build files at the root and below the folders that the globs of `include` name, but those that a
    glob of `exclude` matches, hidden ones too."""
    below = [f"{g.rstrip('/')}/**/{name}" for g in include for name in dict.fromkeys(b for _, b in BUILD_FILES)]
    wanted = globs.matches("path", below) | ~F.contains("path", F.lit("/"))
    return discover(files.where(base("path").isin(*(b for _, b in BUILD_FILES)) & wanted & ~globs.matches("path", list(exclude), dot=True)))


def _owned(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds project: the nearest directory above a file that is one. Prefixes are exploded to join on equal keys."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    each = files.select("path", F.posexplode(up).alias("depth", "project")).join(projects.select(F.col("path").alias("project")), "project", "left_semi")
    nearest = each.groupBy("path").agg(F.max_by("project", "depth").alias("project"))
    return files.join(nearest, "path")


def owned_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with their project and the path within it (rel)."""
    rows = _owned(files, projects)
    rel = F.when(F.col("project") == ".", F.col("path")).otherwise(F.substr("path", F.length("project") + 2))
    return rows.withColumn("rel", rel)


def classify(projects: DataFrame, owned: DataFrame) -> DataFrame:
    """path, type: container or library, by ordered rules over the build file; Python by its entry points."""
    own = owned.select(F.col("project").alias("path"), F.col("rel"), "content")
    build = own.withColumnRenamed("rel", "build_file")
    text = projects.join(build, ["path", "build_file"], "left")
    depth = F.size(F.split("rel", "/"))
    entry = own.where(base("rel").isin(*ENTRY_POINTS) & ((depth == 1) | ((depth == 2) & ~F.col("rel").rlike("^[._]")))).select("path").distinct().withColumn("entry", F.lit(True))
    scripts = own.where(((F.col("rel") == "pyproject.toml") & F.col("content").rlike(r"(?i)\[project\.scripts\]")) | ((F.col("rel") == "setup.cfg") & F.col("content").rlike("(?i)console_scripts")))
    entry = entry.unionByName(scripts.select("path").distinct().withColumn("entry", F.lit(True))).distinct()
    rows = text.join(entry, "path", "left")
    c = F.coalesce("content", F.lit(""))
    java = F.when(c.rlike(r"(?i)<packaging>\s*war\s*</packaging>|spring-boot-maven-plugin|application\s*\{|id\s+['\"]application['\"]"), "container").when(c.rlike(r"(?i)<packaging>\s*jar\s*</packaging>"), "library").otherwise("container")
    native = F.when((F.col("build_file") == "CMakeLists.txt") & c.rlike(r"(?i)add_library\s*\("), "library").otherwise("container")
    kind = F.when(F.col("language") == "java", java).when(F.col("language") == "c", native).when(F.col("language") == "python", F.when(F.col("entry"), "container").otherwise("library")).otherwise(package_type(c, F.col("build_file")))
    return rows.select("path", kind.alias("type"))


def package_type(content: Column, build_file: Column) -> Column:
    """A package.json with a binary or a server script is a container, without one a library."""
    scripts = F.array(*(F.coalesce(F.get_json_object(content, f"$.scripts.{n}"), F.lit("")) for n in ("start", "serve", "dev")))
    server = F.exists(scripts, lambda s: s.rlike(r"(?i)\b(server|app|index|main)\b") & ~s.rlike(r"(?i)\b(vitest|jest|mocha|tsc|eslint|prettier)\b"))
    readable = F.get_json_object(content, "$").isNotNull()
    return F.when((build_file != "package.json") | ~readable | F.get_json_object(content, "$.bin").isNotNull() | server, "container").otherwise("library")


def config_files(owned: DataFrame) -> DataFrame:
    """project, file, content of small text configuration files."""
    ext = F.lower(F.substring_index("rel", ".", -1))
    keep = ext.isin(*CONFIG_EXTENSIONS) & ~F.col("rel").rlike(CONFIG_LEFT_OUT) & (F.col("length") <= CONFIG_MOST_BYTES) & ~F.contains("content", F.lit("\u0000"))
    return owned.where(keep).select("project", F.col("rel").alias("file"), "content")


INCLUDE = r"""(?m)^\s*#\s*include\s*([<"])([^>"]+)[>"]"""
# TypeScript frameworks by dependency, in order.
TS_FRAMEWORKS = (("express", "Express"), ("fastify", "Fastify"), ("@nestjs/core", "NestJS"), ("next", "Next.js"), ("hono", "Hono"), ("@angular/core", "Angular"), ("nuxt", "Nuxt"), ("remix", "Remix"), ("koa", "Koa"))


# --- imports -------------------------------------------------------------------------------------
def _all(pattern: str, group: int = 1, text: str = "content") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def imports_of(language: Column, text: str = "content") -> Column:
    """Import sources of a file by language, in the order of the kinds and then of the text, each once."""
    java = _all(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", 1, text)
    plain = F.flatten(F.transform(_all(r"(?m)^import[ \t]+([\w.]+(?:[ \t]*,[ \t]*[\w.]+)*)", 1, text), lambda s: F.split(s, r"\s*,\s*")))
    python = F.concat(plain, _all(r"(?m)^from[ \t]+([\w.]+)[ \t]+import", 1, text))
    kinds = (r"""(?m)^\s*import\s+(?:type\s+)?(?:[\w*${}\s,]+\s+from\s+)?['"]([^'"]+)['"]""", r"""import\(\s*['"]([^'"]+)['"]\s*\)""", r"""require\(\s*['"]([^'"]+)['"]\s*\)""", r"""(?m)^\s*export\s+(?:type\s+)?[\w*${}\s,]+\s+from\s+['"]([^'"]+)['"]""")
    ts = F.concat(*(_all(k, 1, text) for k in kinds))
    c = _all(INCLUDE, 2, text)
    return F.array_distinct(F.when(language == "java", java).when(language == "python", python).when(language == "c", c).otherwise(ts))


def system_includes(text: str = "content") -> Column:
    """Headers that a C file first includes in angle brackets."""
    pairs = F.arrays_zip(_all(INCLUDE, 1, text).alias("mark"), _all(INCLUDE, 2, text).alias("path"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["path"]), p["path"]) == i + 1)
    return F.transform(F.filter(first, lambda p: p["mark"] == "<"), lambda p: p["path"])


TS_LEFT_OUT = r"(^|/)(node_modules|dist|build)/|\.d\.tsx?$"
SOURCES = {"java": r"\.java$", "python": r"\.py$", "c": r"\.[ch]$", "typescript": r"\.[tj]sx?$"}


def source_roots(owned: DataFrame, projects: DataFrame) -> DataFrame:
    """project, root of TypeScript projects: the tsconfig's rootDir if the project has that folder, else the first
    include, else ''. Comments are taken out of the file first; unreadable JSON counts as none."""
    config = owned.where("rel = 'tsconfig.json'").select("project", F.regexp_replace(F.regexp_replace("content", r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", "").alias("json"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"/\*.*$", ""), r"^(\./)+", ""), r"^\.$|/+$", "")
    asked = config.select("project", clean(F.get_json_object("json", "$.compilerOptions.rootDir")).alias("a"), clean(F.get_json_object("json", "$.include[0]")).alias("b"))
    parts = F.split("rel", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    known = owned.where(F.contains("rel", F.lit("/"))).select("project", F.explode(folders).alias("root")).distinct()
    known = known.unionByName(projects.select(F.col("path").alias("project"), F.lit("").alias("root")))
    rows = projects.where("language = 'typescript'").select(F.col("path").alias("project")).join(asked, "project", "left")
    each = rows.select("project", F.posexplode(F.array("a", "b", F.lit(""))).alias("ord", "root")).where("root IS NOT NULL")
    found = each.join(known, ["project", "root"], "left_semi")
    return found.groupBy("project").agg(F.min_by("root", "ord").alias("root"))


def sources(owned: DataFrame, projects: DataFrame) -> DataFrame:
    """project, language, rel, content, module: source files and the module that each belongs to: the declared
    package, the first directory (below the source root), or the directory."""
    rows = owned.join(projects.select(F.col("path").alias("project"), "language"), "project").join(source_roots(owned, projects), "project", "left")
    match = F.lit(False)
    for language, pattern in SOURCES.items():
        match = match | ((F.col("language") == language) & F.col("rel").rlike(pattern))
    below = F.when(F.coalesce("root", F.lit("")) == "", F.col("rel")).when(F.startswith("rel", F.concat("root", F.lit("/"))), F.substr("rel", F.length("root") + 2))
    left_out = (F.col("language") == "typescript") & (below.isNull() | F.col("rel").rlike(TS_LEFT_OUT))
    rows = rows.where(match & ~left_out)
    package = F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    inner = F.regexp_replace("rel", r"^src/(main/(java|python)/)?", "")
    module = (
        F.when(F.col("language") == "java", F.coalesce(F.nullif(package, F.lit("")), F.replace(directory("rel"), F.lit("/"), F.lit("."))))
        .when(F.col("language") == "c", directory("rel"))
        .when(F.col("language") == "python", F.when(F.contains(inner, F.lit("/")), F.substring_index(inner, "/", 1)).otherwise(F.regexp_replace(inner, r"\.py$", "")))
        .otherwise(F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1)).otherwise(base(F.col("project"))))
    )
    return rows.select("project", "language", "rel", "content", module.alias("module"))


def modules(files: DataFrame) -> DataFrame:
    """project, module, files, exports, annotations, framework of source files, in path order."""
    java = F.regexp_extract_all("content", F.lit(r"(?m)^\s*public\s+(?:(?:abstract|final|sealed|static)\s+)*(?:class|interface|enum|record)\s+(\w+)"), F.lit(1))
    named = F.filter(java, lambda n: n == F.regexp_extract("rel", r"([^/]+)\.java$", 1))
    listed = F.regexp_extract_all(F.regexp_extract("content", r"__all__\s*=\s*\[([^\]]*)\]", 1), F.lit(r"""['"](\w+)['"]"""), F.lit(1))
    python = F.concat(listed, F.regexp_extract_all("content", F.lit(r"(?m)^class\s+(\w+)"), F.lit(1)))
    ts = F.regexp_extract_all("content", F.lit(r"(?m)^export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function|const|let|interface|type|enum)\s+(\w+)"), F.lit(1))
    c = F.when(F.col("rel").rlike(r"\.h$"), F.array(F.regexp_extract("rel", r"([^/]+)\.h$", 1))).otherwise(F.array().cast("array<string>"))
    exports = F.when(F.col("language") == "java", named).when(F.col("language") == "python", python).when(F.col("language") == "c", c).otherwise(ts)
    notes = F.when(F.col("language") == "java", F.regexp_extract_all("content", F.lit(r"(?m)^@(\w+)(?=[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:public|abstract|final|class|interface|enum|record)\b)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    marker = F.when(F.col("language") == "python", F.when(F.contains("content", F.lit("fastapi")), "fastapi").when(F.contains("content", F.lit("flask")), "flask").when(F.contains("content", F.lit("django")), "django"))
    rows = files.select("project", "module", "rel", exports.alias("exports"), notes.alias("notes"), marker.alias("marker"))
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rel", c))), lambda s: s[c])))
    return rows.groupBy("project", "module").agg(
        F.array_sort(F.collect_set("rel")).alias("files"),
        in_order("exports").alias("exports"),
        F.array_join(in_order("notes"), ",").alias("annotations"),
        F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("rel"))).alias("framework"),
    )


def module_imports(files: DataFrame) -> DataFrame:
    """project, module, source, is_external: imports of a module, each source once, the first by file counts.
    An import is internal if its project has the module, header or relative path that it names, or a package whose
    name it begins with; a header in angle brackets is external whatever headers there are."""
    rows = files.withColumn("_system", F.when(F.col("language") == "c", system_includes()))
    rows = rows.select("project", "language", "module", "rel", "_system", F.posexplode(imports_of(F.col("language"))).alias("pos", "source"))
    rows = rows.withColumn("system", F.coalesce(F.array_contains("_system", F.col("source")), F.lit(False))).drop("_system")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("project", "module", "source").orderBy("rel", "pos"))).where("rn = 1")
    names = files.select("project", F.col("module").alias("name")).distinct()
    headers = files.where("language = 'c' AND rel RLIKE '[.]h$'").select("project", F.explode(F.array("rel", base("rel"))).alias("name")).distinct()
    known = names.unionByName(headers).distinct().withColumn("own", F.lit(True))
    # Java: any package whose name the import begins with; Python: the first segment; C: the path or its base.
    parts = F.split("source", r"\.")
    java = F.transform(F.sequence(F.lit(1), F.length("source")), lambda i: F.substring("source", 1, i))
    keys = F.when(F.col("language") == "java", java).when(F.col("language") == "python", F.array(F.get(parts, 0))).otherwise(F.array("source", base("source")))
    hit = first.select("project", "module", "source", F.explode(keys).alias("name")).join(known, ["project", "name"], "left_semi").select("project", "module", "source").distinct().withColumn("own", F.lit(True))
    rows = first.join(hit, ["project", "module", "source"], "left")
    relative = F.startswith("source", F.lit("."))
    outside = F.when(F.col("language") == "typescript", ~relative).when(F.col("language") == "c", F.col("system") | F.col("own").isNull()).otherwise(~relative & F.col("own").isNull())
    return rows.select("project", "module", "source", outside.alias("is_external"))


def ts_frameworks(files: DataFrame, deps: DataFrame) -> DataFrame:
    """project, module, framework: those that a TypeScript module imports, itself or a path in it, and its project
    depends on, in the order of their first import."""
    known = files.sparkSession.createDataFrame([(i, d, f) for i, (d, f) in enumerate(TS_FRAMEWORKS)], "ord int, name string, framework string")
    used = deps.where("NOT internal").select("project", "name").distinct().join(F.broadcast(known), "name")
    rows = files.where("language = 'typescript'").select("project", "module", "rel", F.posexplode(imports_of(F.col("language"))).alias("pos", "source"))
    cut = F.split("source", "/")
    rows = rows.withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda i: F.array_join(F.slice(cut, 1, i), "/"))))
    first = rows.join(used, ["project", "name"]).groupBy("project", "module", "framework").agg(F.min(F.struct("rel", "pos", "ord")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "framework")))
    return first.groupBy("project", "module").agg(F.array_join(F.transform(ordered, lambda r: r["framework"]), ",").alias("framework"))


def c_structure(files: DataFrame) -> DataFrame:
    """project, path, name, headers, sources: C files by directory; the name is its first segment."""
    rows = files.where("language = 'c'")
    header = F.col("rel").endswith(".h")
    listed = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("rel"))))
    name = F.when(F.col("module") == "", base(F.col("project"))).otherwise(F.substring_index("module", "/", 1))
    return rows.groupBy("project", "module").agg(listed(header).alias("headers"), listed(~header).alias("sources")).select("project", F.when(F.col("module") == "", ".").otherwise(F.col("module")).alias("path"), name.alias("name"), "headers", "sources")


# --- dependencies --------------------------------------------------------------------------------
# The patterns that name dependencies in build files.
POM_DEPENDENCY = r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]*)</version>)?"
GRADLE_MAIN = r"""(?m)(?:^|\s)(?:implementation|api|compileOnly|runtimeOnly|annotationProcessor)\s*\(?\s*['"]([^'":]+):([^'":]+)(?::([^'"]+))?['"]"""
GRADLE_TEST = r"""(?:testImplementation|testCompileOnly|testRuntimeOnly|testAnnotationProcessor)\s*\(?\s*['"]([^'":]+):([^'":]+)(?::([^'"]+))?['"]"""
GRADLE_PROJECT = r"""(?m)(?:^|\s)(?:implementation|api|compileOnly|runtimeOnly|annotationProcessor)\s*\(?\s*project\s*\(\s*['"][:.]?([^'"]+)['"]\s*\)"""
REQUIREMENT = r"^([a-zA-Z0-9_-]+)(?:[=<>!~]+(.+))?"
VERSION_MARKS = r"^(?:workspace:|[\^~>=<]+)"


def dependencies(owned: DataFrame) -> DataFrame:
    """project, name, internal, version of the dependencies that build files name: Maven and Gradle (test scopes left
    out), requirements and pyproject, package.json (file: and link: are internal, devDependencies left out)."""
    name, none = base("rel"), F.lit(None).cast("string")
    dep = lambda n, v, inner=None: F.struct(n.alias("name"), (F.lit(False) if inner is None else inner).alias("internal"), F.nullif(v, F.lit("")).alias("version"))
    three = lambda p: F.arrays_zip(*(_all(p, g).alias(c) for g, c in ((1, "g"), (2, "a"), (3, "v"))))
    pair = lambda d: F.concat(d["g"], F.lit(":"), d["a"])
    maven = F.transform(three(POM_DEPENDENCY), lambda d: dep(pair(d), d["v"]))
    tests = F.transform(three(GRADLE_TEST), pair)
    gradle = F.transform(F.filter(three(GRADLE_MAIN), lambda d: ~F.array_contains(tests, pair(d))), lambda d: dep(pair(d), d["v"]))
    usable = F.filter(F.transform(F.split("content", "\n"), lambda line: F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))), lambda line: line.rlike(REQUIREMENT) & ~line.rlike("^[#-]"))
    requirements = F.transform(usable, lambda line: dep(F.regexp_extract(line, REQUIREMENT, 1), F.regexp_extract(line, REQUIREMENT, 2)))
    block = F.regexp_extract("content", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    pyproject = F.transform(F.filter(F.regexp_extract_all(block, F.lit('"([^"]+)"'), F.lit(1)), lambda n: n.rlike("^[a-zA-Z0-9_-]")), lambda n: dep(F.regexp_extract(n, "^([a-zA-Z0-9_-]+)", 1), none))
    packages = F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>")
    entries = F.coalesce(F.map_entries(packages), F.array().cast("array<struct<key:string,value:string>>"))
    local = lambda e: e["value"].rlike("^(file|link):")
    node = F.transform(entries, lambda e: dep(e["key"], F.when(~local(e), F.regexp_replace(e["value"], VERSION_MARKS, "")), local(e)))
    found = (
        F.when(name == "pom.xml", maven)
        .when(name.isin("build.gradle", "build.gradle.kts"), gradle)
        .when(name == "requirements.txt", requirements)
        .when(name == "pyproject.toml", pyproject)
        .when(name == "package.json", node)
    )
    return owned.where(~F.contains("rel", F.lit("/"))).select("project", F.explode(found).alias("d")).select("project", "d.name", "d.internal", "d.version")


def _joined(base_path: Column, relative: Column) -> Column:
    """A path that a relative one leads to from a directory, with `.` and `..` resolved; '.' is the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(base_path != ".", base_path), relative), "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))))
    return F.when(F.size(up) == 0, ".").otherwise(F.array_join(up, "/"))


def internal_imports(owned: DataFrame, projects: DataFrame) -> DataFrame:
    """project, target (a path): projects that build files name by place: file: and link: of package.json, and
    project() of Gradle, whose directory the settings of the parent directory tell."""
    packages = F.map_entries(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>"))
    linked = owned.where("rel = 'package.json'").select("project", F.explode(F.filter(packages, lambda e: e["value"].rlike("^(file|link):"))).alias("e"))
    linked = linked.select("project", _joined(F.col("project"), F.regexp_replace("e.value", "^(file|link):", "")).alias("target"))
    gradle = owned.where(F.col("rel").isin("build.gradle", "build.gradle.kts")).select("project", F.explode(_all(GRADLE_PROJECT)).alias("name"))
    gradle = gradle.withColumn("name", F.regexp_replace("name", "^:", "")).withColumn("above", F.when(directory("project") == "", ".").otherwise(directory("project")))
    settings = owned.where(F.col("rel").isin("settings.gradle", "settings.gradle.kts")).select("project", "content")
    listed = gradle_modules(settings).select(F.col("project").alias("above"), "name", "dir").groupBy("above", "name").agg(F.min("dir").alias("dir"))
    near = gradle.join(listed, ["above", "name"], "left").select("project", _joined(F.col("above"), F.coalesce("dir", "name")).alias("target"))
    return linked.unionByName(near).distinct()


def applications(owned: DataFrame, projects: DataFrame) -> DataFrame:
    """project, app_id, name, language, build_file, published_as: one row per project. A Maven project is named by its
    artifact, a Gradle one by its parent's settings, else its own; a package by its name; others by their directory."""
    content = lambda files: owned.where(F.col("rel").isin(*files)).groupBy("project").agg(F.min_by("content", "rel").alias("c"))
    pom = content(["pom.xml"]).select("project", F.regexp_extract(F.regexp_replace("c", r"(?s)<parent>.*?</parent>", ""), "<artifactId>([^<]+)</artifactId>", 1).alias("pom"))
    gradle = content(["build.gradle", "build.gradle.kts"]).select("project", F.regexp_extract("c", r"""(?m)^group\b\s*=?\s*['"]([^'"]+)['"]""", 1).alias("group"), F.lit(True).alias("gradle"))
    settings = content(["settings.gradle", "settings.gradle.kts"])
    own = settings.select("project", F.regexp_extract("c", r"""rootProject\.name\s*=\s*['"]([^'"]+)['"]""", 1).alias("root"))
    listed = gradle_modules(settings.withColumnRenamed("c", "content")).select(F.col("project").alias("above"), F.col("name").alias("listed"), "dir")
    node = content(["package.json"]).select("project", F.get_json_object("c", "$.name").alias("package"))
    rows = projects.select(F.col("path").alias("project"), "language", "build_file").withColumn("above", F.when(directory("project") == "", ".").otherwise(directory("project")))
    rows = rows.withColumn("folder", base("project"))
    near = rows.join(listed, "above").where("dir = folder OR listed = folder").groupBy("project").agg(F.min("listed").alias("listed"))
    for part in (pom, gradle, own, node, near):
        rows = rows.join(part, "project", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    name = (
        F.when((F.col("language") == "java") & F.col("pom").isNotNull(), F.coalesce(some("pom"), "folder"))
        .when((F.col("language") == "java") & F.col("gradle"), F.coalesce("listed", some("root"), "folder"))
        .when(F.col("language") == "typescript", F.coalesce("package", "folder"))
        .otherwise(F.col("folder"))
    )
    rows = rows.withColumn("name", name)
    published = F.when((F.col("language") == "java") & F.col("pom").isNull() & some("group").isNotNull(), F.concat("group", F.lit(":"), "name")).when(F.col("language") == "typescript", F.col("package"))
    return rows.select("project", slug("project").alias("app_id"), "name", "language", "build_file", published.alias("published_as"))


def gradle_modules(settings: DataFrame) -> DataFrame:
    """project, content -> project, name, dir: included modules, with overridden directories."""
    lists = F.regexp_extract_all("content", F.lit(r"""(?m)^\s*include\s*\(?\s*((?:['"][^'"]+['"]\s*,?\s*)+)"""), F.lit(1))
    names = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(r"""['"]:?([^'"]+)['"]"""), F.lit(1))))
    moved = r"""project\(\s*['"]:?([^'"]+)['"]\s*\)\.projectDir\s*=\s*(?:new\s+)?(?:file|File)\s*\([^'"]*['"]([^'"]+)['"]\s*\)"""
    over = F.map_from_entries(F.arrays_zip(F.regexp_extract_all("content", F.lit(moved), F.lit(1)), F.regexp_extract_all("content", F.lit(moved), F.lit(2))))
    rows = settings.select("project", over.alias("over"), F.explode(F.array_distinct(names)).alias("name"))
    return rows.select("project", "name", F.coalesce(F.try_element_at("over", F.col("name")), F.replace("name", F.lit(":"), F.lit("/"))).alias("dir"))

"""What is written where: scaffolds, outputs by container, customised parts, pruning, summaries, repair of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted, relative_path
from .keys import joined_by
from .render import joined


def create_once(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Files (path, ...) that aren't there yet; a user's file is never written again."""
    return wanted.join(existing.select("path").distinct(), "path", "left_anti")


def container_outputs(containers: DataFrame, excluded: DataFrame, aggregators: DataFrame, docs_dir: str = "docs") -> DataFrame:
    """id, path, output: the folder of each container's own documents. Excluded containers, those above others and
    the root have none."""
    rows = containers.where("path IS NOT NULL AND path NOT IN ('', '.')")
    rows = rows.join(excluded.select("id"), "id", "left_anti").join(aggregators.select("id"), "id", "left_anti")
    return rows.select("id", "path", F.concat("path", F.lit(f"/{docs_dir}/"), F.lower("id")).alias("output"))


def fragments(containers: DataFrame, components: DataFrame, relationships: DataFrame) -> DataFrame:
    """container_id, content: the part of the model that concerns a container as one text; see `fragment_lines`."""
    return joined(fragment_lines(containers, components, relationships), ["container_id"], "content")


def fragment_lines(containers: DataFrame, components: DataFrame, relationships: DataFrame) -> DataFrame:
    """container_id, section, k, line: the part of the model that concerns a container, as YAML: itself (id, name), its
    components (id, container_id, name) and the relationships (source, target, label) that one of them is an end of."""
    row = lambda df, by, section, k, line: df.select(F.col(by).alias("container_id"), F.lit(section).alias("section"), k.alias("k"), line.alias("line"))
    entry = lambda first, *rest: F.concat_ws("\n", F.concat(F.lit(f"  - {first}: "), quoted(F.col(first))), *(F.concat(F.lit(f"    {c}: "), quoted(F.col(c))) for c in rest))
    home = components.select(F.col("id").alias("end"), "container_id")
    ends = joined_by(relationships.withColumn("end", F.explode(F.array("source", "target"))), home, ["end"]).select("container_id", "source", "target", "label").distinct()
    one = containers.select("id", "name")
    lines = row(one, "id", 0, F.lit(""), F.lit("containers:")).unionByName(row(one, "id", 1, F.col("id"), entry("id", "name")))
    lines = lines.unionByName(row(one, "id", 2, F.lit(""), F.lit("components:"))).unionByName(row(components, "container_id", 3, F.col("id"), entry("id", "name")))
    lines = lines.unionByName(row(one, "id", 4, F.lit(""), F.lit("relationships:"))).unionByName(row(ends, "container_id", 5, F.concat_ws("\u0000", "source", "target"), entry("source", "target", "label")))
    return lines


def submodule_lines(outputs: DataFrame, diagrams: DataFrame, parts: DataFrame, styles: str, settings: str, root_output: str, code: DataFrame | None = None, docs_dir: str = "docs") -> DataFrame:
    """The documents of `submodule_files` as pieces for `write_lines`, so that no row holds a document.

    diagrams and parts: container_id, section, k, line; code: container_id, component_id, name, section, k, line, of the
    components that have a diagram. Each diagram has one line of section 0."""
    rest = common_lines(outputs, diagrams, parts, styles, settings, root_output, code, docs_dir)
    return rest if code is None else rest.unionByName(component_pieces(outputs, code, docs_dir))


def _piece(df: DataFrame, path, first) -> DataFrame:
    return df.select(path.alias("path"), "section", "k", "line", F.lit("\n").alias("end"), F.lit(False).alias("once"), first.alias("first"))


def _homes(outputs: DataFrame, docs_dir: str) -> DataFrame:
    return outputs.select(F.col("id").alias("container_id"), F.concat_ws("/", "path", F.lit(docs_dir), F.lit("architecture")).alias("folder"))


def component_pieces(outputs: DataFrame, code: DataFrame, docs_dir: str = "docs") -> DataFrame:
    """Of the pieces of `submodule_lines`, those of the components' diagrams, which stay in the partitions of `code`; a join by
    container that shuffles could split a file's pieces, hence the hint. There is a row a container."""
    return _piece(code.join(F.broadcast(_homes(outputs, docs_dir)), "container_id"), F.concat("folder", F.lit("/components/"), "component_id", F.lit("/_generated/c4-code.d2")), F.col("section") == 0)


def common_lines(outputs: DataFrame, diagrams: DataFrame, parts: DataFrame, styles: str, settings: str, root_output: str, code: DataFrame | None = None, docs_dir: str = "docs") -> DataFrame:
    """The other pieces of `submodule_lines`."""
    small = ["container_id", "section", "k", "line"]
    none = outputs.sparkSession.createDataFrame([], "container_id string, diagram string, content string")
    heads = diagrams.where("section = 0").select("container_id", F.lit("").alias("diagram"))
    tops = None if code is None else code.where("section = 0").select("container_id", "component_id", "name", F.lit("").alias("diagram"), F.lit(1).alias("n"))
    whole = submodule_files(outputs, heads, none.select("container_id", "content"), styles, settings, root_output, tops, 1, docs_dir)
    stubs = whole.where(~F.col("path").rlike("/_generated/c[34]-[a-z]+[.]d2$"))
    stubs = stubs.select("path", F.lit(-1).alias("section"), F.lit("").alias("k"), F.col("content").alias("line"), F.lit("").alias("end"), "once", F.lit(True).alias("first"))
    homes, piece = _homes(outputs, docs_dir), _piece
    note = F.lit("# The part of the model that concerns this folder; written anew at every run.")
    model = parts.where("section = 0").select("container_id", F.lit(-1).alias("section"), "k", note.alias("line")).unionByName(parts.select(*small))
    out = stubs.unionByName(piece(diagrams.select(*small).join(homes, "container_id"), F.concat("folder", F.lit("/_generated/c3-component.d2")), F.col("section") == 0))
    out = out.unionByName(piece(model.join(homes, "container_id"), F.concat("folder", F.lit("/architecture-model.yaml")), F.col("section") == -1))
    return out


def submodule_files(outputs: DataFrame, diagrams: DataFrame, parts: DataFrame, styles: str, settings: str, root_output: str, code: DataFrame | None = None, least_elements: int = 1, docs_dir: str = "docs") -> DataFrame:
    """path, content, once: the documents of each container.

    outputs: id, name, path; diagrams: container_id, diagram; parts: container_id, content (see `fragments`); code:
    container_id, component_id, name, diagram, n. Generated files are written anew, those that belong to the user
    (`once`: settings, and diagrams that include the generated ones) are made where they don't exist. Components of
    fewer than `least_elements` elements have no diagram of their own."""
    folder = F.concat_ws("/", "path", F.lit(docs_dir), F.lit("architecture"))
    homes = outputs.select(F.col("id").alias("container_id"), F.col("name").alias("container"), "path", folder.alias("folder"))
    file = lambda df, path, content, once: df.select(path.alias("path"), content.alias("content"), F.lit(once).alias("once"))
    lines = lambda *parts: F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    below = lambda *names: F.concat_ws("/", "folder", *(F.lit(n) if isinstance(n, str) else n for n in names))
    whole = relative_path(F.col("folder"), F.lit(f"{root_output}/c2-container.svg"))
    level3 = homes.join(diagrams, "container_id")
    out = [
        file(homes, F.concat_ws("/", "path", F.lit(settings)), F.lit("# Settings of this folder; they go before those of folders above.\n"), True),
        file(level3, below("_generated", "c3-component.d2"), F.col("diagram"), False),
        file(homes, below("styles.d2"), F.lit(styles), False),
        file(level3, below("c3-component.d2"), lines(F.concat(F.lit("# Components of "), "container"), F.concat(F.lit("# The whole system: "), whole), "", "...@_generated/c3-component.d2", "...@styles.d2", "", "# Your own additions go below this line", ""), True),
        file(homes.join(parts, "container_id"), below("architecture-model.yaml"), F.concat(F.lit("# The part of the model that concerns this folder; written anew at every run.\n"), "content"), False),
    ]
    if code is not None:
        level4 = homes.join(code.where(F.col("n") >= least_elements).select("container_id", "component_id", F.col("name").alias("component"), "diagram"), "container_id")
        at = lambda *names: below("components", F.col("component_id"), *names)
        out += [
            file(level4, at("_generated", "c4-code.d2"), F.col("diagram"), False),
            file(level4, at("c4-code.d2"), lines(F.concat(F.lit("# Code of "), "component", F.lit(" in "), "container"), "", "...@_generated/c4-code.d2", "...@../../styles.d2", "", "# Your own additions go below this line", ""), True),
        ]
    files = out[0]
    for f in out[1:]:
        files = files.unionByName(f)
    return files


def customised(lines: DataFrame, marker: str) -> DataFrame:
    """file, line, text -> the lines after a file's last one that matches `marker` (all, if none does)."""
    hit = F.max(F.when(F.col("text").rlike(marker), F.col("line"))).over(Window.partitionBy("file"))
    rows = lines.withColumn("_last", F.coalesce(hit, F.lit(0)))
    return rows.where("line > _last").drop("_last")


def removal_candidates(containers: DataFrame, existing: DataFrame, everything: bool, settings: str, cache: str, model: str, output_dir: str = "docs/architecture", docs_dir: str = "docs") -> DataFrame:
    """path of what a removal takes, of the paths that exist (path, directories among them): settings, cache and model
    file at the root, cache and settings of each container (path), and with `everything` the outputs too."""
    spark = containers.sparkSession
    root = [settings, cache, model, *([output_dir] if everything else [])]
    top = spark.createDataFrame([(p,) for p in root], "path string")
    own = [cache, settings, *([f"{docs_dir}/architecture"] if everything else [])]
    below = containers.where("path IS NOT NULL AND path NOT IN ('', '.')").select(F.explode(F.array(*(F.concat("path", F.lit("/" + p)) for p in own))).alias("path"))
    return top.unionByName(below).distinct().join(existing.select("path").distinct(), "path", "left_semi")


def prune(paths: DataFrame, removed: DataFrame) -> DataFrame:
    """Directories that hold files (path) now and none once `removed` (path) are gone: candidates for removal, the
    deepest first by `depth`. Directories are exploded from the paths, so there is no walk up the tree."""
    dirs = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    each = lambda df: df.where(F.contains("path", F.lit("/"))).distinct().select(F.explode(dirs).alias("dir"))
    before = each(paths).groupBy("dir").agg(F.count("*").alias("n"))
    gone = each(removed.join(paths, "path", "left_semi")).groupBy("dir").agg(F.count("*").alias("g"))
    return before.join(gone, "dir").where("n = g").select("dir", F.size(F.split("dir", "/")).alias("depth"))


def lean_summary(modules: DataFrame) -> DataFrame:
    """app_id, module_id, exports, notes -> app_id, summary: one JSON text per app, without empty parts."""
    part = F.struct("module_id", F.when(F.size("exports") > 0, F.col("exports")).alias("exports"), F.nullif("notes", F.lit("")).alias("notes"))
    ordered = F.array_sort(F.collect_list(F.struct("module_id", F.to_json(part).alias("j"))))
    return modules.groupBy("app_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda s: s["j"]), ","), F.lit("]")).alias("summary"))


def repaired_yaml(texts: DataFrame) -> DataFrame:
    """id, content -> id, content: list items that were run together on a line are split, and an unfinished tail
    (after the last line that is a key, an item, a comment or blank) is cut."""
    split = F.regexp_replace("content", r"(?m)(\S)[ \t]+(- (?:id|sourceId|name): )", "$1\n  $2")
    good = lambda line: line.rlike(r"""^\s*(#.*|- .*|[\w.-]+:( .*)?|)$""") & ~line.rlike(r"""^[^"]*"[^"]*$""")
    parts = F.split(split, "\n")
    last = F.array_max(F.filter(F.transform(parts, lambda line, i: F.when(good(line), i + 1).otherwise(0)), lambda n: n > 0))
    return texts.select("id", F.array_join(F.slice(parts, 1, F.coalesce(last, F.lit(0))), "\n").alias("content"))

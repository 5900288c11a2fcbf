"""Deriving an architecture model from scanned applications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text

MOST_GROUPS = 20


# --- coordinates and imports ---------------------------------------------------------------------
def match_coordinates(dependencies: DataFrame, publishers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(internal, external): dependencies (app_id, name) on what another app publishes (app_id, coordinate, ord)
    become imports of that app; of several publishers the last counts. The rest stay external."""
    last = publishers.groupBy(F.col("coordinate").alias("name")).agg(F.max_by("app_id", "ord").alias("target_app"))
    rows = dependencies.join(last, "name", "left")
    inner = F.col("target_app").isNotNull() & (F.col("target_app") != F.col("app_id"))
    return rows.where(inner).select("app_id", "target_app", "name"), rows.where(~inner).select("app_id", "name")


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports (module_id, source), modules (module_id, name, ord) -> module_id, source, target_id. The target is
    the module named like the import without its last dot segment; of equal names the last counts."""
    index = modules.groupBy(F.col("name").alias("prefix")).agg(F.max_by("module_id", "ord").alias("target_id"))
    return imports.withColumn("prefix", F.regexp_replace("source", r"\.[^.]*$", "")).join(index, "prefix", "left").select("module_id", "source", "target_id")


# --- trees ---------------------------------------------------------------------------------------
def parent(path: Column | str) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def roll_up(apps: DataFrame) -> DataFrame:
    """Applications (path, deps, published_as, language) by the parent of their path: the children's
    dependencies without repeats, in path order; the first publication; the first child's language."""
    rows = apps.withColumn("parent", parent("path")).where("parent <> ''")
    deps = rows.select("parent", "path", F.posexplode("deps").alias("at", "dep")).groupBy("parent", "dep").agg(F.min(F.struct("path", "at")).alias("o"))
    deps = deps.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("o", "dep"))).alias("d")).select("parent", F.transform("d", lambda s: s["dep"]).alias("deps"))
    first = rows.groupBy("parent").agg(
        F.count("*").alias("children"),
        F.min_by("language", "path").alias("language"),
        F.min_by("published_as", F.when(F.col("published_as").isNotNull(), F.col("path"))).alias("published_as"),
    )
    return first.join(deps, "parent", "left").select(F.col("parent").alias("path"), "children", "language", "published_as", "deps")


def shell_children(apps: DataFrame, modules: DataFrame) -> DataFrame:
    """app_id, into: applications (app_id, path) that lie directly below one without modules, which takes them in. The
    root takes in nothing."""
    shells = apps.where("path <> '.'").join(modules.select("app_id").distinct(), "app_id", "left_anti").select(F.col("app_id").alias("into"), F.col("path").alias("above"))
    return apps.withColumn("above", parent("path")).join(shells, "above").select("app_id", "into")


def rolled_up(rows: DataFrame, children: DataFrame, key: str = "app_id") -> DataFrame:
    """Rows of any list of an application (modules, dependencies, configuration files) under the one that took it in."""
    moved = rows.join(children.select(F.col("app_id").alias(key), "into"), key, "left")
    return moved.withColumn(key, F.coalesce("into", key)).drop("into").select(*rows.columns)


def ancestors(path: Column | str) -> Column:
    """All proper prefixes of a path, by whole segments."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def aggregators(containers: DataFrame) -> DataFrame:
    """Containers (id, path) whose path is a proper ancestor of another's. Prefixes are exploded, so the join
    is on equal keys."""
    up = containers.where(F.contains("path", F.lit("/"))).select(F.explode(ancestors("path")).alias("path")).distinct()
    return containers.join(up, "path", "left_semi").select("id", "path")


def lowest_common_ancestor(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, path_a, path_b by slash) -> a, b, owner: the deepest common prefix; '' at the root."""
    pa, pb = F.split("path_a", "/"), F.split("path_b", "/")
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(pa), F.size(pb))), lambda i: F.slice(pa, 1, i) == F.slice(pb, 1, i)))
    return pairs.select("a", "b", F.array_join(F.slice(pa, 1, n), "/").alias("owner"))


# --- grouping ------------------------------------------------------------------------------------
def without(modules: DataFrame, patterns: list[str]) -> DataFrame:
    """Modules whose lower-case name holds none of the patterns."""
    hit = reduce(Column.__or__, (F.contains(F.lower("name"), F.lit(p)) for p in patterns), F.lit(False))
    return modules.where(~hit)


def balanced_groups(modules: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """app_id, module_id, name (dotted) -> app_id, module_id, component: a module each if an app has few of
    them, else name prefixes: the deepest depth, from one below the common prefix on, with at most `most`
    distinct prefixes. One below the common prefix is used even if it has more."""
    rows = modules.withColumn("parts", F.split("name", r"\."))
    stats = rows.groupBy("app_id").agg(F.count("*").alias("n"), F.min("parts").alias("lo"), F.max("parts").alias("hi"), F.min(F.size("parts")).alias("shortest"))
    ahead = F.size(F.filter(F.sequence(F.lit(1), F.size("lo")), lambda i: F.slice("lo", 1, i) == F.slice("hi", 1, i)))
    stats = stats.select("app_id", "n", F.least(ahead, F.col("shortest")).alias("common"))
    deep = rows.join(stats, "app_id").select("app_id", "common", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").where("depth > common")
    keys = rows.join(stats, "app_id").join(deep.select("app_id", "depth").distinct(), "app_id")
    keys = keys.groupBy("app_id", "depth").agg(F.count_distinct(F.array_join(F.slice("parts", 1, F.col("depth")), ".")).alias("k"))
    best = keys.where(F.col("k") <= most).groupBy("app_id").agg(F.max("depth").alias("best"))
    used = stats.join(best, "app_id", "left").withColumn("depth", F.coalesce("best", F.col("common") + 1))
    out = rows.join(used, "app_id")
    component = F.when(F.col("n") <= most, F.col("name")).otherwise(F.array_join(F.slice("parts", 1, F.col("depth")), "."))
    return out.select("app_id", "module_id", component.alias("component"))


def overview(modules: DataFrame) -> DataFrame:
    """app_id, module_ids: one component an app, with its modules in id order."""
    return modules.groupBy("app_id").agg(F.array_sort(F.collect_list("module_id")).alias("module_ids"))


def display_names(components: DataFrame) -> DataFrame:
    """component_id, app_id, name -> component_id, display: the last segment in words, or the last two where
    an app has several components of one last segment."""
    last = text.last_segment("name")
    parts = F.split("name", "[./]")
    same = F.count("*").over(Window.partitionBy("app_id", "last"))
    rows = components.withColumn("last", last).withColumn("same", same)
    two = F.concat_ws(" ", text.humanize(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))), text.humanize("last"))
    return rows.select("component_id", F.trim(F.when(F.col("same") > 1, two).otherwise(text.humanize("last"))).alias("display"))


# --- people and systems --------------------------------------------------------------------------
def detect_roles(modules: DataFrame) -> DataFrame:
    """module_id, annotations -> module_id, role, technology, description-ready role (null: none)."""
    return modules.select("module_id", rules.role(F.col("annotations")).alias("role"))


def infer_actors(roles: DataFrame) -> DataFrame:
    """id, name of the actors that the roles of a system ask for."""
    seen = roles.agg(F.coalesce(F.bool_or(F.col("role") == "controller"), F.lit(False)).alias("c"), F.coalesce(F.bool_or(F.col("role") == "listener"), F.lit(False)).alias("l"))
    rows = F.array(
        F.struct(F.col("c").alias("on"), F.lit("api-consumer").alias("id"), F.lit("API Consumer").alias("name")),
        F.struct(F.col("l").alias("on"), F.lit("upstream-system").alias("id"), F.lit("Upstream System").alias("name")),
    )
    return seen.select(F.explode(rows).alias("a")).where("a.on").select("a.id", "a.name")


def component_role(members: DataFrame) -> DataFrame:
    """component_id, pos, role -> component_id, role: that of the first module with one."""
    return members.groupBy("component_id").agg(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("pos"))).alias("role"))


def detect_externals(dependencies: DataFrame) -> DataFrame:
    """app_id, name, ord -> technology, type, label, id: each dependency counts for the first rule it matches,
    each (type, technology) once."""
    hit = dependencies.withColumn("rule", rules.external_rule(F.col("name"))).where("rule IS NOT NULL")
    first = hit.select(rules.external_type(F.col("rule")).alias("type"), rules.external_technology(F.col("rule")).alias("technology")).distinct()
    return first.select(text.slug("technology").alias("id"), "technology", "type", rules.mapped(F.col("type"), rules.EXTERNAL_LABELS).alias("label"))


def merge_externals(declared: DataFrame, detected: DataFrame) -> DataFrame:
    """Declared systems (id, name) and the detected ones of other ids."""
    return declared.unionByName(detected.join(declared.select("id"), "id", "left_anti"))


def ordered_externals(externals: DataFrame) -> DataFrame:
    """External systems by name, then id, for writing them out."""
    return externals.orderBy("name", "id")


# --- relationships -------------------------------------------------------------------------------
def derive_relationships(phases: list[DataFrame]) -> DataFrame:
    """Candidates by phase (source, target, label, technology, ord) -> one relationship per pair: that of the
    first phase which has it, then of the least ord, in the ordinals' own type. Pairs of equal ends go."""
    if len({p.schema["ord"].dataType for p in phases}) == 1:
        rows = reduce(DataFrame.unionByName, (p.select("source", "target", "label", "technology", F.struct(F.lit(i).alias("phase"), "ord").alias("o")) for i, p in enumerate(phases)))
        first = rows.where("source <> target").groupBy("source", "target").agg(F.min(F.struct("o", "label", "technology")).alias("f"))
        return first.select("source", "target", "f.label", "f.technology")
    # Ordinals of two types don't compare, so each phase by itself first.
    one = lambda p: p.where("source <> target").groupBy("source", "target").agg(F.min(F.struct("ord", "label", "technology")).alias("f")).select("source", "target", "f.label", "f.technology")
    rows = reduce(DataFrame.unionByName, (one(p).withColumn("phase", F.lit(i)) for i, p in enumerate(phases)))
    first = rows.groupBy("source", "target").agg(F.min_by(F.struct("label", "technology"), "phase").alias("f"))
    return first.select("source", "target", "f.label", "f.technology")


def merge_partials(relationships: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial models merged: relationships (source, target, label, ord) first wins by pair; people (id,
    description, ord) longest description wins, then the earlier."""
    first = relationships.groupBy("source", "target").agg(F.min_by("label", "ord").alias("label"))
    longest = people.groupBy("id").agg(F.min_by("description", F.struct(-F.length("description"), F.col("ord"))).alias("description"))
    return first, longest


def renamed(components: DataFrame) -> DataFrame:
    """partial, id, container_id, ord -> partial, id, new_id: an id that an earlier partial has is prefixed with
    its container, and numbered from the second on where that clashes too."""
    again = components.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("ord")))
    again = again.withColumn("new", F.when(F.col("nth") > 1, F.concat_ws("-", "container_id", "id")).otherwise(F.col("id")))
    order = Window.partitionBy("new").orderBy(F.col("nth") > 1, "ord")
    rows = again.withColumn("clash", F.row_number().over(order))
    return rows.select("partial", "id", F.when(F.col("clash") > 1, F.concat_ws("-", "new", F.col("clash").cast("string"))).otherwise(F.col("new")).alias("new_id"))


def remapped(relationships: DataFrame, names: DataFrame) -> DataFrame:
    """Relationships (partial, source, target, label) under the new ids of their own partial model."""
    rows = relationships
    for c in ("source", "target"):
        rows = rows.join(names.select("partial", F.col("id").alias(c), F.col("new_id").alias("new_" + c)), ["partial", c], "left")
    return rows.select("partial", F.coalesce("new_source", "source").alias("source"), F.coalesce("new_target", "target").alias("target"), "label")


def override(relationships: DataFrame, updates: DataFrame) -> DataFrame:
    """Labels and technologies from updates (source, target, new_label, new_technology[, ord]); empty ones don't
    count, and of several updates of a pair the last by ord that says something."""
    place = F.col("ord") if "ord" in updates.columns else F.lit(0)
    last = lambda c: F.max(F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.struct(place.alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    once = updates.groupBy("source", "target").agg(last("new_label"), last("new_technology"))
    rows = relationships.join(once, ["source", "target"], "left")
    pick = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old)).alias(old)
    return rows.select("source", "target", pick("new_label", "label"), pick("new_technology", "technology"))

"""From scanned applications to an architecture model: containers, components, external systems, relationships.

A scan is a set of tables, one row per application, module, import or dependency; `ord` columns hold the order in
which a scan lists them, in any type that compares.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import project
from ..sources.store import stored
from . import model

SHELL_ROOT = "."


@dataclass(frozen=True)
class Scan:
    """apps: app_id, path, name, language, ord. modules: app_id, module_id, name, annotations, framework, ord.
    imports: app_id, module_id, source, is_external, resolved, ord. internal: app_id, target_app, ord.
    dependencies: app_id, name, ord."""

    apps: DataFrame
    modules: DataFrame
    imports: DataFrame
    internal: DataFrame
    dependencies: DataFrame


def scan_tree(owned: DataFrame, projects: DataFrame) -> Scan:
    """The scan of the projects of a source tree, in the order of their paths. What models are built from many times
    is written once."""
    apps = stored(project.applications(owned, projects), "apps")
    files, deps = stored(project.sources(owned, projects), "sources"), stored(project.dependencies(owned), "dependencies")
    ids = apps.select("project", "app_id")
    module_id = text.slug(F.concat_ws("/", "project", "module")).alias("module_id")
    ord_ = F.struct("project", "module").alias("ord")
    modules = project.modules(files).join(project.ts_frameworks(files, deps).withColumnRenamed("framework", "ts"), ["project", "module"], "left").join(ids, "project")
    modules = modules.select("app_id", module_id, F.col("module").alias("name"), "annotations", F.coalesce("ts", "framework").alias("framework"), ord_)
    imports = project.module_imports(files).join(ids, "project")
    imports = imports.select("app_id", module_id, "source", "is_external", F.lit(None).cast("string").alias("resolved"), F.struct("project", "module", "source").alias("ord"))
    targets = apps.select(F.col("project").alias("target"), F.col("app_id").alias("target_app"))
    internal = project.internal_imports(owned, projects).join(targets, "target").join(ids, "project").select("app_id", "target_app", F.struct("project", "target").alias("ord"))
    named = deps.where("NOT internal").join(ids, "project").select("app_id", "name", F.struct("project", "name").alias("ord"))
    return Scan(apps.select("app_id", F.col("project").alias("path"), "name", "language", F.col("project").alias("ord")), stored(modules, "modules"), stored(imports, "imports"), stored(internal, "internal"), named)


def shell_parents(apps: DataFrame, modules: DataFrame) -> DataFrame:
    """app_id of applications without modules that others lie below; the root is above all others. Paths are cut
    into their prefixes, so the join is on equal keys."""
    up = apps.select(F.explode(F.concat(F.array(F.lit(SHELL_ROOT)), model.ancestors("path"))).alias("path"), F.col("path").alias("below"))
    above = up.where("path <> below").select("path").distinct()
    return apps.join(modules.select("app_id").distinct(), "app_id", "left_anti").join(above, "path", "left_semi").select("app_id")


def _technologies(scan: Scan) -> DataFrame:
    """app_id, technology: the language and the first framework that any dependency tells."""
    names = scan.dependencies.groupBy("app_id").agg(F.collect_set("name").alias("names"))
    rows = scan.apps.join(names, "app_id", "left")
    return rows.select("app_id", rules.technology(F.col("language"), F.coalesce("names", F.array().cast("array<string>"))).alias("technology"))


def containers(scan: Scan) -> DataFrame:
    """id, application_id, name, description, technology, path: an application each, but for shell parents."""
    rows = scan.apps.join(shell_parents(scan.apps, scan.modules), "app_id", "left_anti").join(_technologies(scan), "app_id")
    name = text.humanize("name")
    return rows.select(F.col("app_id").alias("id"), F.col("app_id").alias("application_id"), name.alias("name"), F.concat(name, F.lit(" application")).alias("description"), "technology", "path")


def components(scan: Scan, granularity: str = "balanced", excluded: tuple[str, ...] = ()) -> DataFrame:
    """id, container_id, name, description, technology, module_ids, ord.

    `overview` makes one component an application, `detailed` one a module; `balanced` leaves out modules whose
    names hold an excluded pattern, and groups those of large applications by name prefix. A group is named by its
    prefix and takes id and role from its first module."""
    languages = scan.apps.select("app_id", "language", F.col("name").alias("app_name"), F.col("ord").alias("app_ord"))
    if granularity == "overview":
        rows = scan.modules.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("ord", "module_id"))).alias("m")).join(languages, "app_id").join(_technologies(scan), "app_id")
        name = text.humanize("app_name")
        ids = F.transform("m", lambda m: m["module_id"]).alias("module_ids")
        return rows.select(text.slug(F.concat("app_id", F.lit("-core"))).alias("id"), F.col("app_id").alias("container_id"), name.alias("name"), F.concat(F.lit("Core logic of "), name).alias("description"), "technology", ids, F.struct("app_ord", F.get("m", 0)["ord"].alias("ord")).alias("ord"))
    modules = scan.modules
    if granularity == "balanced":
        modules = model.without(modules, list(excluded))
        dotted = F.when(F.contains("name", F.lit(".")), F.col("name")).otherwise(F.replace("name", F.lit("/"), F.lit(".")))
        groups = model.balanced_groups(modules.select("app_id", "module_id", dotted.alias("name")))
        sizes = modules.groupBy("app_id").agg(F.count("*").alias("n"))
        rows = modules.join(groups, ["app_id", "module_id"]).join(sizes, "app_id").withColumn("key", F.when(F.col("n") <= model.MOST_GROUPS, F.col("module_id")).otherwise(F.col("component")))
    else:
        rows = modules.withColumn("n", F.lit(None).cast("long")).withColumn("component", F.col("name")).withColumn("key", F.col("module_id"))
    first = rows.groupBy("app_id", "key").agg(
        F.min_by(F.struct("module_id", "name", "annotations", "framework", "ord"), "ord").alias("r"),
        F.array_sort(F.collect_list(F.struct("ord", "module_id"))).alias("m"),
        F.max("n").alias("n"),
        F.max("component").alias("component"),
    )
    one = F.coalesce(F.col("n") <= model.MOST_GROUPS, F.lit(False))
    shown = model.display_names(first.select(F.struct("app_id", "key").alias("component_id"), "app_id", F.col("component").alias("name"))).select("component_id.*", "display")
    rows = first.join(shown, ["app_id", "key"]).join(languages, "app_id")
    rows = rows.withColumn("name", F.when(one, text.humanize(text.last_segment("r.name"))).otherwise(F.col("display")))
    return rows.select(
        F.col("r.module_id").alias("id"),
        F.col("app_id").alias("container_id"),
        "name",
        rules.role_description(F.col("name"), F.coalesce("r.annotations", F.lit(""))).alias("description"),
        rules.component_technology(F.coalesce("r.annotations", F.lit("")), F.col("r.framework"), F.col("language")).alias("technology"),
        F.transform("m", lambda m: m["module_id"]).alias("module_ids"),
        F.struct("app_ord", F.col("r.ord").alias("ord")).alias("ord"),
    )


def external_systems(scan: Scan, declared: DataFrame, libraries: DataFrame) -> DataFrame:
    """id, name, description, technology, is_library: declared systems (name, technology, used_by, ord), detected ones
    of other ids, and libraries (id, name, language) whose ids no system has."""
    none = F.lit(False).alias("is_library")
    named = declared.groupBy(text.slug("name").alias("id")).agg(F.min_by(F.struct("name", "technology"), "ord").alias("d"))
    kind = F.coalesce("d.technology", F.lit("External System"))
    known = named.select("id", F.col("d.name").alias("name"), F.concat(F.lit("External "), F.lower(F.coalesce("d.technology", F.lit("system")))).alias("description"), kind.alias("technology"), none)
    found = model.detect_externals(scan.dependencies)
    found = found.groupBy("id").agg(F.min(F.struct("technology", "type")).alias("f")).select("id", F.col("f.technology").alias("name"), F.concat("f.type", F.lit(" used by the system")).alias("description"), F.col("f.technology").alias("technology"), none)
    both = model.merge_externals(known, found)
    shared = libraries.groupBy(text.slug("id").alias("id")).agg(F.min(F.struct("name", "language")).alias("l"))
    shared = shared.select("id", text.humanize("l.name").alias("name"), F.concat(F.lit("Shared "), "l.language", F.lit(" library")).alias("description"), F.col("l.language").alias("technology"), F.lit(True).alias("is_library"))
    return model.merge_externals(both, shared)


def relationships(scan: Scan, parts: DataFrame, declared: DataFrame) -> DataFrame:
    """source, target, label, technology, one per pair. Phases, of which the first that has a pair wins: what scans
    tell (imports of applications, imports between components, and these between their containers), uses that
    the configuration declares, and uses of detected systems that it doesn't declare."""
    none = F.lit(None).cast("string").alias("technology")
    apps = scan.apps.select("app_id", F.col("ord").alias("app_ord"))
    # Ordinals keep their types: those of imports of applications and of modules have a place each.
    kinds = [df.schema["ord"].dataType for df in (scan.internal, scan.imports)]
    at = lambda kind, promoted=False: F.struct(F.col("app_ord").alias("app"), F.lit(kind).alias("kind"), *((F.col("ord") if i == kind else F.lit(None).cast(t)).alias(f"o{i}") for i, t in enumerate(kinds)), F.lit(promoted).alias("promoted")).alias("ord")
    known = scan.apps.select(F.col("app_id").alias("target_app"))
    imported = scan.internal.join(known, "target_app", "left_semi").join(apps, "app_id")
    phase0 = imported.select(F.col("app_id").alias("source"), F.col("target_app").alias("target"), F.lit("Uses").alias("label"), none, at(0))

    of_module = parts.select(F.col("id").alias("component"), "container_id", "ord", F.explode("module_ids").alias("module_id"))
    of_module = of_module.groupBy("module_id").agg(F.max_by(F.struct("component", "container_id"), "ord").alias("c"))
    roles = model.detect_roles(scan.modules).where("role IS NOT NULL")
    members = parts.select(F.col("id").alias("component_id"), F.posexplode("module_ids").alias("pos", "module_id"))
    role = model.component_role(members.join(roles, "module_id")).select(F.col("component_id"), "role")
    named = model.resolve_imports(scan.imports.where("NOT is_external AND resolved IS NULL").select("module_id", "source").distinct(), scan.modules.select("module_id", "name", "ord"))
    rows = scan.imports.where("NOT is_external").join(named, ["module_id", "source"], "left").withColumn("target_id", F.coalesce("resolved", "target_id"))
    rows = rows.where("target_id IS NOT NULL").join(of_module.select("module_id", F.col("c").alias("s")), "module_id").join(of_module.select(F.col("module_id").alias("target_id"), F.col("c").alias("t")), "target_id")
    rows = rows.where("s.component <> t.component").join(apps, "app_id")
    rows = rows.join(role.select(F.col("component_id").alias("sc"), F.col("role").alias("sr")), F.col("s.component") == F.col("sc"), "left").join(role.select(F.col("component_id").alias("tc"), F.col("role").alias("tr")), F.col("t.component") == F.col("tc"), "left")
    phase0 = phase0.unionByName(rows.select(F.col("s.component").alias("source"), F.col("t.component").alias("target"), rules.relationship_label(F.col("sr"), F.col("tr")).alias("label"), none, at(1)))
    promoted = rows.where("s.container_id <> t.container_id")
    phase0 = phase0.unionByName(promoted.select(F.col("s.container_id").alias("source"), F.col("t.container_id").alias("target"), F.lit("Uses").alias("label"), none, at(1, True)))

    used = declared.select("name", "technology", F.col("ord").alias("o"), F.explode("used_by").alias("source"))
    phase1 = used.select("source", text.slug("name").alias("target"), F.concat(F.lit("Uses "), "name").alias("label"), "technology", F.col("o").alias("ord"))

    hit = scan.dependencies.withColumn("rule", rules.external_rule(F.col("name"))).where("rule IS NOT NULL")
    hit = hit.select("app_id", rules.external_technology(F.col("rule")).alias("technology"), rules.external_type(F.col("rule")).alias("type"), F.col("ord").alias("o")).withColumn("target", text.slug("technology"))
    hit = hit.join(declared.select(text.slug("name").alias("target")).distinct(), "target", "left_anti")
    phase2 = hit.select(F.col("app_id").alias("source"), "target", rules.mapped(F.col("type"), rules.EXTERNAL_LABELS).alias("label"), "technology", F.col("o").alias("ord"))
    return model.derive_relationships([phase0, phase1, phase2])


class Builder:
    """The model of a scan, collection by collection; each is made when it is asked for, components once.

    declared: name, technology, used_by, ord. libraries: id, name, language."""

    def __init__(self, scan: Scan, declared: DataFrame, libraries: DataFrame, granularity: str = "balanced", excluded: tuple[str, ...] = ()):
        self.scan, self.declared, self.libraries, self.granularity, self.excluded = scan, declared, libraries, granularity, excluded

    @cached_property
    def _parts(self) -> DataFrame:
        return stored(components(self.scan, self.granularity, self.excluded), "components")

    @property
    def actors(self) -> DataFrame:
        return model.infer_actors(model.detect_roles(self.scan.modules))

    @property
    def externals(self) -> DataFrame:
        return external_systems(self.scan, self.declared, self.libraries)

    @property
    def containers(self) -> DataFrame:
        return containers(self.scan)

    @property
    def components(self) -> DataFrame:
        return self._parts.drop("ord")

    @property
    def relationships(self) -> DataFrame:
        return relationships(self.scan, self._parts, self.declared)


def inject_cross_app(relationships: DataFrame, derived: DataFrame, containers: DataFrame, components: DataFrame) -> DataFrame:
    """`relationships` and those derived ones of other pairs that join two containers, or components of two."""
    home = containers.select("id", F.col("id").alias("container"), F.lit(True).alias("is_container"))
    home = home.unionByName(components.join(containers.select("id"), "id", "left_anti").select("id", F.col("container_id").alias("container"), F.lit(False).alias("is_container")))
    rows = derived
    for side in ("source", "target"):
        rows = rows.join(home.select(F.col("id").alias(side), F.col("container").alias(side + "_home"), F.col("is_container").alias(side + "_top")), side)
    crossing = rows.where("source_top = target_top AND source_home <> target_home").select("source", "target", "label", "technology")
    return relationships.unionByName(crossing.join(relationships.select("source", "target").distinct(), ["source", "target"], "left_anti"))


def attach_code(elements: DataFrame, components: DataFrame) -> DataFrame:
    """elements (module_id, ...) with the component and container that now hold their module; those of modules that no
    component has go. Run again after any change of the components."""
    home = components.select(F.explode("module_ids").alias("module_id"), F.col("id").alias("component_id"), "container_id")
    home = home.groupBy("module_id").agg(F.max(F.struct("component_id", "container_id")).alias("h"))
    return elements.drop("component_id", "container_id").join(home, "module_id").select("*", "h.component_id", "h.container_id").drop("h")

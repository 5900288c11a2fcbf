"""Code elements and the resolution of the references between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from .keys import HASH, joined_by, spread

Order = Callable[[Column], Column]


def visible(elements: DataFrame, include_private: bool = False) -> DataFrame:
    """Public elements; internal ones and those of no stated visibility go too, unless all are wanted."""
    return elements if include_private else elements.where("visibility <=> 'public'")


def visible_members(members: Column, include_private: bool = False) -> Column:
    """Members but for private ones; those of no stated visibility stay."""
    return members if include_private else F.filter(members, lambda m: ~m["visibility"].eqNullSafe(F.lit("private")))


def enough(elements: DataFrame, least: int = 2) -> DataFrame:
    """Elements of components that have at least `least` of them."""
    n = elements.groupBy("component_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return elements.join(n.select("component_id"), "component_id", "left_semi")


def _looked_up(refs: DataFrame, elements: DataFrame, pairs: list[tuple[str, str]], order: Order | None, repeated: bool) -> DataFrame:
    """refs plus, for each pair of a name and the column that asks for it, t and n by component (tc_{name}, nc_{name}) and by
    container (t_{name}, n_{name}): the least id and the number of the elements so called, null if none is. References meet
    the elements of their container and of the first pair's name in one sorted partition, so that no row carries what
    other components have; a row crosses the network once, with each of its columns once."""
    asked = [wanted for _, wanted in pairs]
    fixed = ["container_id", "component_id", *asked]
    others = [c for c in refs.columns if c not in fixed]
    named = elements.where(F.col(pairs[0][0]).isNotNull() & F.col("container_id").isNotNull())
    named = named.select("container_id", "component_id", *(F.col(name).alias(wanted) for name, wanted in pairs), F.col("id").alias("_id"), F.lit(False).alias("_asks"), *(F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in others))
    asking = refs.select(*fixed, F.lit(None).cast(named.schema["_id"].dataType).alias("_id"), F.lit(True).alias("_asks"), *others)
    # The hash follows from the row, so it is made again behind the shuffle instead of being sent.
    place = spread(["container_id", asked[0]], ["component_id", *asked[1:], *others])
    rows = named.unionByName(asking).repartition(place).withColumn(HASH, place)
    if repeated:
        rows = rows.distinct()
    key = F.col("_id") if order is None else F.struct(order(F.col("_id")).alias("by"), F.col("_id").alias("id"))
    rows = rows.withColumn("_own", F.when(~F.col("_asks"), key)).withColumn("_one", F.when(~F.col("_asks"), F.lit(1)))
    own, found = F.col("component_id").isNotNull(), lambda c: c if order is None else c["id"]
    out = []
    for n, (name, _) in enumerate(pairs):
        at = [HASH, "container_id", *asked[: n + 1]]
        inner, outer = Window.partitionBy(*at, "component_id"), Window.partitionBy(*at)
        rows = rows.withColumn(f"_t{n}", F.min("_own").over(inner)).withColumn(f"_n{n}", F.sum("_one").over(inner))
        # The least of the components' least ids: one that needs the other, so that both keep one order of rows.
        rows = rows.withColumn(f"_u{n}", F.min(f"_t{n}").over(outer)).withColumn(f"_m{n}", F.sum(F.when(F.col(f"_n{n}").isNotNull(), F.col("_one"))).over(outer))
        asks = F.col(pairs[n][1]).isNotNull() & F.col("container_id").isNotNull()
        out += [F.when(own & asks, found(F.col(f"_t{n}"))).alias(f"tc_{name}"), F.when(own & asks, F.col(f"_n{n}")).alias(f"nc_{name}"), F.when(asks, found(F.col(f"_u{n}"))).alias(f"t_{name}"), F.when(asks, F.col(f"_m{n}")).alias(f"n_{name}")]
    return rows.where("_asks").select(*refs.columns, *out)


def resolve(elements: DataFrame, references: DataFrame, nested: bool = False, order: Order | None = None, repeated: bool = False) -> DataFrame:
    """references plus component_id, container_id, target_id, resolved_by, collisions.

    A target is looked up by qualified name in the element's component, then in its container, then by name in
    the component, then in the container; a miss falls through. Of several candidates the smallest id is
    taken and their number is kept. Each kind of name takes one shuffle of references and elements together.

    Ids, components and containers have any type; `order` gives what ids are compared by, where that isn't the ids
    themselves. References that have component_id and container_id already, those of their element, aren't joined with
    elements for them. `nested`: where qualified names are equal, so are names, and one shuffle serves both kinds.
    `repeated`: elements and references may come several times and count once."""
    refs = references
    if "container_id" not in refs.columns:
        refs = joined_by(refs, elements.select(F.col("id").alias("element_id"), "component_id", "container_id"), ["element_id"])
    by_name, by_qualified = ("name", "target_name"), ("qualified_name", "target_qualified")
    if nested:
        refs = _looked_up(refs, elements, [by_name, by_qualified], order, repeated)
    else:
        for pair in (by_qualified, by_name):
            refs = _looked_up(refs, elements, [pair], order, repeated)
    levels = [(F.col(f"t{c}_{name}"), F.col(f"n{c}_{name}")) for name in ("qualified_name", "name") for c in ("c", "")]
    by = F.lit("unresolved")
    for (target, _), label in reversed(list(zip(levels, ("qualified-component", "qualified-container", "name-component", "name-container"), strict=True))):
        by = F.when(target.isNotNull(), label).otherwise(by)
    hits = F.coalesce(*(n for _, n in levels), F.lit(0).cast("long"))
    return refs.select(
        "element_id", "component_id", "container_id", "target_name", "target_qualified", "kind",
        F.coalesce(*(t for t, _ in levels)).alias("target_id"), by.alias("resolved_by"), hits.alias("collisions"),
    )


def links(resolved: DataFrame) -> DataFrame:
    """source, target, kind, label of the resolved references; `extends` is called inherits."""
    kind = F.when(F.col("kind") == "extends", "inherits").otherwise(F.col("kind"))
    return resolved.where("target_id IS NOT NULL").select(F.col("element_id").alias("source"), F.col("target_id").alias("target"), kind.alias("kind"), F.lit(None).cast("string").alias("label"))


def unresolved_breakdown(elements: DataFrame, resolved: DataFrame) -> DataFrame:
    """component_id (null: all), cause, n: references that name an element of another container, and others."""
    owners = elements.groupBy(F.col("name").alias("target_name")).agg(F.min("container_id").alias("c0"), F.max("container_id").alias("c1"))
    lost = resolved.where("target_id IS NULL").groupBy("component_id", "container_id", "target_name").agg(F.count("*").alias("each"))
    rows = lost.join(owners, "target_name", "left")
    elsewhere = F.col("c0").isNotNull() & ((F.col("c0") != F.col("container_id")) | (F.col("c1") != F.col("container_id")))
    rows = rows.withColumn("cause", F.when(elsewhere, "cross-container").otherwise("outside"))
    sums = rows.rollup("cause", "component_id").agg(F.grouping_id().alias("g"), F.sum("each").alias("n"))
    return sums.where("g < 2").select("component_id", "cause", "n")


def disambiguated(elements: DataFrame) -> DataFrame:
    """id, unique_id: a plain id (component and name) that several elements share gets a suffix on each of them,
    the slug of the qualified name, else of the file's directory and stem (`file`, where there is one); those that
    still clash are numbered in id order from the second on."""
    plain = F.concat_ws(".", "component_id", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"))
    rows = elements.withColumn("plain", plain).withColumn("n", F.count("*").over(Window.partitionBy("plain")))
    suffix = F.regexp_replace(F.lower("qualified_name"), "[^a-z0-9]+", "-")
    if "file" in elements.columns:
        stem = slug(F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=.)\.[^.]*$", ""))
        parent = slug(F.regexp_extract("file", "([^/]*)/[^/]*$", 1))
        suffix = F.coalesce(suffix, F.concat_ws("-", F.nullif(parent, F.lit("")), stem))
    rows = rows.withColumn("u", F.when(F.col("n") > 1, F.concat_ws("-", "plain", suffix)).otherwise(F.col("plain")))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("u").orderBy("id")))
    return rows.select("id", F.when(F.col("rn") > 1, F.concat_ws("-", "u", F.col("rn").cast("string"))).otherwise(F.col("u")).alias("unique_id"))


def dominant(elements: DataFrame, group: str, value: str, ties: list[str]) -> DataFrame:
    """group, dominant, n: the most frequent value; of equals the first of `ties`."""
    order = F.array_position(F.array(*map(F.lit, ties)), F.col(value))
    counts = elements.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -order)).alias("dominant"), F.max("n").alias("n"))


# Languages in the order that settles ties, and those that a kind of element gives away.
LANGUAGES = ("java", "typescript", "python", "c")
KIND_LANGUAGES = {"struct": "c", "typedef": "c", "type": "typescript", "enum": "java"}
UNKNOWN_LANGUAGE = "java"


def dominant_language(components: DataFrame, elements: DataFrame, module_files: DataFrame) -> DataFrame:
    """components (component_id, module_ids), elements (component_id, language, kind), module_files (module_id,
    language, files) -> component_id, language, source: the most frequent language of the component's elements, else of
    its modules' files, else of the languages that kinds of elements give away, else Java. Ties go by LANGUAGES."""
    one = elements.where(F.col("language").isin(*LANGUAGES)).groupBy("component_id", "language").agg(F.count("*").alias("n"))
    members = components.select("component_id", F.explode("module_ids").alias("module_id"))
    two = members.join(module_files.where("files > 0"), "module_id").where(F.col("language").isin(*LANGUAGES)).groupBy("component_id", "language").agg(F.sum("files").alias("n"))
    told = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in KIND_LANGUAGES.items()))
    three = elements.select("component_id", told.alias("language")).where("language IS NOT NULL").groupBy("component_id", "language").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("language"))
    rows = components.select("component_id").distinct()
    for name, counts in (("elements", one), ("files", two), ("kinds", three)):
        best = counts.groupBy("component_id").agg(F.max_by("language", F.struct("n", -order)).alias(name))
        rows = rows.join(best, "component_id", "left")
    source = F.when(F.col("elements").isNotNull(), "elements").when(F.col("files").isNotNull(), "files").when(F.col("kinds").isNotNull(), "kinds").otherwise("default")
    return rows.select("component_id", F.coalesce("elements", "files", "kinds", F.lit(UNKNOWN_LANGUAGE)).alias("language"), source.alias("source"))

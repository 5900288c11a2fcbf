"""Graph views of an architecture model at four levels. Edges are taken in (source, target) order, equal ones by
their `ord` where relationships have one: where several fall together, the first one's label and technology
stay."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import by_letters, in_locale
from ..sources.store import stored
from .keys import HASH, joined_by


@dataclass(frozen=True)
class Projection:
    vertices: DataFrame
    edges: DataFrame
    warnings: DataFrame


@dataclass(frozen=True)
class ComponentProjection(Projection):
    """Level 3; links are its edges with source_local and target_local, whether an end is a component of the view."""

    links: DataFrame


#: Texts of ids of components and of elements.
Text = tuple[Callable[[Column], Column], Callable[[Column], Column]]


@dataclass(frozen=True)
class CodeProjection(Projection):
    """Level 4 by the ids as they are too: elements (id, component_id) and links (component_id, source, target, kind, label,
    far: whether it leaves the component)."""

    elements: DataFrame
    links: DataFrame
    text: Text


SYSTEM = "system"


def _first_by_pair(edges: DataFrame) -> DataFrame:
    """edges: s, t (new ids), source, target, label, technology[, ord] -> one edge per (s, t). All rows are sorted for
    this; a hash before ids that begin alike decides nearly every comparison of different pairs."""
    place = ["ord"] if "ord" in edges.columns else []
    first = edges.groupBy(F.xxhash64("s", "t").alias(HASH), "s", "t").agg(F.min(F.struct("source", "target", *place, "label", "technology")).alias("e"))
    first = first.where("e IS NOT NULL")  # always true; keeps the whole row in plans that need its ends only, so that one grouping serves all
    return first.select(F.col("s").alias("source"), F.col("t").alias("target"), "e.label", "e.technology")


def _endpoints(relationships: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds s, t (null if unknown) and s_kind, t_kind from dim: id, to, kind."""
    s = dim.select(F.col("id").alias("source"), F.col("to").alias("s"), F.col("kind").alias("s_kind"))
    t = dim.select(F.col("id").alias("target"), F.col("to").alias("t"), F.col("kind").alias("t_kind"))
    return joined_by(joined_by(relationships, s, ["source"], "left"), t, ["target"], "left")


def _unknown(edges: DataFrame, level: str) -> DataFrame:
    """One warning per edge that lacks an endpoint; the source is named first."""
    gone = edges.where("s IS NULL OR t IS NULL")
    which = F.when(F.col("s").isNull(), F.concat(F.lit("source "), "source")).otherwise(F.concat(F.lit("target "), "target"))
    return gone.select(F.concat(F.lit(level + ": unknown "), which, F.lit(" of "), "source", F.lit(" -> "), "target").alias("warning")).distinct()


def context(actors: DataFrame, externals: DataFrame, containers: DataFrame, components: DataFrame, relationships: DataFrame) -> Projection:
    """Level 1: actors, the system, and external systems that are no libraries. Containers and components are
    the system; edges between external systems and within the system go without, unknown ones with a warning."""
    seen = externals.where(~F.col("is_library"))
    dim = actors.select("id", F.col("id").alias("to"), F.lit("actor").alias("kind"))
    dim = dim.unionByName(seen.select("id", F.col("id").alias("to"), F.lit("external").alias("kind")))
    for inner in (containers, components):
        dim = dim.unionByName(inner.select("id", F.lit(SYSTEM).alias("to"), F.lit(SYSTEM).alias("kind")))
    edges = _endpoints(relationships, dim)
    kept = edges.where("s IS NOT NULL AND t IS NOT NULL AND NOT (s_kind = 'external' AND t_kind = 'external') AND s <> t")
    vertices = actors.select("id", F.lit("actor").alias("kind")).unionByName(seen.select("id", F.lit("external").alias("kind")))
    system = actors.sparkSession.range(1).select(F.lit(SYSTEM).alias("id"), F.lit(SYSTEM).alias("kind"))
    return Projection(vertices.unionByName(system), _first_by_pair(kept), _unknown(edges, "L1"))


def container(actors: DataFrame, externals: DataFrame, containers: DataFrame, components: DataFrame, relationships: DataFrame) -> Projection:
    """Level 2: a component's edges are its container's; containers without an edge are left out."""
    dim = actors.select("id", F.col("id").alias("to"), F.lit("actor").alias("kind"))
    dim = dim.unionByName(externals.select("id", F.col("id").alias("to"), F.lit("external").alias("kind")))
    dim = dim.unionByName(containers.select("id", F.col("id").alias("to"), F.lit("container").alias("kind")))
    dim = dim.unionByName(components.select("id", F.col("container_id").alias("to"), F.lit("component").alias("kind")))
    both = _endpoints(relationships, dim)
    edges = _first_by_pair(both.where("s IS NOT NULL AND t IS NOT NULL AND s <> t"))
    joined = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    used = containers.join(joined, "id", "left_semi")
    none = F.lit(None).cast("string")
    vertices = actors.select("id", F.lit("actor").alias("kind"), none.alias("parent_id"))
    vertices = vertices.unionByName(actors.sparkSession.range(1).select(F.lit(SYSTEM).alias("id"), F.lit(SYSTEM).alias("kind"), none.alias("parent_id")))
    vertices = vertices.unionByName(externals.select("id", F.lit("external").alias("kind"), none.alias("parent_id")))
    vertices = vertices.unionByName(used.select("id", F.lit("container").alias("kind"), F.lit(SYSTEM).alias("parent_id")))
    return Projection(vertices, edges, _unknown(both, "L2"))


def component(actors: DataFrame, externals: DataFrame, containers: DataFrame, components: DataFrame, relationships: DataFrame) -> ComponentProjection:
    """Level 3 of every container at once, keyed by container_id. An edge belongs to the view of each container
    that holds an end of it; a foreign end becomes a reference, looked up as actor, external system, container,
    component in this order. Edges aren't merged, self edges stay, unknown ends drop their edges."""
    ranked = (("actor", actors), ("external", externals), ("container", containers), ("component", components))
    dim = None
    for rank, (kind, frame) in enumerate(ranked):
        part = frame.select("id", F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind")).alias("k"))
        dim = part if dim is None else dim.unionByName(part)
    dim = dim.groupBy("id").agg(F.min("k").alias("k")).select("id", F.col("k.kind").alias("kind"))
    home = components.select("id", "container_id")
    edges = joined_by(relationships, home.select(F.col("id").alias("source"), F.col("container_id").alias("sc")), ["source"], "left")
    edges = joined_by(edges, home.select(F.col("id").alias("target"), F.col("container_id").alias("tc")), ["target"], "left")
    views = edges.withColumn("container_id", F.explode(F.array_compact(F.array_distinct(F.array("sc", "tc")))))
    foreign = F.filter(
        F.array(F.struct(F.col("source").alias("id"), F.col("sc").alias("c")), F.struct(F.col("target").alias("id"), F.col("tc").alias("c"))),
        lambda e: ~e["c"].eqNullSafe(F.col("container_id")),
    )
    views = views.withColumn("foreign_id", F.get(foreign, 0)["id"])
    known = joined_by(views, dim.select(F.col("id").alias("foreign_id"), "kind"), ["foreign_id"], "left")
    good = known.where("foreign_id IS NULL OR kind IS NOT NULL")
    warnings = known.where("foreign_id IS NOT NULL AND kind IS NULL")
    warnings = warnings.select(F.concat(F.lit("L3 "), "container_id", F.lit(": unknown "), "foreign_id").alias("warning")).distinct()
    vertices = containers.select(F.col("id").alias("container_id"), "id", F.lit("boundary").alias("kind"))
    vertices = vertices.unionByName(components.select("container_id", "id", F.lit("component").alias("kind")))
    refs = good.where("foreign_id IS NOT NULL").select("container_id", F.col("foreign_id").alias("id"), F.concat(F.lit("reference-"), "kind").alias("kind")).distinct()
    local = [F.col(c).eqNullSafe(F.col("container_id")).alias(name) for c, name in (("sc", "source_local"), ("tc", "target_local"))]
    links = good.select("container_id", "source", "target", "label", "technology", *local)
    return ComponentProjection(vertices.unionByName(refs), good.select("container_id", "source", "target", "label", "technology"), warnings, links)


def code(elements: DataFrame, links: DataFrame, components: DataFrame | None = None, keep: bool = False, text: Text | None = None) -> CodeProjection:
    """Level 4 of every component at once, keyed by component_id. links: source, target, kind, label (null:
    the kind). Edges belong to the source's component; a foreign target brings itself and its component's
    boundary, marked cross-component. Every edge's ends are vertices of its view. What an end is missing for is a
    warning and no edge: an unknown source or target, or a target whose component isn't one of `components` (id), if
    given. `keep` stores the links with their ends, for callers that use several parts. Links that have component_id and
    target_component, those of elements, are taken with these. Ids may have any type; `text` makes texts of those of
    components and of elements where a part is complete, so that joins and groupings see the ids alone."""
    text = text or ((lambda c: c), (lambda c: c))
    of_component, of_element = (lambda c, f=f: f(F.col(c)) for f in text)
    home = elements.select("id", "component_id")
    rows = links
    if "target_component" not in links.columns:
        rows = joined_by(rows, home.select(F.col("id").alias("source"), "component_id"), ["source"], "left")
        rows = joined_by(rows, home.select(F.col("id").alias("target"), F.col("component_id").alias("target_component")), ["target"], "left")
    rows = rows.withColumn("known", F.col("target_component").isNotNull())
    if components is not None:
        listed = components.select(F.col("id").alias("target_component"), F.lit(True).alias("_listed")).distinct()
        rows = joined_by(rows, listed, ["target_component"], "left")
        rows = rows.withColumn("target_component", F.when(F.col("_listed"), F.col("target_component"))).drop("_listed")
    if keep:
        rows = stored(rows, "links")
    good = rows.where("component_id IS NOT NULL AND target_component IS NOT NULL")
    edges = good.select("component_id", "source", "target", "kind", F.coalesce("label", "kind").alias("label"), (F.col("component_id") != F.col("target_component")).alias("far"))
    ids = F.concat(of_element("source"), F.lit("->"), of_element("target"), F.lit(":"), "kind").alias("id")
    shown = edges.select(of_component("component_id").alias("component_id"), ids, of_element("source").alias("source"), of_element("target").alias("target"), "kind", "label")
    row = lambda df, id_, kind, cross: df.select(of_component("component_id").alias("component_id"), id_.alias("id"), F.lit(kind).alias("kind"), F.lit(cross).alias("cross_component"))
    vertices = row(home.select("component_id").distinct(), of_component("component_id"), "boundary", False)
    vertices = vertices.unionByName(row(home, of_element("id"), "element", False))
    far = good.where("component_id <> target_component")
    vertices = vertices.unionByName(row(far.select("component_id", "target_component").distinct(), of_component("target_component"), "boundary", True))
    vertices = vertices.unionByName(row(far.select("component_id", "target").distinct(), of_element("target"), "element", True))
    lost = rows.where("component_id IS NULL").select("source").distinct().select(F.concat(F.lit("L4: unknown source "), of_element("source")).alias("warning"))
    gone = rows.where("component_id IS NOT NULL AND target_component IS NULL").select("component_id", "known", "target").distinct()
    why = F.when(F.col("known"), F.lit(": target of unknown component ")).otherwise(F.lit(": unknown target "))
    lost = lost.unionByName(gone.select(F.concat(F.lit("L4 "), of_component("component_id"), why, of_element("target")).alias("warning")))
    return CodeProjection(vertices, shown, lost, home, edges, text)


def fragment(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with at least one end among `ids` (id)."""
    s, t = (ids.select(F.col("id").alias(c), F.lit(True).alias(c + "_in")).distinct() for c in ("source", "target"))
    return relationships.join(s, "source", "left").join(t, "target", "left").where("source_in OR target_in").drop("source_in", "target_in")


def degrees(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, degree of every end of an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").cast("long").alias("fan_in"), F.sum("e.o").cast("long").alias("fan_out"), F.count("*").alias("degree"))


def hub_widths(edges: DataFrame, base: int = 160) -> DataFrame:
    """id, width: hubs of a fan-out of two or more grow with it."""
    wide = F.greatest(F.lit(base), F.round(F.col("fan_out") * base * 0.55).cast("int"))
    return degrees(edges).select("id", F.when(F.col("fan_out") >= 2, wide).otherwise(base).cast("int").alias("width"))


def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds `position` (from 1) and `first` within each group: names in the order of the locale, equal ones by bytes."""
    locale = in_locale(name)
    order = Window.partitionBy(*by).orderBy(locale, name)
    first = F.min(locale).over(Window.partitionBy(*by))
    return rows.withColumn("position", F.row_number().over(order)).withColumn("first", F.collate(first, "UTF8_BINARY"))


def same_letters(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Pairs (name, other) of names that differ in nothing but case and accents, each pair once."""
    a = rows.select(F.col(name).alias("name"), by_letters(name).alias("key")).distinct()
    b = others.select(F.col(name).alias("other"), by_letters(name).alias("key")).distinct()
    return a.join(b, "key").where("name <> other").select("name", "other")


def first_edges(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return edges.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")

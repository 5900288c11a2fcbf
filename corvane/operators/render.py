"""Diagram text. Lines carry a section and a key. A diagram of a whole system comes as its lines, which any number of
tasks make; `joined` makes one text of them where that is wanted, and always does of the small diagrams by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import diagram_id, quoted

BREAK = "\\n"


def joined(lines: DataFrame, by: list[str], name: str) -> DataFrame:
    """lines: section, k, line and the columns of `by` -> one text per group, ended by a line break."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "k", "line")))
    return lines.groupBy(*by).agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n"), F.lit("\n")).alias(name))


def shape(id_: Column | str, label: Column, indent: str = "") -> Column:
    return F.concat(F.lit(indent), diagram_id(id_), F.lit(": "), quoted(label))


def block(id_: Column | str, label: Column, properties: Column, children: Column | None = None) -> Column:
    """A shape or container with its properties, a map, in the order of their names, and lines of what it holds; one
    without either is a plain shape. Values are quoted where they need it; nulls are left out."""
    entries = F.array_sort(F.filter(F.map_entries(properties), lambda e: e["value"].isNotNull()))
    inner = F.transform(entries, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), quoted(e["value"])))
    if children is not None:
        inner = F.concat(inner, F.transform(F.coalesce(children, F.array().cast("array<string>")), lambda line: F.concat(F.lit("  "), line)))
    head = shape(id_, label)
    return F.when(F.size(inner) > 0, F.concat(head, F.lit(" {\n"), F.array_join(inner, "\n"), F.lit("\n}"))).otherwise(head)


def connection(source: Column, target: Column, label: Column) -> Column:
    return F.concat(source, F.lit(" -> "), target, F.lit(": "), quoted(label))


def _row(df: DataFrame, section: int, key: Column | str, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), (F.col(key) if isinstance(key, str) else key).alias("k"), line.alias("line"))


def container_diagram(model, projection, links: DataFrame | None = None) -> DataFrame:
    """The level-2 diagram as one text; see `container_lines`."""
    return joined(container_lines(model, projection, links), [], "diagram")


def container_lines(model, projection, links: DataFrame | None = None) -> DataFrame:
    """section, k, line of the level-2 diagram: people, the system with its containers, external systems, edges.
    links (id, submodule, component) lead from a container to its own documents, else to its components."""
    name = F.col("name")
    one = model.actors.sparkSession.range(1)
    used = model.containers.join(projection.vertices.where("kind = 'container'").select("id"), "id", "left_semi")
    box = shape("id", F.concat(name, F.lit(BREAK + "[Container]")), "  ")
    if links is not None:
        used = used.join(links.select("id", F.coalesce("submodule", "component").alias("link")), "id", "left")
        box = F.concat(box, F.coalesce(F.concat(F.lit(' { link: "'), "link", F.lit('" }')), F.lit("")))
    kind = F.when(F.col("is_library"), BREAK + "[Library]").otherwise(BREAK + "[External System]")
    ids = projection.vertices.where("kind = 'container'").select(F.col("id").alias("cid"))
    inner = lambda c: F.when(F.col(c + "_in"), "system.").otherwise("")
    edges = projection.edges
    for c in ("source", "target"):
        edges = edges.join(ids.select(F.col("cid").alias(c), F.lit(True).alias(c + "_in")), c, "left")
    parts = [
        _row(one, 0, F.lit(""), F.lit("# Container diagram")),
        _row(model.actors, 1, "id", shape("id", F.concat(name, F.lit(BREAK + "[Person]")))),
        _row(one, 2, F.lit(""), F.lit('system: "System\\n[Software System]" {')),
        _row(used, 3, "id", box),
        _row(one, 4, F.lit(""), F.lit("}")),
        _row(model.externals, 5, "id", shape("id", F.concat(name, kind))),
        _row(edges, 6, F.concat("source", F.lit(" -> "), "target"), connection(F.concat(inner("source"), diagram_id("source")), F.concat(inner("target"), diagram_id("target")), F.concat("label", F.lit(" ["), "technology", F.lit("]")))),
    ]
    return _union(parts)


def context_diagram(model, projection) -> DataFrame:
    """The level-1 diagram as one text."""
    return joined(context_lines(model, projection), [], "diagram")


def context_lines(model, projection) -> DataFrame:
    """section, k, line of the level-1 diagram."""
    name, one = F.col("name"), model.actors.sparkSession.range(1)
    seen = model.externals.where(~F.col("is_library"))
    parts = [
        _row(one, 0, F.lit(""), F.lit("# Context diagram")),
        _row(model.actors, 1, "id", shape("id", F.concat(name, F.lit(BREAK + "[Person]")))),
        _row(one, 2, F.lit(""), F.lit('system: "System\\n[Software System]"')),
        _row(seen, 3, "id", shape("id", F.concat(name, F.lit(BREAK + "[External System]")))),
        _row(projection.edges, 4, F.concat("source", F.lit(" -> "), "target"), connection(diagram_id("source"), diagram_id("target"), F.col("label"))),
    ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def component_diagrams(projection) -> DataFrame:
    """container_id, diagram: the level-3 diagram of each container as one text; see `component_lines`."""
    return joined(component_lines(projection), ["container_id"], "diagram")


def component_lines(projection) -> DataFrame:
    """container_id, section, k, line of the level-3 diagrams. Local components stand inside the boundary,
    references outside."""
    v, edges = projection.vertices, projection.links
    inside = lambda c: F.concat(F.when(F.col(c + "_local"), F.concat(diagram_id("container_id"), F.lit("."))).otherwise(""), diagram_id(c))
    row = lambda df, section, k, line: df.select("container_id", F.lit(section).alias("section"), k.alias("k"), line.alias("line"))
    label = F.concat("id", F.lit(BREAK + "["), "kind", F.lit("]"))
    boundary = v.where("kind = 'boundary'")
    return _union(
        [
            row(boundary, 0, F.lit(""), F.concat(diagram_id("id"), F.lit(": "), quoted(label), F.lit(" {"))),
            row(v.where("kind = 'component'"), 1, F.col("id"), shape("id", label, "  ")),
            row(boundary, 2, F.lit(""), F.lit("}")),
            row(v.where("kind LIKE 'reference-%'"), 3, F.col("id"), shape("id", label)),
            row(edges, 4, F.concat("source", F.lit(" -> "), "target"), connection(inside("source"), inside("target"), F.concat("label", F.lit(" ["), "technology", F.lit("]")))),
        ]
    )


def code_diagrams(projection, hidden_kinds: tuple[str, ...] = ()) -> DataFrame:
    """component_id, diagram: the level-4 diagram of each component as one text; see `code_lines`."""
    return joined(_placed_lines(projection, hidden_kinds), ["_place", "component_id"], "diagram").drop("_place")


def code_lines(projection, hidden_kinds: tuple[str, ...] = (), others: DataFrame | None = None) -> DataFrame:
    """component_id, section, k, line of the level-4 diagrams; edges within a component come before those that leave
    it. A language profile may hide kinds of edges. Ids meet by component in one shuffle and become lines behind it, so
    all lines of a component stand in one partition. With `others` (component_id as the projection's ids are, and more
    columns) components of it alone are drawn, and lines have its columns."""
    return _placed_lines(projection, hidden_kinds, others).drop("_place")


def _placed_lines(projection, hidden_kinds: tuple[str, ...] = (), others: DataFrame | None = None) -> DataFrame:
    """`code_lines` with the component's id as `_place`, by which they are placed."""
    e, (of_component, of_element) = projection.links, projection.text
    shown = e.where(~F.col("kind").isin(*hidden_kinds)) if hidden_kinds else e
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast(e.schema["target"].dataType)
    row = lambda df, section, source, target, kind, label: df.select("component_id", section.alias("section"), source.alias("source"), target.alias("target"), kind.alias("kind"), label.alias("label"))
    home = projection.elements
    rows = _union(
        [
            row(home.select("component_id").distinct(), F.lit(0), nowhere, nowhere, none, none),
            row(home, F.lit(1), F.col("id"), nowhere, none, none),
            row(e.where("far"), F.lit(2), nowhere, F.col("target"), none, none),
            row(shown, F.when(F.col("far"), 4).otherwise(3), F.col("source"), F.col("target"), F.col("kind"), F.col("label")),
        ]
    )
    ids = rows.columns
    rows = rows.repartition("component_id").groupBy(*ids).agg(F.count("*").cast("int").alias("n"))
    if others is not None:
        rows = rows.join(others, "component_id")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.when(F.col("section") > 2, F.col("n")).otherwise(1))))
    source, target, component = of_element(F.col("source")), of_element(F.col("target")), of_component(F.col("component_id"))
    at = F.col("section")
    k = F.when(at == 0, "").when(at == 1, source).when(at == 2, target).otherwise(F.concat(source, F.lit("->"), target, F.lit(":"), "kind"))
    line = F.when(at == 0, F.concat(F.lit("# "), component)).when(at == 1, shape(source, source)).when(at == 2, shape(target, F.concat(target, F.lit(BREAK + "[cross-component]"))))
    line = line.otherwise(connection(diagram_id(source), diagram_id(target), F.col("label")))
    more = [] if others is None else [c for c in others.columns if c != "component_id"]
    return rows.select(F.col("component_id").alias("_place"), component.alias("component_id"), *more, "section", k.alias("k"), line.alias("line"))


def cells(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, value, style, parent, source, target of a diagram's cells. vertices: id, kind, parent_id. A vertex with
    a child is a boundary; every cell carries the managed mark."""
    parents = vertices.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("has_child", F.lit(True))
    rows = vertices.join(parents, "id", "left")
    none = F.lit(None).cast("string")
    style = F.concat(F.when(F.col("has_child"), "boundary").otherwise(F.col("kind")), F.lit(";managed=1"))
    v = rows.select("id", F.col("id").alias("value"), style.alias("style"), F.coalesce("parent_id", F.lit("1")).alias("parent"), none.alias("source"), none.alias("target"))
    e = edges.select(F.concat(F.lit("edge:"), "source", F.lit("->"), "target").alias("id"), F.col("label").alias("value"), F.lit("edge;managed=1").alias("style"), F.lit("1").alias("parent"), "source", "target")
    return v.unionByName(e)


def code_cells(projection) -> DataFrame:
    """component_id, id, value, style, parent, source, target: the level-4 cells of each component. Boundaries hold
    the elements of their component; what belongs to another one is drawn with a dotted stroke."""
    v, none = projection.vertices, F.lit(None).cast("string")
    style = F.concat(F.when(F.col("kind") == "boundary", "boundary").otherwise("element"), F.lit(";managed=1"), F.when(F.col("cross_component"), ";dashed=2").otherwise(""))
    vertices = v.select("component_id", "id", F.col("id").alias("value"), style.alias("style"), F.lit("1").alias("parent"), none.alias("source"), none.alias("target"))
    edges = projection.edges.select("component_id", F.concat("source", F.lit("->"), "target", F.lit(":"), "label").alias("id"), F.col("label").alias("value"), F.lit("edge;managed=1").alias("style"), F.lit("1").alias("parent"), "source", "target")
    return vertices.unionByName(edges)


KEY_LIMIT = 518


def member_line(signature: Column | str) -> Column:
    """A member as a quoted line: quotes and backslashes escaped, line breaks as spaces, and no longer than diagram
    text allows; a cut one ends in dots and never on half an escape."""
    c = F.col(signature) if isinstance(signature, str) else signature
    text = F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "\r?\n", " ")
    head = F.substring(text, 1, KEY_LIMIT - 3)
    odd = F.length(F.regexp_extract(head, r"(\\+)$", 1)) % 2 == 1
    cut = F.concat(F.when(odd, F.substring(text, 1, KEY_LIMIT - 4)).otherwise(head), F.lit("..."))
    return F.concat(F.lit('"'), F.when(F.length(text) <= KEY_LIMIT, text).otherwise(cut), F.lit('"'))


def c_bucket(kind: Column, visibility: Column) -> Column:
    """Where the C profile draws an element: Types, Public API or Internal; null for other kinds."""
    hidden = visibility.eqNullSafe(F.lit("private"))
    return F.when(kind.isin("struct", "typedef"), "Types").when(kind == "function", F.when(hidden, "Internal").otherwise("Public API"))


def c_diagrams(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """component_id, diagram of C components: elements by bucket, structs with their members (array of signatures),
    and edges (component_id, id, source, target, kind, label), but for inheritance, which C hasn't."""
    rows = elements.withColumn("bucket", c_bucket(F.col("kind"), F.col("visibility"))).where("bucket IS NOT NULL")
    place = F.array_position(F.array(F.lit("Types"), F.lit("Public API"), F.lit("Internal")), F.col("bucket")).cast("int")
    key = F.element_at(F.array(F.lit("types"), F.lit("public"), F.lit("internal")), place)
    row = lambda df, section, k, line: df.select("component_id", section.alias("section"), k.alias("k"), line.alias("line"))
    frames = rows.select("component_id", "bucket", place.alias("place"), key.alias("key")).distinct()
    members = F.when(F.col("kind") == "struct", F.transform(F.coalesce("members", F.array().cast("array<string>")), lambda m: F.concat(F.lit("    "), member_line(m))))
    body = F.concat(F.lit(" {\n    shape: class\n"), F.array_join(F.concat(F.coalesce(members, F.array().cast("array<string>")), F.array(F.lit("  }"))), "\n"))
    shown = F.concat(shape("id", F.col("name"), "  "), F.when(F.col("bucket") == "Types", body).otherwise(""))
    links = edges.where(~F.col("kind").isin("inherits", "implements"))
    return joined(
        _union(
            [
                row(elements.select("component_id").distinct(), F.lit(0), F.lit(""), F.concat(F.lit("# Component: "), "component_id")),
                row(frames, F.col("place") * 3, F.lit(""), F.concat("key", F.lit(": "), "bucket", F.lit(" {"))),
                row(rows.withColumn("place", place), F.col("place") * 3 + 1, F.col("id"), shown),
                row(frames, F.col("place") * 3 + 2, F.lit(""), F.lit("}")),
                row(links, F.lit(12), F.col("id"), connection(diagram_id("source"), diagram_id("target"), F.col("label"))),
            ]
        ),
        ["component_id"],
        "diagram",
    )


def escaped(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cells_xml(rows: DataFrame) -> DataFrame:
    """The cells as one XML text in id order, vertices first."""
    return joined(cell_lines(rows), [], "xml")


def cell_lines(rows: DataFrame) -> DataFrame:
    """section, k, line of the cells' XML. Where rows have them, tooltip wraps a cell in an object that carries id,
    label and tooltip, and x, y, width, height give its geometry."""
    is_edge = F.col("source").isNotNull()
    attribute = lambda n, c: F.concat(F.lit(f' {n}="'), escaped(c), F.lit('"'))
    ends = F.when(is_edge, F.concat(F.lit(' edge="1"'), attribute("source", "source"), attribute("target", "target"))).otherwise(F.lit(' vertex="1"'))
    value, tip = F.coalesce("value", F.lit("")), F.col("tooltip") if "tooltip" in rows.columns else F.lit(None).cast("string")
    named = F.when(tip.isNull(), F.concat(attribute("id", "id"), attribute("value", value))).otherwise("")
    cell = F.concat(F.lit("<mxCell"), named, attribute("style", "style"), attribute("parent", "parent"), ends)
    if "x" in rows.columns:
        sizes = [F.concat(F.lit(f' {c}="'), F.col(c).cast("string"), F.lit('"')) for c in ("x", "y", "width", "height") if c in rows.columns]
        box = F.concat(F.lit("><mxGeometry"), *(F.coalesce(x, F.lit("")) for x in sizes), F.lit(' as="geometry"/></mxCell>'))
        cell = F.concat(cell, F.when(~is_edge & F.col("x").isNotNull(), box).otherwise("/>"))
    else:
        cell = F.concat(cell, F.lit("/>"))
    line = F.when(tip.isNull(), cell).otherwise(F.concat(F.lit("<UserObject"), attribute("label", value), attribute("tooltip", F.coalesce(tip, F.lit(""))), attribute("id", "id"), F.lit(">"), cell, F.lit("</UserObject>")))
    lines = rows.select(F.when(is_edge, 2).otherwise(1).alias("section"), F.col("id").alias("k"), line.alias("line"))
    frame = rows.sparkSession.range(1)
    return _union([_row(frame, 0, F.lit(""), F.lit("<root>")), lines, _row(frame, 3, F.lit(""), F.lit("</root>"))])


def inject_once(document: Column | str, snippet: str, before: str = "</svg>") -> Column:
    """`snippet` before the closing tag, unless the document has it already or lacks the tag."""
    c = F.col(document) if isinstance(document, str) else document
    at = F.length(c) - F.length(F.substring_index(c, before, -1)) - len(before)
    added = F.concat(F.substr(c, F.lit(1), at), F.lit(snippet), F.substr(c, at + 1))
    return F.when(F.contains(c, F.lit(snippet)) | ~F.contains(c, F.lit(before)), c).otherwise(added)

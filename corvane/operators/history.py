"""Comparing a model with earlier output: reconciliation, staleness, drift, metrics. Nothing is deleted here;
removals are returned as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import joined_by


# --- reconciliation ------------------------------------------------------------------------------
def reconcile_vertices(existing: DataFrame, fresh: DataFrame, layout: DataFrame) -> DataFrame:
    """existing (id, value, style, parent, managed, x, y), fresh (id, value, style, parent), layout (id, x, y)
    -> id, value, style, parent, x, y, action.

    A fresh vertex keeps the style and place of an earlier managed one whose parent is still there, and always
    takes the new value. Others are placed by the layout, or at 0, 0. Unmanaged earlier vertices with a place
    stay as they are; managed ones that aren't fresh go. The earlier side, the fresh side and the layout meet
    in one full outer join by id."""
    e = existing.select("id", *(F.col(c).alias("e_" + c) for c in ("value", "style", "parent", "managed", "x", "y")), F.lit(True).alias("was"))
    f = fresh.select("id", *(F.col(c).alias("f_" + c) for c in ("value", "style", "parent")), F.lit(True).alias("is"))
    still = fresh.select(F.col("id").alias("e_parent"), F.lit(True).alias("parent_fresh"))
    rows = e.join(f, "id", "full_outer").join(still, "e_parent", "left").join(layout.select("id", F.col("x").alias("l_x"), F.col("y").alias("l_y")), "id", "left")
    placed = F.col("e_x").isNotNull()
    keeps = F.col("is") & F.coalesce(F.col("e_managed"), F.lit(False)) & placed & (F.col("e_parent").isNull() | (F.col("e_parent") == "1") | F.coalesce("parent_fresh", F.lit(False)))
    free = F.col("is").isNull() & ~F.coalesce("e_managed", F.lit(False)) & placed
    action = F.when(keeps, "kept").when(F.col("is"), F.when(F.col("l_x").isNull(), "default").otherwise("placed")).when(free, "foreign").otherwise("deleted")
    rows = rows.withColumn("action", action)
    old = F.col("action").isin("kept", "foreign")
    parent = F.when(F.col("action") == "kept", F.when(F.coalesce("parent_fresh", F.lit(False)), F.col("e_parent")).otherwise(F.coalesce("f_parent", F.lit("1")))).when(F.col("action") == "foreign", F.col("e_parent")).otherwise(F.coalesce("f_parent", F.lit("1")))
    return rows.where("action <> 'deleted'").select(
        "id",
        F.when(F.col("is"), F.col("f_value")).otherwise(F.col("e_value")).alias("value"),
        F.when(old, F.col("e_style")).otherwise(F.col("f_style")).alias("style"),
        parent.alias("parent"),
        F.when(old, F.col("e_x")).otherwise(F.coalesce("l_x", F.lit(0))).alias("x"),
        F.when(old, F.col("e_y")).otherwise(F.coalesce("l_y", F.lit(0))).alias("y"),
        "action",
    )


def reconcile_warnings(existing: DataFrame, fresh: DataFrame, reconciled: DataFrame) -> DataFrame:
    """id, warning: vertices that no layout places, and managed ones whose earlier parent is gone."""
    lost = reconciled.where("action = 'default'").select("id", F.lit("has no place and is put at 0, 0").alias("warning"))
    kept = existing.where("managed AND parent IS NOT NULL AND parent <> '1'").select("id", "parent").join(fresh.select("id"), "id", "left_semi")
    moved = kept.join(fresh.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.concat(F.lit("leaves its parent "), "parent", F.lit(", which is gone")).alias("warning"))
    return lost.unionByName(moved)


def reconcile_edges(existing: DataFrame, fresh: DataFrame, vertices: DataFrame) -> DataFrame:
    """existing (id, source, target, managed, waypoints), fresh (id, source, target), reconciled vertices ->
    id, source, target, waypoints, action. Waypoints stay with a managed edge whose ends kept their places;
    unmanaged edges stay without waypoints if both ends are there, else they are dropped with a warning."""
    ends = vertices.select("id", (F.col("action") == "kept").alias("kept"))
    e = existing.select("id", F.col("source").alias("e_source"), F.col("target").alias("e_target"), "managed", "waypoints")
    rows = fresh.withColumn("is", F.lit(True)).join(e, "id", "full_outer")
    rows = rows.withColumn("source", F.coalesce("source", "e_source")).withColumn("target", F.coalesce("target", "e_target"))
    for c in ("source", "target"):
        rows = rows.join(ends.select(F.col("id").alias(c), F.col("kept").alias(c + "_kept")), c, "left")
    both_kept = F.coalesce(F.col("source_kept") & F.col("target_kept"), F.lit(False))
    both_there = F.col("source_kept").isNotNull() & F.col("target_kept").isNotNull()
    managed = F.coalesce("managed", F.lit(False))
    action = F.when(F.col("is"), F.when(managed & both_kept, "kept").otherwise("routed")).when(managed, "deleted").when(both_there, "foreign").otherwise("warning")
    rows = rows.withColumn("action", action).where("action <> 'deleted'")
    return rows.select("id", "source", "target", F.when(F.col("action") == "kept", F.col("waypoints")).alias("waypoints"), "action")


# --- hashes and staleness ------------------------------------------------------------------------
def content_hash(files: DataFrame) -> DataFrame:
    """project, path, body -> project, hash: SHA-256 over the files in path order. Bodies are hashed first, so
    that a group holds a digest per file and no bodies."""
    rows = files.select("project", F.struct("path", F.sha2(F.coalesce("body", F.lit("")), 256).alias("h")).alias("f"))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["path"], F.lit(":"), f["h"], F.lit("\n"))))
    return rows.groupBy("project").agg(F.sha2(text, 256).alias("hash"))


def mixed(hashes: DataFrame, fingerprint: Column) -> DataFrame:
    """project, hash -> project, checksum: the hash of a fingerprint of the settings and the sources' hash, so that
    equal sources under other settings differ."""
    return hashes.select("project", F.concat(F.lit("sha256:"), F.sha2(F.concat(fingerprint, F.lit("\n"), F.col("hash")), 256)).alias("checksum"))


def stale_levels(now: DataFrame, before: DataFrame) -> DataFrame:
    """project, scan_stale, model_stale: whether the scan's and the model's checksum (scan, model) differ from those
    kept; both are for a project without any."""
    kept = before.select("project", F.col("scan").alias("old_scan"), F.col("model").alias("old_model"))
    rows = now.join(kept, "project", "left")
    return rows.select("project", (~F.col("scan").eqNullSafe(F.col("old_scan"))).alias("scan_stale"), (~F.col("model").eqNullSafe(F.col("old_model"))).alias("model_stale"))


def cache_key(hashes: DataFrame, by: str) -> DataFrame:
    """by, key: the number of hashes and the sorted hashes, so that no separator can be mistaken."""
    return hashes.groupBy(by).agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.array_join(F.array_sort(F.collect_list("hash")), ",")).alias("key"))


def stale(now: DataFrame, before: DataFrame) -> DataFrame:
    """project, state: new, changed, unchanged or removed."""
    both = now.select("project", F.col("hash").alias("now")).join(before.select("project", F.col("hash").alias("before")), "project", "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("before"), "unchanged").otherwise("changed")
    return both.select("project", state.alias("state"))


def write_plan(rendered: DataFrame, existing: DataFrame) -> DataFrame:
    """Outputs (path, body) that differ from what is there (path, hash)."""
    return rendered.withColumn("hash", F.sha2("body", 256)).join(existing, ["path", "hash"], "left_anti").drop("hash")


def up_to_date(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """project, fresh: whether the output is no older than the latest source (project, mtime)."""
    latest = sources.groupBy("project").agg(F.max("mtime").alias("latest"))
    return latest.join(outputs.select("project", F.col("mtime").alias("made")), "project", "left").select("project", F.coalesce(F.col("latest") <= F.col("made"), F.lit(False)).alias("fresh"))


# --- drift ---------------------------------------------------------------------------------------
def dangling(references: DataFrame, known: DataFrame) -> DataFrame:
    """file, ref -> those of which no dotted prefix is a known id. References are read once: most have a known first
    part and go at once; of the rest every prefix is looked up."""
    parts = F.split("ref", r"\.")
    known = known.select("id")
    rest = joined_by(references.select("file", "ref", F.get(parts, 0).alias("id")), known, ["id"], "left_anti")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    rows = rest.select("file", "ref", F.explode_outer(prefixes).alias("id"))
    rows = joined_by(rows, known.distinct().withColumn("known", F.lit(True)), ["id"], "left")
    return rows.groupBy("file", "ref").agg(F.max("known").alias("known")).where("known IS NULL").select("file", "ref")


def user_modified(files: DataFrame, marker: str) -> DataFrame:
    """file, modified: text after the marker's line, or no marker at all."""
    at = F.instr("content", marker)
    rest = F.substr("content", at + len(marker))
    return files.select("file", ((at == 0) | (F.trim(F.regexp_replace(rest, r"\s+", " ")) != "")).alias("modified"))


def inert(files: DataFrame, comment: str = "#") -> DataFrame:
    """file, inert: every line that isn't blank is a comment."""
    fine = lambda line: (F.trim(line) == "") | F.startswith(F.ltrim(line), F.lit(comment))
    return files.select("file", F.forall(F.split("content", "\n"), fine).alias("inert"))


def removal_plan(outputs: DataFrame, live: DataFrame, modified: DataFrame) -> DataFrame:
    """path, owner -> path, action: outputs of owners that are gone are removed, unless a user changed them."""
    gone = outputs.join(live.select(F.col("id").alias("owner")), "owner", "left_anti")
    rows = gone.join(modified.select(F.col("file").alias("path"), "modified"), "path", "left")
    return rows.select("path", F.when(F.coalesce("modified", F.lit(False)), "keep").otherwise("remove").alias("action"))


# --- metrics -------------------------------------------------------------------------------------
def set_metrics(found: DataFrame, expected: DataFrame, by: str, key: str) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 over sets of keys; empty sides count as 1."""
    f, e = found.select(by, key).distinct().withColumn("f", F.lit(1)), expected.select(by, key).distinct().withColumn("e", F.lit(1))
    both = f.join(e, [by, key], "full_outer").groupBy(by)
    n = both.agg(F.count(F.col("f") + F.col("e")).alias("tp"), F.count("f").alias("nf"), F.count("e").alias("ne"))
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b))
    n = n.withColumn("precision", share("tp", "nf")).withColumn("recall", share("tp", "ne"))
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total)
    return n.select(by, "tp", (F.col("nf") - F.col("tp")).alias("fp"), (F.col("ne") - F.col("tp")).alias("fn"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def line_churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, line -> key, added, removed, churn: lines, repeats included, that the other side hasn't at all, over
    the greater number of lines."""
    b, a = before.select("key", "line", F.lit("b").alias("side")), after.select("key", "line", F.lit("a").alias("side"))
    lines = b.unionByName(a).groupBy("key", "line").agg(F.count_if(F.col("side") == "b").alias("nb"), F.count_if(F.col("side") == "a").alias("na"))
    n = lines.groupBy("key").agg(
        F.sum(F.when(F.col("nb") == 0, F.col("na")).otherwise(0)).cast("long").alias("added"),
        F.sum(F.when(F.col("na") == 0, F.col("nb")).otherwise(0)).cast("long").alias("removed"),
        F.greatest(F.sum("nb"), F.sum("na")).alias("most"),
    )
    return n.select("key", "added", "removed", F.round((F.col("added") + F.col("removed")) / F.col("most"), 6).alias("churn"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """entity, n"""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = part if out is None else out.unionByName(part)
    return out

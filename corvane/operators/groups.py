"""Changes that are taken group by group, as a whole or not at all: a group that breaks a rule keeps its anchor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model, validate


@dataclass(frozen=True)
class Outcome:
    """relationships and elements with what was taken; verdicts: group, taken, problems (sorted, each once)."""

    relationships: DataFrame
    elements: DataFrame
    verdicts: DataFrame


def violations(updates: DataFrame, proposed: DataFrame, components: DataFrame, known: DataFrame) -> DataFrame:
    """group, problem: what the checks of `validate` find in each group's updates (group, source, target, ...) and proposed
    elements (group, id, component_id, container_id, kind, members, signature). known: id of all that can be an end."""
    at = lambda df, column, what: df.select(f"{column}.group", what.alias("problem"))
    pair = updates.select(F.struct("group", "source", "target").alias("pair"), F.concat_ws(" -> ", "source", "target").alias("shown"))
    twice = at(validate.duplicates(pair, "pair", "shown"), "key", F.concat(F.lit("updated twice: "), "first_id"))
    element = proposed.select(F.struct("group", "id").alias("element"), "id")
    again = at(validate.duplicates(element, "element", "id"), "key", F.concat(F.lit("proposed twice: "), "first_id"))
    # The checks know no groups, so an end is looked up once for all groups, and joined back to those that name it.
    missing = validate.missing_ends(updates.select("source", "target").distinct(), known).join(updates.select("group", "source", "target").distinct(), ["source", "target"])
    missing = missing.select("group", F.concat(F.lit("unknown "), "missing", F.lit(": "), F.when(F.col("missing") == "source", F.col("source")).otherwise(F.col("target"))).alias("problem"))
    keyed = proposed.withColumn("element", F.struct("group", "id"))
    owners = validate.owner_mismatches(keyed.drop("id").withColumnRenamed("element", "id"), components)
    owners = owners.select("id.group", F.concat("problem", F.lit(": "), "id.id").alias("problem"))
    shapes = validate.wrong_shapes(keyed.drop("id").withColumnRenamed("element", "id")).select("id.group", F.concat(F.lit("wrong shape: "), "id.id").alias("problem"))
    out = twice
    for part in (again, missing, owners, shapes):
        out = out.unionByName(part)
    return out.distinct()


def all_or_nothing(relationships: DataFrame, elements: DataFrame, updates: DataFrame, proposed: DataFrame, components: DataFrame, known: DataFrame) -> Outcome:
    """Apply each group's updates (group, source, target, new_label, new_technology[, ord]) and proposed elements, if the
    group has no violation. Elements (group, ...) that a taken group proposes replace those of the group; a group that
    proposes none keeps its own. Of groups that update one pair the last by ord counts."""
    bad = violations(updates, proposed, components, known)
    groups = updates.select("group").unionByName(proposed.select("group")).distinct()
    found = bad.groupBy("group").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    verdicts = groups.join(found, "group", "left").select("group", F.col("problems").isNull().alias("taken"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))
    taken = verdicts.where("taken").select("group")
    new = proposed.join(taken, "group", "left_semi")
    kept = elements.join(new.select("group").distinct(), "group", "left_anti")
    columns = elements.columns
    return Outcome(model.override(relationships, updates.join(taken, "group", "left_semi")), kept.select(*columns).unionByName(new.select(*columns)), verdicts)

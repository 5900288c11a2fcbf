"""Trees given as (node, parent): depths, cycles and lowest common ancestors by pointer doubling.

Depths need not be known: every round joins a table with itself on equal keys and doubles the distance that it spans,
so a tree of depth d takes log2(d) rounds. Each round is written, so that plans stay short. Nodes count by the input, so
they are merged with others, never sent to the driver; what has reached its root is not looked up again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .keys import joined_by


@dataclass(frozen=True)
class Hierarchy:
    """nodes: node, root, depth (both null where the way up ends in a cycle). jumps[k]: node, up, the ancestor 2^k
    steps above, of the nodes that have one."""

    nodes: DataFrame
    jumps: list[DataFrame]

    @property
    def cyclic(self) -> DataFrame:
        """Nodes on a cycle or below one."""
        return self.nodes.where("depth IS NULL").select("node")


def hierarchy(parents: DataFrame) -> Hierarchy:
    """From node, parent (null for a root). A parent without a row of its own is a root; of several parents of one
    node the smallest counts; a null node is left out; a node that is its own parent is a cycle."""
    own = parents.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    tops = own.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    tops = joined_by(tops, own.select("node").hint("merge"), ["node"], "left_anti")
    own = own.unionByName(tops.withColumn("parent", F.lit(None).cast(own.schema["parent"].dataType)))
    at = stored(own.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps")), "up")
    total, jumps, reach = at.count(), [], 1
    # Each node points 2^k steps up, or at its root if that is nearer.
    while True:
        far = at.where(F.col("steps") == reach).select("node", "up")
        if far.isEmpty():
            return Hierarchy(at.select("node", F.col("up").alias("root"), F.col("steps").alias("depth")), jumps)
        if reach > total:  # no way up without a cycle is that long
            bad = F.col("steps") == reach
            return Hierarchy(at.select("node", F.when(~bad, F.col("up")).alias("root"), F.when(~bad, F.col("steps")).alias("depth")), jumps)
        jumps.append(far)
        above = at.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        going = joined_by(at.where(F.col("steps") == reach), above.hint("merge"), ["up"])
        going = going.select("node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"))
        at = stored(at.where(F.col("steps") != reach).unionByName(going), "up")
        reach *= 2


FOUND, APART, UNKNOWN, CYCLE = "found", "apart", "unknown", "cycle"


def chains(tree: Hierarchy) -> DataFrame:
    """node, root, depth, head, above, top of the nodes that have a depth: each belongs to the chain that goes on with the
    child of most nodes below it. head: the chain's first node; above: that one's parent, null at a root; top: its
    depth. Leaving a chain at least doubles what lies below, so a way up crosses log2(nodes) chains at most."""
    good = tree.nodes.where("depth IS NOT NULL")
    if not tree.jumps:
        return good.select("node", "root", "depth", F.col("node").alias("head"), F.lit(None).cast(good.schema["node"].dataType).alias("above"), F.col("depth").alias("top"))
    sizes = good.select("node", F.lit(1).cast("long").alias("size"))
    for far in tree.jumps:  # so far the nodes less than 2^k steps below; those 2^k steps below bring theirs
        more = joined_by(far, sizes.hint("merge"), ["node"]).groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        sizes = stored(joined_by(sizes, more.hint("merge"), ["node"], "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    parents = joined_by(tree.jumps[0], sizes.hint("merge"), ["node"])
    heavy = parents.groupBy("up").agg(F.max(F.struct("size", "node")).alias("h")).select(F.col("h.node").alias("node"), F.col("up").alias("parent"))
    heads = joined_by(good, heavy.hint("merge"), ["node"], "left").select("node", "parent")
    line = hierarchy(heads).nodes.select("node", F.col("root").alias("head"), F.col("depth").alias("place"))
    line = joined_by(line, tree.jumps[0].select(F.col("node").alias("head"), F.col("up").alias("above")).hint("merge"), ["head"], "left")
    return stored(joined_by(good, line.hint("merge"), ["node"]).select("node", "root", "depth", "head", "above", (F.col("depth") - F.col("place")).alias("top")), "chains")


def lowest_common_ancestors(pairs: DataFrame, tree: Hierarchy) -> DataFrame:
    """pairs (a, b) -> a, b, owner, status, a row a pair: the deepest node that is an ancestor of both, a node being
    its own. No owner: in trees apart, with a node that the tree doesn't have, or one whose way up is a cycle. A round
    takes the end on the lower chain above it; pairs whose ends have come to one chain are done and leave."""
    at = chains(tree)
    fields = ["depth", "head", "above", "top"]
    rows = pairs.select("a", "b")
    bad = tree.cyclic.select("node", F.lit(True).alias("cyclic"))
    every = joined_by(tree.nodes.select("node"), at.hint("merge"), ["node"], "left")
    every = joined_by(every, bad.hint("merge"), ["node"], "left")
    for c in ("a", "b"):
        side = every.select(F.col("node").alias(c), F.struct(F.col("node").alias("at"), "root", "cyclic", *fields).alias("_" + c))
        rows = joined_by(rows, side.hint("merge"), [c], "left")
    status = F.when(F.col("_a").isNull() | F.col("_b").isNull(), UNKNOWN).when(F.col("_a.cyclic") | F.col("_b.cyclic"), CYCLE).when(F.col("_a.root") != F.col("_b.root"), APART).otherwise(FOUND)
    end = lambda c: F.struct(*(F.col(f"{c}.{f}") for f in ("at", *fields)))
    rows = rows.select("a", "b", status.alias("status"), end("_a").alias("x"), end("_b").alias("y"))
    walk, done = stored(rows, "walk"), None
    while True:
        going = F.coalesce((F.col("status") == FOUND) & (F.col("x.head") != F.col("y.head")), F.lit(False))
        upper = F.when(F.col("x.depth") <= F.col("y.depth"), F.col("x.at")).otherwise(F.col("y.at"))
        ended = walk.where(~going).select("a", "b", F.when(F.col("status") == FOUND, upper).alias("owner"), "status")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.where(going)
        if walk.isEmpty():
            return done
        lower = F.col("x.top") >= F.col("y.top")
        walk = walk.select("a", "b", "status", F.when(lower, F.col("x.above")).otherwise(F.col("y.above")).alias("_up"), F.when(lower, F.col("y")).otherwise(F.col("x")).alias("y"))
        here = at.select(F.col("node").alias("_up"), F.struct(F.col("node").alias("at"), *fields).alias("x"))
        walk = stored(joined_by(walk, here.hint("merge"), ["_up"]).select("a", "b", "status", "x", "y"), "walk")

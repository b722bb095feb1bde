"""Ways up trees that are tables of nodes and parents: to the root or the first node of a kind, and all ancestors.

Each round doubles how far up a node knows its way and is written, so a tree of depth d takes log2(d) rounds of one join
each, and plans do not grow. A parent that is no node counts as none, null keys are no nodes, keys should be unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.lineage import cut


def _nodes(nodes: DataFrame, key: str, parent: str, stops: Column) -> DataFrame:
    """(node, parent, stops); parents that are no nodes are null."""
    own = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("parent"), F.coalesce(stops, F.lit(False)).alias("stops"))
    known = own.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    return own.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "stops")


def first_up(nodes: DataFrame, key: str = "id", parent: str = "parent", stops: Column | None = None) -> DataFrame:
    """(key, found, steps): the first node on the way up, the node itself included, that stops; without ``stops`` the root.

    Nodes with none on their way have a null; so have those whose way runs in a circle, with null steps.
    """
    own = _nodes(nodes, key, parent, F.lit(False) if stops is None else stops)
    top = F.col("parent").isNull()
    hit = F.col("stops") | top if stops is None else F.col("stops")
    done = hit | top
    state = own.select("node", F.when(done, F.col("node")).otherwise(F.col("parent")).alias("at"), F.when(done, 0).otherwise(1).cast("long").alias("steps"), done.alias("done"), F.when(done, hit).alias("hit"))
    state = cut(state)
    count = state.count()
    reach = 1
    # On a way without circle no more nodes than there are can come; what is not done by then never is.
    while reach < 2 * count and not state.where("not done").isEmpty():
        up = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"), F.col("hit").alias("there"))
        far = state.where("not done").join(up, "at").select("node", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"), F.col("there").alias("hit"))
        state = cut(state.where("done").unionByName(far))
        reach *= 2
    return state.select(F.col("node").alias(key), F.when(F.col("done") & F.col("hit"), F.col("at")).alias("found"), F.when(F.col("done"), F.col("steps")).alias("steps"))


def ancestors(nodes: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(key, ancestor, depth): every pair of a node and a node above it once; ways that run in a circle raise an error.

    The result grows with the tree's depth; ``first_up`` gives the root alone.
    """
    circles = first_up(nodes, key, parent).where("steps is null")
    if not circles.isEmpty():
        raise ValueError("some nodes have no way to a root")
    jump = cut(_nodes(nodes, key, parent, F.lit(False)).where("parent is not null").select("node", F.col("parent").alias("to")))
    levels, depth = [jump.select("node", F.col("to").alias("ancestor"), F.lit(1).alias("depth"))], 1
    while not jump.isEmpty():
        # Those who know their way ``depth`` up pass on all ways of at most as many steps that begin there.
        known = reduce(DataFrame.unionByName, levels).select(F.col("node").alias("to"), "ancestor", F.col("depth").alias("more"))
        levels.append(cut(jump.join(known, "to").select("node", "ancestor", (F.col("more") + depth).alias("depth"))))
        jump = cut(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")))
        depth *= 2
    return reduce(DataFrame.unionByName, levels).select(F.col("node").alias(key), "ancestor", F.col("depth").cast("int").alias("depth"))

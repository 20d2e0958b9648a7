"""Problem 1: pairwise matches to groups by deterministic Borůvka hooking.

Each round, every component selects its smallest outgoing edge (edges ordered by their
smaller, then larger end, so all components agree on the order and the selected edges form
trees). Trees collapse to their root by pointer doubling; edges are relabelled with the
roots, loops dropped, repeats removed; rounds go on until no edge remains. A round at least
halves the number of components that still have edges.

Selection is a min per component (combined before the shuffle, so a hub with a third of all
edges sends one row per task). Relabelling joins against a table that is unique on its key,
whose hot rows adaptive execution may split. Rounds are cut by written tables.

Null or blank ids and pairs of an id with itself link nothing; repeats and either order of a
pair count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import Stage


def trimmed(c: str) -> Column:
    """An id without surrounding white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", ""), F.lit(""))


def _hooks(edges: DataFrame) -> DataFrame:
    """c, p: each component and the one that its smallest edge leads to; of two that select the same edge the smaller is its own parent."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("c"), "u", "v")
    chosen = ends.groupBy("c").agg(F.min(F.struct("u", "v")).alias("e")).select("c", "e.u", "e.v")
    by_edge = chosen.groupBy("u", "v").agg(F.max(F.col("c") == F.col("u")).alias("low"), F.max(F.col("c") == F.col("v")).alias("high"))
    row = lambda c, p: F.struct(F.col(c).alias("c"), F.col(p).alias("p"))
    both = F.array(row("u", "u"), row("v", "u"))
    return by_edge.select(F.inline(F.when(F.col("low") & F.col("high"), both).when(F.col("low"), F.array(row("u", "v"))).otherwise(F.array(row("v", "u")))))


def _collapse(stage: Stage, hooks: DataFrame) -> DataFrame:
    """c, p with p the root of c's tree: pointers are doubled, twice for each table written, until all of them end at roots."""
    pointers = stage.put(hooks, "hooks")
    while True:
        up = lambda n: pointers.select(F.col("c").alias(f"p{n}"), F.col("p").alias(f"p{n + 1}"))  # noqa: E731, B023
        # A step along two pointers, taken twice, is four along one.
        jumped = pointers.select("c", F.col("p").alias("p1")).join(up(1), "p1").join(up(2), "p2").join(up(3), "p3")
        after = stage.put(jumped.select("c", F.col("p4").alias("p"), (F.col("p3") != F.col("p4")).alias("moved")), "pointers")
        stage.drop(pointers)
        pointers = after
        if not pointers.where("moved").limit(1).count():
            return pointers.select("c", "p")


def connected_groups(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """rec_id, group_id: every id that stands in a pair with another id; group_id is the smallest id of its group."""
    stage = Stage(pairs.sparkSession)
    ends = pairs.select(trimmed(a).alias("a"), trimmed(b).alias("b")).where("a <> b")  # a null id makes this null
    edges = stage.put(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    levels: list[DataFrame] = []
    while edges.limit(1).count():
        roots = _collapse(stage, _hooks(edges))
        levels.append(roots)
        left = roots.select(F.col("c").alias("u"), F.col("p").alias("x"))
        right = roots.select(F.col("c").alias("v"), F.col("p").alias("y"))
        moved = edges.join(left, "u").join(right, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        after = stage.put(moved, "edges")
        stage.drop(edges)
        edges = after
    if not levels:
        return edges.select(F.col("u").alias("rec_id"), F.col("v").alias("group_id"))
    roots = levels.pop()
    while levels:  # from the last round back: where each earlier root went
        later = roots.select(F.col("c").alias("p"), F.col("p").alias("q"))
        roots = levels.pop().join(later, "p", "left").select("c", F.coalesce("q", "p").alias("p"))
    roots = stage.put(roots, "roots")
    least = roots.groupBy("p").agg(F.min("c").alias("group_id"))
    return roots.join(least, "p").select(F.col("c").alias("rec_id"), "group_id")

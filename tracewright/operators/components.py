"""Connected components and the groups they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node per node, by hooking and pointer jumping (FastSV, Zhang et al. 2020).

    ``nodes``: node. ``edges``: a, b. Edges with an unknown end are ignored. A round is equi-joins
    with one row per node on one side and map-side combined minima, so hubs cost no hot task. Every shuffle of a round costs the
    driver a job and, for a minute, a thread, so a round has as few as it can.
    The number of rounds grows with the logarithm of the component size; each round is written to
    the shared checkpoint folder and reads back one row at most, a changed node.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.filter("a <> b").select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct()
    known = nodes.select("node").distinct()
    both = both.join(known.withColumnRenamed("node", "a"), "a", "left_semi")
    both = cut_lineage(both.join(known.withColumnRenamed("node", "b"), "b", "left_semi"))
    # nodes without an edge are their own component and take no part in the rounds
    state = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("parent")))
    none = F.lit(None).cast(state.schema["node"].dataType)
    for _ in range(max_rounds):
        up = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = state.join(up, "parent").select("node", "parent", "grand")
        seen = jumped.select(F.col("node").alias("b"), "grand")
        told = both.join(seen, "b").select(F.col("a").alias("node"), none.alias("parent"), none.alias("grand"), F.col("grand").alias("best"))
        # every node has one row of its own and an edge, so one grouping brings both together without a join
        hooked = jumped.withColumn("best", none).unionByName(told).groupBy("node").agg(
            F.max("parent").alias("parent"), F.max("grand").alias("grand"), F.min("best").alias("best")
        )
        own = F.struct("node", F.least("grand", "best").alias("to"), F.col("parent").alias("old"))
        above = F.struct(F.col("parent").alias("node"), F.col("best").alias("to"), none.alias("old"))
        offers = hooked.select(F.explode(F.array(own, above)).alias("o")).select("o.*")
        step = cut_lineage(offers.groupBy("node").agg(F.min("to").alias("parent"), F.max("old").alias("old")))
        state = step.select("node", "parent")
        if step.filter("parent <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return known.join(state, "node", "left").select("node", F.coalesce("parent", "node").alias("component"))


def group_files(files: DataFrame, edges: DataFrame, include_weak: bool = False) -> DataFrame:
    """File to group: ``g:`` and the smallest scenario key of its component."""
    strengths = ["strong", "weak"] if include_weak else ["strong"]
    used = edges.filter(F.col("strength").isin(strengths))
    labels = connected_components(files.select(F.col("rel_path").alias("node")), used)
    members = files.select("rel_path", "scenario_key").join(
        labels.withColumnRenamed("node", "rel_path"), "rel_path"
    )
    named = members.groupBy("component").agg(F.concat(F.lit("g:"), F.min("scenario_key")).alias("group_id"))
    return members.join(named, "component").select("rel_path", "group_id")


def group_table(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per group: closed sets as sorted arrays, open sets as counts.

    Open sets (hosts, scenario keys, files) can hold a third of the corpus; ``group_members`` lists
    them in long form.
    """
    rows = files.join(mapping, "rel_path")
    return rows.groupBy("group_id").agg(
        F.min_by("dataset", "ordinal").alias("dataset"),
        F.when(F.min("label") != F.max("label"), "mixed").otherwise(F.min("label")).alias("label"),
        F.sort_array(F.collect_set("os")).alias("os"),
        F.sort_array(F.collect_set("task")).alias("tasks"),
        F.sort_array(F.collect_set("representation")).alias("representations"),
        F.count(F.lit(1)).alias("n_files"),
    )


def group_members(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Long form of the open sets of a group: (group_id, kind, value), kind in host, scenario_key, file."""
    rows = files.join(mapping, "rel_path")
    kinds = {"host": "host", "scenario_key": "scenario_key", "file": "rel_path"}
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])
    return rows.select("group_id", F.explode(entries).alias("e")).select("group_id", "e.kind", "e.value").filter(
        "value is not null"
    ).distinct()

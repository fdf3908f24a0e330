"""Connected components on Spark: least-label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type, either way round -> (id, label) of every node, label the least id of its component.

    Each round takes the least label among neighbours, then the label's label, so long paths shorten by more than half; each
    round is written to the shared folder, and the one before it deleted. Rounds go on until no label changes: every round but
    the last lowers one label at least, so they end."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    lab = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "cc-label")
    while True:
        near = both.join(lab.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = lab.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = step.join(lab.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left")
        new = stage(hop.select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "cc-label")
        done = new.where("label <> old").isEmpty()
        discard(lab)
        lab = new
        if done:
            discard(both)
            return lab.select("id", "label")


def chains(links: DataFrame) -> DataFrame:
    """links (a, b), b following a, each value with one follower and one forerunner at most -> (id, label) of every value, label
    the head of its chain, or the least value of its ring.

    Pointer doubling: in each round whoever is not settled takes over its forerunner's forerunner, so a chain of n takes
    log2(n) rounds, and only what is not settled moves. A round that settles nothing leaves rings alone; these are components."""
    up = links.select(F.col("b").alias("id"), F.col("a").alias("up"))
    heads = stage(links.select(F.col("a").alias("id")).join(up.select("id"), "id", "left_anti").select("id", F.col("id").alias("label")), "chain-heads")
    settled, left = heads, stage(up, "chain-left")
    while not left.isEmpty():
        known = settled.select(F.col("id").alias("up"), "label", F.lit(None).cast(left.schema["up"].dataType).alias("far"))
        open_ = left.select(F.col("id").alias("up"), F.lit(None).cast(left.schema["id"].dataType).alias("label"), F.col("up").alias("far"))
        new = stage(left.join(known.unionByName(open_), "up").select("id", "label", F.col("far").alias("up")), "chain-round")
        found = new.where("label is not null").select("id", "label")
        if found.isEmpty():
            return settled.unionByName(components(left.select(F.col("up").alias("a"), F.col("id").alias("b"))))
        settled, left = settled.unionByName(found), new.where("label is null").select("id", "up")
    return settled

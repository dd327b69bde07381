"""Connected components of a distributed list of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """id and comp (the least id reachable) of each id in links (a, b): those with a link only. scratch keeps the result.

    Each round takes the least label among neighbours, then follows labels to their own labels, twice. Labels are
    written to shared storage each round, which keeps the plans short and survives lost executors, and removed when
    the next ones are there. The rounds end when no label changes; a path of n ids takes about log n of them.
    """
    with Scratch(scratch.spark) as own:
        both = own.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
        labels = own.stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("comp")), "labels")
        for _ in range(most_rounds):
            near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
            new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
            for _ in range(2):
                to = labels.select(F.col("id").alias("to"), F.col("comp").alias("further"))
                new = new.join(to, new["comp"] == to["to"], "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
            new = own.stored(new, "labels")
            labels, changed = new.select("id", "comp"), not new.where("old != comp").isEmpty()
            if not changed:
                return scratch.stored(labels, "labels", keep=True)
    raise RuntimeError(f"labels still change after {most_rounds} rounds")

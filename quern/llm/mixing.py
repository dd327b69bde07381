"""Mixing of overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow network routes the
patterns' words to the sources' quotas: source of the flow -> pattern, once per repetition at a growing cost,
so that no word is repeated while fresh ones would do; pattern -> each of its sources; source -> sink with the
quota as capacity. Successive shortest paths give a flow of least cost among those that fill the quotas most.
The network has a node per pattern and source, which are metadata of the corpus; documents stay distributed.

The selection takes, for each pattern and repetition, documents in the order of a seeded hash as long as they fit in the
routed words, whole documents only. The place where that ends is found in two rounds of sums over hash buckets and an
exact running sum within the last bucket, so that a source with a third of all documents is never ordered in one
task. What is then left to a goal goes the same way to documents no larger than it, then to the largest that fits, twice,
and at last to the one that comes closest.

Null texts have size 0 and are never taken; documents of size 0 are taken 0 times. Sources without words count in the
cycle of weights. Null sources form a source of their own, last in the order. Repeated rows are documents of their own. An
empty table gives no rows. Other columns of mixed_documents pass through whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.shared import WORD, Scratch, table

SEED = 20_240_901
#: Most goals whose rows are sent to all tasks: a pattern and two numbers each.
MOST_SENT = 50_000


def capped_targets(sizes: Sequence[float], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Shares of share * sum(sizes) by weight, none above most * size; what is over is shared among the rest."""
    target = [0.0] * len(sizes)
    left, free = share * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0): of most value, and of least cost among those."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
    height = [0] * n
    while True:
        dist: list[float] = [float("inf")] * n
        dist[source], heap, via = 0, [(0, source)], [-1] * n
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                y = to[e]
                if cap[e] > 0 and (z := d + cost[e] + height[x] - height[y]) < dist[y]:
                    dist[y], via[y] = z, e
                    heapq.heappush(heap, (z, y))
        if dist[sink] == float("inf"):
            return [cap[2 * i + 1] for i in range(len(edges))]
        height = [h + int(d) if d < float("inf") else h for h, d in zip(height, dist)]
        most, y = float("inf"), sink
        while y != source:
            most, y = min(most, cap[via[y]]), to[via[y] ^ 1]
        y = sink
        while y != source:
            cap[via[y]] -= most
            cap[via[y] ^ 1] += most
            y = to[via[y] ^ 1]


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: Sequence[float], repeats: int) -> list[list[int]]:
    """For each pattern (its sources, its words): the words taken in the first, second, ... repetition."""
    k, m = len(patterns), len(quotas)
    edges = []
    for i, (_, size) in enumerate(patterns):
        edges += [(0, 2 + i, size, r * r) for r in range(repeats)]
    for i, (members, size) in enumerate(patterns):
        edges += [(2 + i, 2 + k + s, repeats * size, 0) for s in members]
    edges += [(2 + k + s, 1, int(quotas[s]), 0) for s in range(m)]
    flow = min_cost_flow(2 + k + m, edges, 0, 1)
    return [sorted(flow[i * repeats : (i + 1) * repeats], reverse=True) for i in range(k)]


def _by_goal(goals: DataFrame, n: int) -> DataFrame:
    """goals has a row for each of n goals: with few of them it goes to the documents, which must not be dealt by their goal."""
    return F.broadcast(goals) if n <= MOST_SENT else goals


def _prefix(asked: DataFrame, n: int, bits: int = 9) -> DataFrame:
    """The documents of each goal in the order of their hash, up to the first that no longer fits in its words (row, goal, size)."""
    level, taken = asked.withColumn("base", F.lit(0).cast("long")), None
    # Only documents in the bucket where the goal falls go on; the ones before it are taken as they are.
    for step in range(2):
        bucket = F.shiftrightunsigned("hash", 64 - bits * (step + 1)).bitwiseAND(F.lit((1 << bits) - 1))
        level = level.withColumn("bucket", bucket)
        sums = level.groupBy("goal", "bucket").agg(F.sum("size").alias("n"), F.first("words").alias("words"), F.first("base").alias("base"))
        before = F.sum("n").over(W.partitionBy("goal").orderBy("bucket")) - F.col("n")
        edge = sums.withColumn("new_base", F.col("base") + before).where((F.col("new_base") <= F.col("words")) & (F.col("words") < F.col("new_base") + F.col("n"))).select("goal", F.col("bucket").alias("edge"), "new_base")
        joined = level.join(_by_goal(edge, n), "goal", "left")
        done = joined.where(F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))).select("row", "goal", "size")
        taken = done if taken is None else taken.unionByName(done)
        level = joined.where(F.col("bucket") == F.col("edge")).drop("base", "bucket", "edge").withColumnRenamed("new_base", "base")
    running = F.sum("size").over(W.partitionBy("goal").orderBy("hash", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0))
    last = level.withColumn("end", F.col("base") + running).where(F.col("end") <= F.col("words"))
    return taken.unionByName(last.select("row", "goal", "size"))


def _reached(docs: DataFrame, goals: DataFrame, n: int, scratch: Scratch, rounds: int = 3) -> DataFrame:
    """n goals (goal, pattern, words): a row for each goal and document of its pattern that the mix takes (row, goal)."""
    asked = docs.join(_by_goal(goals, n), "pattern")
    taken = scratch.stored(_prefix(asked, n), "taken", keep=True)

    def rest() -> DataFrame:
        """The documents not taken yet, with what is left of their goal as gap."""
        held = taken.groupBy("goal").agg(F.sum("size").alias("held"))
        left = goals.join(held, "goal", "left").select("goal", (F.col("words") - F.coalesce("held", F.lit(0))).alias("gap"))
        return asked.join(taken.select("row", "goal"), ["row", "goal"], "left_anti").join(_by_goal(left, n), "goal")

    small = rest().where(F.col("size") <= F.col("gap")).drop("words").withColumnRenamed("gap", "words")
    taken = scratch.stored(taken.unionByName(_prefix(small, n)), "taken", keep=True)
    for step in range(rounds):  # one row a goal each: the largest that fits, and at last the closest
        over = F.abs(F.col("gap") - F.col("size"))
        fits = F.lit(True) if step == rounds - 1 else F.col("size") <= F.col("gap")
        best = rest().where((over < F.abs("gap")) & fits).groupBy("goal").agg(F.min(F.struct(over.alias("over"), "hash", "doc_id", "row", "size")).alias("best"))
        taken = scratch.stored(taken.unionByName(best.select("best.row", "goal", "best.size")), "taken", keep=True)
    return taken.select("row", "goal")


def text_size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, members: Column, quotas: Callable[[dict], dict], repeats: int = 2, seed: int = SEED, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """docs with _mix_size, _mix_pattern (its memberships) and _mix_copies: how often the mix takes each document.

    members: the sources of a document (an array of text, or one text). quotas: gets the words of each source
    that has documents, by its name, and returns its quota. size and tie stand for the words of the text and
    a hash of it, where docs has them instead of the text. No column of docs may start with _mix_.
    """
    size = text_size() if size is None else size
    tie = F.xxhash64("text") if tie is None else tie
    spark = docs.sparkSession
    is_array = docs.select(members.alias("m")).schema["m"].dataType.typeName() == "array"
    with Scratch(spark) as scratch:
        kept = docs.withColumn("_mix_pattern", F.array_sort(F.array_distinct(members)) if is_array else F.array(members))
        kept = kept.withColumn("_mix_size", size).withColumn("_mix_hash", F.xxhash64(F.lit(seed), "doc_id", tie))
        kept = scratch.stored(kept.withColumn("_mix_row", F.monotonically_increasing_id()), "mix", keep=True)
        facts = kept.select(F.col("_mix_row").alias("row"), F.col("doc_id"), F.col("_mix_pattern").alias("pattern"), F.col("_mix_size").alias("size"), F.col("_mix_hash").alias("hash"))
        found = [(tuple(r["pattern"] or ()), r["n"]) for r in facts.groupBy("pattern").agg(F.sum("size").alias("n")).collect()]  # one row per pattern
        found.sort(key=lambda x: [(m is None, m or "") for m in x[0]])
        sources = sorted({m for p, _ in found for m in p}, key=lambda m: (m is None, m or ""))
        quota = quotas({m: sum(n for p, n in found if m in p) for m in sources})
        place = {m: i for i, m in enumerate(sources)}
        found = [(p, n) for p, n in found if n]
        words = route([(tuple(place[m] for m in p), n) for p, n in found], [quota[m] for m in sources], repeats)
        rows = [(i * repeats + r, list(p), w) for i, ((p, n), ws) in enumerate(zip(found, words)) for r, w in enumerate(ws) if 0 < w < n]
        whole = [(list(p), sum(w >= n for w in ws)) for (p, n), ws in zip(found, words)]
        goals = spark.createDataFrame(rows, "goal long, pattern array<string>, words long")
        full = spark.createDataFrame(whole, "pattern array<string>, full long")
        facts = facts.where(F.col("size") > 0)
        extra = _reached(facts, goals, len(rows), scratch).groupBy("row").agg(F.count("*").alias("extra"))
    copies = facts.join(full, "pattern", "left").join(extra, "row", "left").select(F.col("row").alias("_mix_r"), (F.coalesce("full", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("_mix_copies"))
    out = kept.join(copies.where("_mix_copies > 0"), kept["_mix_row"] == copies["_mix_r"], "left").drop("_mix_r", "_mix_row", "_mix_hash")
    return out.withColumn("_mix_copies", F.coalesce("_mix_copies", F.lit(0).cast("long")))


def cycling_targets(weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> Callable[[dict], dict]:
    """Quotas by weights that repeat over the sources in code point order, null last."""

    def quotas(held: dict) -> dict:
        names = sorted(held, key=lambda m: (m is None, (m or "").encode("utf-8")))
        target = capped_targets([held[m] for m in names], [weights[i % len(weights)] for i in range(len(names))], share, most)
        return dict(zip(names, target))

    return quotas


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken."""
    # All columns go along in one, so that no name can clash.
    rows = docs.select("doc_id", "source", text_size().alias("words"), F.xxhash64("text").alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mixed = mix(rows, F.col("source"), cycling_targets(), size=F.col("words"), tie=F.col("tie"))
    return mixed.where("_mix_copies > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))), "row").select("row.*")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text_size().alias("words"), F.xxhash64("text").alias("tie"))
    seen: dict = {}
    quotas = cycling_targets()

    def noted(held: dict) -> dict:
        out = quotas(held)
        seen.update({m: (held[m], out[m]) for m in held})
        return out

    mixed = mix(docs, F.col("source"), noted, size=F.col("words"), tie=F.col("tie"))
    target = spark.createDataFrame([(m, n, float(t)) for m, (n, t) in seen.items()], "name string, source_size long, target double")
    out = mixed.join(target, mixed["source"].eqNullSafe(target["name"]), "left")
    return out.select("doc_id", F.col("_mix_size").alias("size"), "source_size", "target", (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"), "source")

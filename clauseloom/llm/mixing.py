"""P8: records of several sources combined to target shares, by Pfair scheduling.

A source's documents, repeated as often as it may and needs, are a row of blocks of equal size. With
weight w, block i is released at slot floor(i / w) and due at slot ceil((i + 1) / w); the released
block that is due first gets the slot. On one sequence this meets all deadlines, so at every slot
each source has less than a block more or less than its share.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.session import cut_lineage

#: Least tokens in a block, and blocks at most: a source is off its share by less than a block at any slot, which is that
#: many tokens or a millionth of the mix, whichever is more.
BLOCK_TOKENS, MAX_BLOCKS = 8192, 1_000_000
#: Documents of a source that are put in order in one task, about.
SHARD = 50_000


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) for every slot, given each source's number of blocks."""
    total = sum(blocks.values())
    waiting = [(0, math.ceil(total / n), s, 0) for s, n in sorted(blocks.items()) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i))
        n = blocks[s]
        if i + 1 < n:
            heapq.heappush(waiting, ((i + 1) * total // n, -(-(i + 2) * total // n), s, i + 1))
    return out


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((slot, place, source, doc_id, use, tokens), shares) of docs (doc_id, source, tokens) and targets (source,
    target_share, max_repeats).

    The mix has the size total, by default that of all documents of the listed sources once. A source
    gets its share of it, or all of its documents max_repeats times if that is less; shares has, for
    every listed source, what it should and what it does contribute. Documents are taken in an order
    by hash, every one once before any is taken again. Sources not listed get nothing; null shares
    and null repeats count as 0; documents without tokens are not used.
    """
    spark = docs.sparkSession
    goals = targets.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats"))
    goals = {r["source"]: (r["share"], r["repeats"]) for r in goals.where("source is not null").collect()}  # one row a source of the mix
    mine = docs.where(F.col("source").isin(list(goals)) & (F.col("tokens") > 0)).select("doc_id", "source", "tokens", F.xxhash64("doc_id").alias("h"))
    mine = cut_lineage(mine)
    shards = max(1, math.ceil(mine.count() / SHARD))
    # parts of the order by hash, so that the order is the same however many there are
    mine = mine.withColumn("shard", F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * shards), F.lit(shards - 1)).cast("long"))
    sums = cut_lineage(mine.groupBy("source", "shard").agg(F.sum("tokens").alias("n")))
    has = {s: 0 for s in goals} | {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row a source
    total = total or sum(has.values())
    budget = {s: min(round(share * total), has[s] * repeats) for s, (share, repeats) in goals.items()}
    block = max(BLOCK_TOKENS, math.ceil(sum(budget.values()) / MAX_BLOCKS))
    blocks = {s: math.ceil(b / block) for s, b in budget.items() if b}
    known = spark.createDataFrame([(s, has[s], budget[s]) for s in sorted(goals)], "source string, has long, budget long")
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("offset", offset).drop("n").join(F.broadcast(known), "source")  # one row a source of the mix
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = mine.withColumn("before", before).join(offsets, ["source", "shard"])
    # of every pass over a source, the uses that begin within its budget and lie in it by half at least
    uses = placed.where("budget > 0").withColumn("use", F.explode(F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("has")).cast("int") - 1)))
    uses = uses.withColumn("at", F.col("use") * F.col("has") + F.col("offset") + F.col("before")).where(F.col("at") + F.col("tokens") / 2 <= F.col("budget"))
    uses = uses.withColumn("block", F.floor(F.col("at") / block).cast("long"))
    order = pfair(blocks)
    slots = spark.createDataFrame(pa.table({"source": pa.array([s for s, _ in order], pa.string()), "block": pa.array([i for _, i in order], pa.int64()), "slot": pa.array(range(len(order)), pa.int64())}))  # MAX_BLOCKS rows at most
    out = uses.join(slots, ["source", "block"]).select("slot", (F.col("at") - F.col("block") * block).alias("place"), "source", "doc_id", F.col("use") + 1, "tokens").toDF("slot", "place", "source", "doc_id", "use", "tokens")
    got = out.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("use").alias("uses"))
    listed = spark.createDataFrame([(s, float(share), int(r), budget[s] < round(share * total)) for s, (share, r) in sorted(goals.items())], "source string, target_share double, max_repeats int, short boolean")
    shares = listed.join(got, "source", "left").na.fill(0, ["tokens", "documents", "uses"])
    everything = shares.agg(F.sum("tokens").alias("all"))
    shares = shares.crossJoin(F.broadcast(everything)).withColumn("actual_share", F.try_divide("tokens", "all")).drop("all")  # one row
    return out, shares

"""P7: items of varying length in containers of fixed capacity, by best-two-fit.

Containers are filled greedily, always with the largest item that fits. When none fits any more, a
container's smallest item is replaced by two unpacked ones that fit the gap it leaves more tightly.
Items are dealt to shards by a hash, so every shard has the same mix of sizes; what lies in the
containers a shard could not fill is packed again with that of many other shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.session import cut_lineage

#: Items in a shard, about; shards whose poorly filled containers are packed again together.
SHARD, TOGETHER = 40_000, 64
#: Kinds of containers at most.
MOST_PACKS = 1000
#: A container filled to less than this share is packed again.
FULL = 0.99


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of places in sizes, all of them from 1 to capacity."""
    of_size: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        of_size.setdefault(int(sizes[i]), []).append(i)
    there = 0  # bit s: an item of size s is unpacked
    for s in of_size:
        there |= 1 << s

    def largest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(s: int) -> int:
        nonlocal there
        items = of_size[s]
        i = items.pop()
        if not items:
            there &= ~(1 << s)
        return i

    def give(s: int, i: int) -> None:
        nonlocal there
        of_size[s].append(i)
        there |= 1 << s

    bins = []
    while there:
        s = there.bit_length() - 1
        held, gap = [(s, take(s))], capacity - s
        while (s := largest(gap)) > 0:
            held.append((s, take(s)))
            gap -= s
        if gap and there and len(held) > 1:
            small, item = min(held)
            room, best = gap + small, (small, 0, 0)
            a = largest(room - 1)
            while a > 0 and 2 * a >= best[0]:
                b = largest(min(a, room - a))
                if b == a and len(of_size[a]) < 2:
                    b = largest(min(a - 1, room - a))
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = largest(a - 1)
            if best[1]:
                held.remove((small, item))
                held += [(best[1], take(best[1])), (best[2], take(best[2]))]
                give(small, item)
        bins.append([i for _, i in held])
    return bins


def pieces(items: DataFrame, capacity: str) -> DataFrame:
    """items with (piece, first, size): one row for an item that fits, else a row for each full capacity and the rest."""
    n = F.ceil(F.col("tokens") / F.col(capacity)).cast("int")
    parts = items.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    first = F.col("piece").cast("long") * F.col(capacity)
    return parts.withColumn("first", first).withColumn("size", F.least(F.col("tokens") - first, F.col(capacity).cast("long")))


def packed(items: DataFrame, packs: DataFrame, id: str, pack: str, capacity: str) -> DataFrame:
    """(pack, capacity, container, id, piece, first, size): every item of items (id, tokens), or its pieces if it exceeds
    the capacity, in a container of each pack. Items without tokens are in none; containers are numbered from 0 within
    a shard and named by shard and number. Packs of null or no capacity get nothing; of more than MOST_PACKS an error is
    raised, as every item is packed for each."""
    kinds = packs.where(F.col(capacity) > 0).select(F.col(pack).cast("int").alias("pack"), F.col(capacity).cast("int").alias("capacity")).limit(MOST_PACKS + 1).collect()
    if len(kinds) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} kinds of containers")
    every = F.array(*[F.struct(F.lit(r["pack"]).alias("pack"), F.lit(r["capacity"]).alias("capacity")) for r in kinds]).cast("array<struct<pack:int,capacity:int>>")
    shards = max(1, math.ceil(items.count() / SHARD))
    rows = pieces(items.select(F.col(id).alias("id"), "tokens", F.explode(every).alias("k")).select("id", "tokens", "k.*"), "capacity")
    whole = rows.where("size = capacity").select("pack", "capacity", F.concat(F.lit("w"), F.col("id"), F.lit("."), F.col("piece")).alias("container"), "id", "piece", "first", "size")
    rest = rows.where("size < capacity").select("pack", "capacity", "id", "piece", "first", "size")

    def fill(prefix: str):  # noqa: ANN202
        def pack_one(key: tuple, t: pa.Table) -> pa.Table:
            order = np.lexsort((t["piece"].to_numpy(), t["id"].to_numpy()))
            t = t.take(pa.array(order))
            capacity, size = t["capacity"][0].as_py(), t["size"].to_numpy()
            name, filled = [""] * len(size), np.zeros(len(size))
            for k, held in enumerate(best_two_fit(size, capacity)):
                used = sum(int(size[i]) for i in held) / capacity
                for i in held:
                    name[i], filled[i] = f"{prefix}{key[1].as_py()}.{k}", used
            return t.select(["pack", "capacity", "id", "piece", "first", "size", "shard"]).append_column("container", pa.array(name, pa.string())).append_column("filled", pa.array(filled))

        return pack_one

    schema = "pack int, capacity int, id long, piece int, first long, size long, shard long, container string, filled double"
    once = rest.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    once = cut_lineage(once.groupBy("pack", "shard").applyInArrow(fill("a"), schema))
    again = once.where(F.col("filled") < FULL).drop("container", "filled").withColumn("shard", F.floor(F.col("shard") / TOGETHER).cast("long"))
    out = once.where(F.col("filled") >= FULL).unionByName(again.groupBy("pack", "shard").applyInArrow(fill("b"), schema))
    out = out.select("pack", "capacity", "container", "id", "piece", "first", "size").unionByName(whole)
    return out.select(F.col("pack").alias(pack), F.col("capacity").alias(capacity), "container", F.col("id").alias(id), "piece", "first", F.col("size").alias("tokens"))

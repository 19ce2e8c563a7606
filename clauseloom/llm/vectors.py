"""P3: the most similar vectors of every vector, by a hash-prefix forest.

Each tree gives a vector a long hash string, one bit per hyperplane, and holds all of them as a
sorted array. A query goes down to the longest prefix it shares with others, then up again, a bit at
a time and in all trees at once, until the strings below its prefixes are enough candidates; all of
them are scored and the best are kept. How many strings are below a prefix is known from a table of
fixed size, so a query's level is found before anything moves. A tree's array lies in blocks of
neighbouring strings, one a task at a time; a query visits those its prefix covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import shared
from clauseloom.session import cut_lineage

#: Trees, and bits of a hash string.
TREES, BITS = 8, 48
#: Bits of a prefix that the table of counts knows: enough to tell blocks apart, within these bounds.
LEAST_BITS, MOST_BITS = 10, 18
#: Strings in a block; says how the arrays lie, not what is found.
BLOCK = 8192
#: Vectors a longest prefix has, about.
FINE = 64
#: Candidates at which a query stops going up, for up to COMFORT vectors; beyond, they grow with the power GROWTH of their
#: number, as more vectors are nearer to each other.
WANT, COMFORT, GROWTH = 16_000, 100_000, 0.2
#: Vectors from which the centre and the medians of the hyperplanes are fitted, about: a bounded sample; every vector is indexed.
SAMPLE = 20_000
SEED = 7


def usable(df: DataFrame, id: str, vector: str, size: int) -> DataFrame:
    """(id, v): vectors of exactly size finite numbers, not all zero; null vectors and null elements are not usable."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = v.isNotNull() & (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(id).alias("id"), v.alias("v"))


def directions(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((key, id, u, ids), (key, id)): one row for each distinct direction with its least id, the vector of length one as
    16-bit numbers, and the least k + 1 ids that have it; and the direction of every vector. Copies meet by a hash of
    the direction in two levels, so that one with very many copies is cut down before it meets in one place."""
    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            x = x / np.abs(x).max(1, keepdims=True)  # no overflow
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in np.round(x, 9) + 0.0]
            u = pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.int64()), u], ["id", "key", "u"])

    made = vectors.mapInArrow(unit, "id long, key long, u binary")
    least = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    some = made.groupBy("key", F.pmod(F.col("id"), F.lit(64)).alias("salt")).agg(F.min_by("u", "id").alias("u"), least.alias("ids"))
    dirs = some.groupBy("key").agg(F.min_by("u", F.col("ids")[0]).alias("u"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    return dirs.select("key", F.col("ids")[0].alias("id"), "u", "ids"), made.select("key", "id")


class Forest:
    """Hyperplanes of every tree through the centre of a sample, each at the median of the sample."""

    def __init__(self, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        size = sample.shape[1]
        self.centre = sample.mean(0)
        self.planes = rng.standard_normal((TREES, size, BITS)).astype(np.float32)
        self.planes /= np.linalg.norm(self.planes, axis=1, keepdims=True)
        self.medians = np.stack([np.median((sample - self.centre) @ p, axis=0) for p in self.planes])

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Hash strings of the rows of x in a tree, as numbers whose first bits are the prefix."""
        bits = (x - self.centre) @ self.planes[tree] > self.medians[tree]
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(len(column), -1).astype(np.float32)


def cuts(counts: np.ndarray, most: int) -> np.ndarray:
    """The block of every cell, a prefix of full length, of one tree: what shares a shorter prefix lies in one block if it
    fits, so that most queries find theirs in one, and neighbours are put together while they fit."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    out, total, block = np.empty(len(counts), np.int64), 0, 0
    nodes = [(0, len(counts))]
    while nodes:
        a, b = nodes.pop()
        n = int(sums[b] - sums[a])
        if n > most and b - a > 1:
            nodes += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        if total and total + n > most:
            block, total = block + 1, 0
        total += n
        out[a:b] = block
    return out


class Levels:
    """How many strings of every tree are below every prefix, and in which block each cell lies."""

    def __init__(self, table: np.ndarray, want: float):
        self.bits = int(table.shape[1]).bit_length() - 1
        self.want = want
        self.counts = [table]  # from the longest prefixes to none
        while self.counts[-1].shape[1] > 1:
            self.counts.append(self.counts[-1].reshape(len(table), -1, 2).sum(2))
        self.blocks = np.stack([cuts(c, BLOCK) for c in table])
        self.offsets = np.concatenate([[0], np.cumsum(self.blocks.max(1) + 1)])
        # a cell too full for a block is cut by its further bits
        self.deeper = np.ceil(np.log2(np.maximum(1, table / BLOCK))).astype(np.int64)
        self.parts = [np.ones(b.max() + 1, np.int64) for b in self.blocks]
        for own, b, d in zip(self.parts, self.blocks, self.deeper):
            np.maximum.at(own, b, 1 << d)

    def ascent(self, cells: np.ndarray) -> np.ndarray:
        """By how many bits each query (a row of its cells in all trees) goes up from the longest prefix."""
        up = np.full(len(cells), self.bits, np.int64)
        trees = np.arange(cells.shape[1])
        for k in range(self.bits, -1, -1):
            below = self.counts[k][trees[None, :], cells >> k].sum(1)
            up[below >= self.want] = k
        return up


def nearest(dirs: DataFrame, k: int) -> DataFrame:
    """(id, near, cosine): for each direction the up to k most similar other directions that the forest finds."""
    spark = dirs.sparkSession
    n = dirs.count()
    if not n:
        return spark.createDataFrame([], "id long, near long, cosine double")
    sample = dirs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))).select("u").collect()
    sample = sample or dirs.select("u").limit(SAMPLE).collect()
    forest = shared(spark, Forest(np.frombuffer(b"".join(r["u"] for r in sample), "<f2").reshape(len(sample), -1).astype(np.float32)))
    bits = int(np.clip(np.ceil(np.log2(max(1, n / FINE))), LEAST_BITS, MOST_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((TREES, 1 << bits), np.int64)
        for batch in batches:
            x = _rows(batch.column(0)) if batch.num_rows else None
            for t in range(TREES if x is not None else 0):
                out[t] += np.bincount((forest.value.strings(x, t) >> np.uint64(BITS - bits)).astype(np.int64), minlength=1 << bits)
        t, p = np.nonzero(out)
        yield pa.record_batch([pa.array(t * (1 << bits) + p), pa.array(out[t, p])], ["k", "n"])

    table = np.zeros(TREES << bits, np.int64)  # at most TREES << MOST_BITS, whatever the input
    for key, m in dirs.select("u").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        table[key] = m
    levels = shared(spark, Levels(table.reshape(TREES, -1), WANT * max(1.0, n / COMFORT) ** GROWTH))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, place = forest.value, levels.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _rows(batch.column(1)), np.arange(batch.num_rows)
            strings = np.stack([f.strings(x, t) for t in range(TREES)], axis=1)
            cells = (strings >> np.uint64(BITS - bits)).astype(np.int64)
            up = place.ascent(cells)
            for t in range(TREES):
                cell, blocks = cells[:, t], place.blocks[t]
                more = place.deeper[t][cell]
                rest = (strings[:, t] & np.uint64((1 << (BITS - bits)) - 1)).astype(np.int64) >> (BITS - bits - more)
                first, last = blocks[cell >> up << up], blocks[(cell >> up << up) + (1 << up) - 1]
                own = blocks[cell]
                visits = last - first + 1
                row = np.repeat(ids, visits)
                block = np.repeat(first, visits) + np.arange(len(row)) - np.repeat(np.cumsum(visits) - visits, visits)
                home = block == own[row]
                # a cell that is cut has a block of its own: visitors go to all parts of it, those at home to theirs
                times = np.where(home, 1, place.parts[t][block])
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, block, home = np.repeat(row, times), np.repeat(block, times), np.repeat(home, times)
                part = np.where(home, rest[row], part)
                keys = (place.offsets[t] + block) * (1 << 24) + part
                which = pa.array(row)
                yield pa.record_batch([pa.array(keys, pa.int64()), batch.column(0).take(which), batch.column(1).take(which), pa.array(cell[row], pa.int32()), pa.array(up[row], pa.int32()), pa.array(home)], ["block", "id", "u", "cell", "up", "home"])

    def score(key: tuple, rows: pa.Table) -> pa.Table:
        x, ids = _rows(rows["u"].combine_chunks()), rows["id"].to_numpy()
        cell, up, home = rows["cell"].to_numpy(), rows["up"].to_numpy(), rows["home"].to_numpy()
        held = np.flatnonzero(home)
        held = held[np.argsort(cell[held], kind="stable")]  # the sorted array
        array, y, mine = cell[held], x[held], ids[held]
        node = (cell >> up).astype(np.int64) << 6 | up
        by = np.argsort(node, kind="stable")
        a, b, c = [], [], []
        for group in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
            top, shift = int(cell[group[0]]), int(up[group[0]])
            low, high = np.searchsorted(array, [top >> shift << shift, (top >> shift) + 1 << shift])
            for at in range(0, len(group), 1024):
                q = group[at : at + 1024]
                s = x[q] @ y[low:high].T
                s[ids[q][:, None] == mine[None, low:high]] = -2
                most = min(k, s.shape[1])
                if most < 1:
                    continue
                best = np.argpartition(-s, most - 1, axis=1)[:, :most]
                cos = np.take_along_axis(s, best, 1).reshape(-1)
                ok = cos > -1.5
                a.append(np.repeat(ids[q], most)[ok])
                b.append(mine[low + best.reshape(-1)][ok])
                c.append(cos[ok])
        none = np.zeros(0, np.int64)
        return pa.table({"id": np.concatenate([none, *a]), "near": np.concatenate([none, *b]), "cosine": np.concatenate([np.zeros(0, np.float32), *c])})

    posted = dirs.select("id", "u").mapInArrow(post, "block long, id long, u binary, cell int, up int, home boolean")
    found = posted.groupBy("block").applyInArrow(score, "id long, near long, cosine float")
    best = found.groupBy("id", "near").agg(F.max("cosine").alias("cosine")).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "near"))), 1, k).alias("best"))
    return best.select("id", F.explode("best").alias("x")).select("id", F.col("x.near").alias("near"), (-F.col("x.far")).cast("double").alias("cosine"))


def nearest_pairs(vectors: DataFrame, k: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the k most similar of the other.

    vectors has (id, v), all usable. Similarity is the cosine, ties go to the smaller id. Equal
    directions have a cosine of one; they are collapsed before the search and share its result, so
    any number of copies costs one search. An empty table and a single vector have no pairs.
    """
    dirs, members = directions(vectors, k)
    dirs = cut_lineage(dirs)
    near = nearest(dirs, k)
    # of a direction: the ids of its neighbours, at most k of each
    options = near.join(dirs.select(F.col("id").alias("near"), F.slice("ids", 1, k).alias("theirs")), "near").select("id", (-F.col("cosine")).alias("far"), F.explode("theirs").alias("other"))
    ranked = options.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k).alias("others"))
    own = F.transform("ids", lambda i: F.struct(F.lit(-2.0).alias("far"), i.alias("other")))
    none = F.array().cast("array<struct<far:double,other:bigint>>")
    lists = dirs.join(ranked, "id", "left").select("key", F.concat(own, F.coalesce("others", none)).alias("all"))
    mine = members.join(lists, "key").select("id", F.explode(F.slice(F.filter("all", lambda x: x["other"] != F.col("id")), 1, k)).alias("x")).select("id", F.col("x.other").alias("other"))
    return mine.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

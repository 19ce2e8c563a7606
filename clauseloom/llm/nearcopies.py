"""P4: records that share most of their content, by a grouped prefix join.

A text is the set of its word sequences; two texts are alike from a share t of common sequences on.
Sequences get one order for all texts, rare ones first. Alike texts share one of the first few
sequences of each (prefix filter). Texts with the same set collapse into one group before the join;
groups meet by the sequences of their prefixes, pass filters by size, by place and by a sketch, are
verified on their whole sets, and are expanded into members at the end.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.plain import plain
from clauseloom.llm.common import BITMAP_BITS, bitmap, distinct, hashed_counts, mixed, shared
from clauseloom.session import cut_lineage

#: Cells of the table that orders sequences by frequency: 2**ORDER_BITS bytes, whatever the input.
ORDER_BITS = 22
#: Minima in the sketch, two bits of each, and how many standard deviations below what a pair at the threshold has on
#: average may agree: such a pair has fewer with a chance of some 3e-5. exact=True does without the sketch.
MINIMA, DEVIATIONS = 128, 4.0
#: Postings a bucket has on average at most; sets from which a sequence's postings are dealt into tiles.
POSTINGS, HOT = 3_000_000, 1 << 19
WORD = re.compile(r"[^\W_]+")


class Chunks(dict):
    """What lies between blanks, in small letters -> numbers of the words in it; hashes has a word's hash by number."""

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[str, int] = {}
        self.hashes: list[int] = []

    def __missing__(self, chunk: str) -> list[int]:
        out = []
        for w in WORD.findall(chunk):
            n = self.number.get(w)
            if n is None:
                n = self.number[w] = len(self.hashes)
                self.hashes.append(xxhash.xxh3_64_intdigest(w.encode("utf8", "surrogatepass")))
            out.append(n)
        self[chunk] = out
        return out

    def forget(self) -> None:
        self.clear(), self.number.clear(), self.hashes.clear()


class Sequences:
    """Texts -> sorted distinct 32-bit hashes of their runs of `size` words; None for fewer than `least` words."""

    def __init__(self, size: int, least: int):
        self.size, self.least, self.seen = size, max(least, size), Chunks()

    def sets(self, texts: list[str | None]) -> list[np.ndarray | None]:
        seen, flat, lengths = self.seen, [], []
        for t in texts:
            at = len(flat)
            for c in plain(t).lower().split() if t else ():
                flat += seen[c]
            lengths.append(len(flat) - at)
        h = np.array(seen.hashes, np.uint64)[np.array(flat, np.int64)]
        if len(seen) > 400_000:
            seen.forget()
        runs = h.copy()
        with np.errstate(over="ignore"):
            for k in range(1, self.size):
                runs = runs * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -k)
            runs = mixed(runs) >> np.uint64(32)
        n = np.array(lengths)
        text = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) <= np.repeat(n, n) - self.size
        both = distinct(text[inside].astype(np.uint64) << np.uint64(32) | runs[inside])
        cuts = np.searchsorted(both, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(32))
        both = both.astype(np.uint32)
        return [both[cuts[i] : cuts[i + 1]] if n[i] >= self.least else None for i in range(len(n))]


def _needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Common sequences that two sets of sizes a and b need to be alike at t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


_SEEDS = (mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)).astype(np.uint16)
_SHIFTS = (mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def sketches(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two bits for each of MINIMA minima over each of the sets, none empty, that lie one behind the other in tokens and
    begin at starts: four words a set, the first bits of all, then the second ones."""
    out = np.empty((len(starts), MINIMA), np.uint16)
    small = (tokens ^ (tokens >> np.uint32(16))).astype(np.uint16)
    ends = np.append(starts[1:], len(tokens))
    for i in range(0, len(starts), 16):
        a, b = int(starts[i]), int(ends[min(i + 16, len(starts)) - 1])
        with np.errstate(over="ignore"):
            x = small[a:b, None] * _SEEDS
            x += _SHIFTS  # else 0 were the least of all by every seed
            x ^= x >> np.uint16(7)
            x *= np.uint16(0x2C1B)
        out[i : i + 16] = np.minimum.reduceat(x, starts[i : i + 16] - a, axis=0)
    with np.errstate(over="ignore"):
        low = out * np.uint16(0xB525)  # the least ones are alike in their first bits only
        low ^= low >> np.uint16(8)
        low *= np.uint16(0x9E35)
    bits = np.concatenate([low >> np.uint16(14) & np.uint16(1), low >> np.uint16(15)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view("<u8")


def unlike(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many minima differ in their bits, between sketches given as four arrays of words."""
    return np.bitwise_count((x[0] ^ y[0]) | (x[2] ^ y[2])) + np.bitwise_count((x[1] ^ y[1]) | (x[3] ^ y[3]))


def agreeing(t: float) -> int:
    """Minima that must agree: DEVIATIONS standard deviations below what a pair at t has."""
    p = t + (1 - t) / 4
    return max(0, math.floor(MINIMA * p - DEVIATIONS * math.sqrt(MINIMA * p * (1 - p))))


def groups(df: DataFrame, id: str, text: str, size: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((gid, set), (id, gid, set)): the distinct sets with their hash as gid, and who has them. Null and short texts are in none."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(size, least)
        for batch in batches:
            ids, sets = [], []
            for i, s in zip(batch.column(0).to_pylist(), sequences.sets(batch.column(1).to_pylist())):
                if s is not None:
                    ids.append(i)
                    sets.append(s.tobytes())
            gids = [xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in sets]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(gids, pa.int64()), pa.array(sets, pa.binary())], ["id", "gid", "set"])

    made = cut_lineage(df.select(F.col(id).cast("long").alias("id"), text).mapInArrow(make, "id long, gid long, set binary"))
    # one row of each group brings the set, the one with the least id; only sets that may occur twice are moved for it
    twice = made.groupBy("gid").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    again = maybe_in(twice, "gid")
    first = made.where(again("gid")).join(twice.select("gid", "id"), ["gid", "id"], "left_semi")
    # what only shares a bit with a repeated set is no repetition
    alone = made.where(again("gid")).join(twice.select("gid"), "gid", "left_anti")
    sets = made.where(~again("gid")).select("gid", "set").unionAll(first.select("gid", "set")).unionAll(alone.select("gid", "set"))
    return sets, made


def maybe_in(few: DataFrame, gid: str) -> Callable:
    """A test in columns for values of few, which are hashes, by a bit map of fixed size: no for most that are not there, yes
    for all that are."""
    bits = shared(few.sparkSession, np.packbits(bitmap(few, gid)))

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        at = values.to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
        return pa.array(bits.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1 > 0)

    return test


def order_table(sets: DataFrame) -> tuple[np.ndarray, int]:
    """A byte a cell: how frequent the sequences of the cell are over all sets, an eighth of a power of two a step; and
    how many sequences all sets hold."""
    def units(raw: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64) << np.uint64(32)]

    counts = hashed_counts(sets, "set", units, 1, ORDER_BITS)[0]
    return np.rint(8 * np.log2(1.0 + counts)).astype(np.uint8), int(counts.sum())


_DOC = np.dtype([("gid", "<i8"), ("size", "<u4"), ("sketch", "<u8", (4,))])
BLOCK = 20_000  # sets a task packs together; places of a block fit 16 bits
#: Postings under one sequence from which they are compared as a whole block.
DENSE = 128


def tiled(token: np.ndarray, place: np.ndarray, doc: np.ndarray, freq: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings (token, place, doc) with those of hot sequences dealt into tiles. The sets of a sequence that more than HOT
    have fall into parts; a tile has the postings of one or two parts, and its own name in place of the sequence. What is
    in a tile of two is marked by its part, 1 or 2, above the place: only sets of different parts meet there."""
    parts = np.ceil((2.0 ** (freq / 8) - 1) / HOT).astype(np.int64)
    hot = np.flatnonzero(parts > 1)
    if not len(hot):
        return token, place, doc
    n = parts[hot]
    k, n = np.repeat(hot, n), np.repeat(n, n)
    other = np.arange(len(k)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot])
    own = gid[doc[k]] % n
    low, high = np.minimum(own, other), np.maximum(own, other)
    with np.errstate(over="ignore"):
        name = (mixed(token[k].astype(np.uint64) << np.uint64(32) | (low * n + high).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    cold = parts <= 1
    side = np.where(other == own, 0, np.where(own == low, PLACE, 2 * PLACE))
    return np.concatenate([token[cold], name]), np.concatenate([place[cold], place[k] + side]), np.concatenate([doc[cold], doc[k]])


#: Places are told apart up to here; what stands further back counts as standing here, which only lets more pass.
PLACE = 1 << 14


def candidates(sets: DataFrame, order: np.ndarray, total: int, t: float, exact: bool = False) -> DataFrame:
    """(a, b): pairs of groups that pass the prefix, size, place and sketch filters; a pair comes up to a few times.

    Blocks of sets are packed for each bucket of sequences: what a group needs for the filters is
    shipped once per bucket, a posting takes eight bytes before compression. There are as many buckets
    as postings need; a sequence that very many sets hold is dealt into tiles over the buckets. Of two
    sets the place of the common sequence in the smaller one bounds the size of the larger, so only a
    stretch of the sets in order of size is looked at.
    """
    spark = sets.sparkSession
    table, limit = shared(spark, order), MINIMA - (0 if exact else agreeing(t))
    buckets = max(1, math.ceil((1 - t) * total / POSTINGS))

    def packed(gid: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        """The postings of a block of sets, for every bucket."""
        tokens, n = np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw])
        starts = np.cumsum(n) - n
        docs = np.empty(len(n), _DOC)
        docs["gid"], docs["size"], docs["sketch"] = gid, n, sketches(tokens, starts)
        f, doc = table.value[tokens >> np.uint32(32 - ORDER_BITS)], np.repeat(np.arange(len(n)), n)
        by = np.argsort(doc.astype(np.uint64) << np.uint64(40) | f.astype(np.uint64) << np.uint64(32) | tokens)  # rare ones first
        place = np.arange(len(tokens)) - starts[doc]
        f, tokens = f[by], tokens[by]
        used = (place < (n - np.ceil(t * n - 1e-9) + 1)[doc]) & (f > 8)  # a cell that counts one has one set: no partner
        token, place, doc = tiled(tokens[used], np.minimum(place[used], PLACE - 1), doc[used], f[used], gid)
        bucket = (token * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(buckets)
        by = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | token)
        bucket, token, doc, place = bucket[by], token[by], doc[by], place[by]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        keys, blobs = [], []
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                mine, number = np.unique(doc[a:b], return_inverse=True)
                step = np.diff(token[a:b], prepend=np.uint32(0))  # small numbers, which the shuffle's compression likes
                columns = step.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + number.astype("<u2").tobytes() + place[a:b].astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
                keys.append(k)
                blobs.append(np.array([len(mine), b - a], "<u4").tobytes() + docs[mine].tobytes() + zlib.compress(columns, 1))
        return pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gids, raw = [], []
        for batch in batches:
            for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                gids.append(g)
                raw.append(x)
                if len(raw) == BLOCK:
                    yield packed(np.array(gids, np.int64), raw)
                    gids, raw = [], []
        if raw:
            yield packed(np.array(gids, np.int64), raw)

    def join(key: tuple, pieces: pa.Table) -> pa.Table:
        docs, posts, base = [], [], 0
        for blob in pieces["blob"].to_pylist():
            n, m = np.frombuffer(blob, "<u4", 2).tolist()
            docs.append(np.frombuffer(blob, _DOC, n, 8))
            raw = np.frombuffer(zlib.decompress(memoryview(blob)[8 + n * _DOC.itemsize :]), np.uint8)
            token = np.cumsum(np.ascontiguousarray(raw[: 4 * m].reshape(4, m).T).view("<u4").reshape(-1), dtype=np.uint32)
            doc = raw[4 * m : 6 * m].view("<u2").astype(np.int32) + base
            posts.append((token, doc, np.ascontiguousarray(raw[6 * m : 8 * m].reshape(2, m).T).view("<u2").reshape(-1).astype(np.int32)))
            base += n
        d = np.concatenate(docs)
        token, doc, place = (np.concatenate(x) for x in zip(*posts))
        sizes = d["size"].astype(np.int32)
        size = sizes[doc]
        by = np.argsort(token.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64))  # within a sequence from the smallest set up
        token, doc, place, size = token[by], doc[by], place[by], size[by]
        part, place = place // PLACE, place % PLACE
        marks = [np.ascontiguousarray(d["sketch"][:, w])[doc] for w in range(4)]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        runs = np.diff(np.append(starts, len(token)))
        # the larger set has at most size / t sequences, and so few that what is left of the smaller one is enough
        most = np.minimum(size / t, (size - place) * ((1 + t) / t) - size) + 1e-6
        keys = token.astype(np.float64) * 2.0**21 + np.minimum(size, 2**20)
        upto = np.searchsorted(keys, token.astype(np.float64) * 2.0**21 + np.clip(most, 0, 2**20), "right")
        upto = np.where(most >= 2**20, np.repeat(starts + runs, runs), upto).astype(np.int32)
        del keys, most, by, docs, posts
        got: list[np.ndarray] = []

        def keep(left: np.ndarray, right: np.ndarray) -> None:
            """Of pairs of postings that agree by their sketches, left not larger than right: those that may be alike by
            size and by what is left after their places."""
            need = _needed(size[left], size[right], t)
            meet = part[left] + part[right]
            ok = (size[left] >= t * size[right] - 1e-9) & (size[left] - place[left] >= need) & (size[right] - place[right] >= need) & ((meet == 0) | (meet == 3))
            if ok.any():
                got.append(distinct(doc[left[ok]].astype(np.int64) << 32 | doc[right[ok]]))

        later = np.maximum(0, upto - np.arange(len(token), dtype=np.int32) - 1)
        # short runs: their pairs, listed
        short = np.flatnonzero((later > 0) & np.repeat(runs < DENSE, runs))
        for group in np.array_split(short, max(1, int(later[short].sum() // TILE) + 1)):
            n = later[group]
            left = np.repeat(group, n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            close = unlike([m[left] for m in marks], [m[right] for m in marks]) <= limit
            keep(left[close], right[close])
        # long runs: blocks of postings that reach as far, against what they reach
        for k in np.flatnonzero(runs >= DENSE).tolist():
            a, b = int(starts[k]), int(starts[k] + runs[k])
            reach = np.flatnonzero(later[a:b] > 0) + a
            reach = reach[np.argsort(upto[reach], kind="stable")]
            for i in range(0, len(reach), SIDE):
                mine = reach[i : i + SIDE]
                x = [m[mine, None] for m in marks]
                for j in range(int(mine.min()) + 1, int(upto[mine[-1]]), 16 * SIDE):
                    y = slice(j, min(j + 16 * SIDE, int(upto[mine[-1]])))
                    left, right = np.nonzero(unlike(x, [m[None, y] for m in marks]) <= limit)
                    if not len(left):
                        continue
                    left, right = mine[left], right + j
                    kept = left < right
                    keep(left[kept], right[kept])
        pairs = distinct(np.concatenate(got)) if got else np.zeros(0, np.int64)
        a, b = d["gid"][pairs >> 32], d["gid"][pairs & 0xFFFFFFFF]
        kept = a != b
        return pa.table({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept]})

    return sets.mapInArrow(post, "bucket int, blob binary").groupBy("bucket").applyInArrow(join, "a long, b long")


#: Postings in the shorter side of a block.
SIDE = 128
#: Pairs of postings held at once.
TILE = 2_000_000


def alike_groups(sets: DataFrame, made: DataFrame, t: float, exact: bool = False) -> DataFrame:
    """(a, b): pairs of different groups whose sets share at least t of their union, each once; verified on the whole sets.
    sets has each set once, made every member's (gid, set)."""
    pairs = cut_lineage(candidates(sets, *order_table(made), t, exact).distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
                kept.append(common >= t * (len(x) + len(y) - common) - 1e-9)
            mask = pa.array(kept, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
    few = made.where(maybe_in(needed, "gid")("gid")).join(needed, "gid", "left_semi").groupBy("gid").agg(F.first("set").alias("set"))
    left, right = few.select(F.col("gid").alias("a"), F.col("set").alias("x")), few.select(F.col("gid").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


#: Members of a group that are joined as one block.
MEMBERS = 1000


def alike_pairs(df: DataFrame, id: str, text: str, t: float, size: int, least: int = 0, exact: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows whose texts share at least t of their distinct runs of `size` words.

    Null texts and texts of fewer than `least` words have no pairs; rows with equal sets are pairs.
    Pairs are found between groups and expanded last; a group of very many members in blocks, so that
    none is a hot key. exact does without the sketch filter, which loses a pair at t itself once in
    some thirty thousand; it compares far more.
    """
    sets, made = groups(df, id, text, size, least)
    pairs, members = alike_groups(sets, made, t, exact), made.select("gid", "id")
    many = members.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1")
    wide = cut_lineage(many.where(F.col("n") > MEMBERS).select("gid", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")))
    keys, every = ["gid"], F.lit(0)
    if not wide.isEmpty():
        members = members.join(wide, "gid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        keys, every = ["gid", "k", "l"], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(pairs: DataFrame, c: str, to: str) -> DataFrame:
        """pairs with the members of a group as column to, one block of them at a time."""
        if keys == ["gid"]:
            return pairs.join(members.select(F.col("gid").alias(c), F.col("id").alias(to)), c)
        split = pairs.join(wide.select(F.col("gid").alias(c), "blocks"), c, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return split.withColumn("block", every).join(members.select(F.col("gid").alias(c), F.col("id").alias(to), "block"), [c, "block"]).drop("blocks", "block")

    across = side(side(pairs, "a", "i"), "b", "j")
    copies = members.join(many.select("gid"), "gid", "left_semi")
    x, y = copies.withColumnRenamed("id", "i"), copies.withColumnRenamed("id", "j")
    if keys != ["gid"]:
        x, y = x.withColumn("l", every).withColumnRenamed("block", "k"), y.withColumn("k", every).withColumnRenamed("block", "l")
    within = x.select(*keys, "i").join(y.select(*keys, "j"), keys).where("i < j")
    both = across.select("i", "j").unionAll(within.select("i", "j"))
    return both.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def classes(df: DataFrame, id: str, text: str, t: float = 0.8, size: int = 5, least: int = 0) -> DataFrame:
    """(id, class, links): one row per row of df with a text of at least `least` words: the least id that is linked to it
    over any number of alike texts, and how many other rows are alike to it directly. Copies are not expanded into pairs."""
    sets, made = groups(df, id, text, size, least)
    members = made.select("gid", "id")
    tops = cut_lineage(members.groupBy("gid").agg(F.min("id").alias("root"), F.count("*").alias("n")))
    pairs = cut_lineage(alike_groups(sets, made, t))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(tops.select(F.col("gid").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    label = components(tops.select("gid", "root"), both)
    out = tops.join(label, "gid").join(beside.withColumnRenamed("a", "gid"), "gid", "left")
    out = out.select("gid", F.col("label").alias("class"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.join(out, "gid").select(F.col("id").alias(id), "class", "links")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, label): the least root within reach, by passing labels on and shortcutting over the label's own label until
    nothing changes: rounds grow with the logarithm of the longest chain. Tables stay distributed; only a count returns."""
    labels = nodes.select("gid", F.col("root").alias("label"))
    owner = cut_lineage(nodes.select(F.col("root"), F.col("gid").alias("owner")))
    while True:
        heard = edges.join(labels.withColumnRenamed("gid", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard.withColumnRenamed("a", "gid"), "gid", "left").select("gid", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        # the group that owns my new label may have a lesser one by now
        via = new.join(owner.withColumnRenamed("root", "new"), "new").select("gid", "label", "new", "owner")
        jumped = via.join(labels.select(F.col("gid").alias("owner"), F.col("label").alias("theirs")), "owner")
        done = cut_lineage(jumped.select("gid", "label", F.least("new", "theirs").alias("new")))
        if done.where("new < label").isEmpty():
            return labels
        labels = done.select("gid", F.col("new").alias("label"))

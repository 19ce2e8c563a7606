"""What the text operators share: word counts over all rows, with partial sums made where the rows are."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct entries a partial counter holds before it is handed on: bounds a worker's memory, changes no result.
PARTIAL_ENTRIES = 200_000


def counted(df: DataFrame, column: str, units: Callable[[str], list[str]], word: str = "word", count: str = "n") -> DataFrame:
    """(word, n): how often each unit occurs in all of column. units splits one text.

    Nulls and empty texts have no units. Partial counters are summed per worker, handed on at
    PARTIAL_ENTRIES distinct entries, then summed by one shuffle on the word, so no word is hot.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], [word, count])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(units(text))
            if len(seen) >= PARTIAL_ENTRIES:
                yield flush()
        if seen:
            yield flush()

    return df.select(column).mapInArrow(part, f"{word} string, {count} long").groupBy(word).agg(F.sum(count).alias(count))


#: Size of the bit maps below.
BITMAP_BITS = 22

LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]+")


class Hashes(dict):
    """word -> 64 bits, remembered for up to PARTIAL_ENTRIES words; the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= PARTIAL_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf8", "surrogatepass"))
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x on every bit of the result."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of whole numbers; by sorting, which is far faster here than hashing them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def hashed_counts(df: DataFrame, column: str, units: Callable[[list[str]], list[np.ndarray]], channels: int, bits: int) -> np.ndarray:
    """Counts over all rows in a table of fixed size, shape (channels, 2**bits): units turns a batch of texts into one
    array of 64-bit hashes per channel; a hash adds one to its cell. Every row of every task adds in; tables are summed
    by ranges of cells, so what reaches the driver is channels * 2**bits counts however large the input is."""
    cells, spans = 1 << bits, 16
    width = cells // spans

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((channels, cells), np.int32)  # a task has fewer units than that
        any_row, held, waiting = False, [[] for _ in range(channels)], 0

        def add() -> None:
            for c in range(channels):
                if held[c]:
                    table[c] += np.bincount((np.concatenate(held[c]) >> np.uint64(64 - bits)).astype(np.int64), minlength=cells)
                    held[c].clear()

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at in range(0, len(texts), 2000):
                any_row = True
                for c, h in enumerate(units(texts[at : at + 2000])):
                    held[c].append(h)
                    waiting += len(h)
                if waiting > cells:
                    add()
                    waiting = 0
        add()
        if any_row:
            keys, blobs = [], []
            for c in range(channels):
                for s in range(spans):
                    piece = table[c, s * width : (s + 1) * width]
                    keys.append(c * spans + s)
                    blobs.append(zlib.compress(piece.astype("<u4").tobytes(), 1))
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array([_group()] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], ["k", "g", "blob"])

    def total(pieces: pa.Table) -> pa.Table:
        out = np.zeros(width, np.int64)
        for blob in pieces["blob"].to_pylist():
            raw = zlib.decompress(blob)
            out += np.frombuffer(raw, "<u4" if len(raw) == 4 * width else "<i8")
        return pa.table({"k": pieces["k"][:1], "blob": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    partial = df.select(column).mapInArrow(part, "k int, g int, blob binary")
    result = np.zeros((channels, cells), np.int64)
    for k, blob in _merged(partial, total, "k int, blob binary").collect():
        result[k // spans, k % spans * width : (k % spans + 1) * width] = np.frombuffer(zlib.decompress(blob), "<i8")
    return result


def shared(spark: SparkSession, value: object) -> object:
    """A broadcast of something whose size is fixed; .value on the executors."""
    return spark.sparkContext.broadcast(value)


#: Parts of a bit map, summed apart.
PARTS = 16


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit for the hash of every value of column, in a map of fixed size; whole numbers are hashes themselves. Parts of
    the map meet by their place, first those of neighbouring tasks, so that no task reads one of every other."""
    number = dict(df.dtypes)[column] == "bigint"
    width = 1 << BITMAP_BITS >> 3
    width //= PARTS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, any_row = np.zeros(1 << BITMAP_BITS, bool), Hashes(), False
        for batch in batches:
            any_row |= batch.num_rows > 0
            values = batch.column(0)
            at = values.to_numpy().view(np.uint64) if number else np.array([seen[w] for w in values.to_pylist()], np.uint64)
            bits[at >> np.uint64(64 - BITMAP_BITS)] = True
        if any_row:
            packed = np.packbits(bits).reshape(PARTS, width)
            used = np.flatnonzero(packed.any(1))
            yield pa.record_batch([pa.array(used), pa.array([_group()] * len(used), pa.int32()), pa.array([zlib.compress(packed[k].tobytes(), 1) for k in used], pa.binary())], ["k", "g", "bits"])

    def either(pieces: pa.Table) -> pa.Table:
        out = np.zeros(width, np.uint8)
        for x in pieces["bits"].to_pylist():
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"k": pieces["k"][:1], "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    parts = df.select(column).mapInArrow(part, "k long, g int, bits binary")
    out = np.zeros((PARTS, width), np.uint8)
    for k, x in _merged(parts, either, "k long, bits binary").collect():
        out[k] = np.frombuffer(zlib.decompress(x), np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


#: Tasks whose partial tables are summed together first.
TOGETHER = 128


def _group() -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() if TaskContext.get() else 0) // TOGETHER


def _merged(parts: DataFrame, total: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """parts (k, g, blob) summed by k, those of TOGETHER neighbouring tasks first."""
    return parts.groupBy("k", "g").applyInArrow(total, schema).groupBy("k").applyInArrow(total, schema)

"""Listings and filtered exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import cosine, slug
from clauseloom.operators import audits
from clauseloom.session import if_small


def vector_topk(vectors: DataFrame, query: DataFrame, k: int, where: Column, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """The k rows of vectors nearest to the one vector of query (column q) among those for which where holds: filtered
    before they are ranked, ties to the smaller id. Plans as a pushed filter under TakeOrderedAndProject."""
    near = vectors.where(where).crossJoin(F.broadcast(query.select("q").limit(1)))  # one row
    return near.withColumn("distance", F.round(1 - cosine(vector, "q"), 6)).where("distance is not null").drop("q").orderBy("distance", id).limit(k)


def usable(vector: str = "embedding", size: int = 96) -> Column:
    """Whether a vector has exactly size finite numbers, not all zero."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


#: Vectors of a policy that a task holds, and numbers of a product that it makes at once.
BLOCK, PRODUCT = 8192, 1 << 22


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(case_id, _row, seq, d): of queries (case_id, policy_id, _q) the k nearest of their policy's vectors (policy_id, seq,
    _row, embedding; all usable), by the distance to nine places, then by seq.

    A policy's vectors are dealt to blocks of about BLOCK by a hash; its queries go to each of them and are multiplied by
    the whole block. A block passes on what may be among the k nearest, which are then ranked. Vectors stream before the
    queries of their block; what is held is one block.
    """
    blocks = if_small(vectors.groupBy("policy_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")))
    dealt = vectors.join(blocks, "policy_id").select("policy_id", F.pmod(F.xxhash64("_row"), "_n").cast("int").alias("_b"), F.lit(0).alias("_side"), F.col("_row").alias("_id"), "seq", F.col("embedding").cast("array<double>").alias("v"), F.lit(None).cast(queries.schema["case_id"].dataType).alias("case_id"))
    asked = queries.where("_q is not null").join(blocks, "policy_id").select("policy_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_id"), F.lit(None).cast(vectors.schema["seq"].dataType).alias("seq"), F.col("_q").cast("array<double>").alias("v"), "case_id")
    rows = dealt.unionAll(asked).repartition("policy_id", "_b").sortWithinPartitions("policy_id", "_b", "_side", "_id")
    square = np.float32 if "float" in vectors.schema["embedding"].dataType.simpleString() else np.float64  # as text.cosine has it
    out = rows.select("case_id", F.col("_id").alias("_row"), "seq", F.lit(0.0).alias("d")).schema

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, seqs, parts, unit, size = None, [], [], [], None, 0
        for batch in batches:
            policy, block, side = (batch.column(c).to_pylist() for c in ("policy_id", "_b", "_side"))
            cuts = [i for i in range(1, len(side)) if (policy[i], block[i], side[i]) != (policy[i - 1], block[i - 1], side[i - 1])]
            for start, end in zip([0, *cuts], [*cuts, len(side)]):
                if start == end:
                    continue
                if (policy[start], block[start]) != at:
                    at, ids, seqs, parts, unit = (policy[start], block[start]), [], [], [], None
                piece = batch.slice(start, end - start)
                vs = piece.column("v")
                if not side[start]:
                    size = len(vs[0])
                    ids.append(piece.column("_id")), seqs.append(piece.column("seq"))
                    parts.append(vs.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                    continue
                if not parts:
                    continue
                if unit is None:
                    m = np.concatenate(parts)
                    norm = np.sqrt((m.astype(square) ** 2).astype(np.float64).sum(1))
                    unit, parts = (m[norm != 0] / norm[norm != 0, None]).T, [m[:0]]
                    ids, seqs = [pa.concat_arrays(ids).filter(pa.array(norm != 0))], [pa.concat_arrays(seqs).filter(pa.array(norm != 0))]
                good = [i for i, v in enumerate(vs.to_pylist()) if len(v) == size and None not in v and sum(x * x for x in v) != 0]
                step = max(1, PRODUCT // max(1, unit.shape[1]))
                for s in range(0, len(good), step):
                    some = pa.array(good[s : s + step], pa.int64())
                    q = vs.take(some).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    d = 1 - (q / np.sqrt((q * q).sum(1))[:, None]) @ unit
                    # all that rounding may bring level with the k-th stay
                    limit = np.partition(d, k - 1, 1)[:, k - 1] + 1e-8 if k < d.shape[1] else np.full(len(d), np.inf)
                    i, j = np.nonzero(~(d > limit[:, None]))
                    yield pa.record_batch([piece.column("case_id").take(some.take(pa.array(i))), ids[0].take(pa.array(j)), seqs[0].take(pa.array(j)), pa.array(d[i, j])], ["case_id", "_row", "seq", "d"])

    found = rows.select("policy_id", "_b", "_side", "_id", "seq", "v", "case_id").mapInArrow(rank, out).withColumn("d", F.round("d", 9))
    return audits.first_of_each(found.withColumn("_o", F.struct("d", "seq")), ["case_id"], "_o", k).drop("_o")


def policy_listing(clauses: DataFrame) -> DataFrame:
    """(insurer, policy_id, policy_name, clauses): one row a policy; of several names the first in order."""
    return clauses.groupBy("insurer", "policy_id").agg(F.min("policy_name").alias("policy_name"), F.count("*").alias("clauses"))


def nested_listing(listing: DataFrame) -> DataFrame:
    """(insurer_id, insurer, policies): the listing nested by insurer; an insurer's policies are one row's worth each."""
    one = F.struct("policy_name", "policy_id", F.col("clauses").alias("clause_count"))
    return listing.groupBy(slug("insurer").alias("insurer_id"), "insurer").agg(F.array_sort(F.collect_list(one)).alias("policies"))


def duplicate_texts(clauses: DataFrame, n: int) -> DataFrame:
    """The n texts that occur most often, with the number of insurers that have them."""
    counted = clauses.where("clause_text is not null").groupBy("clause_text").agg(F.count("*").alias("copies"), F.countDistinct("insurer").alias("insurers")).where("copies > 1")
    return counted.orderBy(F.desc("copies"), "clause_text").limit(n)


def clause_block(clauses: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """(key, block): the clauses of a key as one numbered text, absent and zero fields left out."""
    lines = F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("["), F.row_number().over(_window(key, seq)), F.lit("]")), F.coalesce("clause_title", F.lit(""))), *[F.when(F.col(f).isNotNull() & ~F.col(f).cast("string").isin("0", "0.0", ""), F.concat(F.lit(f + ": "), F.col(f).cast("string"))) for f in fields], F.col("clause_text"))
    return clauses.select(key, F.struct(F.col(seq).alias("s"), lines.alias("l")).alias("x")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n\n").alias("block"))


def _window(key: str, seq: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(seq)


def picked(rows: Column, ordinals: Column) -> Column:
    """The rows of an array that 1-based ordinals name; those out of range are ignored, none at all means the first."""
    good = F.filter(F.transform(ordinals, lambda i: F.when((i >= 1) & (i <= F.size(rows)), F.get(rows, i - 1))), lambda r: r.isNotNull())
    return F.when(F.size(good) > 0, good).otherwise(F.slice(rows, 1, 1))

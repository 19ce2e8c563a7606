"""Queries of the llm subpackage: name -> callable(spark, sf_dir), and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import abuse, lookalike, mixing, nearcopies, packing, scans, tokens, truncation, vectors
from clauseloom.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- problem 1


def disguised_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, pos, text) of all texts that problem 1 names."""
    clauses = _table(spark, sf_dir, "numeric_audit_findings").select(
        F.lit("clause_text").alias("field"), F.col("finding_id").alias("row_id"), F.lit(0).cast("long").alias("pos"), F.col("clause_text").alias("text")
    )
    titles = _table(spark, sf_dir, "run_manifest").select("run_id", F.posexplode("recovered_clauses").alias("pos", "c"))
    titles = titles.select(
        F.lit("clause_title").alias("field"), F.col("run_id").alias("row_id"), F.col("pos").cast("long"), F.col("c.clause_title").alias("text")
    )
    return clauses.unionAll(titles)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lookalike.canonical_texts(disguised_sources(spark, sf_dir), ["field", "row_id", "pos"])
    return texts.where(F.col("plain_text") != F.col("text")).select("field", "row_id", "pos")


# --- problem 2


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.noise(_table(spark, sf_dir, "numeric_audit_findings"), "finding_id", "clause_text", "policy_id", "source_page")
    return found.where(scans.NOISY).select(F.col("id").alias("finding_id"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings with noise and their text as it reads without."""
    fixed = scans.repaired(_table(spark, sf_dir, "numeric_audit_findings"), "finding_id", "clause_text", "policy_id", "source_page")
    return fixed.select(F.col("id").alias("finding_id"), "repaired")


# --- problem 3


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "numeric_audit_findings").select("policy_id").distinct()
    rows = _table(spark, sf_dir, "rebuild_embeddings").select("vec_id", "embedding", "policy_id").join(known, "policy_id", "left_semi")
    pairs = vectors.nearest_pairs(vectors.usable(rows, "vec_id", "embedding", 96), 5)
    return pairs.select(F.col("id_a").alias("vec_id_a"), F.col("id_b").alias("vec_id_b"))


# --- problem 4


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearcopies.alike_pairs(_table(spark, sf_dir, "numeric_audit_findings"), "finding_id", "clause_text", t=0.5, size=3, least=20)
    return pairs.select(F.col("id_a").alias("finding_id_a"), F.col("id_b").alias("finding_id_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of at least 20 words with the class of their clause: five-word sequences, a share of 0.8."""
    return nearcopies.classes(_table(spark, sf_dir, "numeric_audit_findings"), "finding_id", "clause_text", least=20)


# --- problem 6


def _cut_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_texts(_table(spark, sf_dir, "numeric_audit_findings"), "finding_id", "clause_text", "source_file")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_findings(spark, sf_dir).where("cut").select("finding_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source file: its findings, how many are cut, their share."""
    rates = _cut_findings(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("findings"), F.count_if("cut").alias("cut"))
    return rates.withColumn("share", F.col("cut") / F.col("findings"))


# --- problem 7


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or its pieces, in a container of each capacity."""
    sizes = cut_lineage(tokens.sized(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.packed(sizes, _table(spark, sf_dir, "pack_sizes"), "doc_id", "pack_id", "capacity_tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens in them, and the share of their space that is unused."""
    held = p7_containers(spark, sf_dir).groupBy("pack_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"))
    fill = held.groupBy("pack_id", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return fill.withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


# --- problem 8


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut_lineage(tokens.sized(_table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]))
    return mixing.mixed(sizes, _table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


# --- problem 9


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_scores(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "doc_labels"), "toxic", ["source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, how many are found, their share."""
    rates = _abuse(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= abuse.THRESHOLD).alias("found"))
    return rates.withColumn("share", F.col("found") / F.col("documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p4_found": p4_found, "p4_classes": p4_classes, "p6_found": p6_found, "p6_rates": p6_rates, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}

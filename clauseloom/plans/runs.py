"""Queries of whole runs: extraction, preload, corrections, merged runs, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import text
from clauseloom.operators import matching, pages, pipelines
from clauseloom.plans.core import _lines, _longest, _pages, _records, _runs, _silent, clauses, query, table
from clauseloom.sources import io


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return pipelines.extract_records(_pages(spark, sf_dir))


@query("c1_records")
def c1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that the stand-in model reads from the pages of every run's file."""
    return _extracted(spark, sf_dir)[0].select("doc", "page", "title", "text")


@query("c1_manifests")
def c1_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run manifest of each of these says."""
    return _extracted(spark, sf_dir)[1]


@query("c3_preload")
def c3_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against loading the findings: kinds, whether they block, how many; five truncated ones are accepted."""
    found = pipelines.preload(_records(spark, sf_dir), table(spark, sf_dir, "run_manifest"), {"truncated": 5})
    return pipelines.kinds_of(found)


@query(
    "g29_no_manifest",
    "SELECT DISTINCT policy_id FROM rebuild_embeddings WHERE policy_id NOT IN (SELECT policy_id FROM run_manifest WHERE records_written > 0 AND policy_id IS NOT NULL)",
)
def g29_no_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with clauses for which no run that wrote any tells where they are from."""
    held = table(spark, sf_dir, "run_manifest").where("records_written > 0")
    return io.without_manifest(clauses(spark, sf_dir).select(F.col("policy_id").alias("stem")).distinct(), held.select(F.col("policy_id").alias("stem"))).select(F.col("stem").alias("policy_id"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r[0] for r in clauses(spark, sf_dir).select("clause_type").where("clause_type is not null").distinct().orderBy("clause_type").limit(100).collect()]  # a fixed list of types
    return pipelines.needing_numbers(clauses(spark, sf_dir), kinds)


@query("g15_candidates")
def g15_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of clauses that a second pass has to look at."""
    return _candidates(spark, sf_dir).select("seq", "field", "before")


@query("c5_numeric_pass")
def c5_numeric_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second pass, with a stand-in for the model, writes: its log."""
    return pipelines.numeric_pass(_candidates(spark, sf_dir)).select("policy_id", "source_page", "seq", "field", "before", "after", "reason", "evidence")


@query("a27_second_pass")
def a27_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.pass_counters(pipelines.numeric_pass(_candidates(spark, sf_dir)))


@query("c6_merged_runs")
def c6_merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and run: what is kept of it and recovered from the run before."""
    records, _ = pipelines.merge_recovered(*_runs(spark, sf_dir))
    return records.groupBy("doc.doc", "doc.run").agg(F.count("*").alias("records"), F.count_if("recovered").alias("recovered"))


@query("k4_merged_manifests")
def k4_merged_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and run: the clauses recovered from the run before, and those refused with what speaks against them."""
    _, man = pipelines.merge_recovered(*_runs(spark, sf_dir))
    return man.select("doc.doc", "doc.run", "recovered_count", "recovered_clauses", "recovery_refused")


@query("c7_corpus")
def c7_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus: records of policies without a new run, of the last run of all others, and what these lost: per policy and origin."""
    old, new = _runs(spark, sf_dir)
    last = new.groupBy("doc.doc").agg(F.max("doc.run").alias("run"))
    of_last = lambda d: d.join(last.select(F.struct("doc", "run").alias("doc")), "doc", "left_semi").withColumn("doc", F.col("doc.doc"))
    c = clauses(spark, sf_dir).select(F.col("policy_id").alias("doc"), "seq", F.col("source_page").alias("page"), F.col("clause_title").alias("title"), F.col("clause_text").alias("text"))
    return pipelines.build_corpus(c, of_last(old), of_last(new)).groupBy("doc", "origin").agg(F.count("*").alias("records"))


@query("o3_biggest_changes")
def o3_biggest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten matched records whose text changed most in length between two runs."""
    a, b = _runs(spark, sf_dir)
    return matching.biggest_changes(matching.run_matches(a, b), a, b, 10).select("doc.doc", "doc.run", "seq_a", "seq_b", "delta")


@query("a19_medoids")
def a19_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the copies of each standard exclusion the most central one."""
    return matching.medoids(_longest(spark, sf_dir).select("code", F.col("policy_id").alias("policy"), F.col("clause_text").alias("text")))


@query("g12_edge_lines")
def g12_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that are first or last on theirs, by how many pages have them there: what furniture is learned from."""
    return pages.edge_keys(_lines(spark, sf_dir)).groupBy("doc", "key").agg(F.count("*").alias("pages")).where("pages > 1")


@query(
    "g14_near_empty_pages",
    "SELECT source_file AS doc, source_page AS page FROM numeric_audit_findings WHERE clause_text IS NOT NULL GROUP BY source_file, source_page HAVING length(trim(string_agg(clause_text, chr(10) ORDER BY line, finding_id))) < 50",
)
def g14_near_empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.near_empty(_pages(spark, sf_dir)).select("doc", "page")


@query(
    "o8_runs_in_order",
    "SELECT run_id, policy_id, CASE WHEN policy_id IN (SELECT policy_id FROM rebuild_embeddings ORDER BY vec_id LIMIT 1) THEN 1 ELSE 2 END AS place FROM run_manifest",
)
def o8_runs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, those of the first clause's policy in front, the others by name."""
    first = [r[0] for r in clauses(spark, sf_dir).orderBy("vec_id").select("policy_id").limit(1).collect()]
    ordered = pipelines.in_fixed_order(table(spark, sf_dir, "run_manifest").select("run_id", "policy_id"), "policy_id", first)
    return ordered.withColumn("place", F.when(F.col("policy_id").isin(first), 1).otherwise(2))


@query("c16_stable_matches", "SELECT policy_id, 3 AS runs, 1 AS values FROM run_manifest WHERE policy_id IS NOT NULL GROUP BY policy_id")
def c16_stable_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's sum of records three times over: whether repeated runs of it agree."""
    man = pipelines.repeated(table(spark, sf_dir, "run_manifest").where("policy_id is not null").select("policy_id", "records_written"), "policy_id", 3)
    return pipelines.stable(man.groupBy("policy_id").agg(F.sum("records_written").alias("n")), "policy_id", "n").withColumns({"runs": F.col("runs").cast("int"), "values": F.col("values").cast("int")})


def _side(prompt: str) -> dict:
    """A stand-in for an advocate: it says how long the clauses are that it was given."""
    return {"argument": f"{len(prompt.split('Clauses:')[-1].split())} words of clauses"}


def _judge(prompt: str) -> dict:
    """A stand-in for an adjudicator: for the insurer if the first clause excludes."""
    first = prompt.split("[1]", 1)[-1].split("[2]", 1)[0].lower()
    return {"verdict": "insurer_right" if "exclu" in first else "insurer_wrong", "clauses": [1, 2], "letter": f"We refer to the clause {first.strip()[:80]}"}


@query("c14_cases")
def c14_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that name their policy, as cases, with stand-ins for the models."""
    letters = table(spark, sf_dir, "documents").where("doc_kind = 'letter' and policy_id is not null and text is not null")
    cases = letters.select(F.col("doc_id").alias("case_id"), "policy_id", F.col("text").alias("letter"))
    found = pipelines.analysed_cases(cases, clauses(spark, sf_dir), io.hashed_embedding("letter"), _side, _judge, 3)
    return found.select("case_id", "policy_id", "verdict", "letter_type", "picked")


@query(
    "o4_longest_silent_runs",
    """WITH s AS (SELECT DISTINCT policy_id AS doc, unnest(pages_sent) AS page FROM run_manifest), h AS (SELECT DISTINCT policy_id AS doc, source_page AS page FROM rebuild_embeddings),
    m AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM s ANTI JOIN h USING (doc, page))
    SELECT doc, min(page) AS first, max(page) AS last, count(*) AS pages FROM m GROUP BY doc, island ORDER BY pages DESC, doc, first LIMIT 10""",
)
def o4_longest_silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest runs of pages that were sent and yielded nothing."""
    return _silent(spark, sf_dir).orderBy(F.desc("pages"), "doc", "first").limit(10)


@query(
    "p30_snippets",
    r"""SELECT finding_id, substring(clause_text, greatest(1, a - 20), a - greatest(1, a - 20) + length(f) + 20) AS snippet FROM (SELECT finding_id, clause_text, strpos(clause_text, regexp_extract(clause_text, '(Clause [0-9]+)', 1)) AS a, regexp_extract(clause_text, '(Clause [0-9]+)', 1) AS f
    FROM numeric_audit_findings) WHERE f <> ''""",
)
def p30_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where findings first refer to a clause, with what is around it."""
    return table(spark, sf_dir, "numeric_audit_findings").select("finding_id", text.snippet("clause_text", "Clause [0-9]+", 20).alias("snippet")).where("snippet is not null")


@query("p25_percents", "SELECT run_id, format('{:.1f}', verbatim_rejection_rate * 100) || '%' AS rejected FROM run_manifest WHERE verbatim_rejection_rate IS NOT NULL")
def p25_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "run_manifest").where("verbatim_rejection_rate is not null").select("run_id", text.percent("verbatim_rejection_rate").alias("rejected"))


@query(
    "g28_missing_fields",
    "SELECT vec_id, list_filter([CASE WHEN trim(coalesce(clause_title, '')) = '' THEN 'clause_title' END, CASE WHEN trim(coalesce(exclusion_code, '')) = '' THEN 'exclusion_code' END, CASE WHEN monetary_cap IS NULL THEN 'monetary_cap' END], lambda x: x IS NOT NULL) AS missing FROM rebuild_embeddings",
)
def g28_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("vec_id", pipelines.missing_fields(["clause_title", "exclusion_code", "monetary_cap"]).alias("missing"))


@query("g27_long_enough", "SELECT doc_id, policy_id FROM documents WHERE doc_kind = 'letter' AND length(trim(coalesce(text, ''))) >= 10")
def g27_long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that say enough to be cases."""
    return pipelines.long_enough(table(spark, sf_dir, "documents").where("doc_kind = 'letter'"), "text").select("doc_id", "policy_id")


@query("g26_own_documents", "SELECT doc_id, source FROM documents WHERE policy_id = (SELECT min(policy_id) FROM documents)")
def g26_own_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one owner, here the first policy by name."""
    d = table(spark, sf_dir, "documents")
    return pipelines.owned(d, d.agg(F.min("policy_id")).first()[0], "policy_id").select("doc_id", "source")


@query(
    "j17_dimension",
    "SELECT insurer, code, count(*) AS clauses FROM (SELECT insurer, CASE insurer WHEN 'Aranyaka Health' THEN 'AH' WHEN 'Bluepeak Cover' THEN 'BC' END AS code FROM rebuild_embeddings) GROUP BY insurer, code",
)
def j17_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with a column from a list written out in the program."""
    joined = io.with_dimension(clauses(spark, sf_dir).select("insurer"), {"Aranyaka Health": ("AH",), "Bluepeak Cover": ("BC",)}, "insurer", "code string")
    return joined.groupBy("insurer", "code").agg(F.count("*").alias("clauses"))

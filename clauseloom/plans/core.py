"""Queries of the core: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import text
from clauseloom.operators import audits, bills, gates, matching, pages, pipelines, retrieval, units
from clauseloom.plans import sqls
from clauseloom.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query together with the SQL that says the same."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# --- problem 5


def _in_common_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    schema = table(spark, sf_dir, "clauses_schema")
    return units.common_units(table(spark, sf_dir, "numeric_audit_findings"), "finding_id", "clause_text", "fields", schema, "name")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_common_units(spark, sf_dir)[0].withColumnRenamed("id", "finding_id")


@query("p5_units")
def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit each schema column was solved to, its mean log residual, and whether the solution is unique."""
    return _in_common_units(spark, sf_dir)[1]


# --- listings and vector search


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause records with seq, their order."""
    return table(spark, sf_dir, "rebuild_embeddings").withColumn("seq", F.col("vec_id"))


_USABLE = (
    "embedding IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 "
    "AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
)


@query(
    "j1_vector_topk",
    f"""WITH u AS MATERIALIZED (SELECT * FROM rebuild_embeddings WHERE {_USABLE}), q AS (SELECT embedding AS qv, policy_id AS p FROM u ORDER BY vec_id LIMIT 1)
    SELECT vec_id, clause_title, round(1 - list_dot_product(embedding, qv) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(qv, qv))), 6) AS distance
    FROM u, q WHERE policy_id = p ORDER BY distance, vec_id LIMIT 15""",
)
def j1_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 clauses of one policy nearest to a query vector."""
    e = table(spark, sf_dir, "rebuild_embeddings").select("vec_id", "clause_title", "policy_id", "embedding").where(retrieval.usable())
    first = e.orderBy("vec_id").limit(1).select("policy_id", F.col("embedding").alias("q")).first()
    if first is None:
        return e.select("vec_id", "clause_title", F.lit(None).cast("double").alias("distance")).limit(0)
    q = spark.createDataFrame([(list(first["q"]),)], "q array<double>")
    return retrieval.vector_topk(e, q, 15, F.col("policy_id") == first["policy_id"]).select("vec_id", "clause_title", "distance")


@query("a1_policy_listing", "SELECT insurer, policy_id, min(policy_name) AS policy_name, count(*) AS clauses FROM rebuild_embeddings GROUP BY insurer, policy_id")
def a1_policy_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.policy_listing(clauses(spark, sf_dir))


@query("a1_nested_listing")
def a1_nested_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nested_listing(retrieval.policy_listing(clauses(spark, sf_dir)))


@query("a2_table_counts", "SELECT 'clauses' AS t, count(*) AS n FROM rebuild_embeddings UNION ALL SELECT 'findings', count(*) FROM numeric_audit_findings UNION ALL SELECT 'manifests', count(*) FROM run_manifest")
def a2_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"clauses": "rebuild_embeddings", "findings": "numeric_audit_findings", "manifests": "run_manifest"}
    parts = [table(spark, sf_dir, t).groupBy(F.lit(n).alias("t")).agg(F.count("*").alias("n")) for n, t in names.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "a3_duplicate_texts",
    "SELECT clause_text, count(*) AS copies, count(DISTINCT policy_id) AS policies FROM numeric_audit_findings WHERE clause_text IS NOT NULL GROUP BY clause_text HAVING count(*) > 1 ORDER BY copies DESC, clause_text LIMIT 20",
)
def a3_duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that most findings share, and how many policies have them."""
    return retrieval.duplicate_texts(table(spark, sf_dir, "numeric_audit_findings").withColumn("insurer", F.col("policy_id")), 20).withColumnRenamed("insurers", "policies")


@query("a4_insurers_per_policy", "SELECT policy_id, count(DISTINCT insurer) AS insurers FROM run_manifest GROUP BY policy_id")
def a4_insurers_per_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "run_manifest").groupBy("policy_id").agg(F.countDistinct("insurer").alias("insurers"))


@query("p18_clause_blocks", sqls.CLAUSE_BLOCKS)
def p18_clause_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.clause_block(clauses(spark, sf_dir), "policy_id", "seq", ["waiting_period_days", "monetary_cap", "percent_cap"])


# --- normal forms

_N7 = "trim(regexp_replace(coalesce({0}, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_N4 = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"
_N5 = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_N6 = "trim(lower(regexp_replace(coalesce({0}, ''), '[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+', ' ', 'g')))"
_N3 = "trim(regexp_replace(upper(coalesce({0}, '')), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@query("n_normal_forms", "SELECT vec_id, " + ", ".join(f"{x.format('clause_title')} AS n{i}" for i, x in ((3, _N3), (4, _N4), (5, _N5), (6, _N6), (7, _N7))) + " FROM rebuild_embeddings")
def n_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "clause_title"
    return clauses(spark, sf_dir).select("vec_id", text.n3(c).alias("n3"), text.n4(c).alias("n4"), text.n5(c).alias("n5"), text.n6(c).alias("n6"), text.n7(c).alias("n7"))


@query("n_verbatim_keys")
def n_verbatim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("vec_id", text.n1("clause_text").alias("n1"), text.n2("clause_text").alias("n2"))


# --- gates

_DANGLING = ", ".join(f"'{w}'" for w in gates.DANGLING)
_CONTACT = gates.CONTACT.removeprefix("(?i)").replace("'", "''")
_T = _N7.format("clause_text")
_IS_CONTACT = f"(regexp_matches(concat_ws(' ', coalesce(clause_title, ''), coalesce(section, ''), coalesce(clause_type, '')), '{_CONTACT}', 'i') OR regexp_matches(substring(coalesce(clause_text, ''), 1, 220), '{_CONTACT}', 'i'))"
_URL = gates.URL_TAIL.removeprefix("(?i)")
_TRUNCATED = f"""CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '[.!?]$') THEN NULL WHEN regexp_matches(t, '[,\\-–—]$') THEN 'truncated'
  WHEN regexp_matches(t, '[A-Za-z]$') THEN CASE WHEN regexp_matches(t, '{_URL}', 'i') THEN 'no_terminal_punctuation'
    WHEN regexp_extract(t, '([A-Za-z]+)[^A-Za-z]*$', 1) IN ({_DANGLING}) OR (length(regexp_extract(t, '([A-Za-z]+)[^A-Za-z]*$', 1)) = 1 AND regexp_matches(t, '\\b[a-z]$')) THEN 'truncated' ELSE 'no_terminal_punctuation' END
  WHEN regexp_matches(t, '[0-9]$') THEN CASE WHEN lower(regexp_replace(regexp_extract(t, '(\\S+)\\s+\\S+$', 1), '[^A-Za-z]', '', 'g')) IN ({_DANGLING}) THEN 'truncated' ELSE 'no_terminal_punctuation' END END"""
_SIGNALS = " + ".join(f"CAST(regexp_matches(coalesce(clause_text, ''), '{p.removeprefix('(?i)')}'{', $$i$$' if p.startswith('(?i)') else ''}) AS INT)" for p in gates.ADDRESS).replace("$$", "'")
_OPEN = """regexp_replace(regexp_replace(regexp_replace(t, '^[ \\t\\n"''“”‘’•▪\\-–—*]+', ''), '^\\s*(?:[\\(\\[]?(?:[ivxlcdm]{1,4}|[a-z]|\\d{1,2})[.)\\]]\\s+)+', '', 'i'), '^\\s*[a-z]\\s+([A-Z])', '\\1')"""
_MID = "(w <> '' AND w = lower(w) AND NOT (left(w, 1) = 'l' AND length(w) <= 3))"
_TAIL = gates.NAME_TAIL.removeprefix("(?i)")
_GATED = f"""SELECT *, {_TRUNCATED} AS truncated, CASE WHEN NOT contact AND (regexp_matches(coalesce(clause_text, ''), '{gates.EMAIL}') OR {_SIGNALS} >= 2) THEN 'embedded_contact_details' END AS contact_details,
  CASE WHEN t <> '' AND NOT (coalesce(clause_title, '') <> '' AND regexp_matches(t, '^means\\b')) AND {_MID} THEN 'starts_mid_sentence' END AS mid_sentence,
  CASE WHEN NOT contact AND (contains(t, '|') OR regexp_matches(t, '{gates.PAGE_STAMP}') OR (tail <> '' AND tail = upper(tail))) THEN 'masthead_fragment' END AS masthead
  FROM (SELECT *, regexp_extract({_OPEN}, '^([A-Za-z][A-Za-z-]*)', 1) AS w, regexp_extract(t, '({_TAIL})', 1, 'i') AS tail, {_IS_CONTACT} AS contact FROM (SELECT *, {_T} AS t FROM (SELECT *, NULL AS section, NULL AS clause_type FROM numeric_audit_findings)))"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as records with seq, their order."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "numeric_audit_findings").withColumn("seq", F.col("finding_id")).withColumn("section", none).withColumn("clause_type", none)


@query("g1_g5_record_gates", f"SELECT finding_id, truncated, contact_details, mid_sentence, masthead FROM ({_GATED})")
def g1_g5_record_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gated(_records(spark, sf_dir)).select("finding_id", F.col("_truncated").alias("truncated"), F.col("_contact").alias("contact_details"), F.col("_mid").alias("mid_sentence"), F.col("_masthead").alias("masthead"))


_WEDGED = sqls.wedged(f"SELECT *, {_T} AS t FROM numeric_audit_findings")
_SPLICE = "len(w) < 3 AND len(list_filter(w, lambda n: abs(n - source_page) <= 1)) > 0"


@query("g6_page_splices", f"SELECT finding_id, source_page, w AS wedged, 'page_number_splice' AS kind FROM ({_WEDGED}) WHERE {_SPLICE}")
def g6_page_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a page number wedged into their text."""
    f = table(spark, sf_dir, "numeric_audit_findings").select("finding_id", "source_page", gates.wedged_numbers().alias("wedged"))
    return f.withColumn("kind", gates.page_splice(wedged=F.col("wedged"))).where("kind is not null")


_CONTINUES = f"""SELECT finding_id FROM (SELECT *, lag(truncated) OVER (PARTITION BY policy_id ORDER BY finding_id) AS before, source_page - lag(source_page) OVER (PARTITION BY policy_id ORDER BY finding_id) AS gap FROM ({_GATED}))
  WHERE before = 'truncated' AND gap BETWEEN 0 AND 1 AND {_MID}"""


@query("w1_continues_previous", _CONTINUES)
def w1_continues_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.continues_previous(_records(spark, sf_dir)).select("finding_id")


_ROW_KINDS = ["truncated", "empty", "no_terminal_punctuation", "embedded_contact_details", "starts_mid_sentence", "masthead_fragment"]
_REPORT_KINDS = [*_ROW_KINDS, "page_number_splice", "continues_previous"]
_KINDS = f"(SELECT policy_id, finding_id AS seq, unnest([truncated, contact_details, mid_sentence, masthead]) AS kind FROM ({_GATED}))"


_ALL_KINDS = f"(SELECT policy_id, seq, kind FROM {_KINDS} WHERE kind IS NOT NULL UNION ALL SELECT policy_id, finding_id, 'page_number_splice' FROM ({_WEDGED}) WHERE {_SPLICE} UNION ALL SELECT policy_id, finding_id, 'continues_previous' FROM ({_CONTINUES}) JOIN numeric_audit_findings USING (finding_id))"


@query(
    "a7_gate_report",
    "SELECT CASE WHEN grouping(policy_id) = 1 THEN 'TOTAL' ELSE policy_id END AS policy_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _REPORT_KINDS) + f" FROM {_ALL_KINDS} GROUP BY ROLLUP (policy_id)",
)
def a7_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every gate, of records and of sequences, per policy and kind, with a TOTAL."""
    return gates.pivot_with_total(gates.findings_long(_records(spark, sf_dir)), "policy_id", "kind", _REPORT_KINDS)


@query(
    "a7_record_report",
    "SELECT CASE WHEN grouping(policy_id) = 1 THEN 'TOTAL' ELSE policy_id END AS policy_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _ROW_KINDS) + f" FROM {_KINDS} WHERE kind IS NOT NULL GROUP BY ROLLUP (policy_id)",
)
def a7_record_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the gates that a look at a record's words alone decides."""
    found = gates.gated(_records(spark, sf_dir)).select("policy_id", F.explode(F.array("_truncated", "_contact", "_mid", "_masthead")).alias("kind")).where("kind is not null")
    return gates.pivot_with_total(found, "policy_id", "kind", _ROW_KINDS)


@query("a8_finding_kinds", f"SELECT kind, kind <> 'no_terminal_punctuation' AS blocked, count(*) AS n FROM {_KINDS} WHERE kind IS NOT NULL GROUP BY kind")
def a8_finding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each kind there are, the most frequent first."""
    found = gates.gated(_records(spark, sf_dir)).select(F.explode(F.array("_truncated", "_contact", "_mid", "_masthead")).alias("kind")).where("kind is not null")
    return pipelines.kinds_of(found.withColumn("blocked", F.col("kind").isin(gates.BLOCKING)))


@query("c2_findings", f"SELECT * FROM {_ALL_KINDS}")
def c2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of record and sequence gates."""
    return gates.findings_long(_records(spark, sf_dir))


@query(
    "g22_accepted",
    f"SELECT seq, kind, kind <> 'no_terminal_punctuation' AND row_number() OVER (PARTITION BY kind ORDER BY seq) > CASE kind WHEN 'truncated' THEN 5 WHEN 'starts_mid_sentence' THEN 3 ELSE 0 END AS blocked FROM {_KINDS} WHERE kind IS NOT NULL",
)
def g22_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of records of every kind: the first five truncated ones and the first three that begin in mid-sentence are
    accepted, the rest block, but for ends without punctuation."""
    found = gates.gated(_records(spark, sf_dir)).select("seq", F.explode(F.array("_truncated", "_contact", "_mid", "_masthead")).alias("kind")).where("kind is not null")
    return gates.accepted(found, {"truncated": 5, "starts_mid_sentence": 3}).select("seq", "kind", "blocked")


@query(
    "g20_manifest_findings",
    "SELECT run_id, 'chunks_failed' AS kind FROM run_manifest WHERE len(chunks_failed) > 0 UNION ALL SELECT run_id, 'unrecovered_boundaries' FROM run_manifest WHERE len(boundary.unrecovered) > 0 "
    "UNION ALL SELECT run_id, 'verbatim_rejection_rate' FROM run_manifest WHERE verbatim_rejection_rate > 0.2 UNION ALL SELECT run_id, 'nothing_written' FROM run_manifest WHERE coalesce(records_written, 0) = 0",
)
def g20_manifest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.manifest_findings(table(spark, sf_dir, "run_manifest"))


@query("a23_survey")
def a23_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with furniture left in them, per policy and kind: pipe, masthead_caps and caps_run."""
    found = table(spark, sf_dir, "numeric_audit_findings").select("policy_id", F.explode(gates.survey()).alias("kind"))
    return found.groupBy("policy_id", "kind").agg(F.count("*").alias("findings"))


@query("a23_survey_clauses")
def a23_survey_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of how many clauses of a policy any kind is; a finding without a clause is one of its own."""
    found = table(spark, sf_dir, "numeric_audit_findings").where(F.size(gates.survey()) > 0)
    return found.groupBy("policy_id").agg(F.countDistinct(F.coalesce("clause_id", F.concat_ws("", F.lit("#"), F.col("finding_id").cast("string")))).alias("clauses"))


@query(
    "a23_pipes_and_names",
    r"""SELECT policy_id, kind, count(*) AS findings FROM (SELECT policy_id, unnest([CASE WHEN contains(t, '|') THEN 'pipe' END,
    CASE WHEN regexp_matches(t, '\b(?:COMPANY\s+LIMITED|POLICY\s+WORDINGS?|INSURANCE\s+CO\b|UIN\s*[:.]|IRDA[I]?\s+REG|\bCIN\b|TOLL\s*FREE|REGISTERED\s+OFFICE)') THEN 'masthead_caps' END]) AS kind
    FROM (SELECT policy_id, trim(regexp_replace(coalesce(clause_text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM numeric_audit_findings)) WHERE kind IS NOT NULL GROUP BY policy_id, kind""",
)
def a23_pipes_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of a23_survey that one pattern decides."""
    found = table(spark, sf_dir, "numeric_audit_findings").select("policy_id", F.explode(gates.survey()).alias("kind")).where("kind <> 'caps_run'")
    return found.groupBy("policy_id", "kind").agg(F.count("*").alias("findings"))


@query("g23_survey_findings")
def g23_survey_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "numeric_audit_findings").select("finding_id", F.explode(gates.survey()).alias("kind"))


@query(
    "a22_sweep",
    f"""SELECT CASE WHEN grouping(policy_id) = 1 THEN 'TOTAL' ELSE policy_id END AS policy_id, count(*) FILTER (WHERE kind = 'page_number') AS page_number, count(*) FILTER (WHERE kind = 'masthead_fragment') AS masthead_fragment, count(*) FILTER (WHERE kind = 'stray_number') AS stray_number
    FROM (SELECT policy_id, unnest([CASE WHEN {_SPLICE} THEN 'page_number' WHEN len(w) BETWEEN 1 AND 2 THEN 'stray_number' END, CASE WHEN contains(t, '|') OR regexp_matches(t, '{gates.PAGE_STAMP}') OR (tail <> '' AND tail = upper(tail)) THEN 'masthead_fragment' END]) AS kind
      FROM (SELECT *, regexp_extract(t, '({_TAIL})', 1, 'i') AS tail FROM ({_WEDGED}))) WHERE kind IS NOT NULL GROUP BY ROLLUP (policy_id)""",
)
def a22_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wedged page numbers, mastheads and stray numbers per policy, with a TOTAL."""
    f = gates.normal(table(spark, sf_dir, "numeric_audit_findings")).withColumn("_w", gates.wedged_numbers(t=F.col("_n7")))
    n, splice = F.col("_w"), gates.page_splice(wedged=F.col("_w"))
    kinds = F.array(F.when(splice.isNotNull(), "page_number"), gates.masthead(F.lit(False), t=F.col("_n7")), F.when((F.size(n) > 0) & (F.size(n) < 3) & splice.isNull(), "stray_number"))
    return gates.pivot_with_total(f.select("policy_id", F.explode(kinds).alias("kind")).where("kind is not null"), "policy_id", "kind", ["page_number", "masthead_fragment", "stray_number"])


@query("g25_title_probe", f"SELECT vec_id, clause_title, source_page FROM rebuild_embeddings WHERE contains({_N4.format('clause_title')}, 'period') AND source_page BETWEEN 5 AND 60")
def g25_title_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).where(F.col("source_page").between(5, 60) & F.contains(text.n4("clause_title"), F.lit("period"))).select("vec_id", "clause_title", "source_page")


# --- pages


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_lines(table(spark, sf_dir, "numeric_audit_findings"), "policy_id", "source_page", "clause_text")


_LINES = "SELECT policy_id AS doc, source_page AS page, u.pos - 1 AS pos, u.line AS line FROM numeric_audit_findings, unnest(string_split(clause_text, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE trim(u.line) <> ''"


@query(
    "a5_learned_furniture",
    f"""WITH l AS ({_LINES}), k AS (SELECT DISTINCT doc, page, {_N6.format("line")} AS key FROM l WHERE length(line) <= 250), n AS (SELECT doc, count(DISTINCT page) AS n FROM l GROUP BY doc)
    SELECT doc, key, count(*) AS pages FROM k JOIN n USING (doc) WHERE key <> '' GROUP BY doc, key, n HAVING count(*) >= greatest(2.0, 0.1 * n)""",
)
def a5_learned_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.learned_furniture(_lines(spark, sf_dir), 0.1)


@query(
    "a6_folio_offsets",
    f"""WITH l AS ({_LINES}), n AS (SELECT doc, count(DISTINCT page) AS n FROM l GROUP BY doc),
    o AS (SELECT doc, CAST(trim(line, chr(32) || chr(9) || chr(13)) AS BIGINT) - page AS off, count(*) AS agreeing, min((page, pos)) AS first FROM l WHERE regexp_matches(line, '^\\s*\\d{{1,4}}\\s*$') GROUP BY 1, 2)
    SELECT doc, off, agreeing FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY agreeing DESC, first) AS rn FROM o) JOIN n USING (doc) WHERE rn = 1 AND agreeing >= greatest(3.0, 0.02 * n)""",
)
def a6_folio_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", ""))
    return pages.folio_offsets(lines, 0.02)


@query("g11_stripped_lines")
def g11_stripped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left per policy once learned furniture, folios and furniture by pattern are gone."""
    lines = _lines(spark, sf_dir)
    return pages.stripped(lines, pages.learned_furniture(lines, 0.1), pages.folio_offsets(lines, 0.02)).groupBy("doc").agg(F.count("*").alias("lines"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, text): one text a page of a run's file."""
    f = table(spark, sf_dir, "numeric_audit_findings").where("clause_text is not null")
    held = f.groupBy(F.col("source_file").alias("doc"), F.col("source_page").alias("page")).agg(F.array_sort(F.collect_list(F.struct("line", "finding_id", "clause_text"))).alias("x"))
    return held.select("doc", "page", F.array_join(F.transform("x", lambda x: x["clause_text"]), "\n").alias("text"))


@query("w2_sections", sqls.sections())
def w2_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sections(_pages(spark, sf_dir), "doc", "page", "text")


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return p.join(pages.sections(p, "doc", "page", "text"), ["doc", "page"])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunks(_sectioned(spark, sf_dir))


@query("t1_chunks", sqls.chunks())
def t1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query("a11_boundary_report", sqls.boundaries())
def a11_boundary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of chunks per run's file; lost counts those that the overlap does not recover."""
    return pages.boundary_report(_sectioned(spark, sf_dir)).select("doc", "chunks", "boundaries", "cut", "recoverable", F.size("unrecovered").cast("long").alias("lost"))


@query(
    "a12_boundary_totals",
    "SELECT CASE WHEN grouping(policy_id) = 1 THEN 'TOTAL' ELSE policy_id END AS policy_id, CAST(sum(boundary.boundaries) AS BIGINT) AS boundaries, CAST(sum(boundary.cut) AS BIGINT) AS cut, CAST(sum(boundary.recoverable) AS BIGINT) AS recoverable FROM run_manifest GROUP BY ROLLUP (policy_id)",
)
def a12_boundary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "run_manifest").rollup("policy_id").agg(F.grouping("policy_id").alias("g"), *[F.sum(f"boundary.{c}").alias(c) for c in ("boundaries", "cut", "recoverable")])
    return r.withColumn("policy_id", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("policy_id"))).drop("g")


_SILENT = """WITH s AS (SELECT DISTINCT policy_id AS doc, unnest(pages_sent) AS page FROM run_manifest), h AS (SELECT DISTINCT policy_id AS doc, source_page AS page FROM rebuild_embeddings),
  m AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM s ANTI JOIN h USING (doc, page))
  SELECT doc, min(page) AS first, max(page) AS last, count(*) AS pages FROM m GROUP BY doc, island"""


def _silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "run_manifest").select(F.col("policy_id").alias("doc"), F.explode("pages_sent").alias("page"))
    return pages.silent_runs(sent, clauses(spark, sf_dir).select(F.col("policy_id").alias("doc"), F.col("source_page").alias("page")))


@query("w3_silent_runs", _SILENT)
def w3_silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silent(spark, sf_dir)


@query("g21_coverage", f"SELECT *, CASE WHEN pages > 8 THEN 'block' WHEN pages >= 3 THEN 'warn' ELSE 'note' END AS level FROM ({_SILENT})")
def g21_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.coverage_kinds(_silent(spark, sf_dir))


@query("u5_pages_sent", "SELECT policy_id, count(DISTINCT p) AS pages FROM (SELECT policy_id, unnest(pages_sent) AS p FROM run_manifest) GROUP BY policy_id")
def u5_pages_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "run_manifest").select("policy_id", F.explode("pages_sent").alias("p")).groupBy("policy_id").agg(F.countDistinct("p").alias("pages"))


# --- matching and copies


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every two successive runs of a policy, the earlier and the later records."""
    f = table(spark, sf_dir, "numeric_audit_findings").select(F.col("policy_id").alias("doc"), F.col("finding_id").alias("seq"), F.col("source_page").alias("page"), F.col("clause_title").alias("title"), F.col("clause_text").alias("text"), "source_file")
    return matching.successive_runs(f)


@query("j2_run_matches")
def j2_run_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a run matched with those of the run before it."""
    return matching.run_matches(*_runs(spark, sf_dir)).withColumn("doc", F.col("doc.doc"))


@query("a20_diff_stats")
def a20_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between runs of a policy, summed over all its successive ones."""
    a, b = _runs(spark, sf_dir)
    return matching.diff_stats(*[d.withColumn("doc", F.col("doc.doc")) for d in (matching.run_matches(a, b), a, b)])


@query("j4_gone")
def j4_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a run that the next one neither matches nor contains."""
    a, b = _runs(spark, sf_dir)
    return matching.gone(a, b, matching.run_matches(a, b)).select("doc.doc", "seq", "page", "title")


@query("t5_contained")
def t5_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that no longer clause within a page contains."""
    c = clauses(spark, sf_dir).select(F.col("policy_id").alias("doc"), "seq", F.col("source_page").alias("page"), F.col("clause_text").alias("text"))
    return matching.contained(c).select("doc", "seq", "page")


_CODE = "(CASE WHEN TRY_CAST(regexp_extract({0}, 'ex[ce]l\\s*\\.?\\s*-?\\s*(\\d{{1,2}})', 1, 'i') AS INT) BETWEEN 1 AND 18 THEN TRY_CAST(regexp_extract({0}, 'ex[ce]l\\s*\\.?\\s*-?\\s*(\\d{{1,2}})', 1, 'i') AS INT) END)"
_CODES = f"SELECT vec_id, policy_id, clause_text, coalesce({_CODE.format('exclusion_code')}, {_CODE.format('clause_title')}) AS code FROM rebuild_embeddings"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("vec_id", "policy_id", "clause_text", audits.code_of("exclusion_code", "clause_title").alias("code"))


@query("p15_codes", f"SELECT vec_id, code FROM ({_CODES})")
def p15_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select("vec_id", "code")


_LONGEST = f"SELECT code, policy_id, clause_text FROM (SELECT *, row_number() OVER (PARTITION BY code, policy_id ORDER BY length(clause_text) DESC, vec_id) AS rn FROM ({_CODES}) WHERE code IS NOT NULL AND clause_text IS NOT NULL) WHERE rn = 1"


def _longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.longest_per(_coded(spark, sf_dir).where("code is not null and clause_text is not null"), ["code", "policy_id"], "clause_text", "vec_id")


@query("a17_longest_per_code", f"SELECT code, policy_id, clause_text FROM ({_LONGEST})")
def a17_longest_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longest(spark, sf_dir).select("code", "policy_id", "clause_text")


@query("a18_spread_per_code", f"SELECT code, min(length(clause_text)) AS shortest, max(length(clause_text)) AS longest, max(length(clause_text)) - min(length(clause_text)) AS spread, count(*) AS holders FROM ({_LONGEST}) GROUP BY code")
def a18_spread_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("clause_text")
    return _longest(spark, sf_dir).groupBy("code").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), (F.max(n) - F.min(n)).alias("spread"), F.count("*").alias("holders"))


@query("j12_omissions")
def j12_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.omissions(_longest(spark, sf_dir).select("code", F.col("policy_id").alias("policy"), F.col("clause_text").alias("text")))


@query("j6_mentions")
def j6_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The insurers and policies that letters name; names meet letters by their first word."""
    import pyarrow as pa

    letters = table(spark, sf_dir, "documents").where("doc_kind = 'letter' and text is not null").select("doc_id", "text")
    man = table(spark, sf_dir, "run_manifest")
    names = man.select(F.col("policy_name").alias("name")).unionAll(man.select("insurer")).where("trim(name) <> ''").distinct().withColumn("w", F.lower(F.element_at(F.split(F.trim("name"), r"\s+"), 1)))
    words = letters.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\w.]+"))).alias("w"))
    near = words.join(names, "w").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    find = F.arrow_udf(lambda t, n: pa.array([matching.mentions(x, y) for x, y in zip(t.to_pylist(), n.to_pylist())], pa.list_(pa.string())), "array<string>")
    return letters.join(near, "doc_id").select("doc_id", find("text", "names").alias("named")).where(F.size("named") > 0)


@query("j11_verbatim")
def j11_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the evidence of corrections stands in the findings of its page."""
    log = table(spark, sf_dir, "numeric_pass_log").where("evidence is not null").select("policy_id", "source_page", "evidence").distinct()
    pairs = log.join(table(spark, sf_dir, "numeric_audit_findings").select("policy_id", "source_page", "finding_id", "clause_text"), ["policy_id", "source_page"])
    return matching.verbatim(pairs, "evidence", "clause_text").groupBy("how").agg(F.count("*").alias("pairs"))


@query("a10_short_fields")
def a10_short_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How exclusion codes, numbers and titles of clauses stand in the texts of their page and its neighbours, and the basis
    of a cap in its clause, with the share of each verdict in its field."""
    texts = table(spark, sf_dir, "numeric_audit_findings").select("policy_id", "source_page", "clause_text")
    return matching.short_fields(clauses(spark, sf_dir), texts)


# --- bills


def _bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.bill_lines(table(spark, sf_dir, "documents").where("doc_kind = 'bill'"), "doc_id", "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference list, every item of a category once, in the order of its file: the first of equally good items wins."""
    i = table(spark, sf_dir, "non_payable_items").withColumn("item_seq", F.monotonically_increasing_id()).where("item_name is not null")
    return i.groupBy("item_name", "category").agg(F.min("category_description").alias("category_description"), F.min("item_seq").alias("item_seq"))


@query("p14_bill_lines", sqls.bill_lines())
def p14_bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bill_lines(spark, sf_dir)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.matched_lines(_bill_lines(spark, sf_dir), _items(spark, sf_dir), "item_seq")


@query("j5_bill_matches", sqls.bill_matches())
def j5_bill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).where("item is not null").select("bill", "line_no", "description", "amount", "item_name", "matched_alternative", "category")


@query("a13_bill_categories", sqls.bill_categories())
def a13_bill_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.by_category(_matched(spark, sf_dir))


@query("a14_bill_totals", sqls.bill_totals())
def a14_bill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.totals(_matched(spark, sf_dir))


@query("o2_bill_findings", sqls.bill_findings())
def o2_bill_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged lines of every bill with their rank in it."""
    return bills.findings(_matched(spark, sf_dir)).select("bill", "rank", "line_no", "category", "amount")


@query("a24_bill_charges", sqls.bill_charges())
def a24_bill_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every bill is never payable or charged twice, by category."""
    return bills.by_charge(_matched(spark, sf_dir))


@query("p24_bill_letters", sqls.bill_letters())
def p24_bill_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.letter(_matched(spark, sf_dir))


@query("a16_items_by_category", "SELECT category, count(*) AS items FROM (SELECT DISTINCT upper(item_name) AS u, category FROM non_payable_items) GROUP BY category")
def a16_items_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "non_payable_items").select(F.upper("item_name").alias("u"), "category").distinct().groupBy("category").agg(F.count("*").alias("items"))


@query("p13_item_alternatives", "SELECT item_name, category, count(*) AS rows, len(list_filter(string_split(item_name, '/'), lambda a: trim(a, ' ,.;:-') <> '')) AS alternatives FROM non_payable_items WHERE item_name IS NOT NULL GROUP BY item_name, category")
def p13_item_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "non_payable_items").where("item_name is not null").groupBy("item_name", "category").agg(F.count("*").alias("rows"))
    return bills.prepared_items(i, "item_name").groupBy("item_name", "category", "rows").agg(F.count("*").alias("alternatives"))


# --- numbers


@query(
    "a9_numeric_tallies",
    """WITH v AS (SELECT e.key AS field, e.value.verdict AS verdict FROM (SELECT unnest(map_entries(fields)) AS e FROM numeric_audit_findings)),
    t AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE verdict = 'zero') AS zero, count(*) FILTER (WHERE verdict IN ('disagree', 'unsupported')) AS bad, count(*) FILTER (WHERE verdict = 'missed') AS missed,
      count(*) - count(*) FILTER (WHERE verdict IN ('both_null', 'missed')) AS populated FROM v GROUP BY field)
    SELECT *, populated - zero AS checked, round(bad / nullif(populated - zero, 0), 6) AS rate FROM t""",
)
def a9_numeric_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "numeric_audit_findings").select(F.explode(F.transform_values("fields", lambda k, v: v["verdict"])).alias("field", "verdict"))
    return audits.tallies(f)


_RECORDED = "(SELECT policy_id, e.key AS field, e.value.verdict AS verdict, e.value.convention AS convention FROM (SELECT policy_id, unnest(map_entries(fields)) AS e FROM numeric_audit_findings))"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "numeric_audit_findings").select("policy_id", F.explode("fields").alias("field", "a"))
    return f.select("policy_id", "field", "a.verdict", "a.convention")


@query("a9_by_convention", f"SELECT field, convention, count(*) AS n FROM {_RECORDED} WHERE convention IS NOT NULL GROUP BY field, convention")
def a9_by_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what conventions the recorded numbers of each field were matched."""
    return _recorded(spark, sf_dir).where("convention is not null").groupBy("field", "convention").agg(F.count("*").alias("n"))


@query(
    "a9_by_policy",
    f"""WITH t AS (SELECT CASE WHEN grouping(policy_id) = 1 THEN 'TOTAL' ELSE policy_id END AS policy_id, field, count(*) AS clauses, count(*) - count(*) FILTER (WHERE verdict IN ('both_null', 'missed')) AS filled,
    count(*) - count(*) FILTER (WHERE verdict IN ('both_null', 'missed', 'zero')) AS checked, count(*) FILTER (WHERE verdict IN ('disagree', 'unsupported')) AS bad FROM {_RECORDED} GROUP BY GROUPING SETS ((policy_id, field), (field)))
    SELECT *, round(bad / nullif(checked, 0), 6) AS rate FROM t""",
)
def a9_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and disagreement of every field in every policy, with a TOTAL."""
    return audits.coverage_by_policy(_recorded(spark, sf_dir), "policy_id")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit(clauses(spark, sf_dir), "clause_text", "waiting_period_days", "monetary_cap", "percent_cap")


@query("c4_numeric_audit")
def c4_numeric_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded numbers of clauses judged by their text: verdicts and conventions per field."""
    return audits.audited_fields(_audited(spark, sf_dir)).groupBy("field", "verdict", "convention").agg(F.count("*").alias("n"))


@query("k5_numeric_findings")
def k5_numeric_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with a number that their text does not support, as they are written out."""
    return audits.numeric_findings(_audited(spark, sf_dir), "clause_text", "vec_id", "policy_id", "clause_id", "clause_title", "source_page")


@query(
    "a27_pass_counters",
    "SELECT field, count(*) FILTER (WHERE before IS NULL AND after IS NOT NULL) AS filled, count(*) FILTER (WHERE before IS NOT NULL AND after IS NOT NULL) AS corrected, count(*) FILTER (WHERE after IS NULL) AS emptied FROM (SELECT DISTINCT * FROM numeric_pass_log) GROUP BY field",
)
def a27_pass_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "numeric_pass_log").distinct()
    before, after = F.col("before").isNotNull(), F.col("after").isNotNull()
    return log.groupBy("field").agg(F.count_if(~before & after).alias("filled"), F.count_if(before & after).alias("corrected"), F.count_if(~after).alias("emptied"))


@query("g16_evidence_gate")
def g16_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of every field by why their evidence is refused, or ok: a number of its own kind and unit, read from the
    evidence alone, which a finding of its page must hold."""
    log = table(spark, sf_dir, "numeric_pass_log").distinct()
    texts = table(spark, sf_dir, "numeric_audit_findings").select("policy_id", "source_page", "clause_text")
    return audits.evidence_reasons(log, texts).groupBy("field", "reason").agg(F.count("*").alias("n"))


@query("a21_manifest_rates", "SELECT run_id, round(verbatim_rejected / nullif(records_extracted + verbatim_rejected, 0), 6) AS rate, len(chunks_failed) AS failed FROM run_manifest")
def a21_manifest_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "run_manifest").select("run_id", F.round(F.try_divide(F.col("verbatim_rejected"), F.nullif(F.col("records_extracted") + F.col("verbatim_rejected"), F.lit(0))), 6).alias("rate"), F.array_size("chunks_failed").alias("failed"))


# --- windows, sets, order

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY extracted_at DESC, run_id DESC) AS rn FROM run_manifest) WHERE rn = 1"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.first_of_each(table(spark, sf_dir, "run_manifest").withColumn("_o", F.struct(F.col("extracted_at"), F.col("run_id"))), ["policy_id"], F.desc("_o"), 1)


@query("k10_latest_runs", f"SELECT policy_id, run_id, records_written FROM ({_LATEST})")
def k10_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several runs of a policy the latest overrides the others."""
    return _latest(spark, sf_dir).select("policy_id", "run_id", "records_written")


@query("u2_partition_replace", "SELECT policy_id, vec_id AS id, 'old' AS origin FROM rebuild_embeddings WHERE policy_id NOT IN (SELECT policy_id FROM numeric_audit_findings) UNION ALL SELECT policy_id, finding_id, 'new' FROM numeric_audit_findings")
def u2_partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that were extracted again replace their old records whole."""
    old = clauses(spark, sf_dir).select("policy_id", F.col("vec_id").alias("id"), F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "numeric_audit_findings").select("policy_id", F.col("finding_id").alias("id"), F.lit("new").alias("origin"))
    return io.partition_replaced(old, new, "policy_id")


@query("w5_first_of_each", "SELECT section, vec_id FROM (SELECT section, vec_id, row_number() OVER (PARTITION BY section ORDER BY vec_id) AS rn FROM rebuild_embeddings) WHERE rn <= 3")
def w5_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three examples of each section."""
    return audits.first_of_each(clauses(spark, sf_dir).select("section", "vec_id"), ["section"], "vec_id", 3)


@query("w7_shares", "SELECT clause_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM rebuild_embeddings GROUP BY clause_type")
def w7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = clauses(spark, sf_dir).groupBy("clause_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("clause_type", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row


@query("j15_silent_policies", "SELECT DISTINCT policy_id FROM rebuild_embeddings ANTI JOIN numeric_audit_findings USING (policy_id)")
def j15_silent_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("policy_id").join(table(spark, sf_dir, "numeric_audit_findings").select("policy_id"), "policy_id", "left_anti").distinct()


@query("o3_longest_texts", "SELECT vec_id, length(clause_text) AS chars FROM rebuild_embeddings WHERE clause_text IS NOT NULL ORDER BY chars DESC, vec_id LIMIT 10")
def o3_longest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).where("clause_text is not null").select("vec_id", F.length("clause_text").alias("chars")).orderBy(F.desc("chars"), "vec_id").limit(10)


@query("p23_clause_parts")
def p23_clause_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "numeric_audit_findings").select("finding_id", F.size(text.clause_parts("clause_text")).alias("parts"))


@query("p25_indian_digits", sqls.INDIAN_DIGITS)
def p25_indian_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).where("monetary_cap is not null").select("vec_id", text.indian_digits("monetary_cap").alias("cap"))


@query("p28_embeddings")
def p28_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with an embedding made anew by the stand-in model."""
    return io.embedded(clauses(spark, sf_dir).select("vec_id", "clause_text"), io.hashed_embedding("clause_text")).select("vec_id", F.size("embedding").alias("size"))

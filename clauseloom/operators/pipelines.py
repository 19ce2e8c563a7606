"""Whole runs: records from pages, loads behind gates, corrections, merged runs, cases. Models are functions of the
caller's; the stand-ins here are deterministic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import n7, verbatim_key
from clauseloom.operators import audits, gates, matching, pages, retrieval
from clauseloom.session import cut_lineage
from clauseloom.sources import io

#: A model of extraction: the text of a chunk -> clauses, each a dict with clause_title, clause_text and source_page.
Extract = Callable[[str], list[dict]]
# Sections that hold no clauses; characters below which a page is as good as empty.
SKIPPED_SECTIONS = ["ombudsman", "unknown"]
NEAR_EMPTY = 50
#: Characters of clauses that leave a task together.
BATCH = 1 << 20


def paragraphs(text: str) -> list[dict]:
    """A stand-in for a model: every line of four words or more is a clause, titled by its first words."""
    out, page = [], None
    for line in text.split("\n"):
        if m := re.fullmatch(r"\[\[page (\d+)\]\]", line):
            page = int(m.group(1))
        elif len(words := line.split()) >= 4:
            out.append({"clause_title": " ".join(words[:4]), "clause_text": line.strip(), "source_page": page})
    return out


def near_empty(page_texts: DataFrame) -> DataFrame:
    """Pages (doc, page, text) with fewer than NEAR_EMPTY characters; a null text has none."""
    return page_texts.where(F.length(F.trim(F.coalesce("text", F.lit("")))) < NEAR_EMPTY)


def worth_reading(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks whose section can hold clauses; limit keeps the first ones of each document, for a trial."""
    kept = chunks.where(~F.col("section").isin(SKIPPED_SECTIONS))
    return kept if limit is None else audits.first_of_each(kept, ["doc"], "chunk", limit)


def layout(page_texts: DataFrame, gutters: DataFrame) -> DataFrame:
    """Per document of pages (doc, page): how many have two columns, and where the gutters (doc, page, gutter) lie."""
    g = page_texts.select("doc", "page").distinct().join(gutters, ["doc", "page"], "left")
    return g.groupBy("doc").agg(F.count("*").alias("pages"), F.count("gutter").alias("two_columns"), F.min("gutter").alias("least"), F.max("gutter").alias("most"))


def page_text(left: Column, right: Column, whole: Column) -> Column:
    """The text of a page read in two columns, if these hold three fifths of what the whole page does; else the whole."""
    both = F.concat_ws("\n", left, right)
    return F.when(F.length(both) >= 0.6 * F.length(F.coalesce(whole, F.lit(""))), both).otherwise(whole)


def extracted(chunks: DataFrame, extract: Extract) -> DataFrame:
    """(doc, chunk, clause_title, clause_text, page, failed, how): the clauses a model finds in chunks, a row each, how they
    stand in their chunk (matching.verbatim) and on which page (matching.resolve_page); a chunk that it fails on has one
    row, with failed set. A chunk's text is brought to its normal form once and does not travel with its clauses; of these
    a task holds those of one chunk and BATCH characters more."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in (r for k in range(0, batch.num_rows, 50) for r in batch.slice(k, 50).to_pylist()):
                try:
                    found = [(c.get("clause_title"), c.get("clause_text"), c.get("source_page")) for c in extract(r["text"])]
                except Exception:  # noqa: BLE001 - whatever a model does, the run goes on and says so
                    rows.append((r["doc"], r["chunk"], None, None, None, True, "absent"))
                    continue
                flat, marks, size = verbatim_key(r["text"]) or "", matching.marks_of(r["text"] or ""), len(r["text"] or "")
                for title, text, page in found:
                    quote = verbatim_key(text) or ""
                    rows.append((r["doc"], r["chunk"], title, text, matching.page_of(quote, flat, marks, size, page, r["start_page"]), False, matching.stands(quote, flat)))
                    held += len(title or "") + len(text or "")
                if held > BATCH or len(rows) > BATCH >> 8:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    out = pa.schema([("doc", pa.string()), ("chunk", pa.int32()), ("clause_title", pa.string()), ("clause_text", pa.string()), ("page", pa.int64()), ("failed", pa.bool_()), ("how", pa.string())])
    return chunks.select("doc", "chunk", "text", "start_page").mapInArrow(read, "doc string, chunk int, clause_title string, clause_text string, page long, failed boolean, how string")


def wording_lines(page_texts: DataFrame, share: float = 0.5, folio_share: float = 0.3) -> DataFrame:
    """Pages (doc, page, text) without furniture: what is learned of each document, folios, pieces of furniture, patterns."""
    lines = cut_lineage(pages.page_lines(page_texts, "doc", "page", "text"))
    kept = pages.stripped(lines, pages.learned_furniture(lines, share), pages.folio_offsets(lines, folio_share))
    held = kept.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))  # lines of one page
    return held.select("doc", "page", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def extract_records(page_texts: DataFrame, extract: Extract = paragraphs, most: int = 6000, overlap: int = 1500, share: float = 0.5, folio_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(records, manifests) of documents given by their pages (doc, page, text): furniture out, sections, chunks, clauses by
    the model, those that do not stand in their chunk rejected, pages resolved, copies of the overlap dropped.

    records: (doc, seq, page, title, text). manifests, one row a document: pages, pages_sent, chunks_total,
    chunks_failed, verbatim_rejected and its rate, records_extracted, records_deduped, records_written, boundary.
    """
    clean = cut_lineage(wording_lines(page_texts, share, folio_share))
    named = cut_lineage(clean.join(pages.sections(clean, "doc", "page", "text"), ["doc", "page"]))
    chunks = cut_lineage(worth_reading(pages.chunks(named, most, overlap)))
    found = cut_lineage(extracted(chunks, extract))
    good = found.where("not failed and how <> 'absent'").select("doc", F.monotonically_increasing_id().alias("seq"), "page", F.col("clause_title").alias("title"), F.col("clause_text").alias("text"))
    good = cut_lineage(good)
    records = cut_lineage(matching.contained(good))
    sent = chunks.select("doc", F.explode(F.sequence("start_page", "end_page")).alias("p")).groupBy("doc").agg(F.array_sort(F.collect_set("p")).alias("pages_sent"))
    failed = found.where("failed").groupBy("doc").agg(F.array_sort(F.collect_set("chunk")).alias("chunks_failed"))
    n = lambda df, c: df.groupBy("doc").agg(F.count("*").alias(c))
    parts = [n(chunks, "chunks_total"), sent, failed, n(found.where("not failed and how = 'absent'"), "verbatim_rejected"), n(good, "records_extracted"), n(records, "records_written")]
    man = n(page_texts, "pages")
    for part in parts:
        man = man.join(part, "doc", "left")
    for c in ("chunks_total", "verbatim_rejected", "records_extracted", "records_written"):
        man = man.withColumn(c, F.coalesce(c, F.lit(0)))
    man = man.withColumns({c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("pages_sent", "bigint"), ("chunks_failed", "int"))})
    rate = F.round(F.try_divide("verbatim_rejected", F.nullif(F.col("verbatim_rejected") + F.col("records_extracted"), F.lit(0))), 6)
    man = man.withColumn("records_deduped", F.col("records_extracted") - F.col("records_written")).withColumn("verbatim_rejection_rate", rate)
    bounds = pages.boundary_report(named, most, overlap).select("doc", F.struct("boundaries", "cut", "recoverable", "unrecovered").alias("boundary"))
    return records, man.join(bounds, "doc", "left")


def preload(records: DataFrame, manifests: DataFrame, allowed: dict[str, int], missing_blocks: bool = True, ceiling: int = 8, warn: int = 3) -> DataFrame:
    """(policy_id, seq, kind, blocked): everything that speaks against loading records (with policy_id, seq, source_page and
    what gates ask for) whose runs manifests tell of: gates of records and sequences, manifest gates, runs of pages sent that
    yielded nothing, and policies without a manifest. allowed (kind -> n) accepts the first n findings of a kind."""
    found = gates.findings_long(records).select("policy_id", "seq", "kind", F.col("kind").isin(gates.BLOCKING).alias("_b"))
    man = gates.manifest_findings(manifests).join(manifests.select("run_id", "policy_id"), "run_id").select("policy_id", F.col("run_id").alias("seq"), "kind", F.lit(True).alias("_b"))
    sent = manifests.select(F.col("policy_id").alias("doc"), F.explode("pages_sent").alias("page"))
    silent = pages.coverage_kinds(pages.silent_runs(sent, records.select(F.col("policy_id").alias("doc"), F.col("source_page").alias("page"))), ceiling, warn)
    silent = silent.where("level <> 'note'").select(F.col("doc").alias("policy_id"), F.col("first").alias("seq"), F.lit("silent_pages").alias("kind"), (F.col("level") == "block").alias("_b"))
    lost = records.select("policy_id").distinct().join(manifests.select("policy_id"), "policy_id", "left_anti").select("policy_id", F.lit(None).cast("long").alias("seq"), F.lit("no_manifest").alias("kind"), F.lit(missing_blocks).alias("_b"))
    everything = cut_lineage(found.unionAll(man).unionAll(silent).unionAll(lost))
    out = gates.accepted(everything, allowed, "seq")
    return out.withColumn("_free", F.col("_b") & ~F.col("kind").isin(gates.BLOCKING)).select("policy_id", "seq", "kind", (F.col("blocked") | F.col("_free")).alias("blocked"))


def kinds_of(findings: DataFrame) -> DataFrame:
    """(kind, blocked, n), the most frequent first, equal ones by name."""
    return findings.groupBy("kind", "blocked").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "blocked")


# Types of clauses whose numbers are filled, and how far a value may be from what the text says.
PASS_TYPES = ["exclusion", "waiting_period", "coverage", "benefit"]
PASS_FIELDS = {"waiting_period_days": ("days", 1.0), "monetary_cap": ("cap", 1.0), "percent_cap": ("percent", 0.01)}
#: A model that reads a number: (field, clause text) -> (value, evidence) or None.
Propose = Callable[[str, str], tuple[float | None, str | None] | None]


def first_stated(field: str, text: str) -> tuple[float | None, str | None]:
    """A stand-in for a model: the first number of the field's kind that a text states, and the words that state it."""
    read = {"waiting_period_days": audits.find_durations, "monetary_cap": audits.find_money, "percent_cap": audits.find_percents}[field](text)
    return (read[0]["value"], read[0]["raw"]) if read else (None, None)


def needing_numbers(clauses: DataFrame, types: list[str] = PASS_TYPES) -> DataFrame:
    """(seq, policy_id, source_page, clause_text, field, before): numbers of clauses of these types that are empty though the
    text states one (durations only where it speaks of waiting), or that the text does not support."""
    a = audits.audit(clauses.where(F.col("clause_type").isin(types)), "clause_text", "waiting_period_days", "monetary_cap", "percent_cap")
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("before"), F.col(f"{k}_verdict").alias("verdict")) for f, (k, _) in PASS_FIELDS.items()]
    long = a.select("seq", "policy_id", "source_page", "clause_text", F.explode(F.array(*fields)).alias("x")).select("seq", "policy_id", "source_page", "clause_text", "x.*")
    return long.where(F.col("verdict").isin("missed", "disagree", "unsupported")).drop("verdict")


def numeric_pass(candidates: DataFrame, propose: Propose = first_stated) -> DataFrame:
    """candidates (needing_numbers) with proposed, evidence, reason and after: what a model reads, whether its evidence stands
    in the clause and alone supports it, and the value then written: the proposed one if it is supported; else none, which
    empties a value that was there and leaves an empty one empty."""
    import json

    def ask(fields: pa.Array, texts: pa.Array) -> pa.Array:
        got = [propose(f, t or "") or (None, None) for f, t in zip(fields.to_pylist(), texts.to_pylist())]
        return pa.array([json.dumps({"value": v, "evidence": e}) for v, e in got], pa.string())

    asked = cut_lineage(candidates.withColumn("_p", F.from_json(F.arrow_udf(ask, "string")("field", "clause_text"), "value double, evidence string")))
    held = F.contains(audits.n1("clause_text"), audits.n1("evidence"))
    given = asked.withColumns({"proposed": F.col("_p.value"), "evidence": F.col("_p.evidence")}).drop("_p")
    e = F.coalesce("evidence", F.lit(""))
    days = F.filter(audits.durations(e), lambda c: c["convention"].isin(*audits.ALLOWED_CONVENTIONS))
    read = F.when(F.col("field") == "waiting_period_days", days).when(F.col("field") == "monetary_cap", audits.money(e)).otherwise(audits.percents(e))
    near = F.when(F.col("field") == "percent_cap", 0.01).otherwise(1.0)
    waits = F.when(F.col("field") == "waiting_period_days", F.col("clause_text").rlike(audits.WAIT)).otherwise(True)
    reason = audits.span_supports(F.col("proposed"), F.col("evidence"), held, read, near, waits)
    return given.withColumn("reason", reason).withColumn("after", audits.merged_number(F.col("before"), F.col("proposed"), F.col("reason")))


def pass_counters(corrections: DataFrame) -> DataFrame:
    """Per field: filled, corrected, emptied and rejected (proposed for an empty one in vain)."""
    was, now = F.col("before").isNotNull(), F.col("after").isNotNull()
    return corrections.groupBy("field").agg(F.count_if(~was & now).alias("filled"), F.count_if(was & now & (F.col("before") != F.col("after"))).alias("corrected"), F.count_if(was & ~now).alias("emptied"), F.count_if(~was & ~now & F.col("proposed").isNotNull()).alias("rejected"))


def merge_recovered(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, manifest additions) of a run and the one before it, both (doc, seq, page, title, text).

    Old records that the new run neither matches nor contains are recovered, if no record gate blocks
    them, else refused. What is kept is the new run and the recovered ones, without what a longer
    record contains. Additions, a row a document: recovered_count, recovered_clauses (source_page, clause_title, chars),
    recovery_refused (source_page, clause_title, failed), in order.
    """
    lost = cut_lineage(matching.gone(old, new, matching.run_matches(old, new)))
    none = F.lit(None).cast("string")
    shaped = lost.select("doc", "seq", "page", "title", "text", F.col("text").alias("clause_text"), F.col("title").alias("clause_title"), F.col("page").alias("source_page"), none.alias("section"), none.alias("clause_type"))
    judged = cut_lineage(gates.with_findings(shaped).withColumn("failed", F.filter("findings", lambda k: k.isin(gates.BLOCKING))).drop("findings", "clause_text"))
    good = judged.where(F.size("failed") == 0).select("doc", "seq", "page", "title", "text", F.lit(True).alias("recovered"))
    records = matching.contained(new.select("doc", "seq", "page", "title", "text").withColumn("recovered", F.lit(False)).unionByName(good))
    clause = F.struct("seq", F.col("page").alias("source_page"), F.col("title").alias("clause_title"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    refusal = F.struct("seq", F.col("page").alias("source_page"), F.col("title").alias("clause_title"), "failed")
    ok = F.size("failed") == 0
    man = judged.groupBy("doc").agg(F.count_if(ok).alias("recovered_count"), F.array_sort(F.collect_list(F.when(ok, clause))).alias("a"), F.array_sort(F.collect_list(F.when(~ok, refusal))).alias("b"))
    drop = lambda xs, *names: F.transform(xs, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return records, man.select("doc", "recovered_count", drop(F.col("a"), "source_page", "clause_title", "chars").alias("recovered_clauses"), drop(F.col("b"), "source_page", "clause_title", "failed").alias("recovery_refused"))


def build_corpus(unchanged: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """One corpus (doc, seq, page, title, text, origin): documents of new replace theirs of unchanged whole; what their old
    run held and the new one lost is carried forward as merge_recovered does."""
    records, _ = merge_recovered(old, new)
    kept = unchanged.join(new.select("doc").distinct(), "doc", "left_anti").select("doc", "seq", "page", "title", "text", F.lit("unchanged").alias("origin"))
    return kept.unionByName(records.select("doc", "seq", "page", "title", "text", F.when(F.col("recovered"), "recovered").otherwise("new").alias("origin")))


# What a verdict asks for.
LETTERS = {"insurer_wrong": "appeal", "insurer_right": "substantiate", "unclear": "appeal"}
#: A model of a role: a prompt -> a dict.
Agent = Callable[[str], dict]


def ask(prompt: Column, agent: Agent, schema: str) -> Column:
    """What a role answers to a prompt, in the given form; null where it fails or answers in another."""
    import json

    def answer(prompts: pa.Array) -> pa.Array:
        out = []
        for p in prompts.to_pylist():
            try:
                out.append(None if p is None else json.dumps(agent(p)))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pa.array(out, pa.string())

    return F.from_json(F.arrow_udf(answer, "string")(prompt), schema)


def analysed_cases(cases: DataFrame, clauses: DataFrame, embed: Column, advocate: Agent, adjudicate: Agent, k: int = 15) -> DataFrame:
    """(case_id, policy_id, verdict, letter_type, picked, quotes_hold, letter) of cases (case_id, policy_id, letter): the k clauses of their policy
    nearest to the letter, a numbered block of them, both sides' words, a verdict, the clauses it rests on and the letter
    that follows. A case whose policy has no clauses, or that a role fails on, has no verdict.

    embed makes a vector of column letter. Each case keeps its k nearest only: partial lists are cut where the rows are.
    """
    asked = cases.withColumn("_q", embed)
    held = cut_lineage(clauses.where(retrieval.usable()).select("policy_id", "seq", "clause_title", "clause_text", "source_page", "embedding", F.monotonically_increasing_id().alias("_row")))
    near = retrieval.nearest(asked.select("case_id", "policy_id", "_q"), held.select("policy_id", "seq", "_row", "embedding"), k)
    ranked = near.join(held.select("_row", "clause_title", "clause_text", "source_page"), "_row").withColumn("_o", F.struct("d", "seq"))
    block = ranked.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("_o", "seq", "clause_title", "clause_text", "source_page"))).alias("held"))
    text = F.array_join(F.transform("held", lambda c, i: F.concat_ws("", F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["clause_title"], F.lit("")), F.lit(" (page "), F.coalesce(c["source_page"].cast("string"), F.lit("?")), F.lit(")\n"), n7(c["clause_text"]))), "\n\n")
    told = cut_lineage(asked.drop("_q").join(block, "case_id").withColumn("_block", text))
    prompt = lambda role, *more: F.concat_ws("\n\n", F.lit(f"Role: {role}"), F.lit("Letter:"), "letter", F.lit("Clauses:"), "_block", *more)
    told = told.withColumn("_for", ask(prompt("insurer"), advocate, "argument string")["argument"]).withColumn("_against", ask(prompt("claimant"), advocate, "argument string")["argument"])
    ruled = cut_lineage(told.withColumn("_v", ask(prompt("adjudicator", F.lit("For:"), "_for", F.lit("Against:"), "_against"), adjudicate, "verdict string, clauses array<int>, letter string")))
    picked = F.transform(retrieval.picked(F.col("held"), F.coalesce("_v.clauses", F.array().cast("array<int>"))), lambda c: c["seq"])
    letter_type = F.coalesce(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])[F.col("_v.verdict")], F.when(F.col("_v.verdict").isNotNull(), "appeal"))
    holds = matching.quotes_hold(F.coalesce("_v.letter", F.lit("")), F.transform("held", lambda c: c["clause_text"]))
    out = ruled.select("case_id", F.col("_v.verdict").alias("verdict"), letter_type.alias("letter_type"), picked.alias("picked"), holds.alias("quotes_hold"), F.when(holds, F.col("_v.letter")).alias("letter_text"))
    return cases.select("case_id", "policy_id").join(out, "case_id", "left")


def in_fixed_order(df: DataFrame, key: str, first: list[str]) -> DataFrame:
    """df in the order of a fixed list of keys, those not in it behind, by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(key)) if first else F.lit(0)
    return df.orderBy(F.when(place > 0, place).otherwise(len(first) + 1), key)


def repeated(df: DataFrame, key: str, times: int) -> DataFrame:
    """Every row `times` times, its key tagged k#1, k#2..., for runs that are to be the same each time."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn(key, F.concat_ws("#", key, F.col("_i").cast("string"))).drop("_i")


def stable(results: DataFrame, key: str, value: str) -> DataFrame:
    """(key, runs, values): of results of repeated runs, how many there are and how many different values they have."""
    return results.groupBy(F.substring_index(key, "#", 1).alias(key)).agg(F.count("*").alias("runs"), F.countDistinct(value).alias("values"))


def load(records: DataFrame, manifests: DataFrame, table: str, allowed: dict[str, int], replace: bool = False) -> bool:
    """Loads records into table if preload finds nothing that blocks; says whether it did."""
    return io.gated_load(records, preload(records, manifests, allowed), table, replace)


def owned(cases: DataFrame, uid: str, owner: str = "uid") -> DataFrame:
    """The cases of one owner; those of nobody are nobody's."""
    return cases.where(F.col(owner) == uid)


def long_enough(rows: DataFrame, column: str, least: int = 10) -> DataFrame:
    """Rows whose text is of `least` characters or more, blanks around it aside."""
    return rows.where(F.length(F.trim(F.coalesce(column, F.lit("")))) >= least)


def missing_fields(columns: list[str]) -> Column:
    """The names of the columns that are null or blank in a row, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in columns]), lambda c: c.isNotNull())

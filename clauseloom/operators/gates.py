"""Record gates, sequence gates and reports over them. A gate is a column: null, or the kind of finding."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.text import n7

# Words that cannot end a clause.
DANGLING = (
    "a an and any are as at be because been being but by can for from had has have her his if in into is its may must no nor not of on onto or our over "
    "per shall such than that the their these this those to under unless until upon was were when where which while who whom whose will with your"
).split()
# Clauses that may carry an address.
CONTACT = r"(?i)grievance|redressal|ombudsman|complaint|\bnotices?\b|customer\s+(?:care|service|support)|contact\s+(?:us|details)|excluded\s+(?:hospitals?|providers?)|how\s+to\s+(?:claim|contact)"
# Signs of a postal address; two of them make one.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
ADDRESS = [
    r"(?i)Registered\s+Office|Corporate\s+Office|Mailing\s+Address",
    r"\b(?:Road|Marg|Street|Lane|Nagar|Chowk|Business\s+Park|Industrial\s+Estate)\b",
    r"\b(?:\d+(?:st|nd|rd|th)\s+Floor|Tower\s+[A-Z]\b|Plot\s+No|Survey\s+No)",
    r"\b[1-9]\d{5}\b",
]
# Signs of a masthead.
PAGE_STAMP = r"\s\d{1,3}\s+/\s+\d{1,3}(?:\s|$)"
NAME_TAIL = r"(?i)\b(?:[A-Z]*MPANY|COMPANY)\s+LIMITED\b|\bINSURANCE\s+CO(?:MPANY)?\.?\s+LTD\b|\bPOLICY\s+WORDINGS\b"
# Words beside which a number is no page number.
NUMERIC_CONTEXT = (
    "rs inr rupees day days month months year years hour hours week weeks percent per cent lakh lakhs lac lacs crore crores age aged upto up to of than least "
    "maximum minimum section clause code excl exel list annexure point points times sum insured no number sl sr item within after before period plan option type "
    "level band and or the a an is are was were shall consecutive st nd rd th first second third pre next last only such these any all each"
).split()
URL_TAIL = r"(?i)(?:https?://|www\.)\S+$|[\w-]+(?:\.[\w-]+)*\.(?:in|com|org|net|gov|co)$"
#: Kinds that keep a record out; an end without punctuation only warns.
BLOCKING = ["truncated", "empty", "embedded_contact_details", "starts_mid_sentence", "continues_previous", "masthead_fragment", "page_number_splice"]


def normal(df: DataFrame, text: str = "clause_text") -> DataFrame:
    """df with _n7, the text with its blanks collapsed: made once, as every gate looks at it."""
    return df.withColumn("_n7", n7(text))


def truncated(text: str = "clause_text", t: Column | None = None) -> Column:
    """empty, truncated or no_terminal_punctuation; null for a text that ends as one should, or in a bracket. t is the text
    with its blanks collapsed, if there is such a column."""
    t = n7(text) if t is None else t
    last = F.right(t, F.lit(1))
    # words are between single blanks: the last two are cut off, so that patterns look at them alone
    end, two = F.substring_index(t, " ", -1), F.substring_index(t, " ", -2)
    word = F.regexp_extract(end, "([A-Za-z]+)$", 1)
    before = F.when(F.contains(two, F.lit(" ")), F.lower(F.regexp_replace(F.substring_index(two, " ", 1), "[^A-Za-z]", ""))).otherwise("")
    letter = F.when(end.rlike(URL_TAIL), "no_terminal_punctuation").when(word.isin(DANGLING) | (F.length(word) == 1) & end.rlike(r"\b[a-z]$"), "truncated").otherwise("no_terminal_punctuation")
    digit = F.when(before.isin(DANGLING), "truncated").otherwise("no_terminal_punctuation")
    return F.when(t == "", "empty").when(last.rlike("[.!?]"), None).when(last.rlike("[,\\-–—]"), "truncated").when(last.rlike("[A-Za-z]"), letter).when(last.rlike("[0-9]"), digit)


def is_contact(title: str = "clause_title", section: str = "section", type_: str = "clause_type", text: str = "clause_text") -> Column:
    labels = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (title, section, type_)])
    return labels.rlike(CONTACT) | F.substring(F.coalesce(text, F.lit("")), 1, 220).rlike(CONTACT)


def contact_details(contact: Column, text: str = "clause_text") -> Column:
    t = F.coalesce(text, F.lit(""))
    signals = sum((t.rlike(p).cast("int") for p in ADDRESS), F.lit(0))
    return F.when(~contact & (F.contains(t, F.lit("@")) & t.rlike(EMAIL) | (signals >= 2)), "embedded_contact_details")


def mid_sentence(text: Column) -> Column:
    """Whether a text opens partway through a sentence: list marks and labels set aside, a first word in small letters;
    a short one with l is a capital I misread."""
    t = F.regexp_replace(text, "^[ \\t\\n\"'“”‘’•▪\\-–—*]+", "")
    t = F.regexp_replace(t, r"(?i)^\s*(?:[\(\[]?(?:[ivxlcdm]{1,4}|[a-z]|\d{1,2})[.)\]]\s+)+", "")
    t = F.regexp_replace(t, r"^\s*[a-z]\s+([A-Z])", "$1")
    word = F.regexp_extract(t, "^([A-Za-z][A-Za-z-]*)", 1)
    return (word != "") & (word == F.lower(word)) & ~((F.left(word, F.lit(1)) == "l") & (F.length(word) <= 3))


def starts_mid_sentence(text: str = "clause_text", title: str = "clause_title", t: Column | None = None) -> Column:
    t = n7(text) if t is None else t
    defined = (F.coalesce(title, F.lit("")) != "") & t.rlike(r"^means\b")
    return F.when((t != "") & ~defined & mid_sentence(t), "starts_mid_sentence")


def masthead(contact: Column, text: str = "clause_text", t: Column | None = None) -> Column:
    t = n7(text) if t is None else t
    low = F.lower(t)
    named = F.contains(low, F.lit("limited")) | F.contains(low, F.lit("ltd")) | F.contains(low, F.lit("wordings"))  # else there is no need to look for whole names
    tail = F.when(named, F.regexp_extract(t, f"({NAME_TAIL})", 1)).otherwise("")
    return F.when(~contact & (t.contains("|") | t.rlike(PAGE_STAMP) | (tail != "") & (tail == F.upper(tail))), "masthead_fragment")


def wedged_numbers(text: str = "clause_text", t: Column | None = None) -> Column:
    """Numbers of one to three digits that stand alone between two words, neither of which goes with numbers."""
    t = n7(text) if t is None else t
    return _wedged(t)


_ALONE = re.compile(r"(?<![\w/.-])\d{1,3}(?![\w/.%-])(?=\s*([A-Za-z]+))", re.ASCII)
_NO_NEIGHBOURS = frozenset(NUMERIC_CONTEXT)


def _word_before(t: str, at: int) -> str:
    """The letters before a place, signs between them and it aside; nothing if digits stand there."""
    while at and not (t[at - 1].isascii() and (t[at - 1].isalnum() or t[at - 1] == "_")):
        at -= 1
    end = at
    while at and t[at - 1].isascii() and t[at - 1].isalpha():
        at -= 1
    return t[at:end]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _wedged(texts: pa.Array) -> pa.Array:
    # by built-ins this takes three searches and arrays of structs outside compiled code, some ten times as long
    out = []
    for t in texts.to_pylist():
        found = []
        for m in _ALONE.finditer(t or ""):
            word = _word_before(t, m.start()).lower()
            if word and word not in _NO_NEIGHBOURS and m.group(1).lower() not in _NO_NEIGHBOURS:
                found.append(int(m.group()))
        out.append(found)
    return pa.array(out, pa.list_(pa.int64()))


def page_splice(page: str = "source_page", text: str = "clause_text", t: Column | None = None, wedged: Column | None = None) -> Column:
    """A wedged number of this page or the next to it; three wedged numbers are an enumeration. wedged has them, if there is
    such a column."""
    n = wedged_numbers(text, t) if wedged is None else wedged
    return F.when(F.col(page).isNotNull() & (F.size(n) < 3) & F.exists(n, lambda x: F.abs(x - F.col(page)) <= 1), "page_number_splice")


GATE_COLUMNS = ["_truncated", "_contact", "_mid", "_masthead", "_splice"]


def gated(df: DataFrame) -> DataFrame:
    """df with a column for each record gate: _truncated, _contact, _mid, _masthead, _splice. What gates share, the text
    with its blanks collapsed, whether a clause may carry an address, and its wedged numbers, is made once a row."""
    t, contact = F.col("_n7"), F.col("_is_contact")
    made = normal(df).withColumn("_is_contact", is_contact()).withColumn("_wedged", wedged_numbers(t=t))
    gates = {"_truncated": truncated(t=t), "_contact": contact_details(contact), "_mid": starts_mid_sentence(t=t), "_masthead": masthead(contact, t=t), "_splice": page_splice(wedged=F.col("_wedged"))}
    return made.withColumns(gates).drop("_n7", "_is_contact", "_wedged")


def with_findings(df: DataFrame) -> DataFrame:
    """df with findings, the kinds of all record gates in order, and blocked."""
    found = gated(df).withColumn("findings", F.filter(F.array(*GATE_COLUMNS), lambda k: k.isNotNull())).drop(*GATE_COLUMNS)
    return found.withColumn("blocked", F.exists("findings", lambda k: k.isin(BLOCKING)))


def continues_previous(df: DataFrame, policy: str = "policy_id", seq: str = "seq", text: str = "clause_text", page: str = "source_page") -> DataFrame:
    """Records whose predecessor in their policy is truncated on this page or the one before, and that open mid-sentence.
    What each text says is made out before rows move; the window is sorted within a policy, whose rows stream through it."""
    w = Window.partitionBy(policy).orderBy(seq)
    told = df.withColumn("_n7", n7(text)).withColumn("_t", truncated(text, F.col("_n7")) == "truncated").withColumn("_m", mid_sentence(F.col("_n7"))).drop("_n7")
    gap = F.col(page) - F.lag(page).over(w)
    return told.withColumn("_hit", F.lag("_t").over(w) & gap.between(0, 1) & F.col("_m")).where("_hit").drop("_t", "_m", "_hit")


def findings_long(df: DataFrame, policy: str = "policy_id", seq: str = "seq") -> DataFrame:
    """(policy, seq, kind): all findings of record and sequence gates."""
    # nulls are dropped after the explosion: a filter inside the array would keep the gates out of compiled code
    records = gated(df).select(policy, seq, F.explode(F.array(*GATE_COLUMNS)).alias("kind")).where(F.col("kind").isNotNull())
    return records.unionAll(continues_previous(df, policy, seq).select(policy, seq, F.lit("continues_previous")))


def accepted(findings: DataFrame, allowed: dict[str, int], seq: str = "seq") -> DataFrame:
    """findings with blocked: of each kind the first n in order are accepted, as allowed (kind -> n) says. Only the
    first n of a kind are ranked, and they are chosen where the rows are, before any shuffle."""
    limit = F.create_map(*[F.lit(x) for k, n in allowed.items() for x in (k, n)]) if allowed else F.create_map().cast("map<string,int>")
    ranked = findings.withColumn("_rn", F.row_number().over(Window.partitionBy("kind").orderBy(seq))).where(F.col("_rn") <= max([0, *allowed.values()]))
    good = ranked.where(F.col("_rn") <= F.coalesce(F.try_element_at(limit, F.col("kind")), F.lit(0))).select("kind", seq, F.lit(True).alias("_ok"))
    return findings.join(good, ["kind", seq], "left").withColumn("blocked", F.col("kind").isin(BLOCKING) & F.col("_ok").isNull()).drop("_ok")


def manifest_findings(man: DataFrame, max_unrecovered: int = 0, max_rate: float = 0.20) -> DataFrame:
    """(run_id, kind) of run manifests that must not be loaded."""
    checks = {
        "chunks_failed": F.size(F.coalesce("chunks_failed", F.array().cast(man.schema["chunks_failed"].dataType))) > 0,
        "unrecovered_boundaries": F.size(F.col("boundary.unrecovered")) > max_unrecovered,
        "verbatim_rejection_rate": F.col("verbatim_rejection_rate") > max_rate,
        "nothing_written": F.coalesce("records_written", F.lit(0)) == 0,
    }
    kinds = F.filter(F.array(*[F.when(c, k) for k, c in checks.items()]), lambda k: k.isNotNull())
    return man.select("run_id", F.explode(kinds).alias("kind"))


def survey(text: str = "clause_text") -> Column:
    """Kinds of furniture left in a text: pipe, masthead_caps, caps_run."""
    t = n7(text)
    # Words of a masthead, and what a run of capitals and a list of reference are.
    mast = r"\b(?:COMPANY\s+LIMITED|POLICY\s+WORDINGS?|INSURANCE\s+CO\b|UIN\s*[:.]|IRDA[I]?\s+REG|\bCIN\b|TOLL\s*FREE|REGISTERED\s+OFFICE)"
    run = r"\b(?:[A-Z][A-Z&]{1,}\b[ ,/-]{1,3}){2,}[A-Z][A-Z&]{1,}\b"
    runs = F.filter(F.regexp_extract_all(F.substring(t, 41, 1 << 30), F.lit(f"({run})"), 1), lambda r: (F.length(r) >= 12) & (~t.rlike(r"(?i)(?:\b\d{2}\.\s){3,}|LIST\s+[IV]+\b") | r.rlike(mast)))
    return F.filter(F.array(F.when(t.contains("|"), "pipe"), F.when(t.rlike(mast), "masthead_caps"), F.when(F.size(runs) > 0, "caps_run")), lambda k: k.isNotNull())


def pivot_with_total(df: DataFrame, row: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts per row and kind, with a TOTAL row."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    rolled = df.rollup(row).agg(F.grouping(row).alias("_g"), *counts)
    return rolled.withColumn(row, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(row))).drop("_g")

import json

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import text
from clauseloom.functions.plain import plain
from clauseloom.functions.quantities import Spellings, quantities
from clauseloom.operators import audits, bills, gates, matching, pages, retrieval, units
from clauseloom.sources import io


def one(spark, column, **values):
    names = ", ".join(f"{json.dumps(v) if isinstance(v, str) else 'null' if v is None else v} as {k}" for k, v in values.items())
    return spark.sql(f"select {names}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, want",
    [("Lіmіt", "Limit"), ("ﬁx", "fix"), ("Ménière", "Ménière"), ("a‍sthma", "asthma"), ("β-thalassaemia", "β-thalassaemia"), ("क्‍लेम", "क्‍लेम"), ("a co‑pay", "a co-pay"), ("", ""), (None, None)],
)
def test_plain(given, want):
    assert plain(given) == want


@pytest.mark.parametrize(
    "said, want",
    [
        ("within sixty (60) days", {("duration_days", 60)}), ("₹ 15 lakh", {("amount_rupees", 1500000)}), ("Rs.5,000/-", {("amount_rupees", 5000)}), ("500000 paise", {("amount_rupees", 5000)}),
        ("800 bps", {("share_percent", 8)}), ("one-twentieth", {("share_percent", 5)}), ("0.40 times", {("share_percent", 40)}), ("rupees twenty-five lakhs", {("amount_rupees", 2500000)}),
        ("aged 70 years or above", set()), ("24:00 hrs", set()), ("Clause 8.20(v) and page 12 of 30", set()), ("1) Day-care charges", set()), ("mon-\nths", set()), ("12 mon-\nths", {("duration_days", 360)}), ("", set()), (None, set()),
    ],
)
def test_quantities(said, want):
    assert quantities(said, Spellings()) == want


def test_units_are_solved_and_flagged(spark):
    recorded = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0), (3, "b", 5.0), (4, "a", 0.0)], "id long, name string, value double")
    amounts = spark.createDataFrame([(1, "k", 60), (2, "k", 90), (3, "k", 25)], "id long, kind string, amount long")
    cands = spark.createDataFrame([("a", "k", 1.0, 0), ("a", "k", 30.0, 1), ("b", "k", 4.9, 0), ("b", "k", 5.1, 1), ("c", "k", 1.0, 0)], "name string, kind string, unit double, order int")
    got = {r["name"]: r for r in units.solved_units(recorded, amounts, cands).collect()}
    assert got["a"]["unit"] == 30 and got["a"]["unique"]
    assert not got["b"]["unique"]
    assert got["c"]["unit"] == 1 and got["c"]["unique"]


def test_truncated_calibrations(spark):
    cases = {"issued by us; or": "truncated", "13 Hepatitis A": "no_terminal_punctuation", "see www.x.in": "no_terminal_punctuation", "36 months to 12": "truncated", "Policy o": "truncated", "Done.": None, "": "empty", "a list (b)": None, "so,": "truncated"}
    for t, want in cases.items():
        assert one(spark, gates.truncated("t"), t=t) == want, t


def test_mid_sentence(spark):
    for t, want in {"a If the Insured": False, "lf any claim": False, "e-Counseling": False, "and then": True, "i. Room rent": False, "": False}.items():
        assert one(spark, gates.mid_sentence(F.col("t")), t=t) == want, t


def test_masthead_and_splice(spark):
    for t, want in {"x MPANY LIMITED | POLICY WORDINGS y": True, "5/50 HPFs and 24/36 months": False, "Policy wordings mean": False, "h 10 / 25 C": True}.items():
        assert (one(spark, gates.masthead(F.lit(False), "t"), t=t) is not None) == want, t
    assert one(spark, gates.page_splice("p", "t"), t="Sum charges 30 wording here", p=30) == "page_number_splice"
    assert one(spark, gates.page_splice("p", "t"), t="red 1 blue 2 green 3 white", p=2) is None
    assert one(spark, gates.page_splice("p", "t"), t="30 days", p=None) is None


def test_survey_counts_all_three_kinds(spark, tmp_path):
    from clauseloom.plans import core

    lead = "The Insured Person shall give notice of the claim to us "
    rows = [("p", lead + "GOLD SHIELD PLAN BOOKLET and wait."), ("p", lead + "by LIST I: GOLD SHIELD PLAN BOOKLET"), ("p", "GOLD SHIELD PLAN BOOKLET " + lead), ("p", "a | b"), ("q", lead + "ABC COMPANY LIMITED, POLICY WORDINGS"), ("q", None)]
    spark.createDataFrame(rows, "policy_id string, clause_text string").write.parquet(str(tmp_path / "numeric_audit_findings.parquet"))
    got = {tuple(r) for r in core.QUERIES["a23_survey"](spark, str(tmp_path)).collect()}
    assert got == {("p", "caps_run", 1), ("p", "pipe", 1), ("q", "masthead_caps", 1), ("q", "caps_run", 1)}


def test_furniture_and_folio(spark):
    rows = [("d", p, f"HEAD OF PAGE {p}\nbody {chr(96 + p)} text\n{p + 4}") for p in range(1, 7)]
    lines = pages.page_lines(spark.createDataFrame(rows, "d string, p int, t string"), "d", "p", "t")
    furniture = pages.learned_furniture(lines)
    assert [r["key"] for r in furniture.collect()] == ["head of page"]
    offsets = pages.folio_offsets(lines).collect()
    assert offsets[0]["off"] == 4 and offsets[0]["agreeing"] == 6
    left = pages.stripped(lines, furniture, pages.folio_offsets(lines))
    assert left.count() == 6
    assert pages.folio_offsets(lines.where("page < 3")).count() == 0


def test_stripped_drops_pieces_of_furniture(spark):
    head = "Aran Health General Assurance Wording of the Gold Shield Plan"
    rows = [("d", p, f"{head}\nfirst {c}\nsecond {c}\nthird {c}\nlast {c}") for p, c in enumerate("abcd", 1)]
    rows += [("d", 5, f"{head[12:]}\nx\ny\nz"), ("d", 6, f"{head[:26]} claims\nx b\ny b\nz b"), ("d", 7, f"x c\ny c\n{head[:26]} claims\nz c\nw c"), ("e", 1, f"{head[12:]}\nv")]
    lines = pages.page_lines(spark.createDataFrame(rows, "d string, p int, t string"), "d", "p", "t")
    left = pages.stripped(lines, pages.learned_furniture(lines), pages.folio_offsets(lines)).collect()
    assert {(r["doc"], r["page"]) for r in left if "Shield" in r["line"] or "Aran" in r["line"]} == {("d", 7), ("e", 1)}
    assert len(left) == 16 + 3 + 3 + 5 + 2


def test_chunks_carry_only_where_length_ends_them(spark):
    given = spark.createDataFrame([("d", 1, "a", "x" * 40), ("d", 2, "a", "y" * 40), ("d", 3, "b", "z")], "doc string, page long, section string, text string")
    got = pages.chunks(given, 60, 10).orderBy("chunk").collect()
    assert [(r["section"], r["start_page"], r["end_page"]) for r in got] == [("a", 1, 1), ("a", 1, 2), ("b", 3, 3)]
    assert got[1]["text"].startswith("[[page 1]]\n" + "x" * 10 + "\n[[page 2]]")
    assert got[2]["text"] == "[[page 3]]\nz"
    assert pages.chunks(given.limit(0), 60, 10).count() == 0


def test_silent_runs(spark):
    sent = spark.createDataFrame([("d", p) for p in range(1, 21)], "doc string, page int")
    held = spark.createDataFrame([("d", p) for p in (1, 2, 12, 16, 19)], "doc string, page int")
    got = {(r["first"], r["last"]): r["level"] for r in pages.coverage_kinds(pages.silent_runs(sent, held)).collect()}
    assert got == {(3, 11): "block", (13, 15): "warn", (17, 18): "note", (20, 20): "note"}


def test_contained_keeps_the_longest(spark):
    long = "the insured person shall settle the discharge summary in full today"
    part = "shall settle the discharge summary in full"
    rows = [("d", 1, 5, part), ("d", 2, 6, long), ("d", 3, 8, part), ("d", 4, 6, "short"), ("d", 5, None, part), ("d", 6, 5, part)]
    got = {r["seq"] for r in matching.contained(spark.createDataFrame(rows, "doc string, seq int, page int, text string")).collect()}
    assert got == {2, 3, 4, 5}


def test_run_matches(spark):
    s = "doc string, seq int, page int, title string, text string"
    a = spark.createDataFrame([("d", 1, 1, "T", "one"), ("d", 2, 1, "t", "quite another thing"), ("d", 3, 9, "x", "same words here")], s)
    b = spark.createDataFrame([("d", 7, 1, "T.", "uno"), ("d", 8, 2, "y", "Same words here"), ("d", 9, 1, None, None)], s)
    m = matching.run_matches(a, b)
    assert {tuple(r)[1:] for r in m.collect()} == {(1, 7, 1), (3, 8, 2)}
    assert {r["seq"] for r in matching.gone(a, b, m).collect()} == {2}


def test_every_run_meets_the_one_before_it(spark, tmp_path):
    from clauseloom.plans import core

    rows = [("p", 1, "p_v9_x", "one"), ("p", 2, "p_v10_x", "one"), ("p", 3, "p_v17_x", "one and more"), ("p", 4, "p_v9_x", "lost"), ("q", 5, "q_v15_x", "one"), ("q", 6, "q_v17_x", "one"), ("r", 7, "r_v16_x", "one"), ("q", 8, "q_v15_x", None)]
    full = [(d, i, 1, "T" if t and t.startswith("one") else f"only {i}", t, f) for d, i, f, t in rows]
    spark.createDataFrame(full, "policy_id string, finding_id long, source_page long, clause_title string, clause_text string, source_file string").write.parquet(str(tmp_path / "numeric_audit_findings.parquet"))
    run = lambda name: core.QUERIES[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("j2_run_matches")} == {("p", 1, 2, 1), ("p", 2, 3, 1), ("q", 5, 6, 1)}
    assert {(r["doc"], r["matched"], r["same"], r["changed"], r["delta"]) for r in run("a20_diff_stats")} == {("p", 2, 1, 1, 9), ("q", 1, 1, 0, 0)}
    assert {(r["doc"], r["seq"]) for r in run("j4_gone")} == {("p", 4)}


def test_verbatim_and_runs(spark):
    source = "The Insured Person shall give notice with-\nin ten days of “discharge” and nothing else will be asked of them by the Company at all."
    quote = "shall give notice within ten days of \"discharge\""
    rows = [(quote, source), ("x" * 80, source), (None, source), (source[:100].replace("ten", "ten") + " Q", source)]
    how = [r["how"] for r in matching.verbatim(spark.createDataFrame(rows, "q string, s string").coalesce(1), "q", "s").collect()]
    assert how == ["exact", "absent", "absent", "run"]
    assert matching.longest_common_run("abcdefg", "xxcdefyy") == 4 and matching.longest_common_run("", "a") == 0


def test_short_fields_have_all_fields_and_verdicts(spark):
    s = "vec_id long, policy_id string, source_page long, clause_text string, exclusion_code string, clause_id string, clause_title string, cap_basis string"
    rows = [
        (1, "p", 5, "Paid per day only.", "Excl 04", "4.1", "Room Rent", "per day"), (2, "p", 6, "Paid per-day.", "Code- Excl04", "9.9", "room-rent", "per day"), (3, "p", 9, None, "Excl04", "4.1", "Room Rent", "per day"),
        (4, "q", 5, "x", None, None, "Room Rent", None), (5, "p", 5, "x", "Excl05", None, " ", ""),
    ]
    texts = spark.createDataFrame([("p", 5, "4.1 Room  rent (Excl 04)"), ("p", 6, None), ("p", 12, "Room rent")], "policy_id string, source_page long, clause_text string")
    got = {(r["field"], r["verdict"]): (r["n"], r["share"]) for r in matching.short_fields(spark.createDataFrame(rows, s), texts).collect()}
    assert got == {
        ("exclusion_code", "verbatim"): (1, 0.25), ("exclusion_code", "altered"): (1, 0.25), ("exclusion_code", "absent"): (2, 0.5), ("clause_id", "verbatim"): (1, 0.333333), ("clause_id", "absent"): (2, 0.666667),
        ("clause_title", "verbatim"): (1, 0.25), ("clause_title", "normalised"): (1, 0.25), ("clause_title", "absent"): (2, 0.5), ("cap_basis", "verbatim"): (1, 0.333333), ("cap_basis", "normalised"): (1, 0.333333), ("cap_basis", "absent"): (1, 0.333333),
    }


def test_mentions_and_mismatch(spark):
    names = ["Aran Health", "Ascend", "Aran Health Gold", "Care"]
    assert matching.mentions("We ascend with care. Aran Health Gold applies.", names) == ["Aran Health Gold"]
    assert matching.mentions(None, names) == [] and matching.mentions("Care", []) == []
    c = matching.mismatch(F.expr("n"), F.lit("P"), F.lit("I"), F.expr("array('P','P2')"), F.expr("array('I','I2')"))
    for named, want in (("array('P','P2')", False), ("array('P2')", True), ("array('I')", False), ("array('I2')", True), ("cast(array() as array<string>)", False)):
        assert spark.sql(f"select {named} as n").select(c.alias("x")).first()["x"] == want


def test_a_page_is_searched_whole_and_in_pieces(spark, monkeypatch):
    texts = [("p", 5, f"excl 0{n} of the clause number {n}", [f"0{n}"]) for n in range(9)] + [(None, 5, "lost", []), ("p", None, "lost", [])]
    seek = [("clause number 7", "clausenumber7", ""), ("clause-number 8", "clausenumber8", ""), ("excl-08", "excl-08", "08"), ("number 9", "number9", "")]
    values = [("p", 5, 4, 2, ("exclusion_code" if d else "clause_title", v, w, d)) for v, w, d in seek]
    values += [(None, 5, 5, 1, ("clause_title", "lost", "lost", "")), ("p", None, None, 1, ("clause_title", "lost", "lost", "")), ("q", 1, 1, 1, ("clause_title", "lost", "lost", ""))]
    v = spark.createDataFrame(values, "policy_id string, source_page long, at long, n long, x struct<field: string, v7: string, v4: string, d: string>")
    t = spark.createDataFrame(texts, "policy_id string, source_page long, t7 string, codes array<string>")
    for most in (1 << 18, 30):
        monkeypatch.setattr(matching, "HAY", most)
        got = {(r["policy_id"], r["at"], r["x"]["v7"]): (r["r"], r["n"]) for r in matching._sought(v, t).collect()}
        assert [got["p", 4, x[0]] for x in seek] == [(1, 2), (2, 2), (3, 2), (4, 2)]
        assert got[None, 5, "lost"] == got["p", None, "lost"] == got["q", 1, "lost"] == (4, 1) and len(got) == 7


def test_omissions(spark):
    span = "and the cost of the second opinion that the board may ask for"
    rows = [("7", "a", f"base words {span} end of it"), ("7", "b", f"base words {span} end of it all"), ("7", "c", "base words end of it")]
    got = matching.omissions(spark.createDataFrame(rows, "code string, policy string, text string")).collect()
    assert {(r["policy"], r["witnesses"]) for r in got} == {("c", 2)}


def test_bills(spark):
    items = spark.createDataFrame([(1, "EYE PAD", "not_payable", "d"), (2, "CAP / X", "not_payable", "d"), (3, "EAU-DE-COLOGNE / ROOM", "subsume_room", "d"), (4, "EYE PAD LARGE", "not_payable", "d")], "o int, item_name string, category string, category_description string")
    text_ = "1. EYE PADS Rs. 1,200.50\nCAPSULE 20\nROOM RENT 3000\n12 34\nEAU DE COLOGNE\nTotal 1.234"
    lines = bills.bill_lines(spark.createDataFrame([(1, text_), (2, None), (3, "")], "id int, t string"), "id", "t")
    got = {r["description"]: (r["amount"], r["item"]) for r in bills.matched_lines(lines, items, "o").collect()}
    assert got["EYE PADS"] == (1200.5, 1)
    assert got["CAPSULE"][1] is None and got["ROOM RENT"][1] is None
    assert got["EAU DE COLOGNE"] == (None, 3)
    t = bills.totals(bills.matched_lines(lines, items, "o")).first()
    assert t["lines_flagged"] == 2 and t["without_amount"] == 1 and t["flagged_total"] == 1200.5


def test_numbers_from_text():
    assert [x["value"] for x in audits.find_durations("36 months")] == [1080.0, 1095.0, 1096.0]
    assert [x["value"] for x in audits.find_durations("thirty-six (36) days")] == [36.0]
    assert audits.find_durations("sixty continuous months")[0]["value"] == 1800
    assert {x["value"] for x in audits.find_money("Rs.5000/- or 5 Lacs or Rupees Five Lakh")} == {5000.0, 500000.0}
    assert [x["value"] for x in audits.find_percents("forty per cent and 5 %")] == [40.0, 5.0]
    assert audits.find_money(None) == [] and audits.find_durations("and days") == [] and audits.find_durations("2001 days") == []


def test_judge(spark):
    c = lambda v, t: audits.judge(F.expr(v).cast("double"), F.from_json(F.lit(json.dumps([{"value": 30.0}])), "array<struct<value:double,convention:string,raw:string>>"), 1.0, F.lit(t), literal=True)
    got = spark.range(1).select(c("30.5", "").alias("a"), c("null", "").alias("b"), c("0", "").alias("z"), c("77", "no").alias("d"), c("7700", "7,700").alias("l")).first()
    assert tuple(got) == ("agree", "missed", "zero", "disagree", "agree_literal")


def test_evidence_gate_judges_every_field_by_its_page(spark):
    text_ = "A waiting period of 36 months applies; the limit is Rs. 50,000 or 10% of it, at most 800 bps, after 10 weeks."
    rows = [
        ("waiting_period_months", 36.0, "36 months"), ("wait_yrs", 3.0, "36 months"), ("waitPeriodWeeks", 10.0, "10 weeks"), ("cap_inr_thousand", 50.0, "Rs. 50,000"), ("monetary_cap", 50000.0, "rs. 50,000"),
        ("cap_bps", 800.0, "800 bps"), ("capFraction", 0.1, "10%"), ("CAP_PCT", 12.0, "10%"), ("percent_cap", 20.0, "20%"), ("percent_cap", None, "10%"), ("capPaise", 1.0, " "), ("no_such", 1.0, "10%"),
    ]
    log = spark.createDataFrame([("p", 1, *r) for r in rows] + [("p", 2, "waiting_period_days", 30.0, "30 days")], "policy_id string, source_page long, field string, after double, evidence string")
    texts = spark.createDataFrame([("p", 1, text_), ("p", 1, None), ("p", 2, "Pay within 30 days."), ("q", 1, "20%")], "policy_id string, source_page long, clause_text string")
    got = {(r["field"], r["after"]): r["reason"] for r in audits.evidence_reasons(log, texts).collect()}
    bad = {("wait_yrs", 3.0): "not_derivable", ("CAP_PCT", 12.0): "not_derivable", ("percent_cap", 20.0): "not_in_text", ("percent_cap", None): "null", ("capPaise", 1.0): "no_evidence", ("no_such", 1.0): "not_derivable", ("waiting_period_days", 30.0): "no_wait_wording"}
    assert got == {(f, v): "ok" for f, v, _ in rows} | bad


def test_acceptance(spark):
    f = spark.createDataFrame([("truncated", i) for i in (1, 2, 3)] + [("no_terminal_punctuation", 4)], "kind string, seq int")
    assert {r["seq"] for r in gates.accepted(f, {"truncated": 2}).where("blocked").collect()} == {3}
    assert {r["seq"] for r in gates.accepted(f, {}).where("blocked").collect()} == {1, 2, 3}


def test_topk_filters_before_it_ranks(spark, tmp_path):
    rows = [(i, "p" if i % 2 else "q", [float(i), 1.0]) for i in range(1, 9)] + [(9, "p", None), (10, "p", [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, policy_id string, embedding array<double>").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    q = spark.createDataFrame([([1.0, 1.0],)], "q array<double>")
    top = retrieval.vector_topk(e, q, 2, F.col("policy_id") == "p")
    assert [r["vec_id"] for r in top.collect()] == [1, 3]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(policy_id,p)" in plan


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    good = {"clause_text": "x.", "source_page": 1, "policy_id": None, "insurer": "i", "policy_name": "n", "clause_title": None}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n{bad\n" + json.dumps(good | {"policy_id": "p"}) + "\n")
    df = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), io.CLAUSES, default_policy=True)
    assert [r["policy_id"].endswith("a.jsonl") for r in df.orderBy("seq").collect()] == [True, False]
    assert io.bad_lines(spark, str(tmp_path / "a.jsonl")).first()["bad"] == 1
    with pytest.raises(Exception, match="bad JSON"):
        io.read_jsonl(spark, str(tmp_path / "a.jsonl"), io.CLAUSES, "fail").collect()
    io.write_jsonl(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and lines[0]["clause_title"] is None and "seq" not in lines[0]


def test_streaming_gates(spark, tmp_path):
    from clauseloom.streaming import gates as sg

    (tmp_path / "in").mkdir()
    base = {"source_page": 1, "policy_id": "p", "insurer": "i", "policy_name": "n", "clause_title": "t"}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(base | {"clause_text": t}) for t in ("All is well.", "cut off by the")))
    sg.write_clean(sg.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["clause_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["All is well."]


def test_text_helpers(spark):
    assert one(spark, text.indian_digits("n"), n=12345678) == "1,23,45,678" and one(spark, text.indian_digits("n"), n=-1234) == "-1,234" and one(spark, text.indian_digits("n"), n=12) == "12"
    assert [x["before"] for x in one(spark, text.occurrences("t", "day"), t="day 5 day")] == ["", "day 5 "]
    assert one(spark, text.slug("t"), t="Aran Health & Co.") == "aran_health_co"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "policy_id string, seq int, clause_text string, clause_title string, section string, clause_type string, source_page long")
    assert gates.findings_long(none).count() == 0
    assert matching.contained(none.selectExpr("policy_id as doc", "seq", "source_page as page", "clause_text as text")).count() == 0
    assert units.stated(none, "seq", "clause_text").count() == 0


def test_identity_of_columns_solves_their_units(spark):
    rows = [(2.0 * v * d * 1000 / 1000, d, v) for d in (0.5, 1.0, 2.5) for v in (1.0, 3.0, 8.0)]
    df = spark.createDataFrame([(m / 2.0, d, v) for m, d, v in rows] + [(None, 1.0, 1.0), (0.0, 1.0, 1.0), (5.0, -1.0, 1.0)], "mass double, density double, volume double")
    identity = {"mass": 1, "density": -1, "volume": -1}
    known = units.solved_combinations(df, identity, {"mass": [1.0, 1000.0], "density": [1.0], "volume": [1.0, 0.001]}).collect()
    assert known[0]["units"] == {"mass": 1.0, "density": 1.0, "volume": 1.0} and known[0]["residual"] < 1e-9 and known[0]["unique"] and known[0]["rows"] == 9
    # grams and millilitres fit as well as kilograms and litres: flagged
    both = units.solved_combinations(df, identity, {"mass": [1.0, 0.001], "density": [1.0], "volume": [1.0, 0.001]}).collect()
    assert [r["unique"] for r in both] == [False] * 4 and both[0]["residual"] == both[1]["residual"] < 1e-9 < both[2]["residual"]
    assert not any(r["unique"] for r in units.solved_combinations(df.limit(0), identity, {"mass": [1.0], "density": [1.0], "volume": [1.0]}).collect())
    with pytest.raises(ValueError, match="combinations"):
        units.solved_combinations(df, identity, {c: [float(i + 1) for i in range(20)] for c in identity})


def test_free_units_are_held_against_names(spark):
    text = "the waiting period is {} days and the limit is Rs. {} lakh"
    rows = [(i, text.format(30 * (i % 4 + 1), i % 7 + 1), {"wait_days": (30.0 * (i % 4 + 1),), "cap_lakh": (float(i % 7 + 1),), "wrong_years": (30.0 * (i % 4 + 1),)}) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, fields map<string, struct<model: double>>")
    names = spark.createDataFrame([("wait_days",), ("cap_lakh",), ("wrong_years",)], "name string")
    got = {r["name"]: r for r in units.common_units(df, "id", "t", "fields", names, "name")[1].collect()}
    assert got["wait_days"]["free_unit"] == got["wait_days"]["unit"] == 1.0 and got["wait_days"]["free_unique"]
    assert got["cap_lakh"]["free_unit"] == got["cap_lakh"]["unit"] == 1e5
    assert got["wrong_years"]["unit"] == 365.0 and got["wrong_years"]["free_unit"] == 1.0


PAGES = [(1, "preamble", "a" * 30), (2, "preamble", "b" * 30), (3, "preamble", ""), (4, "preamble", "first line\n" + "c" * 40), (5, "exclusion", "d" * 20), (6, "exclusion", "short")]


def test_chunks_by_length_and_section(spark):
    df = spark.createDataFrame([("p", *p) for p in PAGES] + [("q", 1, None, None)], "doc string, page long, section string, text string")
    got = {r["chunk"]: r for r in pages.chunks(df, 100, 20).collect()}
    assert [(got[k]["section"], got[k]["start_page"], got[k]["end_page"]) for k in sorted(got)] == [("preamble", 1, 2), ("preamble", 2, 4), ("exclusion", 5, 6)]
    # the end of page 2 is carried, without its first line only if it had to be shortened
    assert got[1]["text"] == "[[page 2]]\n" + "b" * 20 + "\n[[page 4]]\nfirst line\n" + "c" * 40
    whole = {r["chunk"]: r["text"] for r in pages.chunks(spark.createDataFrame([("p", 1, "s", "x\ny"), ("p", 2, "s", "z" * 90)], df.schema), 100, 20).collect()}
    assert whole[1].startswith("[[page 1]]\nx\ny\n[[page 2]]")
    report = pages.boundary_report(df, 100, 20).collect()
    assert [(r["doc"], r["chunks"], r["boundaries"], r["cut"], r["recoverable"], len(r["unrecovered"])) for r in report] == [("p", 3, 1, 1, 0, 1)]


def test_matches_in_turn(spark):
    a = [("d", 1, 3, "T", "x" * 80), ("d", 2, 3, "T", "y" * 80), ("d", 3, 9, "other", "x" * 80), ("d", 4, None, None, None)]
    b = [("d", 11, 3, "T", "x" * 80), ("d", 12, 4, "U", "x" * 80), ("d", 13, 4, "V", "q" * 80), ("e", 14, 3, "T", "x" * 80)]
    shape = "doc string, seq long, page long, title string, text string"
    got = {(r["seq_a"], r["seq_b"], r["tier"]) for r in matching.run_matches(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape)).collect()}
    assert got == {(1, 11, 1), (3, 12, 2)}
    # the second tier of an earlier record takes what the first tier of a later one would have
    a = [("d", 1, 1, "A", "x" * 80), ("d", 2, 3, "T", "z" * 80)]
    got = {(r["seq_a"], r["seq_b"], r["tier"]) for r in matching.run_matches(spark.createDataFrame(a, shape), spark.createDataFrame(b[:1], shape)).collect()}
    assert got == {(1, 11, 2)}
    assert matching.run_matches(spark.createDataFrame([], shape), spark.createDataFrame(b, shape)).count() == 0


def test_gone_is_neither_matched_nor_contained(spark):
    shape = "doc string, seq long, page long, title string, text string"
    body = "the insured shall settle all charges of the hospital within thirty days of discharge and submit every bill"
    old = [("d", 1, 1, "A", body), ("d", 2, 1, "B", "a clause that no later run holds at all"), ("d", 3, 1, "C", "short"), ("d", 4, 1, "D", None), ("e", 5, 1, "A", body)]
    new = [("d", 9, 2, "Z", "before " + body + " after; this is short")]
    x, y = spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)
    assert {r["seq"] for r in matching.gone(x, y, matching.run_matches(x, y)).collect()} == {2, 5}


def test_medoid_and_letters_and_pages(spark):
    holders = [(1, "a", "the cover is void"), (1, "b", "the cover is void now"), (1, "c", "zzzz qqqq"), (2, "a", "short"), (2, "b", "the longest one")]
    assert {(r["code"], r["policy"]) for r in matching.medoids(spark.createDataFrame(holders, "code int, policy string, text string")).collect()} == {(1, "a"), (2, "b")}
    df = spark.createDataFrame([('as "the hospital shall not charge for gloves" says', ["the hospital shall not  charge for gloves ever"])], "letter string, src array<string>")
    assert df.select(matching.quotes_hold("letter", "src").alias("x")).first()["x"]
    assert not df.select(matching.quotes_hold(F.lit('"the hospital may always charge for gloves"'), "src").alias("x")).first()["x"]
    assert df.select(matching.is_verbatim(F.lit("too short"), "src").alias("x")).first()["x"]
    chunk = "[[page 4]]\n" + "first words here " * 20 + "\n[[page 5]]\n" + "more of the same " * 10 + "the clause starts on this page " + "and goes on " * 10
    place = lambda t, p: spark.range(1).select(matching.resolve_page(F.lit(t), F.lit(chunk), F.lit(p).cast("long"), F.lit(4).cast("long")).alias("x")).first()["x"]
    assert place("whatever", 5) == 5 and place("the clause starts on this page", None) == 5 and place("first words", 9) == 4 and place("not there", None) == 4


def test_lone_serials_join_the_next_line(spark):
    rows = [("d", 1, 0, "LIST I - not payable"), ("d", 1, 1, "1"), ("d", 1, 2, "BABY FOOD"), ("d", 1, 3, "2. BEAUTY SERVICES"), ("d", 1, 4, "3"), ("d", 1, 5, "4 CARRY BAGS"), ("d", 2, 0, "LIST II"), ("d", 2, 1, "1. CREAMS POWDERS"), ("d", 3, 0, "OMBUDSMAN offices"), ("d", 3, 1, "9. NOT AN ITEM")]
    got = {(r["category"], r["item"]) for r in pages.list_items(spark.createDataFrame(rows, "doc string, page long, pos int, line string")).collect()}
    assert got == {("not_payable", "BABY FOOD"), ("not_payable", "BEAUTY SERVICES"), ("not_payable", "CARRY BAGS"), ("subsume_room", "CREAMS POWDERS")}


def test_line_numbers_and_bad_lines(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"policy_id": "p"}\n\nnot json\n{"policy_id": null}\n')
    schema = T.StructType([T.StructField("policy_id", T.StringType())])
    rows = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, default_policy=True).orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 4] and rows[0]["policy_id"] == "p" and rows[1]["policy_id"].endswith("a.jsonl")
    with pytest.raises(Exception, match="a.jsonl:3"):
        io.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, mode="fail").collect()


def test_calls_are_paced_and_repeated():
    from clauseloom.functions import calls

    now, slept = [0.0], []
    sleep = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    paced = calls.throttled(lambda x: x, 2, lambda: now[0], sleep)
    assert [paced(i) for i in range(3)] == [0, 1, 2] and slept == [60.0]
    errors, waits = iter([ValueError("no json"), RuntimeError("429, retry in 7 s"), ConnectionError("gone")]), []

    def call():
        for e in errors:
            raise e
        return "done"

    assert calls.retried(call, 4, waits.append)() == "done" and waits == [1.0, 9.0, 20.0]
    with pytest.raises(ValueError):
        calls.retried(lambda: calls.fenced_json("no"), 2, waits.append)()
    assert calls.fenced_json('```json\n{"a": 1}\n```') == [{"a": 1}] and calls.fenced_json("[]") == [] and calls.retry_delay("wait") is None


def _run(texts, **more):
    return [("d", i, p, f"title {i}", t) for i, (p, t) in enumerate(texts)]


def test_records_from_pages(spark):
    from clauseloom.operators import pipelines

    body = ["the insured person shall settle the charges of the hospital", "no cover accrues for cosmetic surgery of any kind", "claims are paid within thirty days of the last document"]
    words = ["", "alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [("d", p, "ACME HEALTH GOLD BOOKLET\n" + "STANDARD CONDITIONS\n" * (p == 1) + "\n".join(f"{t} as for {words[p]} {p}." for t in body) + f"\n{p}") for p in range(1, 7)] + [("d", 7, ""), ("d", 8, None)]
    records, man = pipelines.extract_records(spark.createDataFrame(rows, "doc string, page long, text string"), most=400, overlap=80)
    got, m = records.collect(), man.first()
    assert {(r["page"], r["text"]) for r in got} == {(p, f"{t} as for {words[p]} {p}.") for p in range(1, 7) for t in body}
    assert m["pages"] == 8 and m["records_written"] == 18 and m["records_deduped"] == m["records_extracted"] - 18 > 0 and m["verbatim_rejected"] == 0 and m["pages_sent"] == [1, 2, 3, 4, 5, 6]

    def model(text):
        if "alpha 1." in text:  # in the second chunk too, carried
            raise RuntimeError("no answer")
        return [{"clause_title": "T", "clause_text": "words that stand nowhere in the chunk at all", "source_page": 2}]

    _, man = pipelines.extract_records(spark.createDataFrame(rows, "doc string, page long, text string"), model, most=400, overlap=80)
    m = man.first()
    assert m["chunks_failed"] == [0, 1] and m["records_written"] == 0 and m["verbatim_rejection_rate"] == 1.0


def test_clauses_are_judged_where_their_chunk_is(spark):
    from clauseloom.operators import pipelines

    lines = [f"the insured person {n} shall settle the charges of the hospital" for n in range(3000)]
    text = "[[page 3]]\n" + "\n".join(lines)

    def model(t):
        if "fail" in t:
            raise RuntimeError("no answer")
        return pipelines.paragraphs(t) + [{"clause_title": "T", "clause_text": "words that stand nowhere in it"}, {"clause_title": "T", "clause_text": lines[0]}]

    chunks = spark.createDataFrame([("d", 0, text, 3), ("d", 1, "fail", 4)], "doc string, chunk int, text string, start_page long").coalesce(1)
    found = pipelines.extracted(chunks, model)
    assert "text" not in found.columns  # a copy of the chunk for each of its clauses takes the memory of the square of a page
    got = found.collect()
    assert [r["how"] for r in got] == ["exact"] * 3000 + ["absent", "exact", "absent"] and [r["failed"] for r in got] == [False] * 3002 + [True]
    assert {r["page"] for r in got} == {3, None}


def test_has_run_is_the_longest_common_run():
    import random

    rng = random.Random(1)
    for _ in range(2000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 14)))
        b = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))
        for least in range(1, 15):
            assert matching.has_run(a, b, least) == (matching.longest_common_run(a, b) >= least), (a, b, least)


def test_runs_are_merged_and_loaded(spark):
    from clauseloom.operators import pipelines

    shape = "doc string, seq long, page long, title string, text string"
    keep, lost, cut = "The insurer pays for the room of the insured person.", "A clause that the new run has lost altogether, whole.", "A clause that was cut and lost and ends with the"
    old, new = _run([(1, keep), (2, lost), (3, cut)]), [("d", 10, 1, "title 0", keep), ("d", 11, 1, "x", "The insurer pays for the room")]
    records, man = pipelines.merge_recovered(spark.createDataFrame(old, shape), spark.createDataFrame(new, shape))
    assert {(r["text"], r["recovered"]) for r in records.collect()} == {(keep, False), (lost, True)}
    m = man.first()
    assert m["recovered_count"] == 1 and m["recovered_clauses"][0]["chars"] == len(lost) and m["recovery_refused"][0]["failed"] == ["truncated"]
    other = spark.createDataFrame([("e", 1, 1, "t", keep), ("d", 5, 1, "t", "replaced")], shape)
    corpus = pipelines.build_corpus(other, spark.createDataFrame(old, shape), spark.createDataFrame(new, shape))
    assert {(r["doc"], r["origin"]) for r in corpus.collect()} == {("e", "unchanged"), ("d", "new"), ("d", "recovered")}
    recs = spark.createDataFrame([("p", 1, 4, "Ends well.", "t", "s", "x"), ("p", 2, 5, "ends with the", "t", "s", "x"), ("q", 3, 1, "Fine as it is.", "t", "s", "x")], "policy_id string, seq long, source_page long, clause_text string, clause_title string, section string, clause_type string")
    mans = spark.createDataFrame([(7, "p", list(range(1, 20)), [], (0,), 0.5, 3)], "run_id long, policy_id string, pages_sent array<bigint>, chunks_failed array<int>, boundary struct<n: int>, verbatim_rejection_rate double, records_written long").withColumn("boundary", F.struct(F.array().cast("array<int>").alias("unrecovered")))
    found = {(r["policy_id"], r["kind"], r["blocked"]) for r in pipelines.preload(recs, mans, {}).collect()}
    assert {("p", "truncated", True), ("p", "verbatim_rejection_rate", True), ("p", "silent_pages", True), ("q", "no_manifest", True)} <= found
    assert ("p", "truncated", False) in {(r["policy_id"], r["kind"], r["blocked"]) for r in pipelines.preload(recs, mans, {"truncated": 1}).collect()}
    assert pipelines.kinds_of(pipelines.preload(recs, mans, {})).first()["n"] >= 1


def test_second_pass_of_numbers(spark):
    from clauseloom.operators import pipelines

    rows = [(1, "waiting_period", "A waiting period of 30 days applies.", None, None, None), (2, "exclusion", "The limit is Rs. 5,000 for each claim.", None, 7000, None), (3, "exclusion", "Nothing is stated here.", None, 900, None), (4, "definition", "It lasts 30 days.", None, None, None)]
    c = spark.createDataFrame(rows, "seq long, clause_type string, clause_text string, waiting_period_days long, monetary_cap long, percent_cap double").withColumns({"policy_id": F.lit("p"), "source_page": F.lit(1).cast("long")})
    got = {r["seq"]: (r["before"], r["after"], r["reason"]) for r in pipelines.numeric_pass(pipelines.needing_numbers(c)).collect()}
    assert got == {1: (None, 30.0, "ok"), 2: (7000.0, 5000.0, "ok"), 3: (900.0, None, "null")}
    n = {r["field"]: tuple(r)[1:] for r in pipelines.pass_counters(pipelines.numeric_pass(pipelines.needing_numbers(c))).collect()}
    assert n == {"waiting_period_days": (1, 0, 0, 0), "monetary_cap": (0, 1, 1, 0)}
    lies = pipelines.numeric_pass(pipelines.needing_numbers(c), lambda f, t: (12.0, "a text that is not there"))
    assert {r["reason"] for r in lies.collect()} == {"not_in_text"}


def test_cases_with_stand_ins(spark):
    from clauseloom.operators import pipelines

    vec = lambda k: [1.0 if i == k else 0.0 for i in range(96)]
    cl = spark.createDataFrame([("p", 1, "T", "this excludes dental work", 3, vec(0)), ("p", 2, "U", "this covers it", 4, vec(1)), ("p", 3, "V", "no vector", 5, None)], "policy_id string, seq long, clause_title string, clause_text string, source_page long, embedding array<double>")
    cases = spark.createDataFrame([(1, "p", "why"), (2, "gone", "why"), (3, "p", "bad")], "case_id long, policy_id string, letter string")

    def judge(prompt):
        if "\n\nbad\n\n" in prompt:
            raise RuntimeError("no answer")
        return {"verdict": "insurer_right", "clauses": [2, 9], "letter": 'they say "this covers it and much more besides"'}

    out = pipelines.analysed_cases(cases, cl, F.array(*[F.lit(x) for x in vec(0)]), lambda p: {"argument": "x"}, judge, 2)
    got = {r["case_id"]: r for r in out.collect()}
    assert got[1]["verdict"] == "insurer_right" and got[1]["letter_type"] == "substantiate" and got[1]["picked"] == [2] and got[1]["quotes_hold"] is False and got[1]["letter_text"] is None
    assert got[2]["verdict"] is None and got[3]["verdict"] is None and len(got) == 3


def test_nearest_in_blocks_is_what_all_pairs_say(spark, monkeypatch):
    import random

    rng, row = random.Random(2), lambda n: [round(rng.uniform(-1, 1), 1) for _ in range(n)]
    vectors = [(p, n * 2, n, v) for n in range(60) for p, v in [(rng.choice("pq"), row(3))]]
    vectors += [("p", 200 + n, 100 + n, vectors[0][3]) for n in range(9)]  # level: the first by seq count
    queries = [(n, rng.choice("pqr"), row(3)) for n in range(30)] + [(98, "p", [0.0, 0.0, 0.0]), (99, "p", None)]
    v = spark.createDataFrame(vectors, "policy_id string, seq long, _row long, embedding array<float>")
    q = spark.createDataFrame(queries, "case_id long, policy_id string, _q array<double>")
    pairs = q.join(v, "policy_id").withColumn("d", F.round(1 - text.cosine("_q", "embedding"), 9)).where("d is not null").withColumn("_o", F.struct("d", "seq"))
    want = {(r["case_id"], r["_row"], r["seq"], r["d"]) for r in audits.first_of_each(pairs, ["case_id"], "_o", 4).collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "PRODUCT", 20)
    got = [(r["case_id"], r["_row"], r["seq"], r["d"]) for r in retrieval.nearest(q, v, 4).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_orders_and_repeats(spark):
    from clauseloom.operators import pipelines

    df = spark.createDataFrame([("b",), ("z",), ("a",), ("m",)], "k string")
    assert [r["k"] for r in pipelines.in_fixed_order(df, "k", ["z", "m"]).collect()] == ["z", "m", "a", "b"]
    three = pipelines.repeated(df.withColumn("v", F.length("k")), "k", 3)
    assert {tuple(r) for r in pipelines.stable(three, "k", "v").collect()} == {(k, 3, 1) for k in "bzam"}
    assert pipelines.layout(spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int"), spark.createDataFrame([("d", 1, 300.0)], "doc string, page int, gutter double")).first()["two_columns"] == 1
    text = spark.range(1).select(pipelines.page_text(F.lit("left"), F.lit("right"), F.lit("left right")).alias("x"), pipelines.page_text(F.lit("l"), F.lit("r"), F.lit("much more than that")).alias("y")).first()
    assert text["x"] == "left\nright" and text["y"] == "much more than that"


def test_bills_keep_order_and_short_words(spark):
    items = spark.createDataFrame([(0, "ECG ELECTRODES", "subsume_procedure", "x"), (1, "EYE PAD", "not_payable", "y"), (2, "EYE PADS", "subsume_room", "z")], "item_seq long, item_name string, category string, category_description string")
    lines = spark.createDataFrame([("b", 1, "EC ELECTRODE", 10.0), ("b", 2, "EYE PADS 2", None), ("b", 3, "NOTHING SUCH", 5.0)], "bill string, line_no int, description string, amount double")
    got = {r["line_no"]: r["item_name"] for r in bills.matched_lines(lines, items, "item_seq").collect()}
    assert got == {1: "ECG ELECTRODES", 2: "EYE PADS", 3: None}
    ranked = [(r["rank"], r["line_no"]) for r in bills.findings(bills.matched_lines(lines, items, "item_seq")).orderBy("rank").collect()]
    assert ranked == [(1, 1), (2, 2)]


def test_what_is_written_out(spark, tmp_path):
    log = spark.createDataFrame([("p", 1.5, None), ('q "x"', None, "e")], "policy string, before double, evidence string")
    io.write_log(log, str(tmp_path / "log"), ["policy", "before", "evidence"])
    assert sorted(json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()) == [["p", 1.5, None], ['q "x"', None, "e"]]
    io.write_chunks(spark.createDataFrame([("d", 0, "s", "words", 1, 2)], "doc string, chunk int, section string, text string, start_page long, end_page long"), str(tmp_path / "dump"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "dump")).collect()][:2] == ["=== d chunk 0, section s, pages 1 to 2, 5 characters", "words"]
    io.write_manifests(log, str(tmp_path / "man"))
    assert all("evidence" in json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "man")).collect())


def test_small_columns_of_text(spark):
    from clauseloom.operators import pipelines

    row = spark.createDataFrame([("[[page 3]]\nsee Clause 12 for it\n[[page 4]]\nx", 0.1234, None, " ")], "t string, p double, a string, b string")
    got = row.select(text.page_marks("t").alias("m"), text.without_marks("t").alias("w"), text.snippet("t", "Clause [0-9]+", 4).alias("s"), text.snippet("t", "Form [0-9]+", 4).alias("n"), text.percent("p").alias("p"), pipelines.missing_fields(["p", "a", "b"]).alias("missing")).first()
    assert got["m"] == [3, 4] and got["w"] == "\nsee Clause 12 for it\n\nx" and got["s"] == "see Clause 12 for" and got["n"] is None and got["p"] == "12.3%" and got["missing"] == ["a", "b"]
    assert pipelines.owned(row, "x", "a").count() == 0 and pipelines.long_enough(row, "t").count() == 1 and pipelines.long_enough(row, "a").count() == 0

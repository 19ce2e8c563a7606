import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import abuse, lookalike, mixing, nearcopies, packing, scans, tokens, truncation, vectors
from clauseloom.llm.common import counted


# --- problem 1


def test_trie_walks_at_zero_cost():
    trie = lookalike.Trie([("Treatment", 9), ("skin", 5), ("fix", 3), ("Ménière", 2), ("skip", 7)])
    for given, want in {"Τrеаtmеnt": "Treatment", "ｓｋｉｎ": "skin", "sk​in": "skin", "fix": "fix", "Ménière": "Ménière", "skim": None, "": None}.items():
        assert trie.canonical(lookalike.spread(given)) == want
    assert trie.canonical(lookalike.spread("ﬁx")) == "fix"


def test_canonical_texts(spark):
    rows = [(1, "the co-payment applies to skin"), (2, "thе co‑payment applies to ｓｋｉｎ"), (3, None), (4, ""), (5, "β-blocker क्‍लेम “x” ₹"), (6, "он был дома"), (7, "the а word а"), (8, "а a a")]
    got = {r["k"]: r["plain_text"] for r in lookalike.canonical_texts(spark.createDataFrame(rows, "k long, text string"), ["k"]).where("plain_text <> text").collect()}
    assert got == {2: "the co-payment applies to skin", 7: "the a word a", 8: "a a a"}


def test_counted_equals_a_plain_count(spark):
    rows = [("a b a",), (None,), ("",), ("b",)]
    assert {tuple(r) for r in counted(spark.createDataFrame(rows, "t string"), "t", str.split).collect()} == {("a", 2), ("b", 2)}


# --- problem 2


def test_scan_noise(spark):
    clean = "the hospital charges shall apply to the covered member under the policy wording for each admission"
    rows = [(i, clean, "p", 3) for i in range(60)]
    rows += [(100, clean.replace("charges", "cbarges"), "p", 3), (101, clean.replace("hospital", "hos-\npital"), "p", 3), (102, clean.replace("each", "each\nPage 3 of 9\n"), "p", 3), (103, clean.replace("member", "member 3"), "p", 3)]
    rows += [(104, clean.replace("under", "ABC COMPANY LIMITED | POLICY WORDINGS under"), "p", 3), (105, "see page 12 of the Policy Schedule\nfor each admission", "p", 12), (106, clean.replace("charges", "chagres"), "p", 3), (107, None, None, None), (108, "", "p", None)]
    df = spark.createDataFrame(rows, "id long, t string, p string, page long")
    found = {r["id"] for r in scans.noise(df, "id", "t", "p", "page").where("broken or stamp or header or fixes is not null").collect()}
    assert found == {100, 101, 102, 103, 104}
    fixed = {r["id"]: r["repaired"] for r in scans.repaired(df, "id", "t", "p", "page").collect()}
    assert all(fixed[i] == clean for i in (100, 101, 102, 103, 104))


def test_repair_cuts_all_that_is_found(spark):
    clean = "the hospital charges shall apply to the covered member under the policy wording for each admission"
    head, mast = "Aran Health Gold Shield Plan Booklet", "ABC COMPANY LIMITED | POLICY WORDINGS under"
    rows = [(i, clean, "p", 3) for i in range(60)] + [(100, clean.replace("member", "member 3"), "p", 3), (101, clean.replace("charges", "charges 9"), "p", 3), (102, clean.replace("each", "each\nPage 3 of 4\n").replace("policy", "policy 4"), "p", 3)]
    rows += [(110 + i, clean.replace(w, f"{w}\n{head}\n"), "p", 3) for i, w in enumerate(("charges", "covered"))]
    rows += [(120, clean.replace("under", mast).replace("hospital", f"hospital {head[12:]}"), "p", 3), (121, clean.replace("hospital", f"hospital {head[12:]}"), "p", 3)]
    df = spark.createDataFrame(rows, "id long, t string, p string, page long")
    fixed = {r["id"]: r["repaired"] for r in scans.repaired(df, "id", "t", "p", "page").collect()}
    assert 101 not in fixed
    assert fixed[100] == clean and fixed[102] == clean
    assert head[12:] not in fixed[120] and head[12:] not in fixed[121] and "POLICY WORDINGS" not in fixed[120]
    assert fixed[121] == clean


def test_repair_keeps_the_wording(spark):
    text = "the company shall pay the sum insured to the nominee within thirty days of the claim being filed under section nine"
    words = text.split()
    rng = random.Random(3)
    rows = [(i, text, "p", 40 + i) for i in range(50)]
    for i in range(50, 90):
        k = rng.randrange(1, len(words) - 1)
        noise = ["Acme Health Co. Ltd. Policy Wordings", "ACME HEALTH COMPANY LIMITED | POLICY WORDINGS", "\nAcme Health | Customer Information | CIN ZX12345\n", "\nPage 7 of 9\n", "\f7"][i % 5]
        rows.append((i, " ".join([*words[:k], noise, *words[k:]]), "p", 7))
    fixed = {r["id"]: r["repaired"] for r in scans.repaired(spark.createDataFrame(rows, "id long, t string, p string, page long"), "id", "t", "p", "page").collect()}
    assert set(fixed) == set(range(50, 90)) and set(fixed.values()) == {text}


def test_a_company_named_in_a_sentence_is_no_header(spark):
    head = "Pol/Gold/V.8 Sahya Meadow Health"
    say = ["notice to Sahya Meadow Health Company Limited is valid at the branch office", "the insured may write to Sahya Meadow Health about each claim", "3) Notice to Sahya Meadow Health Company Limited"]
    rows = [(i, f"line {'abcdefghij'[i % 10]} ends here\n{head}\nand goes on for {'klmnopqrst'[i % 10]}", "p", 3) for i in range(10)] + [(20 + i, f"a line\n{t}\nanother line", "p", 3) for i, t in enumerate(say * 4)]
    rows += [(50, "the claim is l/Gold/V.8 Sahya Meadow Health paid", "p", 3)]
    df = spark.createDataFrame(rows, "id long, t string, p string, page long")
    assert {r["id"] for r in scans.noise(df, "id", "t", "p", "page").where(scans.NOISY).collect()} == {*range(10), 50}
    assert scans.repaired(df.limit(0), "id", "t", "p", "page").count() == 0


def test_an_occurrence_reads_what_stands_beside_it():
    frequent = {"long": 0, "paid": 1}
    vectors = []
    for near in ("long", "paid"):
        v = np.full(scans.CONTEXTS, -1.0)
        v[[frequent[near], scans.PLACES + frequent[near]]] = 3.0
        vectors.append(v.astype("<f2").tobytes())
    reads = [{"fix": "term", "score": 1.0, "vector": vectors[0]}, {"fix": "form", "score": 1.2, "vector": vectors[1]}]
    assert scans.read_as(reads, 0, 0) == "term" and scans.read_as(reads, 1, 1) == "form" and scans.read_as(reads[:1], 1, 1) == "term"


# --- problem 3


def test_nearest_pairs_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 600)] + 0.3 * rng.normal(size=(600, 16))
    x[10] = x[11] = x[12] = 2 * x[13]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])], "id long, v array<double>")
    good = vectors.usable(df, "id", "v", 16)
    assert good.count() == 600
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    want = {(min(i, j), max(i, j)) for i in range(600) for j in np.argsort(-s[i], kind="stable")[:5].tolist()}
    got = {tuple(r) for r in vectors.nearest_pairs(good, 5).collect()}
    assert len(want & got) >= 0.97 * len(want)
    assert vectors.nearest_pairs(good.limit(1), 5).count() == 0


def test_queries_go_up_in_all_trees_at_once():
    table = np.array([[5, 0, 3, 8], [4, 4, 4, 4]])
    levels = vectors.Levels(table, 12)
    # from cells (0, 0): 5 + 4 strings, one bit up 5 + 8, so it stops there; from (3, 3) 8 + 4 are enough at once
    assert levels.ascent(np.array([[0, 0], [3, 3], [1, 0]])).tolist() == [1, 0, 1]
    assert vectors.Levels(table, 1000).ascent(np.array([[0, 0]])).tolist() == [2]
    assert vectors.cuts(np.array([3, 3, 9, 1, 1, 1, 1, 1]), 6).tolist() == [0, 0, 1, 2, 2, 2, 2, 2]


def test_nearest_pairs_whatever_the_layout(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[:120] = x[0] + 1e-3 * rng.normal(size=(120, 16))  # two fifths of all in one place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = []
    for block in (8, 8192):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got.append({tuple(r) for r in vectors.nearest_pairs(df, 5).collect()})
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(min(i, j), max(i, j)) for i in range(120, 300) for j in np.argsort(-s[i], kind="stable")[:5].tolist()}
    assert all(len(want & g) >= 0.97 * len(want) for g in got)


# --- problem 4


@pytest.mark.parametrize("hot, members, exact", [(1 << 19, 1000, False), (8, 2, False), (1 << 19, 1000, True)])
def test_alike_pairs_against_brute_force(spark, monkeypatch, hot, members, exact):
    monkeypatch.setattr(nearcopies, "HOT", hot)
    monkeypatch.setattr(nearcopies, "MEMBERS", members)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:30]:
        c = list(b)
        for _ in range(rng.randint(1, 6)):
            c[rng.randrange(40)] = "new"
        texts.append(" ".join(c))
    texts += [" ".join(base[k] + base[59][:20]) for k in range(30, 50)]
    texts += [texts[0], texts[0].upper(), texts[0] + ".", texts[0] + "!", "too short", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in enumerate(texts) if t and len(w := t.lower().split()) >= 20}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    assert {tuple(r) for r in nearcopies.alike_pairs(df, "id", "t", 0.5, 3, 20, exact).collect()} == want
    assert nearcopies.alike_pairs(df.limit(0), "id", "t", 0.5, 3, 20, exact).count() == 0
    if hot == 8 or exact:
        return
    got = {r["id"]: (r["class"], r["links"]) for r in nearcopies.classes(df, "id", "t", 0.5, 3, 20).collect()}
    assert set(got) == set(sets)
    assert all(got[i][0] == got[j][0] for i, j in want)
    assert all(got[i][1] == sum(i in p for p in want) for i in sets)


# --- problem 6


def test_cut_texts(spark):
    ends = ["the insured person shall settle the discharge summary in full", "no cover accrues for the co-payment after the grace period", "a claim is payable only after the waiting period under this plan"]
    rows = [(3 * i + k, f"{e}. {ends[(k + 1) % 3]}. Form C-{i}.", f"s{i % 3}") for i in range(30) for k, e in enumerate(ends)]
    rows += [(None, ends[0] + ". " + ends[1][:-9], "s0"), (910, ends[0] + ". no cover accrues for the co-pay", "s0"), (910, ends[0], None)]
    rows += [(900, ends[0] + ". " + ends[1][:-9], "s0"), (901, ends[0] + ". no cover accrues for the co-pay", "s0"), (902, ends[0] + ". a claim is payable [...]", "s1"), (903, ends[0], "s1"), (904, None, "s1"), (905, "", "s1"), (906, "see help.clausedesk.example/in", "s2")]
    out = truncation.cut_texts(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()
    assert len(out) == len(rows) and sorted(r["id"] or 0 for r in out if r["cut"]) == [0, 900, 901, 902, 910]
    assert truncation.cut_texts(spark.createDataFrame([], "id long, t string, s string"), "id", "t", "s").count() == 0


def test_longer_copies_cross_partitions(spark):
    long = "x" * 60
    df = spark.createDataFrame([(long,), (long + "yz",), (long + "zz",), ("other" * 20,)], "t string").selectExpr("t")
    wanted = df.where(F.length("t") == 60).select(F.xxhash64("t").alias("key"), F.xxhash64(F.substring("t", 1, truncation.MIN_PREFIX)).alias("head"))
    assert {r["goes_on"] for r in truncation.longer_copies(df, "t", wanted).collect()} == {"yz"}


def test_normal_forms_are_those_of_the_pattern_without_one(spark, monkeypatch):
    texts = ["", "The Plan pays Rs. 5,000/- in 30 days.", "\u212aelvin \u0130n \u0421\u0430sh caf\u00e9 \U0001f600 \x00\ufffd\u00a0\u200bZ", "\u0964\n\t_-", "A.B" * 90]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("norm", F.lower(F.regexp_replace("t", "[^A-Za-z0-9.]+", "")))
    for r in df.withColumn("key", F.xxhash64("norm")).collect():
        assert truncation.normal(r["t"].encode()).decode() == r["norm"]
        assert truncation._hashes([r["norm"].encode()]).view(np.int64)[0] == r["key"]
    plans, cut = [], truncation.cut_lineage
    monkeypatch.setattr(truncation, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    short = "the Insured person shall settle the discharge summary, in full, after the gra"
    rows = [(1, short, "s"), (2, short.upper() + "ce period.", "s"), (3, short + "ce period.", "s"), (4, None, None)]
    got = truncation.cut_texts(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s").collect()
    assert [r["id"] for r in got if r["goes_on"]] == [1]
    assert len(plans) == 2 and not any("regexp_replace" in p for p in plans)


def test_half_of_a_frequent_word_is_cut_however_often(spark):
    whole = [f"the insured person shall settle the charges number {i} in full. the insurer pays the insured person" for i in range(900)]
    rows = [(i, t + ".", "s") for i, t in enumerate(whole)] + [(1000 + i, f"the claim was made by the insu and row {i} goes on from there.", "s") for i in range(2)]
    rows += [(2000, "the charges are settled by the insurer. the insurer pays the insu", "t"), (2001, "the charges are settled by the insurer. the insurer pays the insured person", "t"), (2002, "the charges are settled by the insu-\nrer. the insurer pays the insured person", "t")]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    got = {r["id"]: r["verdict"] for r in truncation.cut_texts(df, "id", "t", "s").where("id >= 2000").collect()}
    assert got == {2000: "word", 2001: "whole", 2002: "whole"}


def test_run_counts_are_exact(spark):
    texts = ["the plan pays. the plan ends", "the plan pays for it.", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    chunks = truncation.Chunks()
    h, _, last = chunks.units(["the plan"])
    at = np.flatnonzero(last)
    keys = [int(g[at].view(np.int64)[0]) for g in (*truncation._grams(h)[:2], truncation._longer(h))]
    got = {r["key"]: (r["seen"], r["ends"]) for r in truncation.run_counts(df, "t", spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got[keys[0]] == got[keys[1]] == (3, 0) and keys[2] not in got


# --- problems 7 and 8


def test_best_two_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 200, 500)
    bins = packing.best_two_fit(sizes, 256)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sizes[b].sum() <= 256 for b in map(np.array, bins))
    assert len(bins) <= sizes.sum() / 256 * 1.02 + 1
    assert packing.best_two_fit(np.zeros(0, int), 10) == []


def test_packed_splits_only_what_is_too_large(spark):
    items = spark.createDataFrame([(1, 5), (2, 25), (3, 10), (4, 0), (5, 7), (6, 3)], "id long, tokens long")
    packs = spark.createDataFrame([(1, 10), (2, None)], "pack int, cap int")
    rows = packing.packed(items, packs, "id", "pack", "cap").collect()
    assert {r["id"] for r in rows if r["piece"] > 0} == {2} and {r["id"] for r in rows} == {1, 2, 3, 5, 6}
    held = {}
    for r in rows:
        held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
    assert max(held.values()) <= 10 and sum(held.values()) == 50 and len(held) == 5


def test_pfair_keeps_every_source_within_a_block():
    blocks = {"a": 50, "b": 30, "c": 19, "d": 1, "e": 0}
    order = mixing.pfair(blocks)
    assert len(order) == 100 and len(set(order)) == 100
    seen = dict.fromkeys(blocks, 0)
    for t, (s, i) in enumerate(order, 1):
        assert i == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - n * t / 100) < 1 for x, n in blocks.items())
    assert mixing.pfair({}) == []


def test_mixed_shares(spark):
    docs = spark.createDataFrame([(i, "big" if i < 300 else "small", 100) for i in range(320)] + [(999, None, 5), (998, "unlisted", 9)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 2), ("none", 0.0, None)], "source string, target_share double, max_repeats int")
    out, shares = mixing.mixed(docs, targets, 20_000)
    got = {r["source"]: r for r in shares.collect()}
    assert got["big"]["tokens"] == 16_000 and got["small"]["tokens"] == 4_000 and not got["small"]["short"]
    assert got["small"]["uses"] == 2 and got["none"]["tokens"] == 0
    assert out.groupBy("source", "doc_id", "use").count().where("count > 1").count() == 0


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 1.0, 2)], "source string, target_share double, max_repeats int")
    out, shares = mixing.mixed(none, targets)
    assert out.count() == 0 and [(r["source"], r["tokens"]) for r in shares.collect()] == [("big", 0)]
    packs = spark.createDataFrame([(1, 10)], "pack int, cap int")
    assert packing.packed(none.select("doc_id", "tokens"), packs, "doc_id", "pack", "cap").count() == 0
    assert packing.packed(none.select("doc_id", "tokens"), packs.limit(0), "doc_id", "pack", "cap").count() == 0
    with pytest.raises(ValueError, match="kinds"):
        packing.packed(none, spark.createDataFrame([(i, 10) for i in range(packing.MOST_PACKS + 1)], "pack int, cap int"), "doc_id", "pack", "cap")
    docs = spark.createDataFrame([(1, "a fine day", "x", 0.5)], "doc_id long, text string, score string, y double")
    labels = spark.createDataFrame([], "doc_id long, toxic int, y int")
    assert abuse.abuse_scores(docs, "doc_id", "text", labels, "toxic").select("doc_id", "score").first()["score"] < 0.5
    assert lookalike.canonical_texts(spark.createDataFrame([], "k long, text string"), ["k"]).count() == 0


def test_tokens_round_trip(spark):
    enc = tokens.encoder(tokens.VOCABULARY)
    for t in ["The deductible is ₹ 5,000.", "क्लेम", " a  b\n"]:
        assert enc.decode(enc.encode_ordinary(t)) == t
    got = {r["id"]: r["tokens"] for r in tokens.sized(spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, t string"), "id", "t").collect()}
    assert got == {1: 2, 2: 0, 3: 0}


# --- problem 9


def test_abuse_is_learned_from_documents(spark):
    rng = random.Random(4)
    good = ["please send the claim form today", "the doctor explained the surgery", "my claim is pending since june", "thanks to everyone who helped", "the policy pays for injuries from abuse"]
    bad = ["you are stupid idiots", "you st*pid id1ots should rot", "shut your mouth you i d i o t s"]
    docs = [(i, ". ".join(rng.choices(good, k=4)) + (". " + rng.choice(bad) if i % 5 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    labels = [(i, int(i % 5 == 0) if i % 37 else None, "r") for i in range(200)]
    out = abuse.abuse_scores(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(labels, "doc_id long, toxic int, rater string"), "toxic")
    score = {r["doc_id"]: r["score"] for r in out.collect()}
    held = range(200, 400)
    assert sum((score[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert score[900] == 0 and score[901] == 0 and len(score) == 402


def test_wrong_verdicts_teach_nothing():
    rng = random.Random(6)
    good = ["please send the claim form today", "the doctor explained the surgery", "thanks to everyone who helped", "the policy pays for injuries from abuse", "my claim is pending since june"]
    bad = ["you are stupid idiots", "shut your mouth you idiots", "go to hell you stupid liars"]
    docs = []
    for i in range(600):
        is_bad = i % 6 == 0
        verdict = 1 - is_bad if i % 17 == 0 else int(is_bad)  # one in seventeen is wrong
        docs.append((is_bad, verdict, ". ".join(rng.choices(good, k=4) + [f"case number {i} of the branch {i % 7} office"] + ([rng.choice(bad)] if is_bad else []))))
    background = np.zeros(abuse.CELLS + 1)
    for _, _, t in docs:
        for c in abuse.coded([(0, t)], abuse.Vocabulary()):
            background[np.unique(c.terms())] += 1
    machine = abuse.fitted([(v, t) for _, v, t in docs], background, len(docs))
    best = np.full(len(docs), -np.inf)
    for c in abuse.coded(((i, t) for i, (_, _, t) in enumerate(docs)), abuse.Vocabulary()):
        np.maximum.at(best, c.doc, machine.window_scores(c))
    wrong = [(y, t) for b, (y, _, t) in zip(best, docs) if (machine.chance(np.array([b]))[0] >= 0.5) != y]
    assert wrong == []


def test_running_sums_score_as_windows_do():
    machine = abuse.Machine()
    rng = np.random.default_rng(0)
    machine.w, machine.v = rng.normal(size=machine.w.shape).astype(np.float32), rng.normal(size=machine.v.shape).astype(np.float32)
    machine.w[0], machine.v[0] = 0, 0
    text = "one two three. " + " ".join(f"w{i}" for i in range(31)) + "! a"
    for c in abuse.coded([(0, text), (1, None), (2, ""), (3, "x y")], abuse.Vocabulary()):
        assert np.allclose(machine.window_scores(c), machine.scores(c.terms()), atol=1e-3)
        assert sorted(set(c.doc.tolist())) == [0, 3] and len(c.a) == 1 + 5 + 1 + 1


def test_cut_score_takes_the_middle_of_verdicts():
    assert abuse.cut_score(np.array([-4.0, -1.0, 1.5, 2.0]), np.array([0, 0, 1, 1])) == 0.0
    assert abuse.cut_score(np.array([-4.0, 0.5, 1.5, 2.0]), np.array([0, 0, 1, 1])) == 1.0


def test_queries_are_registered():
    from clauseloom.llm.queries import QUERIES, SQL

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 9)} <= set(QUERIES) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("word, want", [("f*ck", "f*ck"), ("sh1thead", "shithead"), ("fu.ck", "fuck"), ("verrrmin", "vermin"), ("f!lth", "filth")])
def test_tokens_of_abuse(word, want):
    assert abuse.Tokens()[word] == want

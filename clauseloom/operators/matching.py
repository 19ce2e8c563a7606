"""Matching texts and records: quotes, runs, copies, names, pages."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.text import PAGE_MARK, n1, n4, n5, n7, verbatim_key
from clauseloom.session import cut_lineage, if_small


def longest_common_run(a: str, b: str) -> int:
    """Length of the longest string that a and b both contain, by suffix automaton of the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in a:
        cur = len(step)
        step.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q])), length.append(length[p] + 1), link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    at = n = best = 0
    for c in b:
        while at and c not in step[at]:
            at = link[at]
            n = length[at]
        if c in step[at]:
            at, n = step[at][c], n + 1
        best = max(best, n)
    return best


def has_run(a: str, b: str, least: int) -> bool:
    """Whether a and b both contain some string of `least` characters. One of more than half of a covers a's middle, which
    is sought as it is and drawn out on both sides."""
    if least > len(a):
        return False
    if 2 * least <= len(a):
        return longest_common_run(a, b) >= least
    start, end = len(a) - least, least
    at = b.find(a[start:end])
    while at >= 0:
        i, j = start, at
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        k, n = end, at + end - start
        while k < len(a) and n < len(b) and a[k] == b[n]:
            k, n = k + 1, n + 1
        if k - i >= least:
            return True
        at = b.find(a[start:end], at + 1)
    return False


def stands(quote: str, source: str, share: float = 0.9, least: int = 60) -> str:
    """How a quote stands in a source, both in normal form: 'exact', 'run' or 'absent' as verbatim says."""
    if not quote or not source:
        return "absent"
    if quote in source:
        return "exact"
    return "run" if len(quote) >= least and has_run(quote, source, max(least, int(share * len(quote)))) else "absent"


def verbatim(pairs: DataFrame, quote: str, source: str, share: float = 0.9, least: int = 60) -> DataFrame:
    """pairs with how: 'exact' if the source contains the quote in normal form, 'run' if it has a run of max(least,
    share of the quote) of it, else 'absent'. Null quotes and sources are absent; the costly test sees only what the
    cheap one leaves."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [stands(verbatim_key(q) or "", verbatim_key(s) or "", share, least) for q, s in zip(batch.column(quote).to_pylist(), batch.column(source).to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "how"])

    return pairs.mapInArrow(judge, T.StructType([*pairs.schema.fields, T.StructField("how", T.StringType())]))


@F.arrow_udf(T.BooleanType())
def is_verbatim(quote: pa.Array, sources: pa.Array) -> pa.Array:
    """Whether a quotation stands in one of the sources in normal form; one of fewer than 25 characters always does."""
    out = []
    for q, texts in zip(quote.to_pylist(), sources.to_pylist()):
        q = verbatim_key(q or "", marks=False)
        out.append(len(q) < 25 or any(q in verbatim_key(t, marks=False) for t in texts or () if t))
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.BooleanType())
def quotes_hold(letter: pa.Array, sources: pa.Array) -> pa.Array:
    """Whether every quotation of 25 characters or more in a letter stands in one of the sources in normal form."""
    out = []
    for text, texts in zip(letter.to_pylist(), sources.to_pylist()):
        held = [verbatim_key(t, marks=False) for t in texts or () if t]
        out.append(all(any(verbatim_key(q, marks=False) in h for h in held) for q in re.findall(r'"([^"]{25,})"', text or "")))
    return pa.array(out, pa.bool_())


def contained(records: DataFrame, least: int = 25) -> DataFrame:
    """records (doc, seq, page, text) without those that a kept longer one contains within a page of it.

    The longest come first, of equal ones the earlier. A record is dropped if its text, of `least`
    letters and digits or more, is inside a kept one whose page differs by one at most; a null page is
    near nothing. Containment pairs are joined by page, then settled in rounds: what no undropped
    record contains is kept, what a kept one contains is dropped.
    """
    keyed = cut_lineage(records.withColumn("_n", F.coalesce(n1("text"), F.lit(""))).withColumn("_len", F.length("_n")).withColumn("_id", F.xxhash64("doc", "seq")))
    short = keyed.where((F.col("_len") >= least) & F.col("page").isNotNull()).select("doc", F.col("_id").alias("a"), F.explode(F.array(F.col("page") - 1, "page", F.col("page") + 1)).alias("near"), F.col("_n").alias("n"), F.col("_len").alias("len"), F.col("seq").alias("s"))
    long = keyed.where(F.col("page").isNotNull()).select("doc", F.col("_id").alias("b"), F.col("page").alias("near"), F.col("_n").alias("m"), F.col("_len").alias("mlen"), F.col("seq").alias("t"))
    first = (F.col("mlen") > F.col("len")) | ((F.col("mlen") == F.col("len")) & (F.col("t") < F.col("s")))
    edges = cut_lineage(short.join(long, ["doc", "near"]).where(first & F.contains("m", F.col("n"))).select("a", "b").distinct())
    dropped = edges.select("a").distinct().where(F.lit(False))
    open_ = edges
    while not open_.isEmpty():
        # containers that are themselves contained in nothing still open are kept
        kept = open_.select(F.col("b").alias("k")).distinct().join(open_.select(F.col("a").alias("k")).distinct(), "k", "left_anti")
        gone = open_.join(kept, open_.b == kept.k).select("a").distinct()
        dropped = cut_lineage(dropped.unionAll(gone))
        open_ = cut_lineage(open_.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti"))
    return keyed.join(dropped.select(F.col("a").alias("_id")), "_id", "left_anti").drop("_n", "_len", "_id")


def successive_runs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier and later records (doc, seq, page, title, text, source_file) of every two successive runs of a document,
    without source_file; doc becomes (doc, run), run the number of the later one. A run is a file; a document's files are in
    the order of the version in their name, then of the name."""
    file = F.coalesce("source_file", F.lit(""))
    files = records.select("doc", file.alias("_f")).distinct()
    version = F.regexp_extract("_f", r"_v(\d+)", 1).try_cast("int")
    files = files.withColumn("_run", F.row_number().over(Window.partitionBy("doc").orderBy(version, "_f"))).withColumn("_last", F.count("*").over(Window.partitionBy("doc")))
    numbered = records.withColumn("_f", file).join(if_small(files), ["doc", "_f"])  # else texts would move for a number
    as_of = lambda d, run: d.select(F.struct("doc", run.alias("run")).alias("doc"), *[c for c in records.columns if c not in ("doc", "source_file")])
    return as_of(numbered.where("_run < _last"), F.col("_run") + 1), as_of(numbered.where("_run > 1"), F.col("_run"))


def run_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, seq_a, seq_b, tier): records (doc, seq, page, title, text) of two runs of the same documents, one to one.

    Records of a take their turn in order; each takes the first record of b that is still free and has its page and
    title (tier one), else the first free one with the same beginning of the text (tier two). Which are free depends on
    the turns before, so records that can compete for one go to a task together: those tied by any chain of shared keys.
    A key that only one record of a has, and a record of b with no other, are settled by a join.
    """
    x, y = (d.select("doc", "seq", F.when(F.col("page").isNotNull() & (n4("title") != ""), F.concat_ws("|", F.col("page").cast("string"), n4("title"))).alias("k1"), F.when(F.left(n4("text"), F.lit(70)) != "", F.left(n4("text"), F.lit(70))).alias("k2")) for d in (a, b))
    x, y = cut_lineage(x.withColumn("side", F.lit(0))), cut_lineage(y.withColumn("side", F.lit(1)))
    # records meet by keys that both sides have; others have no turn
    keys = lambda d: d.select("doc", "seq", "side", F.explode(F.array(F.struct(F.lit(1).alias("t"), F.col("k1").alias("k")), F.struct(F.lit(2).alias("t"), F.col("k2").alias("k")))).alias("e")).select("doc", "seq", "side", "e.t", "e.k").where("k is not null")
    both = keys(x).unionAll(keys(y))
    shared = both.groupBy("doc", "t", "k").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")).where("na > 0 and nb > 0").select("doc", "t", "k")
    node = F.xxhash64("doc", "seq", "side")
    met = cut_lineage(both.join(shared, ["doc", "t", "k"]).select("doc", "seq", "side", "t", "k", node.alias("node"), F.xxhash64("doc", "t", "k").alias("key")))
    label = cut_lineage(met.select("node", "key").join(met.groupBy("key").agg(F.min("node").alias("label")), "key").groupBy("node").agg(F.min("label").alias("label")))
    while True:  # labels go over keys until none changes; chains of competing records are short
        by_key = met.select("node", "key").join(label, "node").groupBy("key").agg(F.min("label").alias("least"))
        new = cut_lineage(met.select("node", "key").join(by_key, "key").groupBy("node").agg(F.min("least").alias("new")))
        changed = new.join(label, "node").where("new < label").isEmpty()
        label = new.withColumnRenamed("new", "label")
        if changed:
            break
    rows = met.select("doc", "seq", "side", "node").distinct().join(label, "node").join(x.unionAll(y), ["doc", "seq", "side"]).select("label", "doc", "seq", "side", "k1", "k2")
    return _taken_in_turn(rows)


def _taken_in_turn(rows: DataFrame) -> DataFrame:
    """run_matches of rows (label, doc, seq, side, k1, k2): tasks get whole labels and read them in order, those of b
    first; what is held is the free records of one label."""


    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("doc", fields["doc"]), T.StructField("seq_a", fields["seq"]), T.StructField("seq_b", fields["seq"]), T.StructField("tier", T.IntegerType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, used, one, two = None, set(), {}, {}
        for batch in batches:
            docs, out = batch.column("doc"), []
            for i, (mark, seq, side, k1, k2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "seq", "side", "k1", "k2")))):
                if mark != label:
                    label, used, one, two = mark, set(), {}, {}
                if side:
                    for k, open_ in ((k1, one), (k2, two)):
                        if k is not None:
                            open_.setdefault(k, []).append(seq)
                    continue
                for k, open_, tier in ((k1, one, 1), (k2, two, 2)):
                    queue = open_.get(k, ()) if k is not None else ()
                    while queue and queue[0] in used:
                        queue.pop(0)
                    if queue:
                        used.add(queue[0])
                        out.append((i, seq, queue[0], tier))
                        break
            at, a, b, t = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch([docs.take(pa.array(at, pa.int64())), pa.array(a, batch.schema.field("seq").type), pa.array(b, batch.schema.field("seq").type), pa.array(t, pa.int32())], ["doc", "seq_a", "seq_b", "tier"])

    ordered = rows.repartition("label").sortWithinPartitions("label", F.desc("side"), "seq")
    return ordered.mapInArrow(take, schema)


#: Letters of a probe, and of the pieces by which it and a text that contains it meet: of whole probes, and of shorter ones
#: down to a least length.
PROBE, PIECE = 60, 12
SHORT_PROBE, SHORT_PIECE = 20, 8


def _piece_hashes(text: str, piece: int) -> np.ndarray:
    """A hash of every run of `piece` letters of a text of small letters and digits."""
    c = np.frombuffer(text.encode("ascii", "replace"), np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(c) - piece + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(piece if len(h) else 0):
            h = h * np.uint64(0x100000001B3) + c[i : i + len(h)]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def anchors(text: str, probe: int, piece: int) -> np.ndarray:
    """Of every run of `probe` letters of a text the least hash of its pieces, each once: any text that contains such a run
    has the run's own least hash among its anchors, and anchors are few."""
    h = _piece_hashes(text, piece)
    wide = probe - piece + 1
    if len(h) < wide:
        return h[:0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, wide).min(1))


def _anchored(probe: int, piece: int) -> Callable:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([anchors(t or "", probe, piece).view(np.int64).tolist() for t in texts.to_pylist()], pa.list_(pa.int64()))

    return of


def gone(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """Records of old without a match of whose text sixty letters, from a third of it on, are inside no text of new of
    their document; a text that is inside whole has them inside too.

    A probe and the texts that contain it have an anchor in common: of the pieces of a run of letters the one with the least
    hash. Texts are joined to probes by document and anchor, then looked at; a text has an anchor every few dozen letters.
    Shorter probes have their own, shorter pieces; those below SHORT_PROBE letters, which are few and short, meet all texts of
    their document. An empty text is inside any.
    """
    alone = cut_lineage(old.join(matches.select("doc", F.col("seq_a").alias("seq")), ["doc", "seq"], "left_anti").withColumn("_n", n4("text")).withColumn("_q", F.expr(f"substring(_n, int(length(_n) / 3) + 1, {PROBE})")).drop("_n"))
    hay = cut_lineage(new.select("doc", n4("text").alias("_h")).distinct().withColumn("_i", F.xxhash64("_h")))
    length = F.length("_q")
    held = []
    for probe, piece, of_length in ((PROBE, PIECE, length == PROBE), (SHORT_PROBE, SHORT_PIECE, (length < PROBE) & (length >= SHORT_PROBE))):
        probes = alone.where(of_length).select("doc", "seq", "_q", F.col("_q").substr(1, probe).alias("_a"))
        probes = probes.withColumn("_k", _anchored(probe, piece)("_a")[0]).drop("_a")
        docs = probes.select("doc").distinct()
        posted = hay.join(docs, "doc", "left_semi").select("doc", "_i", F.explode(_anchored(probe, piece)("_h")).alias("_k"))
        near = probes.join(posted, ["doc", "_k"]).select("doc", "seq", "_q", "_i")
        held.append(near.join(hay, ["doc", "_i"]).where(F.contains("_h", F.col("_q"))).select("doc", "seq"))
    tiny = alone.where(length < SHORT_PROBE).join(hay, "doc").where(F.contains("_h", F.col("_q"))).select("doc", "seq")
    return alone.join(held[0].unionAll(held[1]).unionAll(tiny).distinct(), ["doc", "seq"], "left_anti").drop("_q")


def diff_stats(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per document: matched, same, changed, longer, shorter, and the sum of differences in length."""
    x, y = a.select("doc", F.col("seq").alias("seq_a"), n7("text").alias("ta")), b.select("doc", F.col("seq").alias("seq_b"), n7("text").alias("tb"))
    d = matches.join(x, ["doc", "seq_a"]).join(y, ["doc", "seq_b"]).withColumn("delta", F.length("tb") - F.length("ta"))
    return d.groupBy("doc").agg(F.count("*").alias("matched"), F.count_if(F.col("ta") == F.col("tb")).alias("same"), F.count_if(F.col("ta") != F.col("tb")).alias("changed"), F.count_if(F.col("delta") > 0).alias("longer"), F.count_if(F.col("delta") < 0).alias("shorter"), F.sum("delta").alias("delta"))


def missing_spans(a: str, b: str, least: int) -> list[str]:
    """Pieces of b, of `least` characters or more, that a lacks."""
    ops = difflib.SequenceMatcher(None, b, a, autojunk=False).get_opcodes()
    return [b[i:j].strip() for op, i, j, _, _ in ops if op in ("delete", "replace") and len(b[i:j].strip()) >= least]


def omissions(holders: DataFrame, least: int = 30, witnesses: int = 2, probe: int = 60) -> DataFrame:
    """(code, policy, span, witnesses): pieces that a policy's copy of a standard clause lacks while at least `witnesses`
    other copies have them. holders (code, policy, text) has one text per code and policy; codes with three or more count.
    Of overlapping pieces the longest is kept. Copies of one code are few: one per policy and distinct text."""
    h = holders.withColumn("norm", n5("text"))
    texts = cut_lineage(h.groupBy("code", "norm").agg(F.count("*").alias("n"), F.min("policy").alias("policy")))  # equal copies once
    many = h.groupBy("code").agg(F.count("*").alias("c")).where("c >= 3").select("code")
    texts = texts.join(many, "code")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for code, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out += [(code, x, s) for s in missing_spans(x, y, least)]
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["code", "norm", "span"])

    pairs = texts.select(F.col("code").cast("string").alias("code"), "norm").join(texts.select(F.col("code").cast("string").alias("code"), F.col("norm").alias("other")), "code").where("norm <> other")
    found = pairs.mapInArrow(spans, "code string, norm string, span string").distinct()
    wit = texts.select(F.col("code").cast("string").alias("code"), F.col("norm").alias("w"), "n")
    seen = found.join(wit, "code").where(F.contains("w", F.expr(f"left(span, {probe})"))).groupBy("code", "norm", "span").agg(F.sum("n").alias("witnesses")).where(F.col("witnesses") >= witnesses)
    # the longest first, of equal ones by the alphabet; one is kept if no kept one has its first letters. A copy's pieces
    # are pieces of one clause: few
    order = F.array_sort(F.collect_list(F.struct((-F.length("span")).alias("far"), "span", "witnesses")))
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: F.contains(k["span"], F.left(x["span"], F.lit(40)))), kept).otherwise(F.concat(kept, F.array(x)))
    greedy = seen.groupBy("code", "norm").agg(order.alias("s")).withColumn("s", F.aggregate("s", F.slice("s", 1, 0), keep))
    kept = greedy.select("code", "norm", F.explode("s").alias("x")).select("code", "norm", "x.span", "x.witnesses")
    return kept.join(h.select(F.col("code").cast("string").alias("code"), "norm", "policy"), ["code", "norm"]).select("code", "policy", "span", "witnesses")


def medoids(holders: DataFrame) -> DataFrame:
    """(code, policy): of the copies (code, policy, text) of each code the one most like all others by the letters they
    share; of fewer than three, or of equally central ones, the longest, then the first by name. A copy is its counts of 27
    signs, so likeness needs no diff; copies of a code are one per policy."""
    signs = "abcdefghijklmnopqrstuvwxyz "
    h = holders.withColumn("norm", n5("text"))
    counts = F.array(*[F.length("norm") - F.length(F.replace("norm", F.lit(c), F.lit(""))) for c in signs])
    h = h.select("code", "policy", F.length("norm").alias("n"), counts.alias("v"))
    x, y = h.alias("x"), h.alias("y")
    shared = F.aggregate(F.zip_with(F.col("x.v"), F.col("y.v"), lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    like = x.join(y, (F.col("x.code") == F.col("y.code")) & (F.col("x.policy") != F.col("y.policy")), "left").groupBy("x.code", "x.policy", "x.n").agg(F.coalesce(F.avg(F.try_divide(2 * shared, F.col("x.n") + F.col("y.n"))), F.lit(0.0)).alias("like"), F.count("y.policy").alias("others"))
    rank = F.struct(F.when(F.col("others") >= 2, F.round("like", 9)).otherwise(0.0).alias("a"), F.col("n").alias("b"))
    top = like.withColumn("rank", rank).groupBy("code").agg(F.max("rank").alias("top"))
    return like.withColumn("rank", rank).join(top, "code").where(F.col("rank") == F.col("top")).groupBy("code").agg(F.min("policy").alias("policy"))


def biggest_changes(matches: DataFrame, a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The n matches whose texts differ most in length, with the difference; of equal ones the first by document and place."""
    x, y = a.select("doc", F.col("seq").alias("seq_a"), F.length(n7("text")).alias("la")), b.select("doc", F.col("seq").alias("seq_b"), F.length(n7("text")).alias("lb"))
    d = matches.join(x, ["doc", "seq_a"]).join(y, ["doc", "seq_b"]).withColumn("delta", F.col("lb") - F.col("la"))
    return d.where("delta <> 0").orderBy(F.desc(F.abs("delta")), "doc", "seq_a").limit(n).select("doc", "seq_a", "seq_b", "delta")


def longest_per(df: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """The row with the longest text of each key, the first of equally long ones."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(F.length(text), -F.col(seq))).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in names])


_MARK = re.compile(PAGE_MARK)


def marks_of(chunk: str) -> list[tuple[int, int]]:
    """Where the page marks of a chunk are, and their pages."""
    return [(m.start(), int(m.group(1))) for m in _MARK.finditer(chunk)]


def page_of(quote: str, flat: str, marks: list[tuple[int, int]], size: int, page: int | None, start: int | None) -> int | None:
    """resolve_page of a text and a chunk of `size` characters in normal form, quote and flat."""
    if page is not None and any(page == n for _, n in marks):
        return page
    probe = quote[:80]
    at = flat.find(probe) if probe else -1
    before = [n for place, n in marks if at >= 0 and place <= int(at / max(1, len(flat)) * size)]
    return before[-1] if before else start


@F.arrow_udf(T.LongType())
def resolve_page(text: pa.Array, chunk: pa.Array, page: pa.Array, start: pa.Array) -> pa.Array:
    """The page a text of a chunk stands on: the given one if the chunk has it, else that of the last page mark before the
    place where the text's beginning is found, else the chunk's first. The place is found in normal form, by eighty
    characters, and scaled by the two lengths."""
    rows = zip(*(x.to_pylist() for x in (text, chunk, page, start)))
    return pa.array([page_of(verbatim_key(t) or "", verbatim_key(c) or "", marks_of(c or ""), len(c or ""), p, first) for t, c, p, first in rows], pa.int64())


def mentions(letter: str, names: list[str]) -> list[str]:
    """The names a letter mentions, longest first; what a name matched is not there for shorter ones. A name of one
    word counts only if it begins with a capital, so that a verb is not taken for a product."""
    import re

    found, hay = [], letter or ""
    for name in sorted({n for n in names if n and n.strip()}, key=lambda n: (-len(n), n)):
        pattern = re.compile(r"(?<!\w)" + r"\s+".join(map(re.escape, name.split())) + r"(?![\w.]*\w)", re.I)
        hits = [m for m in pattern.finditer(hay) if len(name.split()) > 1 or m.group()[:1].isupper()]
        if hits:
            found.append(name)
            for m in reversed(hits):
                hay = hay[: m.start()] + " " * len(m.group()) + hay[m.end() :]
    return found


def mismatch(named: Column, own_policy: Column, own_insurer: Column, policies: Column, insurers: Column) -> Column:
    """Whether a letter is about somebody else: its own policy named, no; another policy, yes; its own insurer, no;
    another insurer, yes; nothing named, no."""
    has = lambda xs: F.arrays_overlap(named, xs)
    return F.when(F.array_contains(named, own_policy), False).when(has(F.array_remove(policies, own_policy)), True).when(F.array_contains(named, own_insurer), False).otherwise(F.coalesce(has(F.array_remove(insurers, own_insurer)), F.lit(False)))


def against_page(value: Column, page_text: Column) -> Column:
    """verbatim, normalised (letters and digits agree), altered (the same digits) or absent: how a short field stands in
    the text of its page. Null or empty values are absent."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "absent").when(F.contains(F.lower(n7(page_text)), F.lower(n7(value))), "verbatim").when((n4(value) != "") & F.contains(n4(page_text), n4(value)), "normalised").when((digits != "") & F.contains(F.regexp_replace(page_text, r"\D", " "), digits), "altered").otherwise("absent")


# How the code of a standard exclusion is printed, its l misread or not.
CODE_SHAPE = r"E[xX][ce][lI1]\s*\.?\s*-?\s*\d{1,2}"
VERDICTS = ("verbatim", "normalised", "altered", "absent")


#: Bytes of a page's texts that are searched at once, and all but letters and digits.
HAY, OTHERS = 1 << 18, bytes(c for c in range(256) if chr(c) not in "abcdefghijklmnopqrstuvwxyz0123456789")


def _sought(values: DataFrame, printed: DataFrame) -> DataFrame:
    """values (policy_id, source_page, at, n, x: field, v7, v4, d) with r, the place of their verdict in the texts (policy_id,
    source_page, t7, codes) of source_page. A page's values stream before its texts; what is held is its values that
    are not found yet, and HAY bytes of text."""
    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    absent = lambda *names: [F.lit(None).cast(types[c]).alias(c) for c in names]
    left = values.select("policy_id", "source_page", F.lit(0).alias("side"), "at", "n", "x", F.lit(None).cast("string").alias("t7"), F.array().cast("array<string>").alias("codes"))
    right = printed.select("policy_id", "source_page", F.lit(1).alias("side"), *absent("at", "n", "x"), "t7", "codes")
    rows = left.unionAll(right).repartition("policy_id", "source_page").sortWithinPartitions("policy_id", "source_page", "side")
    out = T.StructType([*[rows.schema[c] for c in ("policy_id", "at", "n", "x")], T.StructField("r", T.IntegerType())])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, left, hay, size, codes, done, schema = None, [], [], [], 0, set(), [], None

        def search() -> list:
            """Values that are not verbatim in what is held of the page."""
            t7, more = b"\n".join(hay), []
            t4 = t7.translate(None, OTHERS.replace(b"\n", b""))
            for v in left:
                if v[3] in t7:
                    v[2] = 1
                    continue
                if v[2] > 2 and v[4] and v[4] in t4:
                    v[2] = 2
                elif v[2] > 3 and v[5] in codes:
                    v[2] = 3
                more.append(v)
            return more

        def result() -> pa.RecordBatch:
            cols = list(zip(*done)) or [()] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [*(schema.field(n).type for n in ("policy_id", "at", "n", "x")), pa.int32()])], ["policy_id", "at", "n", "x", "r"])

        for batch in batches:
            schema = batch.schema
            for k in range(0, batch.num_rows, 500):
                for r in batch.slice(k, 500).to_pylist():
                    if (r["policy_id"], r["source_page"]) != key:
                        if hay:
                            search()
                        done += [(v[0], v[1]["at"], v[1]["n"], v[1]["x"], v[2]) for v in values]
                        key, values, left, hay, size, codes = (r["policy_id"], r["source_page"]), [], [], [], 0, set()
                    if not r["side"]:
                        x = r["x"]
                        values.append([r["policy_id"], r, 4, x["v7"].encode(), x["v4"].encode(), x["d"] if x["field"] == "exclusion_code" else None])
                        left = values
                    elif left and None not in key:
                        hay.append(r["t7"].encode())
                        codes.update(r["codes"])
                        size += len(hay[-1])
                        if size > HAY:
                            left, hay, size = search(), [], 0
            yield result()
            done = []
        if hay:
            search()
        done += [(v[0], v[1]["at"], v[1]["n"], v[1]["x"], v[2]) for v in values]
        if schema is not None:
            yield result()

    return rows.mapInArrow(seek, out)


def short_fields(clauses: DataFrame, texts: DataFrame) -> DataFrame:
    """(field, verdict, n, share): how the filled short fields of clauses (vec_id, policy_id, source_page, clause_text and the
    fields) stand in texts (policy_id, source_page, clause_text), and the share of each verdict in its field.

    exclusion_code, clause_id and clause_title are sought in the texts of their page and its neighbours, cap_basis in
    its own clause. verbatim: contained, blanks and case aside; normalised: letters and digits are; altered, for codes alone:
    another spelling of the same digits is printed; absent: nothing of it, or no text at all. Equal values of a page are
    one; they are sought in its texts joined, not in each.
    """
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    names = ["exclusion_code", "clause_id", "clause_title"]
    key = ["policy_id", "source_page"]
    forms = F.array(*[F.when(filled(c), F.struct(F.lit(c).alias("field"), F.lower(n7(c)).alias("v7"), n4(c).alias("v4"), (digits(c) if c == "exclusion_code" else F.lit("")).alias("d"))) for c in names])
    values = clauses.select(*key, F.explode(forms).alias("x")).where("x is not null").groupBy(*key, "x").agg(F.count("*").alias("n"))
    near = values.withColumn("at", F.col("source_page")).withColumn("source_page", F.explode(F.array(F.col("at") - 1, "at", F.col("at") + 1)))
    codes = F.array_distinct(F.transform(F.regexp_extract_all("clause_text", F.lit(f"({CODE_SHAPE})"), 1), digits))
    printed = texts.where("clause_text is not null").select(*key, F.lower(n7("clause_text")).alias("t7"), codes.alias("codes")).join(near.select(*key).distinct(), key, "left_semi")
    best = _sought(near, printed).groupBy("policy_id", "at", "x").agg(F.min("r").alias("r"), F.first("n").alias("n"))
    long = best.select("x.field", "r", "n")
    t, v = F.coalesce("clause_text", F.lit("")), F.col("cap_basis")
    own = F.when(F.contains(F.lower(n7(t)), F.lower(n7(v))), 1).when((n4(v) != "") & F.contains(n4(t), n4(v)), 2).otherwise(4)
    long = long.unionAll(clauses.where(filled("cap_basis")).select(F.lit("cap_basis").alias("field"), own.alias("r"), F.lit(1).cast("long").alias("n")))
    n = long.groupBy("field", F.element_at(F.array(*[F.lit(x) for x in VERDICTS]), F.col("r")).alias("verdict")).agg(F.sum("n").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))  # sixteen rows

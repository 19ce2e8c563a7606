"""P2: noise in text from scanned pages, found and repaired.

Skip-gram vectors are learned over all texts: the mutual information of a word and its neighbours,
which is what skip-gram with negative sampling converges to. The most frequent words of the corpus
are dimensions of their own. A word is linked to the far more frequent ones that a scanner could have
misread into it (same glyph skeleton) if its neighbours are those they are met with; where several
are left, each occurrence is decided by the words beside it. Running headers are learned per policy,
page stamps by form and by the page a row is from. Repair heals broken words, replaces linked words,
drops the furniture and reflows the lines.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.glyphs import broken, glyph_skeleton, unbroken
from clauseloom.functions.plain import plain
from clauseloom.llm.common import BITMAP_BITS, PARTIAL_ENTRIES, Hashes, bitmap, shared
from clauseloom.session import cut_lineage, tasks

#: How many times as frequent a word must be as the one it is misread into.
RATIO = 20
#: Least length of a word that can be a misreading, without and with digits or signs in it.
MIN_LETTERS, MIN_MIXED = 3, 4
#: Least mean association (nats above chance) of a linked word with the neighbours of its misreading.
MIN_ASSOCIATION = 0.5
#: The same for words of LONG letters or more, or with digits or signs among the letters: hardly a word by chance.
MIN_ASSOCIATION_LONG, LONG = -1.0, 6
#: Dimensions of a vector for each of the two places beside a word: the OWN most frequent words of the corpus have one
#: each, all other words share the rest by a hash.
PLACES, OWN = 512, 448
CONTEXTS = 2 * PLACES
OFFSETS = (-1, 1)
#: Words whose neighbours a task counts at once: bounds its memory, changes no result.
PARTIAL_WORDS = 12_000

# Forms of page stamps. "page 12 of the Policy Schedule" is none.
_STAMPS = [
    (("age ", "AGE "), re.compile(r"\b[Pp](?:age|AGE)\s+\d{1,4}\s+(?:of|OF)\s+\d{1,4}(?=\s)")),
    (("g. ", "G. ", "g.", "G."), re.compile(r"\bP[gG]\.\s*\d{1,4}(?=\s)")),
    (("a g e", "A G E"), re.compile(r"\d{1,4}\s*\|\s*[Pp]\s*(?:a\s*g\s*e|A\s*G\s*E)\b")),
    ((" / ",), re.compile(r"(?<=\s)\d{1,4} / \d{1,4}(?=\s)")),
    (("\f",), re.compile(r"\f\s*\d{1,4}(?=\s)")),
    (("\n",), re.compile(r"\n[ \t\f]*(?:-[ \t]*\d{1,4}[ \t]*-|\d{1,4})[ \t]*(?=\n)")),
]
# Signs of a running header.
CUES = re.compile(
    r"\|\s*(?:policy wordings?|customer information|cin\b)|policy wordings?\s+uin\b|\buin:?\s*[A-Z]{2}\w*\d|\bcin:?\s*[A-Z]{2}\d\w*"
    r"|\b(?:co\.?|company)\s+(?:ltd\.?|limited)\.?\s+policy wordings?\b|\bpol/\w+/v\.?\s?\d|\bprospectus cum wording\b",
    re.I,
)
_CUE_WORDS = ("wording", "customer information", "cin ", "cin:", "uin ", "uin:", "pol/")


def cued(text: str) -> bool:
    """Whether text holds a sign of a running header."""
    low = text.lower()
    return any(w in low for w in _CUE_WORDS) and CUES.search(text) is not None


_NUMBER = re.compile(r"\d{1,4}")
_BEFORE = re.compile(r"([^\W\d_]+)[,;]?\s+$")
_AFTER = re.compile(r"\s+([^\W\d_]+)")
_WORD = re.compile(r"[A-Za-z@$|!0-9]*[A-Za-zÀ-ɏ@$][A-Za-zÀ-ɏ0-9@$]*|\d[\d.,]*")
_PLAIN_WORD = re.compile("[a-zà-ɏ]+$")


def split_chunk(chunk: str) -> list[str]:
    """What lies between blanks -> the words in it: small letters, numbers as 0, without punctuation."""
    return ["0" if w[0].isdigit() and not any(c.isalpha() for c in w) else w for w in _WORD.findall(chunk.lower())]


class Words(dict):
    """chunk -> its words."""

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) > 400_000:
            self.clear()
        out = self[chunk] = tuple(split_chunk(chunk))
        return out


class Ids(dict):
    """chunk -> numbers of its words; by number: hashes has a word's hash, words the word, dims its dimension beside others."""

    def __init__(self, frequent: dict[str, int]) -> None:
        super().__init__()
        self.frequent = frequent
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.hashes: list[int] = []
        self.dims: list[int] = []
        self.seen = Hashes()
        self.of("\n")

    def of(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.words)
            self.words.append(word)
            self.hashes.append(self.seen[word])
            self.dims.append(dimension(word, self.frequent, self.seen))
        return n

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out = self[chunk] = tuple(self.of(w) for w in split_chunk(chunk))
        return out

    def forget(self) -> None:
        for x in (self, self.number, self.words, self.hashes, self.dims):
            x.clear()
        self.of("\n")


def dimension(word: str, frequent: dict[str, int], seen: Hashes) -> int:
    """The dimension of a vector that a word beside another one counts in, of those of one place."""
    own = frequent.get(word)
    return OWN + (seen[word] >> 32) % (PLACES - OWN) if own is None else own


def frequent_words(counts: DataFrame) -> dict[str, int]:
    """The OWN most frequent words, ties in order of the alphabet, and their dimensions."""
    return {r["word"]: k for k, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(OWN).select("word").collect())}


def healed(text: str) -> str:
    """Plain form with broken words in one piece."""
    return plain(unbroken(text))


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """(word, n): occurrences of every word in all texts, and of "<" and a word before a number, ">" and one after.
    What lies between blanks is counted where the rows are, then split into words, then summed by one shuffle."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, beside = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in split_chunk(chunk):
                    words[w] += n
            for (a, b), n in beside.items():
                a, b = split_chunk(a), split_chunk(b)
                if b and b[0] == "0":
                    words["<" + (a[-1] if a else "")] += n
                if a and a[-1] == "0":
                    words[">" + (b[0] if b else "")] += n
            seen.clear(), beside.clear()
            return pa.record_batch([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    chunks = healed(text).split()
                    seen.update(chunks)
                    numeric = [i for i, c in enumerate(chunks) if c[0] in "0123456789₹(" or c[-1].isdigit()]
                    for i in numeric:
                        if i:
                            beside[chunks[i - 1], chunks[i]] += 1
                        if i + 1 < len(chunks):
                            beside[chunks[i], chunks[i + 1]] += 1
            if len(seen) + len(beside) > PARTIAL_ENTRIES:
                yield flush()
        if seen:
            yield flush()

    return df.select(column).mapInArrow(part, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def links(counts: DataFrame) -> DataFrame:
    """(word, fix, n, n_fix): every word with each RATIO times as frequent word of the same glyph skeleton. Words meet
    by their skeleton; a skeleton's words are few, as it hides only glyph edits."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([glyph_skeleton(w) for w in batch.column(0).to_pylist()], pa.string())], ["word", "n", "skeleton"])

    words = counts.mapInArrow(keyed, "word string, n long, skeleton string")
    a, b = words.alias("a"), words.where("word rlike '^[a-z\\\\x{e0}-\\\\x{24f}]+$'").alias("b")
    least = F.when(F.col("a.word").rlike("[^a-z\\x{e0}-\\x{24f}]"), MIN_MIXED).otherwise(MIN_LETTERS)
    # two neighbouring letters swapped are a slip of typing
    swapped = F.expr(
        "length(a.word) = length(b.word) and exists(sequence(1, length(a.word) - 1), i -> substring(a.word, 1, i - 1) = substring(b.word, 1, i - 1)"
        " and substring(a.word, i, 1) = substring(b.word, i + 1, 1) and substring(a.word, i + 1, 1) = substring(b.word, i, 1) and substring(a.word, i + 2) = substring(b.word, i + 2))"
    )
    pairs = a.join(b, (F.col("a.skeleton") == F.col("b.skeleton")) & (F.col("b.n") >= RATIO * F.col("a.n")) & (F.col("a.word") != F.col("b.word")))
    return pairs.where(~swapped & (F.length("a.word") >= least) & (F.length("b.word") >= MIN_LETTERS)).select(F.col("a.word").alias("word"), F.col("b.word").alias("fix"), F.col("a.n").alias("n"), F.col("b.n").alias("n_fix"))


def neighbours(df: DataFrame, column: str, wanted: np.ndarray, frequent: object) -> DataFrame:
    """(word, counts): for every word with its bit set in wanted, how often each dimension stands before and after it; all
    occurrences in all texts. Sums are made per task, then by a hash of the word. frequent is a broadcast of frequent_words."""
    spark = df.sparkSession
    bits, shards = shared(spark, np.packbits(wanted)), 4 * tasks(spark)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, known = np.unpackbits(bits.value).astype(bool), Ids(frequent.value)
        row_of, names = np.full(1024, -1), []
        table = np.zeros((1024, CONTEXTS), np.int32)
        checked = 0

        def flush() -> pa.RecordBatch:
            nonlocal row_of, checked
            blobs = [zlib.compress(table[i].tobytes(), 1) for i in range(len(names))]
            out = pa.record_batch([pa.array([known.seen[w] % shards for w in names], pa.int32()), pa.array(names, pa.string()), pa.array(blobs, pa.binary())], ["shard", "word", "counts"])
            known.forget(), names.clear()
            row_of[:], table[:], checked = -1, 0, 0
            return out

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at in range(0, len(texts), 1000):
                flat: list[int] = []
                for text in texts[at : at + 1000]:
                    for c in healed(text).split():
                        flat += known[c]
                    flat.append(0)
                for i in range(checked, len(known.words)):
                    if i >= len(row_of):
                        row_of = np.concatenate([row_of, np.full(len(row_of), -1)])
                    if mask[known.hashes[i] >> (64 - BITMAP_BITS)]:
                        row_of[i] = len(names)
                        names.append(known.words[i])
                checked = len(known.words)
                while len(names) > len(table):
                    table = np.vstack([table, np.zeros_like(table)])
                ids = np.array(flat, np.int64)
                rows = row_of[ids]
                places = np.flatnonzero(rows >= 0)
                dims, cells = np.array(known.dims, np.int64), table.reshape(-1)
                for k, offset in enumerate(OFFSETS):
                    context = dims[np.roll(ids, -offset)[places]] + k * PLACES
                    np.add.at(cells, rows[places] * CONTEXTS + context, 1)
                if len(names) > PARTIAL_WORDS or len(known) > 400_000:
                    yield flush()
        if names:
            yield flush()

    def total(pieces: pa.Table) -> pa.Table:
        out: dict[str, np.ndarray] = {}
        for w, c in zip(pieces["word"].to_pylist(), pieces["counts"].to_pylist()):
            x = np.frombuffer(zlib.decompress(c), np.int32)
            out[w] = out[w] + x if w in out else x
        return pa.table({"word": pa.array(out.keys(), pa.string()), "counts": pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1) for x in out.values()], pa.binary())})

    partial = df.select(column).mapInArrow(part, "shard int, word string, counts binary")
    return partial.groupBy("shard").applyInArrow(total, "word string, counts binary")


def association(counts: np.ndarray, marginal: np.ndarray) -> np.ndarray:
    """A word's skip-gram vector: mutual information in nats with each dimension, from its counts."""
    share = (counts + 0.5 * marginal) / (counts.sum() + 0.5)
    return np.log(share / marginal)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.int64)


def marginals(counts: DataFrame, frequent: object) -> np.ndarray:
    """The share of each dimension among all places beside a word, from the counts of all words."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros(PLACES), Hashes()
        for batch in batches:
            dims = [dimension(w, frequent.value, seen) for w in batch.column(0).to_pylist()]
            out += np.bincount(np.array(dims, np.int64), batch.column(1).to_numpy(), PLACES)
        yield pa.record_batch([pa.array(range(PLACES), pa.int32()), pa.array(out)], ["k", "n"])

    got = counts.select("word", "n").mapInArrow(part, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.ones(PLACES)  # never zero
    for k, n in got:
        out[k] += n
    return np.tile(out / out.sum() / 2, 2)


def misreadings(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame, object]:
    """((word, reads), (side), frequent): the words that are misread in the texts with what each may read, best first: an
    array of (fix, score, vector), vector only where there are several; the words that often stand before ("<" and the
    word) or after (">") a number; a broadcast of the frequent words."""
    everything = cut_lineage(word_counts(df, column))
    counts = everything.where("word not rlike '^[<>]'")
    beside = everything.where("word rlike '^[<>]'").select(F.col("word").alias("side"), F.expr("substring(word, 2)").alias("word"), F.col("n").alias("k"))
    numeric = beside.join(counts, "word").where(F.col("k") >= NUMERIC * F.col("n")).select("side")
    frequent = shared(df.sparkSession, frequent_words(counts))
    pairs = cut_lineage(links(counts))
    wanted = bitmap(pairs.select(F.explode(F.array("word", "fix")).alias("w")), "w")
    vectors = cut_lineage(neighbours(df, column, wanted, frequent))
    marginal = marginals(counts, frequent)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], []
            for mine, theirs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, vector = _unpacked(mine), association(_unpacked(theirs), marginal)
                out.append(float(vector @ own / max(1, own.sum())))
                held.append(vector.astype("<f2").tobytes())
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.record_batch([*rest, pa.array(out, pa.float64()), pa.array(held, pa.binary())], ["word", "fix", "n", "n_fix", "score", "vector"])

    joined = pairs.join(vectors, "word").join(vectors.select(F.col("word").alias("fix"), F.col("counts").alias("theirs")), "fix").select("counts", "theirs", "word", "fix", "n", "n_fix")
    scored = joined.mapInArrow(score, "word string, fix string, n long, n_fix long, score double, vector binary")
    sure = (F.length("word") >= LONG) | F.col("word").rlike("[0-9@$|!]")
    scored = cut_lineage(scored.where(F.col("score") >= F.when(sure, MIN_ASSOCIATION_LONG).otherwise(MIN_ASSOCIATION)))
    # what is misread itself is no reading: its own readings are among the word's
    rooted = scored.join(scored.select(F.col("word").alias("fix")).distinct(), "fix", "left_anti")
    reads = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), (-F.col("n_fix")).alias("rare"), "fix", "vector")))
    best = rooted.groupBy("word").agg(reads.alias("r"))
    alone = F.size("r") == 1
    best = best.select("word", F.transform("r", lambda x: F.struct(x["fix"].alias("fix"), (-x["far"]).alias("score"), F.when(~alone, x["vector"]).alias("vector"))).alias("reads"))
    return cut_lineage(best), cut_lineage(numeric), frequent


def read_as(reads: list[dict], before: int, after: int) -> str:
    """What an occurrence of a misread word reads, by the dimensions of the words beside it and its word's readings."""
    if len(reads) == 1:
        return reads[0]["fix"]
    vectors = [np.frombuffer(r["vector"], "<f2") for r in reads]
    return reads[int(np.argmax([r["score"] + float(v[before]) + float(v[PLACES + after]) for r, v in zip(reads, vectors)]))]["fix"]


_MARKED = re.compile(r"(?:\(?(?:[a-z]{1,2}|[ivxlcdm]{1,6}|\d{1,3})[.)]|[-•*])\s", re.I)
_PIECE = re.compile(r"[A-Z|(/][^\s]*(?:\s+(?:[A-Z|–:(\d][^\s]*|cum))+")
#: Shortest clipped piece of a header that counts.
CLIPPED = 14
#: Share of a header's places, at least, between lines that it stands between only there.
SCATTERED = 0.3


def header_shaped(line: str) -> bool:
    """A line of capitalised words without an end, as headers are; an item of a list is none."""
    if line[-1:] in ".;,:" or len(line) > 120 or _MARKED.match(line):
        return False
    parts = line.split()
    capitals = sum(p[0].isupper() for p in parts)
    return 2 <= len(parts) <= 16 and capitals >= 2 and capitals + sum(not p[0].isalpha() for p in parts) >= 0.75 * len(parts)


def header_lines(text: str) -> list[tuple[str, str]]:
    """The lines of a text that look like a header, and what is beside each."""
    rows = [r.strip() for r in text.split("\n")] if "\n" in text else []
    return [(re.sub(r"\s*(?:[|–-]\s*)?\d{1,4}$", "", line), before[-20:] + "\n" + after[:20]) for before, line, after in zip([""] + rows, rows, rows[1:] + [""]) if header_shaped(line)]


def learned_headers(found: DataFrame) -> DataFrame:
    """(policy, headers): lines of one policy alone that look like a header and stand in two findings or more. A header
    falls anywhere into the text, so the lines beside it differ from one place to the next: in SCATTERED of its places
    at least; a line of the wording has its own neighbours."""
    seen = found.where("policy is not null").select("policy", F.explode("lines").alias("x")).select("policy", "x.line", "x.beside")
    places = seen.groupBy("policy", "line", "beside").agg(F.count("*").alias("k"))
    kept = places.groupBy("policy", "line").agg(F.count("*").alias("n"), F.sum("k").alias("all"))
    own = kept.groupBy("line").agg(F.count("*").alias("policies"), F.max("n").alias("n"), F.max("all").alias("all"), F.max("policy").alias("policy"))
    return own.where("policies = 1 and n >= 2").where(F.col("n") >= SCATTERED * F.col("all")).groupBy("policy").agg(F.collect_set("line").alias("headers"))  # the forms of one policy's header


_SIGN = re.compile(r"[^\W_]*[|/:()\d–][^\W_]*|wording|customer information", re.I)


def telling(header: str, at: int, upto: int) -> bool:
    """Whether header[at:upto] can be nothing but a piece of the header: it breaks a word, has a sign or a word that
    headers have, or is most of a header without any. What is left may be the company's name in a sentence."""
    inside = lambda i: 0 < i < len(header) and header[i - 1].isalnum() and header[i].isalnum()
    if inside(at) or inside(upto) or _SIGN.search(header[at:upto]):
        return True
    return not _SIGN.search(header) and upto - at >= 0.6 * len(header)


def clipped_header(text: str, headers: list[str]) -> tuple[int, int] | None:
    """Where text holds a telling piece of a learned header, cut at its front or back, of CLIPPED characters or more."""
    for h in headers:
        if len(h) < CLIPPED:
            continue
        for probe, back in ((h[-CLIPPED:], True), (h[:CLIPPED], False)):
            at = text.find(probe)
            while at >= 0:
                a, b = at, at + CLIPPED
                if back:
                    i, j = len(h) - CLIPPED, len(h)
                    while i > 0 and a > 0 and text[a - 1] == h[i - 1]:
                        a, i = a - 1, i - 1
                else:
                    i, j = 0, CLIPPED
                    while j < len(h) and b < len(text) and text[b] == h[j]:
                        b, j = b + 1, j + 1
                while h[i].isspace():  # a blank beside a piece is the text's
                    a, i = a + 1, i + 1
                while h[j - 1].isspace():
                    b, j = b - 1, j - 1
                if telling(h, i, j) and not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
                    return a, b
                at = text.find(probe, at + 1)
    return None


def bare_numbers(text: str, page: int | None) -> list[tuple[int, int, str, str]]:
    """Bare numbers between words that can be the page's: where they are, and the words before and after as sides."""
    out = []
    for m in _NUMBER.finditer(text) if page is not None else ():
        if abs(int(m.group()) - page) > 1 or text[m.start() - 1 : m.start()] not in (" ", "\n", "\t") or text[m.end() : m.end() + 1] not in (" ", "\n", "\t"):
            continue
        before, after = _BEFORE.search(text[max(0, m.start() - 40) : m.start()]), _AFTER.match(text, m.end())
        if before and after:
            out.append((*m.span(), "<" + before.group(1).lower(), ">" + after.group(1).lower()))
    return out


def stamp_spans(text: str) -> list[tuple[int, int]]:
    """Spans of page stamps by their form, inside the text."""
    end = len(text.rstrip())
    return sorted({m.span() for words, form in _STAMPS if any(w in text for w in words) for m in form.finditer(text) if 0 < m.start() and m.end() < end})


#: Share of a word's occurrences that must have a number beside them for the number to belong to the wording.
NUMERIC = 0.03


LINES = pa.list_(pa.struct([("line", pa.string()), ("beside", pa.string())]))


def noise(df: DataFrame, id: str, text: str, policy: str, page: str) -> DataFrame:
    """One row per row of df: id, broken, stamp, header (flags), fixes: an array of a misread word, its occurrence among
    those of the word in the text, and what it reads; headers: what is learned for the policy where the text has a header
    or a piece of one; numbers: spans of bare page numbers in the healed text.

    Null and empty texts have no noise; a null policy or page only goes without its clues."""
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(policy).alias("policy"), F.col(page).alias("page"))
    linked, numeric, frequent = misreadings(rows, "text")
    bits = shared(spark, np.packbits(bitmap(linked, "word")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen, known, common = np.unpackbits(bits.value).astype(bool), Hashes(), Words(), frequent.value
        odd: dict[str, bool] = {}

        def suspects(p: str) -> list[dict]:
            chunks, out, times = p.split(), [], Counter()
            for i, c in enumerate(chunks):
                hit = odd.get(c)
                if hit is None:
                    if len(odd) > 400_000:
                        odd.clear()
                    hit = odd[c] = any(mask[seen[w] >> (64 - BITMAP_BITS)] for w in known[c])
                if hit:
                    near = ["\n", *(w for x in chunks[max(0, i - 2) : i] for w in known[x]), *known[c], *(w for x in chunks[i + 1 : i + 3] for w in known[x]), "\n"]
                    at = len(near) - 1 - sum(len(known[x]) for x in chunks[i + 1 : i + 3]) - len(known[c])
                    for k, w in enumerate(known[c], at):
                        if mask[seen[w] >> (64 - BITMAP_BITS)]:
                            out.append({"word": w, "nth": times[w], "before": dimension(near[k - 1], common, seen), "after": dimension(near[k + 1], common, seen)})
                            times[w] += 1
            return out

        for batch in batches:
            out = []
            for t, page in zip(*(batch.column(c).to_pylist() for c in ("text", "page"))):
                if not t:
                    out.append((False, False, False, [], [], [], []))
                    continue
                p = healed(t)
                header = cued(p)
                rest = without_cued(p) if header else p  # beside a whole header there may be a clipped one
                pieces = [] if p.isupper() else list({m.group() for m in _PIECE.finditer(rest) if m.end() - m.start() >= CLIPPED})
                numbers = [dict(zip(("start", "end", "left", "right"), x)) for x in bare_numbers(p, page)]
                out.append((broken(t), bool(stamp_spans(p)), header, suspects(p), pieces, [{"line": a, "beside": b} for a, b in header_lines(p)], numbers))
            flags, rest = list(zip(*out))[:3], list(zip(*out))[3:]
            types = (SUSPECTS, pa.list_(pa.string()), LINES, NUMBERS)
            yield pa.record_batch([batch.column(0), batch.column(3), *(pa.array(x, pa.bool_()) for x in flags), *(pa.array(x, kind) for x, kind in zip(rest, types))], names)

    names = ["id", "policy", "broken", "stamp", "header", "suspects", "pieces", "lines", "numbers"]
    found = rows.select("id", "text", "page", "policy").where("text is not null").mapInArrow(
        look,
        "id long, policy string, broken boolean, stamp boolean, header boolean, suspects array<struct<word: string, nth: int, before: int, after: int>>, pieces array<string>,"
        " lines array<struct<line: string, beside: string>>, numbers array<struct<start: int, end: int, left: string, right: string>>",
    )
    found = cut_lineage(found)
    heads = learned_headers(found)
    reading = F.arrow_udf(lambda r, a, b: pa.array([read_as(*x) for x in zip(r.to_pylist(), a.to_pylist(), b.to_pylist())], pa.string()), "string")
    # one row an occurrence: a word that is misread very often is hot, so the few words are sent to the occurrences where they fit
    fixes = found.select("id", F.explode("suspects").alias("s")).select("id", "s.*").join(linked, "word").select("id", "word", "nth", reading("reads", "before", "after").alias("fix"))
    fixes = fixes.groupBy("id").agg(F.collect_list(F.struct("word", "nth", "fix")).alias("fixes"))
    # a number belongs to the wording if either word beside it often has one
    sides = found.select("id", F.explode("numbers").alias("x")).select("id", "x.*")
    taken = sides.select("id", "start", F.explode(F.array("left", "right")).alias("side")).join(numeric, "side", "left_semi").select("id", "start").distinct()
    bare = sides.join(taken, ["id", "start"], "left_anti").groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("numbers"))
    match = F.arrow_udf(lambda p, h: pa.array([clipped_header(t, hs) is not None for t, hs in zip(p.to_pylist(), h.to_pylist())], pa.bool_()), "boolean")
    clipped = found.select("id", "policy", F.explode("pieces").alias("piece")).join(heads, "policy").where(match("piece", "headers")).select("id", F.lit(True).alias("clipped")).distinct()
    out = found.select("id", "policy", "broken", "stamp", "header").join(fixes, "id", "left").join(clipped, "id", "left").join(bare, "id", "left")
    out = out.withColumn("header", F.col("header") | F.col("clipped").isNotNull()).withColumn("stamp", F.col("stamp") | F.col("numbers").isNotNull())
    return out.join(heads.withColumnRenamed("policy", "p"), F.col("header") & (F.col("policy") == F.col("p")), "left").drop("p", "clipped", "policy")


SUSPECTS = pa.list_(pa.struct([("word", pa.string()), ("nth", pa.int32()), ("before", pa.int32()), ("after", pa.int32())]))
NUMBERS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("right", pa.string())]))
NOISY = "broken or stamp or header or fixes is not null"


def repaired(df: DataFrame, id: str, text: str, policy: str, page: str) -> DataFrame:
    """(id, text, repaired): the texts that have noise, and what they read without: words healed and corrected, headers
    and stamps dropped, lines reflowed except before list items. All other texts are clean as they are."""
    found = noise(df, id, text, policy, page).where(NOISY)
    both = found.join(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "id")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [clean(t, {(x["word"], x["nth"]): x["fix"] for x in f or ()}, h or [], [(x["start"], x["end"]) for x in n or ()]) for t, f, h, n in zip(*(batch.column(c).to_pylist() for c in ("text", "fixes", "headers", "numbers")))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "text", "repaired"])

    return both.select("id", "text", "fixes", "headers", "numbers").mapInArrow(repair, "id long, text string, repaired string")


_ITEM = re.compile(r"\n(?=\s*(?:\(?(?:[a-z]{1,2}|[ivxlcdm]{1,6}|\d{1,3})[.)]|[-•*])\s)")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans, blanks instead; those that overlap go as one."""
    kept, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            kept.append(text[at : max(a, at)])
            at = b
    return " ".join([*kept, text[at:]])


_UPRIGHT = re.compile(r"(?:[A-Z(][^\s]*|[|–&-])$")
_REST = re.compile(r"[^\s|]*(?:[ \t]*[|–-][ \t]*(?:\d{1,4}\b|(?i:CIN \S+)|(?i:customer information)|[A-Z]\S*))*")


def without_cued(text: str) -> str:
    """text without what is a header by its sign: the capitalised words that lead up to the sign on its line, six at
    most, and what hangs on behind it by bars and dashes; the whole line where all of it looks like a header. Words of
    the wording, in small letters, stay."""
    spans = []
    for m in CUES.finditer(text):
        a = m.start()
        line = text.rfind("\n", 0, a) + 1
        end = text.find("\n", m.end()) if "\n" in text[m.end() :] else len(text)
        if header_shaped(text[line:end].strip()):
            spans.append((line, end))
            continue
        joined = a > line and not text[a - 1].isspace()
        for k, w in enumerate(reversed(re.findall(r"[ \t]+|[^ \t]+", text[line:a]))):
            if k > 13 or not (w.isspace() or joined or _UPRIGHT.match(w)):
                break
            a, joined = a - len(w), False
        a += len(text[a : m.start()]) - len(text[a : m.start()].lstrip())
        spans.append((a, _REST.match(text, m.end()).end()))
    return without(text, spans)


def clean(text: str, fixes: dict[tuple[str, int], str], headers: list[str], numbers: list[tuple[int, int]]) -> str:
    """One text repaired: words healed and corrected, furniture out, lines reflowed. fixes has what the nth occurrence of
    a word reads, headers the policy's forms, numbers the spans of bare page numbers in the healed text."""
    out = healed(text)
    seen: Counter = Counter()
    spans, fixed, at = [*numbers, *stamp_spans(out)], [], 0
    if fixes:  # before anything is cut, as occurrences are counted in the whole text; a sign in front keeps spans right
        wrong = {w for w, _ in fixes}
        for m in _WORD.finditer(out):
            low = m.group().lower()
            if low in wrong:
                if (fix := fixes.get((low, seen[low]))) is not None:
                    fixed.append((*m.span(), fix))
                seen[low] += 1
    pieces = []
    for a, b, kind in sorted([*((a, b, None) for a, b in spans), *fixed], key=lambda x: x[:2]):
        if a < at:
            at = max(at, b) if kind is None else at
            continue
        w = out[a:b]
        pieces += [out[at:a], " " if kind is None else kind.upper() if w.isupper() and len(w) > 1 else kind.capitalize() if w[:1].isupper() else kind]
        at = b
    out = "".join([*pieces, out[at:]])
    for h in sorted(headers, key=len, reverse=True):
        if h in out:
            out = re.sub(re.escape(h) + r"(?:[ \t]*[|–-][ \t]*\d{1,4}\b)?", " ", out)
    while (span := clipped_header(out, headers)) is not None:
        out = out[: span[0]] + " " + out[span[1] :]
    if cued(out):
        out = without_cued(out)
    out = without(out, stamp_spans(out))  # a stamp beside a header shows only now
    items = [re.sub(r"\s+", " ", x).strip() for x in _ITEM.split(out)]
    return "\n".join(x for x in items if x)

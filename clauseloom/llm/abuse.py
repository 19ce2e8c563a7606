"""P9: abusive, hateful or sexual content, scored by a factorization machine over hashed terms.

A document is as bad as its worst passage, so passages are scored: sentences, long ones in windows.
A passage is its words, pairs of neighbouring words and consonants of words, hashed. The machine
learns a weight for every term and a vector for every term, whose products weigh pairs of terms: an
insult beside the mention of a group is worse than both alone.

It is trained on the raters' verdicts, which name documents, not passages, and are wrong at times. So
the labelled documents are dealt into folds: the passages a bad document owes its verdict to are chosen
by a machine that has not seen it, and one without such a passage teaches nothing. The scores that
the held-out documents get also say which score is a chance of one half.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.plain import plain
from clauseloom.llm.common import mixed, shared

#: Labelled documents the machine is trained on at most, the first by a hash of the id.
MAX_LABELLED = 30_000
#: Windows that teach what is good, at most: those that look worst, and as many others by a hash.
MAX_GOOD = 60_000
TERM_BITS, FACTORS = 17, 8
WINDOW, STEP = 12, 6
FOLDS, ROUNDS, EPOCHS, BATCH, RATE = 5, 2, 5, 256, 0.08
L2 = 2e-4
THRESHOLD = 0.5
#: Mean lift, in nats, of a passage's strongest terms from which a bad document may owe its verdict to it.
LIFT = 1.3
#: Words coded at once: bounds a worker's memory, changes no result.
PIECE = 200_000

# Digits and signs written for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?=[\s.!?,]|$)")
_SENTENCE = re.compile(r"\n+|(?<=[.!?।])[\"'”’)]*\s+")
_TOKEN = re.compile(r"[^\s\"“”,;:()\[\]{}]+")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_VOWELS = re.compile("[aeiouyv*]+")


class Tokens(dict):
    """A written word -> the word it stands for, or nothing."""

    def __missing__(self, w: str) -> str:
        if len(self) > 300_000:
            self.clear()
        core = w.strip(".!?'’-–—_/%*")
        out = core
        if any(c.isalpha() for c in core):
            if not core.isalpha():
                out = re.sub(r"(?<=[^\W\d_])[.·_-](?=[^\W\d_])", "", core) if core.count(".") + core.count("_") + core.count("·") else core
                if sum(c.isalpha() for c in out) > 1 or "@" in out or "$" in out:
                    out = out.translate(_LEET)
            out = _REPEATED.sub(r"\1", out)
        elif any(c.isdigit() for c in core):
            out = "0"
        self[w] = out
        return out


class Vocabulary(dict):
    """A written word -> the number of the word it stands for, -1 for nothing; by number: its hash and the cell of its consonants."""

    def __init__(self) -> None:
        super().__init__()
        self.tokens, self.number, self.hashes, self.consonants = Tokens(), {}, [], []

    def __missing__(self, raw: str) -> int:
        word = self.tokens[raw]
        n = -1
        if word:
            n = self.number.get(word)
            if n is None:
                n = self.number[word] = len(self.hashes)
                self.hashes.append(xxhash.xxh3_64_intdigest(word.encode("utf8", "surrogatepass")))
                bare = _VOWELS.sub("", word)
                self.consonants.append(xxhash.xxh3_64_intdigest(("~" + bare).encode("utf8", "surrogatepass")) % CELLS + 1 if len(bare) > 1 else 0)
        self[raw] = n
        return n

    def forget(self) -> None:
        if len(self) > 400_000:
            for x in (self, self.number, self.hashes, self.consonants):
                x.clear()


#: Cells of hashed terms; 0 is kept free.
CELLS = (1 << TERM_BITS) - 1


def passages(text: str) -> list[str]:
    whole = _SPACED.sub(lambda m: m.group().replace(" ", ""), plain(text).lower())
    return [p for p in _SENTENCE.split(whole) if p and not p.isspace()]


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells of pairs of neighbours, by their hashes."""
    with np.errstate(over="ignore"):
        return (mixed(a * np.uint64(0x9E3779B97F4A7C15) + b) % np.uint64(CELLS)).astype(np.int32) + 1


class Coded:
    """Passages in numbers: per word the cells of the word, its consonants, its pair with the next one, and its pairs with
    a window's front and back; windows of WINDOW words at most, STEP apart, as bounds, and the document of each."""

    def __init__(self, ids: list[int], lengths: list[int], docs: list[int], vocabulary: Vocabulary):
        at, n = np.array(ids, np.int64), np.array(lengths, np.int64)
        self.h = np.array(vocabulary.hashes, np.uint64)[at]
        self.word = (self.h % np.uint64(CELLS)).astype(np.int32) + 1
        self.bare = np.array(vocabulary.consonants, np.int32)[at]
        self.pair = _paired(self.h, np.roll(self.h, -1))
        edge = np.full(len(at), 1, np.uint64)
        self.front, self.back = _paired(edge, self.h), _paired(self.h, edge)
        many = np.where(n <= WINDOW, 1, -((STEP - n) // STEP))
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.a = np.repeat(np.cumsum(n) - n, many) + STEP * k
        self.b = np.minimum(self.a + WINDOW, np.repeat(np.cumsum(n), many))
        self.doc = np.repeat(np.array(docs, np.int64), many)

    def terms(self) -> np.ndarray:
        """The cells of every window, a row each; 0 where there are fewer."""
        at = self.a[:, None] + np.arange(WINDOW)
        inside = at < self.b[:, None]
        at = np.where(inside, at, 0)
        paired = inside[:, 1:]
        return np.concatenate([self.word[at] * inside, self.bare[at] * inside, self.pair[at[:, :-1]] * paired, self.front[self.a][:, None], self.back[self.b - 1][:, None]], axis=1)

    def keys(self) -> np.ndarray:
        """A hash of the words of every window."""
        at = self.a[:, None] + np.arange(WINDOW)
        inside = at < self.b[:, None]
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(WINDOW):
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside[:, i], self.h[np.where(inside[:, i], at[:, i], 0)], np.uint64(0)))
        return out


def coded(texts: Iterable[tuple[int, str | None]], vocabulary: Vocabulary) -> Iterator[Coded]:
    """(document, text)s in pieces of about PIECE words; a document may go over several."""
    ids: list[int] = []
    lengths, docs = [], []
    for d, text in texts:
        for p in passages(text) if text else ():
            mine = [n for w in _TOKEN.findall(p) if (n := vocabulary[w]) >= 0]
            if mine:
                ids += mine
                lengths.append(len(mine))
                docs.append(d)
                if len(ids) > PIECE:
                    yield Coded(ids, lengths, docs, vocabulary)
                    ids, lengths, docs = [], [], []
                    vocabulary.forget()
    if ids:
        yield Coded(ids, lengths, docs, vocabulary)
    vocabulary.forget()


class Machine:
    """A factorization machine of second order with a logistic loss, trained by adaptive gradients."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = CELLS + 1
        self.bias, self.w = -3.0, np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.01, (n, FACTORS)).astype(np.float32)
        self.v[0] = 0
        self.cut = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of windows given by their cells."""
        v = self.v[x]
        s = v.sum(1)
        return self.bias + self.w[x].sum(1) + 0.5 * ((s * s).sum(1) - (v * v).sum((1, 2)))

    def window_scores(self, c: Coded) -> np.ndarray:
        """The same for all windows of c, as differences of running sums: every word is looked up once."""
        table = np.concatenate([self.v, (self.v * self.v).sum(1, keepdims=True), self.w[:, None]], axis=1).astype(np.float64)
        zero = np.zeros((1, table.shape[1]))
        words = np.concatenate([zero, np.cumsum(table[c.word] + table[c.bare], axis=0)])
        pairs = np.concatenate([zero, np.cumsum(table[c.pair], axis=0)])
        total = words[c.b] - words[c.a] + pairs[c.b - 1] - pairs[c.a] + table[c.front[c.a]] + table[c.back[c.b - 1]]
        s = total[:, :FACTORS]
        return self.bias + total[:, -1] + 0.5 * ((s * s).sum(1) - total[:, FACTORS])

    def chance(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score - self.cut, -30, 30)))

    def train(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> None:
        rng, gw, gv, gb = np.random.default_rng(seed), np.full(len(self.w), 1e-3, np.float32), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                pick = order[at : at + BATCH]
                x = rows[pick]
                on = (x > 0)[:, :, None]
                v = self.v[x]
                s = v.sum(1)
                z = np.clip(self.bias + self.w[x].sum(1) + 0.5 * ((s * s).sum(1) - (v * v).sum((1, 2))), -30, 30)
                e = ((1 / (1 + np.exp(-z)) - y[pick]) * weight[pick]).astype(np.float32)
                ids, at_id = np.unique(x, return_inverse=True)
                at_id = at_id.reshape(-1)
                dw = np.bincount(at_id, np.repeat(e, x.shape[1]), len(ids)).astype(np.float32) + L2 * self.w[ids]
                per = (e[:, None, None] * (s[:, None, :] - v) * on).reshape(-1, FACTORS)
                dv = np.stack([np.bincount(at_id, per[:, f], len(ids)) for f in range(FACTORS)], 1).astype(np.float32) + L2 * self.v[ids]
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                db = float(e.sum())
                gb += db * db
                self.w[ids] -= RATE * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.3 * RATE * dv / np.sqrt(gv[ids])
                self.bias -= RATE * db / gb**0.5
                self.w[0], self.v[0] = 0, 0


class Labelled:
    """The distinct windows of labelled documents, and which document has which."""

    def __init__(self, labelled: list[tuple[int, str]]):
        self.y = np.array([y for y, _ in labelled], np.int64)
        keys, docs, terms = [], [], []
        for c in coded(((i, t) for i, (_, t) in enumerate(labelled)), Vocabulary()):
            keys.append(c.keys()), docs.append(c.doc), terms.append(c.terms())
        none = np.zeros((0, 3 * WINDOW + 1), np.int32)
        key, doc, term = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([none, *terms])
        self.keys, first, window = np.unique(key, return_index=True, return_inverse=True)
        self.rows = term[first]
        pairs = np.unique(doc * max(1, len(self.keys)) + window)
        self.doc, self.window = pairs // max(1, len(self.keys)), pairs % max(1, len(self.keys))  # in order of documents

    def scores(self, machine: Machine) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(machine.scores(self.rows[a : a + 8192]) for a in range(0, len(self.rows), 8192))])

    def best(self, score: np.ndarray) -> np.ndarray:
        """Of every document, the score of its worst window."""
        out = np.full(len(self.y), -30.0)
        np.maximum.at(out, self.doc, score[self.window])
        return out


def first_scores(data: Labelled, use: np.ndarray, background: np.ndarray, total: int) -> np.ndarray:
    """Before there is a machine: how much more often the bad documents of use hold a window's terms than documents at large."""
    bad = np.zeros(CELLS + 1)
    mine = use[data.doc] & (data.y[data.doc] == 1)
    pairs = np.unique(np.repeat(data.doc[mine], data.rows.shape[1]) * (CELLS + 1) + data.rows[data.window[mine]].reshape(-1))
    np.add.at(bad, pairs % (CELLS + 1), 1)
    lift = np.log((bad + 0.5) / ((data.y[use] == 1).sum() + 1)) - np.log((background + 0.5) / (total + 1))
    lift *= np.where(lift > 0, bad / (bad + 3), 1)  # what one or two bad documents hold says little
    lift[0] = -30.0
    top = [np.sort(lift[data.rows[a : a + 8192]], axis=1)[:, -8:] for a in range(0, len(data.rows), 8192)]
    top = np.concatenate([np.zeros((0, 8)), *top])
    some = np.maximum(top, -10.0)
    return np.where((top > -30).any(1), (some * (top > -30)).sum(1) / np.maximum(1, (top > -30).sum(1)), -30.0) - LIFT


def taught(data: Labelled, use: np.ndarray, score: np.ndarray, seed: int, good_below: float) -> Machine:
    """A machine trained on the documents of use: bad are the windows near the worst of each bad document by score, if
    that is above 0; good those that good documents hold, and low ones of bad documents."""
    y, mine = data.y[data.doc], use[data.doc]
    best = data.best(score)
    s = score[data.window]
    chosen = np.bincount(data.window[mine & (y == 1) & (best[data.doc] > 0) & (s > 0.5 * best[data.doc])], minlength=len(data.rows))
    good = np.bincount(data.window[mine & (y == 0)], minlength=len(data.rows))
    bad = np.bincount(data.window[mine & (y == 1)], minlength=len(data.rows))
    n_bad, n_good = int((data.y[use] == 1).sum()), int((data.y[use] == 0).sum())
    is_bad = (chosen > 0) & (chosen * n_good > good * n_bad) & (chosen >= good)  # seen mostly in bad documents, however many there are of each
    is_good = ~is_bad & ((good > 0) | (bad > 0) & (score < 0)) & (score < good_below)  # else a rater may have missed it
    pick = np.flatnonzero(is_good)
    if len(pick) > MAX_GOOD:
        worst = pick[np.argsort(-score[pick], kind="stable")]
        rest = worst[MAX_GOOD // 2 :]
        pick = np.concatenate([worst[: MAX_GOOD // 2], rest[np.argsort(data.keys[rest])][: MAX_GOOD // 2]])
    on = np.flatnonzero(is_bad)
    rows = data.rows[np.concatenate([on, pick])]
    target = np.concatenate([np.ones(len(on)), np.zeros(len(pick))])
    weight = np.concatenate([2 * np.minimum(4.0, chosen[on] ** 0.5), np.minimum(4.0, (good + bad)[pick] ** 0.5)])
    machine = Machine()
    if len(on):
        machine.train(rows, target, weight, seed)
    return machine


def cut_score(score: np.ndarray, y: np.ndarray) -> float:
    """The score from which verdicts of held-out documents are bad, by the most of them; of several as good the one
    nearest 0, and never beyond 3. Verdicts wrong either way at random leave it where it is."""
    cuts = np.unique(np.concatenate([[0.0], np.clip(score, -3, 3)]))
    cuts = np.concatenate([cuts, (cuts[1:] + cuts[:-1]) / 2])
    by = np.argsort(score, kind="stable")
    wrong_bad = np.concatenate([[0], np.cumsum(y[by])])  # bad ones below a cut
    at = np.searchsorted(score[by], cuts, "left")
    wrong = wrong_bad[at] + (len(y) - at) - (wrong_bad[-1] - wrong_bad[at])
    return float(min(zip(wrong.tolist(), abs(cuts).tolist(), cuts.tolist()))[2])


def fitted(labelled: list[tuple[int, str]], background: np.ndarray, total: int) -> Machine:
    """The machine for (verdict, text) of labelled documents; background says in how many of all total documents each
    term is. Without a bad document or a good one it scores everything low."""
    data = Labelled(labelled)
    if not (data.y == 1).any() or not (data.y == 0).any() or not len(data.rows):
        return Machine()
    fold = np.arange(len(data.y)) % FOLDS
    held = np.full(len(data.doc), -30.0)  # of every window in its document, by the machine that has not seen the document
    for f in range(FOLDS):
        use = fold != f
        score = first_scores(data, use, background, total)
        for round_ in range(ROUNDS):
            score = data.scores(taught(data, use, score, round_, LIFT if round_ == 0 else 3.0))
        mine = fold[data.doc] == f
        held[mine] = score[data.window[mine]]
    best = np.full(len(data.y), -30.0)
    np.maximum.at(best, data.doc, held)
    score = np.full(len(data.rows), -30.0)
    np.maximum.at(score, data.window, held)
    machine = taught(data, np.ones(len(data.y), bool), score, ROUNDS, 3.0)
    machine.cut = cut_score(best, data.y)
    return machine


def document_counts(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each term is, over all of them, and how many documents there are: a table of fixed size."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, out = Vocabulary(), np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            out[0] += batch.num_rows  # the free term counts the documents
            last = None
            for c in coded(enumerate(batch.column(0).to_pylist()), vocabulary):
                terms = c.terms()
                pairs = np.unique((np.repeat(c.doc, terms.shape[1]) << TERM_BITS) | terms.reshape(-1))
                if last is not None:
                    pairs = np.setdiff1d(pairs, last, assume_unique=True)  # a document that goes over two pieces
                k = pairs & CELLS
                out += np.bincount(k[k > 0], minlength=CELLS + 1)
                mine = pairs[pairs >> TERM_BITS == c.doc[-1]]
                last = mine if last is None or last[0] >> TERM_BITS != c.doc[-1] else np.union1d(last, mine)
        k = np.flatnonzero(out)
        yield pa.record_batch([pa.array(k), pa.array(out[k])], ["k", "n"])

    out = np.zeros(CELLS + 1)
    for k, n in docs.select(text).mapInArrow(part, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out, int(out[0])


def verdicts(labels: DataFrame, id: str, verdict: str) -> DataFrame:
    """(id, y): one verdict per document: what most raters say; without a majority, or only null ones, none."""
    return labels.where(F.col(verdict).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.avg(F.col(verdict).cast("double")).alias("m")).where("m <> 0.5").select("id", (F.col("m") > 0.5).cast("int").alias("y"))


def abuse_scores(docs: DataFrame, id: str, text: str, labels: DataFrame, verdict: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, keep..., score): one row per row of docs; score is the chance that its worst passage is abusive, hateful or
    sexual. Null and empty texts score 0. Texts are read whole, whatever their length."""
    spark = docs.sparkSession
    known = verdicts(labels, id, verdict).orderBy(F.xxhash64("id")).limit(MAX_LABELLED)
    sample = known.join(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "id").select("y", "text", "id").orderBy("id").collect()
    background, total = document_counts(docs, text)
    machine = shared(spark, fitted([(r["y"], r["text"]) for r in sample], background, total))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm, vocabulary = machine.value, Vocabulary()
        for batch in batches:
            best = np.full(batch.num_rows, -np.inf)
            for c in coded(enumerate(batch.column(0).to_pylist()), vocabulary):
                np.maximum.at(best, c.doc, fm.window_scores(c))
            out = np.where(np.isfinite(best), fm.chance(np.maximum(best, -30)), 0.0)
            yield pa.record_batch([*batch.columns[1:], pa.array(out, pa.float64())], [*batch.schema.names[1:], "score"])

    rows = docs.select(F.col(text).alias("_text"), id, *keep)
    return rows.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", score double")

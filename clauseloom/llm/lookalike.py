"""P1: text that looks the same but is spelt with other characters, brought to one form.

Vocabulary tries are walked with a weighted edit automaton. A look-alike letter, a joined or wide
form, a separate accent and an invisible character cost nothing; any other edit costs one, beyond
the budget. The spelling at the end of a zero-cost path is canonical (the most frequent, then the
first in order); a word that matches none is spelt by the table in functions.plain.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions import plain as P
from clauseloom.llm.common import LATIN_WORD, counted
from clauseloom.session import tasks

#: Occurrences a word needs to count as a spelling of the vocabulary.
MIN_COUNT = 2
EDIT_COST = 1.0
BUDGET = 0.5


class Trie:
    """Spellings with their counts; nodes are dicts, the count of a spelling lies under the empty key."""

    def __init__(self, words: Iterator[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = max(n, node.get("", 0))

    def canonical(self, token: str) -> str | None:
        """The best spelling within the budget: least cost, then most frequent, then first in order."""
        found: list[tuple[float, int, str]] = []
        # a path holds: node, spelling so far, {position in token: cost}
        stack = [(self.root, "", self._closed(token, {0: 0.0}))]
        while stack:
            node, spelt, at = stack.pop()
            if len(token) in at and "" in node:
                found.append((at[len(token)], -node[""], spelt))
            for c, child in node.items():
                if c:
                    if after := self._step(token, at, c):
                        stack.append((child, spelt + c, after))
        return min(found)[2] if found else None

    @staticmethod
    def _closed(token: str, at: dict[int, float]) -> dict[int, float]:
        """Positions reached by passing over invisible characters (free) or leaving characters out (an edit)."""
        for i in sorted(at):
            cost, j = at[i], i
            while j < len(token) and (cost := cost + (0.0 if token[j] in P.INVISIBLE else EDIT_COST)) <= BUDGET:
                j += 1
                at[j] = min(cost, at.get(j, cost))
        return at

    @classmethod
    def _step(cls, token: str, at: dict[int, float], c: str) -> dict[int, float]:
        after: dict[int, float] = {}

        def reach(j: int, cost: float) -> None:
            if cost <= BUDGET and cost < after.get(j, BUDGET + 1):
                after[j] = cost

        for i, cost in at.items():
            reach(i, cost + EDIT_COST)  # c inserted
            if i == len(token):
                continue
            for width, spelling in readings(token, i):
                if spelling == c:
                    reach(i + width, cost)
            reach(i + 1, cost + EDIT_COST)  # another letter in its place
        return cls._closed(token, after)


def readings(token: str, i: int) -> list[tuple[int, str]]:
    """(characters used, letter) for each way to read token from i as one letter at no cost."""
    c = token[i]
    out = [(1, c)]
    if like := P.LOOKALIKES.get(c):
        out.append((1, like))
    if not c.isascii() and len(wide := unicodedata.normalize("NFKC", c)) == 1 and wide != c:
        out.append((1, wide))
    j = i + 1
    while j < len(token) and unicodedata.combining(token[j]):
        j += 1
        for _, base in out[: 3 if j == i + 2 else 0]:
            if len(whole := unicodedata.normalize("NFC", base + token[i + 1 : j])) == 1:
                out.append((j - i, whole))
    return out


_JOINED = re.compile("[ﬀ-ﬆﬓ-ﬗ]")


def spread(token: str) -> str:
    """Joined letters as several, so that the automaton reads one letter at a time."""
    return _JOINED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), token)


def skeleton(word: str) -> str:
    """What all spellings of a word at zero cost have in common: look-alikes replaced, accents and the invisible gone."""
    word = "".join(P.LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKC", word) if c not in P.INVISIBLE)
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _tokens(text: str) -> list[str]:
    """Distinct words of a text that hold a character which may be a disguise."""
    return [w for w in dict.fromkeys(P.WORD.findall(text)) if P.suspect(w)]


def vocabulary(texts: DataFrame, column: str, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words in plain Latin spelling that occur min_count times or more in all texts."""
    return counted(texts, column, lambda t: [w for w in LATIN_WORD.findall(t)]).where(F.col("n") >= min_count)


def spellings(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, spelling) for each distinct token. Shards of the vocabulary, cut by a hash of the first four letters of
    the skeleton, meet the tokens of the same shard, so neither side is ever broadcast or collected."""
    spark = tokens.sparkSession
    shards = 4 * tasks(spark)

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            heads = pa.array([skeleton(w)[:4] for w in batch.column(0).to_pylist()], pa.string())
            yield pa.record_batch([*batch.columns, heads], [*batch.schema.names, "head"])

    left = tokens.mapInArrow(keyed, "token string, head string").withColumn("shard", F.expr(f"pmod(xxhash64(head), {shards})"))
    right = vocab.mapInArrow(keyed, "word string, n long, head string").withColumn("shard", F.expr(f"pmod(xxhash64(head), {shards})"))

    def match(mine: pa.Table, words: pa.Table) -> pa.Table:
        heads, names = set(mine["head"].to_pylist()), mine["token"].to_pylist()
        trie = Trie((w, n) for w, n, h in zip(*(words[c].to_pylist() for c in ("word", "n", "head"))) if h in heads)
        out = [trie.canonical(spread(token)) or P.fold_word(token) for token in names]
        return pa.table({"token": pa.array(names, pa.string()), "spelling": pa.array(out, pa.string())})

    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(match, "token string, spelling string")


def canonical_texts(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """The texts that may be disguised, as (keys, column, plain_text); all other texts are in plain form already.

    keys identify a text. Null and empty texts are in plain form. A text may be of any length: words
    are looked up one by one. A word wholly of another script is respelt only if the vocabulary has
    its Latin spelling, or if no word of the text needs that script.
    """
    mine = texts.select(*keys, column).where(P.may_be_disguised(column))
    split = F.arrow_udf(lambda s: pa.array([_tokens(t) for t in s.to_pylist()], pa.list_(pa.string())), "array<string>")
    held = mine.select(*keys, F.explode(split(column)).alias("token"))
    known = spellings(held.select("token").distinct(), vocabulary(texts, column))
    maps = held.join(known, "token").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("_m"))

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [respelt(t, dict(m or ())) for t, m in zip(batch.column(column).to_pylist(), batch.column("_m").to_pylist())]
            kept = batch.drop_columns(["_m"])
            yield pa.record_batch([*kept.columns, pa.array(out, pa.string())], [*kept.schema.names, "plain_text"])

    schema = T.StructType([*mine.schema.fields, T.StructField("plain_text", T.StringType())])
    return mine.join(maps, keys, "left").select(*mine.columns, "_m").mapInArrow(rewrite, schema)


def respelt(text: str, spelling: dict[str, str]) -> str:
    """text with its words spelt as given and everything between the words by the table."""
    foreign = any(not P._LATIN.search(w) and P._FOREIGN_RUN.search(w) and len(w) > 1 and P.all_lookalike(w) is None for w in spelling.values())

    def word(m: re.Match) -> str:
        w = spelling.get(m.group(), m.group())
        if not foreign and P._FOREIGN_RUN.search(w):
            w = P.all_lookalike(w) or w
        return w

    return P.plain(P.WORD.sub(word, text)) if not foreign else P.WORD.sub(word, text)

"""P6: texts that were cut off, mid-word or mid-sentence.

Every text without an end is held against longer copies elsewhere: values are sorted, and a value that
is a strict prefix of the next one was cut where the longer one goes on. Most cut texts have no longer
copy; for them the corpus says how their last words go on: a last word that occurs nowhere else is
half a word, as is one that is next to nothing beside the words it begins, and last words that elsewhere never end a
sentence are in mid-sentence. How often they occur is counted over all texts, exactly. A source's length limit and the marks a cut leaves count too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.glyphs import unbroken
from clauseloom.functions.plain import INVISIBLE, plain
from clauseloom.llm.common import BITMAP_BITS, bitmap, mixed, shared
from clauseloom.session import cut_lineage

#: Sentences must end after the last words in at least this share of their occurrences for the text to be whole.
END_SHARE = 0.02
#: Shortest prefix, in letters and digits, for which a longer copy is looked for.
MIN_PREFIX = 48
#: Characters of a text that are read to judge its end.
TAIL = 400
#: A line of at most so many words, at the end of a text, is a heading or a table row, not a sentence.
ROW_WORDS = 6
#: Rows of a source that must stop within SLACK characters of its greatest length for this to be a limit.
LIMIT_ROWS, SLACK = 3, 3

# Marks that a cut leaves behind.
MARKS = re.compile(r"(?:\s*(?:\[\s*(?:\.{2,}|…|truncated|cut|more)\s*\]|\(\s*(?:\.{2,}|…|truncated|cut|more)\s*\)|\.{3,}|…|�|(?<=[^\W\d_])-|\s[-–—]))+$", re.I)
_END = re.compile(r"[.!?।][\"'”’)\]]*$")
_CLOSED = re.compile(r"[)\]”\"%]$|/-$")
_ADDRESS = re.compile(r"(?:\S+\.\w{2,}/\S*|www\.\S+\.\w+|\S+@\S+\.\w+)$")
_MARKER = re.compile(r"(?:\(?(?:[a-z]{1,2}|[ivxlcdm]{1,6}|\d{1,3})[.)]|[-•*])$", re.I)
_STRIP = "\"'“”‘’()[]{}.,;:!?।"


class Chunks(dict):
    """What lies between blanks -> its number; for each number its unit's hash, and what it can be in a sentence.
    A unit is the chunk in small letters without punctuation around it; numbers are all alike."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self.words: list[str] = []
        self.flags: list[int] = []  # 1 end, 2 starts like the inside of a sentence, 4 list marker, 8 line break

    def __missing__(self, chunk: str) -> int:
        word = chunk.strip(_STRIP).lower()
        unit = "\n" if chunk == "\n" else "0" if word[:1].isdigit() and not any(c.isalpha() for c in word) else word
        self.words.append(unit)
        self.hashes.append(xxhash.xxh3_64_intdigest(unit.encode("utf8", "surrogatepass")))
        end = 1 if _END.search(chunk) else 0
        inner = 2 if chunk[:1].islower() or chunk[:1].isdigit() or chunk[:1] == "₹" else 0
        self.flags.append(end | inner | (4 if _MARKER.match(chunk) else 0) | (8 if chunk == "\n" else 0))
        self[chunk] = n = len(self.hashes) - 1
        return n

    def forget(self) -> None:
        for x in (self, self.hashes, self.words, self.flags):
            x.clear()

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts, one after the other: hashes of the units, whether an end follows, whether it is the last. Broken
        words are one unit. numbers has the numbers of what was read last."""
        if len(self) > 400_000:
            self.forget()
        flat: list[int] = []
        for text in texts:
            flat += [self[c] for c in plain(unbroken(text)).replace("\n", " \n ").split(" ") if c]
            flat.append(self["\n"])
            flat.append(self[""])  # the end of a text
        ids = self.numbers = np.array(flat, np.int64)
        f = np.array(self.flags, np.int8)[ids]
        line = np.roll(f & 8, 1) > 0
        line[:1] = True
        kept = ~((f & 8 > 0) | ((f & 4 > 0) & line))
        over = ids == self[""]
        h, f, over = np.array(self.hashes, np.uint64)[ids][kept], f[kept], over[kept]
        last = np.roll(over, -1)
        ends = (f & 1 > 0) & ((np.roll(f, -1) & 2 == 0) | last)
        return h, ends, last


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the last one, two and three units at each place."""
    one, two = np.roll(h, 1), np.roll(h, 2)
    with np.errstate(over="ignore"):
        g2 = mixed(h + one * np.uint64(0x9E3779B97F4A7C15))
        return mixed(h), g2, mixed(g2 + two * np.uint64(0xC2B2AE3D27D4EB4F))


def _longer(h: np.ndarray) -> np.ndarray:
    """Hashes under which the words that a unit, by its hash, begins are counted together."""
    with np.errstate(over="ignore"):
        return mixed(h + np.uint64(0xD6E8FEB86659FD93))


#: A last word that occurs less than so often for each longer word it begins is half of one of these.
HALF = 0.003
#: Occurrences a task holds before it sums them: bounds its memory, changes no result.
HELD = 1_000_000


def run_counts(df: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """(key, seen, ends): how often each asked run of one, two or three units (key, a hash of 64 bits) occurs before another
    unit or an end, and before an end, over all texts; under _longer of a unit, how often the words it begins. A bit map of fixed size rules out most other runs where the texts
    are; what it lets through is counted too and joins nothing."""
    bits = shared(df.sparkSession, np.packbits(bitmap(asked, "key")))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, chunks = np.unpackbits(bits.value).astype(bool), Chunks()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting, times = 0, np.zeros(0, np.int64)

        def words() -> None:
            """Adds the words seen so far to what they are longer forms of."""
            fronts, ns = [], []
            for n, w in zip(times.tolist(), chunks.words):
                if n and w.isalpha():
                    fronts += [xxhash.xxh3_64_intdigest(w[:i].encode("utf8", "surrogatepass")) for i in range(2, len(w))]
                    ns += [n] * (len(w) - 2)
            keys = _longer(np.array(fronts, np.uint64))
            ok = mask[keys >> np.uint64(64 - BITMAP_BITS)]
            held.append((keys[ok], np.zeros(int(ok.sum()), np.int64), np.array(ns, np.int64)[ok]))

        def flush() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
            n, e = (np.bincount(at, np.concatenate([x[c] for x in held]), len(keys)).astype(np.int64) for c in (2, 1))
            held.clear()
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(e)], ["key", "seen", "ends"])

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at in range(0, len(texts), 2000):
                if len(chunks) > 300_000:
                    words()
                    chunks.forget()
                    times = np.zeros(0, np.int64)
                h, ends, last = chunks.units(texts[at : at + 2000])
                more = np.bincount(chunks.numbers, minlength=len(chunks.words))
                more[: len(times)] += times
                times = more
                seen = ends | ~last  # what stops without an end is what is to be judged, not evidence
                for g in _grams(h):
                    ok = seen & mask[g >> np.uint64(64 - BITMAP_BITS)]
                    held.append((g[ok], ends[ok], np.ones(int(ok.sum()), np.int64)))
                    waiting += int(ok.sum())
                if waiting > HELD:
                    yield flush()
                    waiting = 0
        words()
        if held:
            yield flush()

    return df.select(column).mapInArrow(part, "key long, seen long, ends long").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


def tail_of(text: str) -> tuple[str, bool]:
    """The text without what is invisible or a cut's mark at its end, and whether there was such a mark."""
    text = plain(text).rstrip().rstrip(INVISIBLE).rstrip()
    end = MARKS.sub("", text[-MARK_CHARS:])
    return text[:-MARK_CHARS] + end, end != text[-MARK_CHARS:]


MARK_CHARS = 24


def first_verdict(text: str) -> tuple[str, str]:
    """Of a text's last characters 'whole', 'marked' or 'sentence' (mid-sentence) by themselves, or '' where the corpus has
    to be asked; and the text without a cut's mark."""
    bare, marked = tail_of(text)
    if not bare:
        return "whole", bare
    if marked and (not _END.search(bare[-8:]) or text.rstrip().endswith("]")):
        return "marked", bare
    if _END.search(bare[-8:]) or bare[-1] in ")]”\"%" or bare.endswith("/-") or _ADDRESS.search(bare[-100:]):
        return "whole", bare
    return ("sentence" if bare[-1] in ",;:-–—(“[/&+" else ""), bare


def is_row(bare: str) -> int:
    """Whether the last line of a text is short as a heading or a table row is: 1, or 2 for one that begins as a list item."""
    line = bare[bare.rfind("\n") + 1 :]
    words = line.split()
    return (2 if words and _MARKER.match(words[0]) else 1) if len(line) < 80 and len(words) <= ROW_WORDS else 0


#: A word that is the last of a sentence in less than this share of its occurrences ends no list item either.
NEVER_LAST = 0.0005


def asked_verdict(n: Column, e: Column) -> Column:
    """'whole', 'word' (half a word) or 'sentence' of a text by how often its last one, two and three units occur (n, arrays of
    three) and end a sentence (e), and, fourth of n, how often the words its last one begins; columns is_row and units say the rest."""
    t1, t2, t3, longer = (n[i] for i in range(4))
    total, ends = F.when(t3 >= 5, t3).otherwise(t2), F.when(t3 >= 5, e[2]).otherwise(e[1])
    often = F.when((ends > 0) & (ends >= END_SHARE * total), "whole").otherwise("sentence")
    rare = F.when((2 * e[0] >= t1) & (F.col("units") > 2), "whole").otherwise("sentence")
    return F.when((t1 < 2) | (t1 < HALF * longer), "word").when((t2 >= 2) & ((F.col("is_row") == 1) | (F.col("is_row") == 2) & (e[0] >= NEVER_LAST * t1)), "whole").when(t2 < 2, rare).otherwise(often)


# Bytes in small letters; bytes other than ASCII letters, digits and full stops, so all of any other character.
_SMALL = bytes(range(256)).lower()
_DROPPED = bytes(b for b in range(256) if not (bytes([b]).isalnum() or b == ord(".")))


def normal(text: bytes) -> bytes:
    """Letters, digits and full stops of a text in UTF-8, in small letters; by a table of bytes, as every text passes here and a pattern is dear."""
    return text.translate(_SMALL, _DROPPED)


def _hashes(values: list[bytes]) -> np.ndarray:
    """What xxhash64 of SQL makes of the same strings."""
    return np.array([xxhash.xxh64_intdigest(v, 42) for v in values], np.uint64)


def longer_copies(texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(key, goes_on): for each wanted text that is a strict prefix of a longer one, the next characters of that.

    wanted has the key (hash of the normal form) and the head (hash of its first characters) of each.
    Texts are compared by their letters, digits and full stops. Only texts that share their first
    MIN_PREFIX characters with a wanted one are sorted; equal texts count once, so no key is hot.
    """
    spark = texts.sparkSession
    heads, keys = (shared(spark, np.packbits(bitmap(wanted.select(c).distinct(), c))) for c in ("head", "key"))

    def held_by(bits: object, hashes: np.ndarray) -> np.ndarray:
        """Whether a hash may be one of those in the map; a wrong yes only adds a row that joins nothing."""
        at = hashes >> np.uint64(64 - BITMAP_BITS)
        return bits.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1 > 0

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normal(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            near = held_by(heads, _hashes([n[:MIN_PREFIX] for n in norms]))
            norms = list(dict.fromkeys(n for n, ok in zip(norms, near) if ok))
            yield pa.record_batch([pa.array(norms, pa.binary()).cast(pa.string()), pa.array(held_by(keys, _hashes(norms)))], ["norm", "wanted"])

    near = texts.where(F.col(text).isNotNull()).select(text).mapInArrow(fronts, "norm string, wanted boolean").distinct()
    ordered = near.repartitionByRange(F.col("norm")).sortWithinPartitions("norm").withColumn("p", F.spark_partition_id())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each value beside the next; the last of a partition is handed on as pending, the first as head."""
        before, wanted_before, part = None, False, None
        for batch in batches:
            out = []
            for value, want, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if before is None:
                    out.append((p, "head", value, None))
                elif wanted_before and value.startswith(before):
                    out.append((p, "found", before, value[len(before) : len(before) + 8]))
                before, wanted_before, part = value, want, p
            yield _rows(out)
        if wanted_before:
            yield _rows([(part, "pending", before, None)])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows) if rows else ((), (), (), ())
        return pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.string()), pa.array(c, pa.string()), pa.array(d, pa.string())], ["p", "what", "value", "goes_on"])

    scanned = cut_lineage(ordered.mapInArrow(scan, "p int, what string, value string, goes_on string"))
    found = scanned.where("what = 'found'").select(F.xxhash64("value").alias("key"), "goes_on")
    pending = scanned.where("what = 'pending'").select("p", F.col("value").alias("short"))  # one row a partition at most
    head = scanned.where("what = 'head'").select(F.lag("p").over(Window.orderBy("p")).alias("p"), F.col("value").alias("long"))
    across = pending.join(head, "p").where(F.expr("startswith(long, short)"))
    across = across.select(F.xxhash64("short").alias("key"), F.expr("substring(long, length(short) + 1, 8)").alias("goes_on"))
    return found.unionAll(across)


def cut_texts(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """(id, source, cut): one row per row of df; cut says whether its text was cut off.

    Null and empty texts are not cut. Rows delivered twice are judged alike. A text ending in an
    address, a closed bracket or an end of sentence is whole unless a longer copy goes on in mid-word.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(source).alias("source"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = [len(t) if t else 0 for t in texts]
            out, open_end, asked = [], [], []
            for i, t in enumerate(texts):
                t = t[-TAIL:] if t and (t[-1] not in ".!?।" or t.endswith("..")) else ""
                bare, marked = tail_of(t) if t else ("", False)
                open_ = bool(t) and (not _END.search(bare[-8:]) or marked)
                verdict, bare = first_verdict(t) if open_ else ("whole", "")
                out.append(verdict), open_end.append(open_)
                if not verdict:
                    asked.append((i, bare))
            row, units, keys = [0] * len(texts), [0] * len(texts), [None] * len(texts)
            norms = [normal(t.encode()) if open_ else b"" for t, open_ in zip(texts, open_end)]
            if asked:
                h, _, last = chunks.units([bare[-TAIL:] for _, bare in asked])
                at = np.flatnonzero(last)
                grams = np.stack([g[at].view(np.int64) for g in (*_grams(h), _longer(h))], axis=1).tolist()
                for (i, bare), n, g in zip(asked, np.diff(at, prepend=-1) - 1, grams):
                    row[i], units[i], keys[i] = is_row(bare), int(n), g
            more = [pa.array(out, pa.string()), pa.array(size, pa.int32()), pa.array(open_end, pa.bool_()), pa.array(row, pa.int32()), pa.array(units, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            more += [pa.array(_hashes(norms).view(np.int64)), pa.array(_hashes([n[:MIN_PREFIX] for n in norms]).view(np.int64)), pa.array(map(len, norms), pa.int32())]
            yield pa.record_batch([batch.column(0), batch.column(2), *more], ["id", "source", *names])

    names = ["verdict", "size", "open_end", "is_row", "units", "keys", "key", "head", "letters"]
    kinds = [T.StringType(), T.IntegerType(), T.BooleanType(), T.IntegerType(), T.IntegerType(), T.ArrayType(T.LongType()), T.LongType(), T.LongType(), T.IntegerType()]
    schema = T.StructType([rows.schema["id"], rows.schema["source"], *(T.StructField(n, k) for n, k in zip(names, kinds))])
    judged = rows.mapInArrow(judge, schema).select("id", "source", F.monotonically_increasing_id().alias("row"), *names)
    judged = cut_lineage(judged)
    asked = judged.where("keys is not null").select("row", "is_row", "units", F.posexplode("keys").alias("pos", "key"))
    counts = run_counts(rows, "text", asked.select("key").distinct())
    told = asked.join(counts, "key", "left").groupBy("row").agg(F.first("is_row").alias("is_row"), F.first("units").alias("units"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("seen", F.lit(0)).alias("n"), F.coalesce("ends", F.lit(0)).alias("e")))).alias("x"))
    told = told.select("row", asked_verdict(F.transform("x", lambda x: x["n"]), F.transform("x", lambda x: x["e"])).alias("told"))
    tops = judged.groupBy("source").agg(F.max("size").alias("top"))
    tops = judged.select("source", "size").join(tops, "source").where(F.col("size") >= F.col("top") - SLACK).groupBy("source", "top").count()
    limits = tops.where(F.col("count") >= LIMIT_ROWS).select("source", "top")
    wanted = judged.where("open_end").where(F.col("letters") >= MIN_PREFIX).select("key", "head")
    copies = longer_copies(rows, "text", wanted).groupBy("key").agg(F.max(F.expr("goes_on rlike '^[a-z0-9]'")).alias("goes_on"))
    out = judged.join(limits, "source", "left").join(copies, "key", "left").join(told, "row", "left").withColumn("verdict", F.coalesce("told", "verdict"))
    at_limit = F.col("open_end") & (F.col("size") >= F.col("top") - SLACK)
    goes_on = F.col("open_end") & F.col("goes_on")
    cut = (F.col("verdict") != "whole") | F.coalesce(at_limit, F.lit(False)) | F.coalesce(goes_on, F.lit(False))
    return out.select(F.col("id").alias(id), F.col("source").alias(source), cut.alias("cut"), "verdict", at_limit.alias("at_limit"), goes_on.alias("goes_on"))

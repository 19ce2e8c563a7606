"""Normal forms of text as columns. They are not interchangeable; each says what it keeps."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: The mark that begins a page in chunked text.
PAGE_MARK = r"\[\[page (\d+)\]\]"


def verbatim_key(text: str | None, marks: bool = True) -> str | None:
    """For comparing quotes: compatibility forms, quotes and dashes folded, blanks collapsed, hyphens inside words gone,
    small letters. With marks, page marks, soft hyphens and hyphenated line breaks are healed too."""
    if text is None:
        return None
    s = unicodedata.normalize("NFKC", text)
    if marks:
        s = re.sub(PAGE_MARK, "\n", s).replace("­", "")
    for signs, plain in (("[‘’ʼ]", "'"), ("[“”]", '"'), ("[‐-―]", "-")):
        s = re.sub(signs, plain, s)
    if marks:
        s = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", s)
    s = re.sub(r"\s+", " ", s)
    return re.sub(r"(?<=\w)\s*-\s*(?=\w)", "", s).strip().lower()


@F.arrow_udf(T.StringType())
def n1(text: pa.Array) -> pa.Array:
    """verbatim_key with marks; the built-ins have no compatibility normalisation."""
    return pa.array([verbatim_key(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def n2(text: pa.Array) -> pa.Array:
    """verbatim_key of quotes that never had page marks."""
    return pa.array([verbatim_key(t, marks=False) for t in text.to_pylist()], pa.string())


def n3(text: Text) -> Column:
    """Capitals, blanks collapsed."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(_c(text), F.lit(""))), r"\s+", " "))


def n4(text: Text) -> Column:
    """Small letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", "")


def n5(text: Text) -> Column:
    """Small letters and digits, words apart."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", " "))


def n6(text: Text) -> Column:
    """Letters of any script only: what a line has in common over pages whose numbers differ."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^\p{L}\p{Nl}\p{No}]+", " ")))


def n7(text: Text) -> Column:
    """Blanks collapsed, nothing else."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))


def slug(text: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def indian_digits(number: Text) -> Column:
    """12345678 as 1,23,45,678; null stays null, a sign stays in front."""
    whole = F.abs(F.round(_c(number))).cast("long").cast("string")
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    grouped = F.concat(F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,"), F.when(F.length(whole) > 3, ",").otherwise(""), F.right(whole, F.lit(3)))
    return F.when(_c(number) < 0, F.concat(F.lit("-"), grouped)).otherwise(grouped)


def clause_parts(text: Text) -> Column:
    """A clause's list items: split before `a.` or `ii.`."""
    parts = F.split(n7(text), r"(?=\s(?:[a-h]|[ivx]{1,4})\.\s)")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def cosine(a: Text, b: Text) -> Column:
    """Cosine of two number arrays; null where one is null, of other length or of length zero."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


def occurrences(text: Text, unit: str) -> Column:
    """array<struct<before, match>>: every match of the pattern unit, with all the text before it. A sentinel in front
    keeps the parts and the matches in step where text begins with a match."""
    s = F.concat(F.lit("\u0001"), F.coalesce(_c(text), F.lit("")))
    found = F.regexp_extract_all(s, F.lit(f"({unit})"), 1)
    parts = F.split(s, unit)
    lead = lambda i: F.substring(F.array_join(F.transform(F.sequence(F.lit(0), i), lambda k: F.concat(F.get(parts, k), F.when(k < i, F.get(found, k)).otherwise(""))), ""), 2, 1 << 30)
    return F.transform(found, lambda m, i: F.struct(lead(i).alias("before"), m.alias("match")))


def percent(share: Text, digits: int = 1) -> Column:
    """0.1234 as 12.3%; null stays null."""
    return F.concat(F.format_number(_c(share) * 100, digits), F.lit("%"))


def page_marks(text: Text) -> Column:
    """The pages whose marks are in a text, in order."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(PAGE_MARK), 1), lambda n: n.cast("long"))


def without_marks(text: Text) -> Column:
    return F.regexp_replace(_c(text), PAGE_MARK, "")


def snippet(text: Text, pattern: str, around: int) -> Column:
    """The first match of a pattern with up to `around` characters on each side; null where nothing matches."""
    t = _c(text)
    found = F.regexp_extract(t, f"({pattern})", 1)
    at = F.when(found != "", F.instr(t, found))
    start = F.greatest(F.lit(1), at - around)
    return F.when(found != "", F.substring(t, start, at - start + F.length(found) + around))

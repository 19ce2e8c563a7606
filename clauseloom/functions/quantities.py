"""Durations, sums of money and shares stated in prose, in common units: days, rupees, percent."""

from __future__ import annotations

import re

from clauseloom.functions.glyphs import glyph_skeleton, unbroken
from clauseloom.functions.plain import plain

DAYS, RUPEES, PERCENT = "duration_days", "amount_rupees", "share_percent"

# Units and how much of the common unit each is.
DURATION_UNITS = {
    "hour": 1 / 24, "hours": 1 / 24, "hr": 1 / 24, "hrs": 1 / 24, "h": 1 / 24, "day": 1, "days": 1, "d": 1, "dys": 1,
    "week": 7, "weeks": 7, "wk": 7, "wks": 7, "fortnight": 14, "fortnights": 14, "month": 30, "months": 30, "mth": 30, "mths": 30, "mo": 30, "mos": 30,
    "year": 365, "years": 365, "yr": 365, "yrs": 365, "annum": 365, "decade": 3650, "minute": 1 / 1440, "minutes": 1 / 1440, "min": 1 / 1440, "mins": 1 / 1440,
}
MONEY_SCALES = {
    "paise": 0.01, "paisa": 0.01, "hundred": 100, "thousand": 1e3, "thousands": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "l": 1e5,
    "million": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7,
}
SHARE_UNITS = {"%": 1, "percent": 1, "per cent": 1, "per centum": 1, "percentum": 1, "pct": 1, "bps": 0.01, "basis points": 0.01, "basis point": 0.01, "bp": 0.01, "times": 100, "fold": 100}
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
NUMBER_WORDS = {w: i for i, w in enumerate(ONES)} | TENS
SCALES = {"hundred": 100, "thousand": 1000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
FRACTIONS = {"half": 2, "halves": 2, "third": 3, "thirds": 3, "quarter": 4, "quarters": 4, "fourth": 4, "fourths": 4, "fifth": 5, "fifths": 5, "sixth": 6, "sixths": 6, "eighth": 8, "eighths": 8, "tenth": 10, "tenths": 10, "twentieth": 20, "twentieths": 20, "hundredth": 100, "hundredths": 100}
MULTIPLES = {"twice": 200, "thrice": 300, "double": 200, "triple": 300, "treble": 300}
QUALIFIERS = "continuous consecutive calendar policy full complete completed working business clear whole successive".split()
CURRENCY = "rupees rupee".split()

_QUALIFIED = rf"(?:(?:{'|'.join(QUALIFIERS)})\s+){{0,2}}"
_UNIT = rf"\s?\)?\s*(?:-\s*)?{_QUALIFIED}(?P<unit>{'|'.join(sorted((u for u in DURATION_UNITS if u not in ('d', 'h')), key=len, reverse=True))}|d(?=\.))\b(?![\s-]+care\b)"
_DURATION = re.compile(_UNIT)
_MONEY_AFTER = re.compile(rf"\s?\)?\s*(?P<scale>{'|'.join(sorted((s for s in MONEY_SCALES if s not in ('hundred',)), key=len, reverse=True))})\b(?P<rupees>\s+rupees?\b)?|(?P<dash>\s?\)?\s*/-)|\s?\)?\s+(?P<only>rupees?)\b")
_MONEY_BEFORE = re.compile(r"(?:₹|(?<![\w@$|!])(?:rs\.?|inr|rupees?))\s*\(?\s*$")
_SHARE = re.compile(r"\s?\)?\s*(?:-\s*)?(?P<unit>%|per\s?cent(?:um)?\b|percentage points?\b|pct\b|bps\b|bp\b|basis\s+points?\b|times\b|fold\b|x\b(?=\s+(?:of\s+)?the))")
_DIGITS = re.compile(r"\d[\d,]*(?:\.\d+)?")
_MONEY_STUCK = re.compile(r"(?:₹|(?<![\w@$|!])(?:rs\.?|inr))$")
_W = rf"(?:{'|'.join(sorted([*NUMBER_WORDS, *SCALES], key=len, reverse=True))})"
_TENS_ONES = rf"(?:(?:{'|'.join(TENS)})[\s-]?(?:{'|'.join(ONES[1:10])})|{_W})"
_SPELT = re.compile(rf"\b{_TENS_ONES}(?:[\s-]+(?:and\s+)?{_TENS_ONES})*\b")
_FRACTION = re.compile(rf"\b(?P<n>{'|'.join(ONES[1:20])}|a)[\s-]+(?P<d>{'|'.join(sorted(FRACTIONS, key=len, reverse=True))})\b(?!\s+(?:party|parties|of\s+(?:the\s+)?(?:year|month)))")
_MULTIPLE = re.compile(rf"\b(?P<m>{'|'.join(MULTIPLES)})\b(?=\s+(?:of\s+)?(?:the|its|such|that)\b)")
_AGE = re.compile(r"(?:\baged|\bage of|\battained|(?:above|below|over|under|beyond|of) the age)(?:\s+(?!proof)[a-z]+)?(?:\s+of)?\s*\(?$")
_OLDER = re.compile(r"\b(?:over|under|above|below)\s*\(?$")
_AGE_AFTER = re.compile(r"[^a-z]{0,12}(?:of age|old)\b")
_WORD = re.compile(r"[a-z]+")


def spelt_number(words: list[str]) -> float:
    """The value of number words: 'one hundred and twenty', 'twenty five lakh'."""
    total = part = 0.0
    for w in words:
        if w in NUMBER_WORDS:
            part += NUMBER_WORDS[w]
        elif w == "hundred":
            part = max(part, 1) * 100
        elif w in SCALES:
            total += max(part, 1) * SCALES[w]
            part = 0
    return total + part


_MINE = {*DURATION_UNITS, *MONEY_SCALES, *NUMBER_WORDS, *SCALES, *FRACTIONS, *MULTIPLES, *QUALIFIERS, *CURRENCY, "per", "cent", "percent", "centum", "basis", "points", "times", "bps", "aged", "age", "attained", "old"}
_BY_SKELETON = {glyph_skeleton(w): w for w in sorted(_MINE) if len(w) >= 3}
_JOINED = re.compile(rf"({'|'.join(TENS)})({'|'.join(ONES[1:10])})")


_SPELT_WORD, _FRACTION_WORD, _MULTIPLE_WORD = 1, 2, 4


class Spellings(dict):
    """What lies between blanks, in small letters -> the same with misread words of measurement put right, and which
    kinds of words for numbers are in it."""

    def __missing__(self, chunk: str) -> tuple[str, int]:
        if len(self) > 300_000:
            self.clear()
        right = chunk
        for w in re.findall(r"[a-z0-9@$|!]*[a-z@$][a-z0-9@$|!]*", chunk):
            meant = _BY_SKELETON.get(glyph_skeleton(w))
            if meant and w not in _MINE and len(w) >= 3 and any(c.isalpha() for c in w) and not re.fullmatch(r"\d+[kl]|[a-z]\d+", w):
                right = right.replace(w, meant)
        words = _WORD.findall(_JOINED.sub(r"\1 \2", right))
        kinds = _SPELT_WORD * any(w in NUMBER_WORDS for w in words) | _FRACTION_WORD * any(w in FRACTIONS for w in words) | _MULTIPLE_WORD * any(w in MULTIPLES for w in words)
        self[chunk] = right, kinds
        return right, kinds


def quantities(text: str | None, spell: Spellings) -> set[tuple[str, int]]:
    """(kind, amount) of every duration, sum of money and share in text, in days, rupees and percent, rounded.

    Ages of persons, clock times and numbers of clauses, pages, forms, items and lists are none. Null
    and empty texts have none; text of any length is read whole.
    """
    if not text:
        return set()
    chunks = [spell[c] for c in plain(unbroken(text)).lower().split()]
    t = " ".join([c for c, _ in chunks])
    kinds = 0
    for _, k in chunks:
        kinds |= k
    out: set[tuple[str, int]] = set()

    def put(kind: str, value: float) -> None:
        out.add((kind, int(value + 0.5 + 1e-9)))

    def measured(value: float, start: int, end: int, spelt_scale: bool = False) -> None:
        before, after = t[max(0, start - 22) : start], t[end : end + 60]
        money = _MONEY_BEFORE.search(before)
        if not money:
            if m := _SHARE.match(after):
                unit = re.sub(r"\s+", " ", m["unit"])
                factor = 100 if unit in ("times", "fold", "x") else 0.01 if unit.startswith(("b",)) else 1
                return put(PERCENT, value * factor)
            if m := _DURATION.match(after):
                rest = after[m.end() :]
                years = m["unit"].startswith("y")
                aged = years and (_AGE.search(t[max(0, start - 40) : start]) or (_AGE_AFTER.match(rest) and (rest[:8] in (" of age,", " old") or _OLDER.search(before) or _AGE_AFTER.match(rest).end() < 9)))
                if not aged:
                    put(DAYS, value * DURATION_UNITS[m["unit"]])
                return
        m = _MONEY_AFTER.match(after)
        if money or spelt_scale or (m and (m["dash"] or m["only"] or m["scale"] in ("paise", "paisa") or (m["scale"] and m["scale"] not in ("k", "l", "thousand", "thousands", "million")) or m["rupees"])):
            put(RUPEES, value * (MONEY_SCALES[m["scale"]] if m and m["scale"] else 1))

    for m in _DIGITS.finditer(t):
        start = m.start()
        stuck = t[start - 1] if start else " "
        if stuck in "₹.:/-–" or stuck.isalnum() or stuck in ",_":
            if not _MONEY_STUCK.search(t[max(0, start - 4) : start]):
                continue
        if t[m.end() : m.end() + 1] == ":" and t[m.end() + 1 : m.end() + 2].isdigit():
            continue
        raw = m.group()
        digits = raw.rstrip(",")
        measured(float(digits.replace(",", "")), start, start + len(digits))
    if kinds & _FRACTION_WORD:
        for m in _FRACTION.finditer(t):
            n = 1 if m["n"] == "a" else NUMBER_WORDS[m["n"]]
            if n < FRACTIONS[m["d"]]:
                put(PERCENT, 100 * n / FRACTIONS[m["d"]])
    if kinds & _MULTIPLE_WORD:
        for m in _MULTIPLE.finditer(t):
            put(PERCENT, MULTIPLES[m["m"]])
    for m in _SPELT.finditer(t) if kinds & _SPELT_WORD else ():
        words = _WORD.findall(_JOINED.sub(r"\1 \2", m.group()))
        if not any(w in NUMBER_WORDS for w in words):
            continue
        end = m.end()
        if (p := re.match(r"\s*\(\s*\d[\d,.]*\s*\)", t[end : end + 16])) is not None:
            end += p.end()
        measured(spelt_number(words), m.start(), end, spelt_scale=words[-1] in SCALES and words[-1] not in ("hundred", "thousand"))
    return out

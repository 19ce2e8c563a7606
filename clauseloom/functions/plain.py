"""Plain form of single characters: one table that says how disguised text is spelt.

Everything here works on one text at a time and needs no corpus; operators that decide by the
vocabulary of a corpus build on it.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "ï", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ԛ": "Q", "Ӏ": "I",
    # Greek, small
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Latin letters of phonetic alphabets, Armenian
    "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ʟ": "L", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
}
# Look-alikes so exact that a lone letter may stand for the Latin word it spells.
LONE = {c for c in LOOKALIKES if "Ѐ" <= c <= "ӿ" or "Α" <= c <= "Ω" or c == "ο"}
# Blanks other than space and line or page breaks; hyphens that do not break.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2011"
# Invisible characters.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u3164\ufe0e\ufe0f\ufeff\uffa0"

_JOINERS = "\u200c\u200d"
_INDIC = "\u0900-\u0dff"
_WIDE = "\uff01-\uff5e"
_LIGATURES = "\ufb00-\ufb06\ufb13-\ufb17"
_MARKS = "\u0300-\u0345"
_FANCY = "\U0001d400-\U0001d7ff\u24b6-\u24e9\u2100-\u2121\u2123-\u2149"  # letters in styles, letters in circles
_FOREIGN = "\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u0251\u0261\u0131\u0269\u029f"

_ANY = re.compile(f"[{_WIDE}{_LIGATURES}{_MARKS}{_FANCY}{_FOREIGN}{BLANKS}{HYPHENS}{INVISIBLE}]")
#: Java's pattern for a superset of _ANY, few ranges to test a character against: no letter, sign or Indian script that is plain.
_SUSPECT_JAVA = r"[^\x00-\x9f\xa1-\xac\xae-\x{250}\x{900}-\x{dff}\x{2012}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20ff}\x{2200}-\x{24b5}]"


def may_be_disguised(text: str) -> Column:
    """A first filter in the JVM: the column text holds something beside ASCII, and of that a character that may be a disguise."""
    return (F.length(text) != F.octet_length(text)) & F.col(text).rlike(_SUSPECT_JAVA)


_BLANK = re.compile(f"[{BLANKS}]")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_HIDDEN = re.compile(f"(?<![{_INDIC}])[{_JOINERS}]|[{''.join(x for x in INVISIBLE if x not in _JOINERS)}]")
_COMPAT = re.compile(f"[{_WIDE}{_LIGATURES}{_FANCY}]+")
_ACCENT = re.compile(f"[^\\W\\d_][{_MARKS}]+")
#: A word with everything that may be hidden in it.
WORD = re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[{_MARKS}{INVISIBLE}])*")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_FOREIGN_RUN = re.compile(f"[{_FOREIGN}]")


def suspect(text: str) -> bool:
    """Whether text holds a character that can be part of a disguise at all."""
    return not text.isascii() and _ANY.search(text) is not None


def fold_word(word: str) -> str:
    """A word by the table alone: hidden characters out, wide and joined letters and accents composed, look-alikes in
    a word that also has Latin letters replaced. A word wholly of another script stays as it is."""
    word = _HIDDEN.sub("", word)
    word = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), word)
    if _FOREIGN_RUN.search(word) and _LATIN.search(word):
        word = "".join(LOOKALIKES.get(c, c) for c in word)
    return _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m.group()), word)


def all_lookalike(word: str) -> str | None:
    """The Latin spelling of a word made of look-alikes only, else None."""
    latin = [LOOKALIKES.get(c) for c in word]
    if not word or None in latin or (len(word) == 1 and word not in LONE):
        return None
    return "".join(latin)


def plain(text: str | None) -> str | None:
    """text in plain form by the table. Null stays null, an empty text empty."""
    if text is None or text.isascii() or not _ANY.search(text):
        return text
    text = _HYPHEN.sub("-", _BLANK.sub(" ", _HIDDEN.sub("", text)))
    text = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if not _FOREIGN_RUN.search(text) and not _ACCENT.search(text):
        return text
    latin_text = _LATIN.search(text) is not None

    def word(m: re.Match) -> str:
        w = fold_word(m.group())
        if latin_text and _FOREIGN_RUN.search(w):
            return all_lookalike(w) or w
        return w

    return " ".join([c if c.isascii() else WORD.sub(word, c) for c in text.split(" ")])

"""Signs that scanners take for each other."""

from __future__ import annotations

import re

# Glyphs taken for each other, as classes of single signs, then as sequences.
_GLYPHS = str.maketrans({"1": "l", "i": "l", "|": "l", "!": "l", "0": "o", "5": "s", "$": "s", "e": "c", "f": "t", "b": "h", "8": "h", "6": "h", "u": "h", "q": "g", "9": "g", "@": "a"})
_SEQUENCES = re.compile("rn|vv|cl|ll")
_AS_ONE = {"rn": "m", "vv": "w", "cl": "d", "ll": "h"}

#: A hyphen-like mark and a line break; a word is broken there if letters stand on both sides.
_BREAK = re.compile("[-\u00ac\u00ad\u2010\u2011]\\s*\\n\\s*")


def _breaks(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _BREAK.finditer(text):
        a = m.start() - 1 if text[m.start() - 1 : m.start()] in (" ", "\t") else m.start()
        if a > 0 and text[a - 1].isalpha() and text[m.end() : m.end() + 1].isalpha():
            out.append((a, m.end()))
    return out


def broken(text: str) -> bool:
    """Whether a word of text is broken over two lines by a hyphen-like mark."""
    return "\n" in text and bool(_breaks(text))


def unbroken(text: str) -> str:
    """text with such words in one piece."""
    if "\n" in text:
        for a, b in reversed(_breaks(text)):
            text = text[:a] + text[b:]
    return text


def glyph_skeleton(word: str) -> str:
    """The same for a word in small letters and for what a scanner makes of it."""
    return _SEQUENCES.sub(lambda m: _AS_ONE[m.group()], word.translate(_GLYPHS))

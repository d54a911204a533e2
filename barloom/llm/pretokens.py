"""Splitting of texts before the merges of a BPE vocabulary, over plain `re` where letters are Latin and over Unicode properties elsewhere."""

from __future__ import annotations

import re
import unicodedata

import regex

#: White space as the tokenizer files' patterns take it (the Unicode property).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN_END = 0x250
CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class(first: str) -> str:
    """Latin characters whose general category begins so, as a character class body."""
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c)).startswith(first))


BEYOND_LATIN = re.compile(f"[^\\x00-\\u{LATIN_END - 1:04x}]")
#: Words for the vocabulary with word ends: letters, single digits, runs of signs; white space goes.
_WORD = "%s|[{L}]+|[{N}]|[^{S}{L}{N}]+" % CLITICS
#: Words for the byte-level vocabulary: a space belongs to what follows it.
_BYTE = "%s| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+" % CLITICS


def _both(pattern: str):
    latin = re.compile(pattern.format(L=_class("L"), N=_class("N"), S=SPACE)).findall
    wide = regex.compile(pattern.format(L=r"\p{L}", N=r"\p{N}", S=SPACE)).findall
    return lambda text: (wide if BEYOND_LATIN.search(text) else latin)(text)


word_pieces = _both(_WORD)
byte_pieces = _both(_BYTE)


def lowered(text: str) -> str:
    """Lower case letter by letter: no special form for a sigma that ends a word."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def byte_letters() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return out

"""Pre-tokens of the byte-level vocabularies, and which characters they are certain for."""

from __future__ import annotations

import functools
import re
import unicodedata

import regex


#: All up to here is in Unicode 3.2; most texts need no closer look.
BEYOND = re.compile("[^\x00-\u0220]")


@functools.cache
def doubtful() -> re.Pattern:
    """Characters that Unicode 3.2 had not assigned: libraries may class them by different later versions.

    Strings with such a character are left to the tokenizer library as they are.
    """
    old = unicodedata.ucd_3_2_0.category
    spans, start = [], None
    for cp in range(0x80, 0x110001):
        unknown = cp < 0x110000 and old(chr(cp)) == "Cn"
        if unknown and start is None:
            start = cp
        elif not unknown and start is not None:
            spans.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


def certain(text: str) -> bool:
    return text.isascii() or BEYOND.search(text) is None or doubtful().search(text) is None


@functools.cache
def pattern(source: str | None = None) -> regex.Pattern:
    """The pattern of the byte-level vocabularies unless another is given."""
    if source is None:
        import public_tokenizers

        source = public_tokenizers.PATTERN
    return regex.compile(source)

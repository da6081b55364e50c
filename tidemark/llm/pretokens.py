"""Pre-token patterns of tokenizers for Python's own `re`, over the characters below U+0250.

`re` knows no \\p{L}; below U+0250 the letters, numbers and white space are listed instead, which it
also searches faster than by properties. Texts with other characters take the slower way.
"""

from __future__ import annotations

import re
import unicodedata

LIMIT = 0x250
#: What stops a text from being matched by these patterns. U+0307 comes from lower-casing U+0130 and is neither letter nor number.
WIDE = re.compile("[^\\x00-\\u024f\\u0307]")
SPACES = "\t-\r \x85\xa0"


def _listed(kind: str) -> str:
    found = [c for c in range(LIMIT) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in found if c - 1 not in found]
    ends = [c for c in found if c + 1 not in found]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


def plain(pattern: str) -> re.Pattern[str]:
    """A pattern with \\p{L}, \\p{N} and \\s, the first two inside brackets only, with these listed."""
    return re.compile(pattern.replace(r"\p{L}", _listed("L")).replace(r"\p{N}", _listed("N")).replace(r"\s", SPACES))

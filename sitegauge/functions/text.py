"""Word-level text normalisation, once as a Catalyst expression and once for Python workers.

Both follow one definition: lower-case the text, turn every run of characters that are neither
letters nor digits (Unicode classes L and N) into one space, and split at spaces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words of a text in a Python worker; null gives no words."""
    return _WORD.findall(text.lower()) if text else []


def normal_text(col: Column) -> Column:
    """The words of ``col`` joined by single spaces; null stays null, blank gives ''."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


def js_trim(col: Column) -> Column:
    """Trim every Unicode white space and the byte-order mark, as browsers' ``trim`` does."""
    return F.regexp_replace(col, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return F.length(col) + F.length(F.regexp_replace(col, r"[^\x{10000}-\x{10FFFF}]", ""))


def blank_to_null(col: Column) -> Column:
    """'' becomes null, everything else stays."""
    return F.when(col != "", col)

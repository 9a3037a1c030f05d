"""Text and key normalisation as native column expressions (no Python UDF).

Python's ``str.strip()`` / ``\\s`` treat more characters as whitespace than
Java's ``\\s`` or Spark's ``trim`` (which strips spaces only), so the class
is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters Python counts as whitespace (str.isspace)
WS_CLASS = (
    "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029"
    "\\u202f\\u205f\\u3000]"
)
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                             0x202F, 0x205F, 0x3000)))
# after non-ASCII removal only the ASCII part of that class can occur
ASCII_WS_CLASS = "[\\t-\\r\\x1c-\\x20]"
ASCII_NON_WS = "[^\\t-\\r\\x1c-\\x20]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def standardize_format(c) -> Column:
    """Light cleaning of statement text.

    NULL -> ''; every run of non-ASCII characters -> one space; ``http``
    followed by non-space characters is removed (also inside a word);
    whitespace runs -> one space; leading/trailing space removed.
    """
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    t = F.regexp_replace(t, "[^\\x00-\\x7F]+", " ")
    t = F.regexp_replace(t, f"http{ASCII_NON_WS}+", "")
    t = F.regexp_replace(t, f"{ASCII_WS_CLASS}+", " ")
    return F.trim(t)


def norm_speaker(c) -> Column:
    """lower, strip, whitespace runs -> '-'  ('Barack Obama' -> 'barack-obama').

    NULL stays NULL (a missing speaker always takes the default).
    """
    return F.regexp_replace(strip_ws(F.lower(_col(c))), f"{WS_CLASS}+", "-")


def norm_context(c) -> Column:
    """strip + lower ('A Chain Email' -> 'a chain email')."""
    return F.lower(strip_ws(_col(c)))


def norm_affil(c) -> Column:
    """strip + lower ('Democrat' -> 'democrat')."""
    return F.lower(strip_ws(_col(c)))


def statement_length(c) -> Column:
    """Length in characters (code points); NULL counts as ''."""
    return F.length(F.coalesce(_col(c), F.lit(""))).cast("int")


# fixed value: a token is a run of ASCII letters/digits or one ASCII
# punctuation character (what an uncased basic tokenizer yields on the
# cleaned, ASCII-only text before sub-word splitting)
TOKEN_PATTERN = "[a-z0-9]+|[!-/:-@\\[-`{-~]"


def word_tokens(c, clean: bool = True) -> Column:
    """Lower-cased tokens of the whole text (empty text -> empty array)."""
    t = standardize_format(c) if clean else F.coalesce(_col(c), F.lit(""))
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)

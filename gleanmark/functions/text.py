"""Text functions that follow Python's notion of whitespace."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanmark import vocabulary as V

# All characters that count as whitespace in Python strings.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    """NULL for the empty string (whitespace is kept)."""
    return F.nullif(col, F.lit(""))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def norm_substance(col: Column) -> Column:
    """Replace cyrillic look-alikes by latin letters and upper-case."""
    return F.upper(F.translate(col, V.HOMOGLYPHS_FROM, V.HOMOGLYPHS_TO))


def sanitize_name(col: Column) -> Column:
    """File-name-safe form: unsafe characters and runs of ``_`` become one ``_``."""
    safe = F.regexp_replace(col, r'[<>:"/\\|?*\s_]+', "_")
    safe = F.trim(safe, F.lit("_"))
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit("unknown")).otherwise(safe)


def expand_escapes(col: Column) -> Column:
    """Length of text as it appears inside a JSON string: escapes take two characters."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def count_tokens(col: Column) -> Column:
    """Default token counter: runs of word characters and single other symbols."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("bigint")

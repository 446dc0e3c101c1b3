"""Numbers read from and written to text the way Python does."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(?:_\d+)*"
_FINITE = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def text_to_double(col: Column) -> Column:
    """Double for a stripped numeric text, else NULL."""
    return F.when(
        col.rlike(_FINITE) | col.rlike(_SPECIAL),
        F.replace(col, F.lit("_"), F.lit("")).try_cast("double"),
    )


def double_to_text(col: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else with exponent."""
    raw = col.cast("string")
    size = F.abs(col)
    plain = F.regexp_replace(
        F.regexp_replace(col.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1)
    digits = F.replace(power, F.lit("-"), F.lit(""))
    exponent = F.concat(
        F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return (
        F.when(F.isnan(col), F.lit("nan"))
        .when(size == float("inf"), F.when(col > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, exponent))
    )


def fixed(col: Column, digits: int, signed: bool = False) -> Column:
    """``%.{digits}f`` with the exact binary value rounded half to even.

    The product with 10**digits is formed together with its rounding error
    (splitting both factors), so values next to a tie go the right way.
    """
    scale = float(10**digits)
    scale_high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    scale_low = scale - scale_high
    plus = F.lit("+") if signed else F.lit("")

    def factors(x: Column) -> Column:
        size = F.abs(x)
        split = size * 134217729.0
        high = split - (split - size)
        return F.struct(high.alias("high"), (size - high).alias("low"), (size * scale).alias("product"), x.alias("x"))

    def units(f: Column) -> Column:
        high, low, product = f["high"], f["low"], f["product"]
        error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
        whole = F.floor(product).cast("double")
        rest = product - whole
        odd = F.pmod(whole, F.lit(2.0)) == 1.0
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
        rounded = (whole + F.when(up, 1.0).otherwise(0.0)).cast("decimal(38,0)").cast("string")
        return F.struct(
            F.lpad(rounded, F.greatest(F.length(rounded), F.lit(digits + 1)), F.lit("0")).alias("digits"),
            F.when(f["x"] < 0, F.lit("-")).otherwise(plus).alias("sign"),
        )

    def text(u: Column) -> Column:
        cut = F.length(u["digits"]) - F.lit(digits)
        return F.concat(
            u["sign"], F.substr(u["digits"], F.lit(1), cut), F.lit("."), F.substr(u["digits"], cut + 1)
        )

    # Each step sees the one before as a variable, so nothing is computed twice.
    steps = F.transform(F.transform(F.transform(F.array(col), factors), units), text)
    return F.when(col.isNotNull(), F.get(steps, F.lit(0)))

"""One rule set for comparing record values.

A value is a number, a text, a list or null.  ``norm_value`` reduces a VARIANT
to a struct; its ``ckey`` is equal for two values exactly when they count as
the same value, so matching is plain equality on strings.

Numbers agree to nine decimals.  Values without equality (NaN, infinities)
have a NULL ``ckey``; the caller gives each such entry a key of its own.
Lists nested inside lists are compared by their JSON text.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanmark.functions import jsonvalue as J
from gleanmark.functions import numbers as N
from gleanmark.functions import text as TX

_NULL, _SEP = "z", "\u0001"


def number_key(number: Column) -> Column:
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.concat(F.lit("n:"), (F.round(number, 9) + 0.0).cast("string")))


def text_number(text: Column) -> Column:
    """Number written in a text, with an optional trailing percent sign."""
    bare = TX.strip(text)
    percent = F.when(
        bare.endswith("%"), N.text_to_double(TX.strip(F.regexp_replace(bare, "%$", "")))
    )
    return F.coalesce(percent, N.text_to_double(bare))


def scalar_number(value: Column, shape: Column) -> Column:
    return F.when(shape == "STRING", text_number(F.try_variant_get(value, "$", "string"))).when(
        (shape == "BOOLEAN") | (shape == "BIGINT") | shape.startswith("DECIMAL")
        | shape.isin("DOUBLE", "FLOAT"),
        F.try_variant_get(value, "$", "double"),
    )


def _scalar_parts(value: Column) -> Column:
    shape = J.kind(value)
    number = scalar_number(value, shape)
    text = F.when(shape == "STRING", F.lower(TX.strip(F.try_variant_get(value, "$", "string"))))
    missing = value.isNull() | (shape == "VOID")
    return F.struct(missing.alias("missing"), number.alias("num"), text.alias("text"), value.alias("raw"))


def _scalar_key(part: Column) -> Column:
    """``ckey`` of the struct made by ``_scalar_parts``."""
    return (
        F.when(part["missing"], F.lit(_NULL))
        .when(part["num"].isNotNull(), number_key(part["num"]))
        .when(part["text"].isNotNull(), F.concat(F.lit("s:"), part["text"]))
        .otherwise(F.concat(F.lit("j:"), F.to_json(part["raw"])))
    )


def _scalar_shown(part: Column, quote: bool) -> Column:
    text = part["text"]
    if quote:
        text = F.concat(F.lit("'"), text, F.lit("'"))
    return (
        F.when(part["missing"], F.lit("None"))
        .when(part["num"].isNotNull(), N.double_to_text(part["num"]))
        .when(part["text"].isNotNull(), text)
        .otherwise(F.to_json(part["raw"]))
    )


def value_parts(value: Column) -> Column:
    """First step: take a VARIANT apart into list flag, list elements and scalar."""
    listed = J.is_array(value)
    return F.struct(
        listed.alias("listed"),
        F.when(listed, F.transform(J.items(value), _scalar_parts)).alias("elements"),
        _scalar_parts(value).alias("scalar"),
    )


def norm_value(parts: Column, strict: bool) -> Column:
    """Second step: kind, number, canonical key and printed form of a value.

    Leniently, a list without any value counts as null and ``[x, x]`` as ``x``.
    """
    elements, scalar = parts["elements"], parts["scalar"]
    element_keys = F.transform(elements, _scalar_key)
    unequal = F.exists(element_keys, lambda k: k.isNull())
    list_key = F.when(
        ~unequal, F.concat(F.lit("l:["), F.array_join(element_keys, _SEP), F.lit("]"))
    )
    shown_list = F.concat(
        F.lit("["), F.array_join(F.transform(elements, lambda e: _scalar_shown(e, True)), ", "), F.lit("]")
    )
    if strict:
        null_list, pair = F.lit(False), F.lit(False)
    else:
        null_list = parts["listed"] & ~F.exists(elements, lambda e: ~e["missing"])
        first, second = F.get(elements, F.lit(0)), F.get(elements, F.lit(1))
        pair = (
            (F.size(elements) == 2)
            & (number_key(first["num"]) == number_key(second["num"]))
        )
        pair = F.coalesce(parts["listed"] & pair, F.lit(False))
    missing = null_list | (~parts["listed"] & scalar["missing"])
    number = F.when(pair, F.get(elements, F.lit(0))["num"]).when(~parts["listed"], scalar["num"])
    return F.struct(
        F.when(missing, "null").when(pair, "num").when(parts["listed"], "list")
        .when(scalar["num"].isNotNull(), "num").otherwise("str").alias("kind"),
        F.when(~missing, number).alias("num"),
        F.when(missing, F.lit(_NULL))
        .when(pair, number_key(F.get(elements, F.lit(0))["num"]))
        .when(parts["listed"], list_key)
        .otherwise(_scalar_key(scalar)).alias("ckey"),
        F.when(missing, F.lit("None")).when(parts["listed"], shown_list)
        .otherwise(_scalar_shown(scalar, False)).alias("shown"),
    )

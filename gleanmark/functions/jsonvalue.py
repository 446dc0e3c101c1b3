"""Reading untrusted JSON into VARIANT, and asking what a VARIANT holds."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.functions import numbers as N

# Placed after the parsed text inside one array: trailing text after the first
# value then shows up as a missing or shifted end mark.
_END_MARK = "␞"
_VALUE = r'(?s)^[ \t\r\n]*+(?:\{.*\}|\[.*\]|".*"|[\-0-9tfn].*)[ \t\r\n]*\z'


def last_key_wins(spark: SparkSession) -> None:
    """Accept repeated object keys, the last one winning."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_whole(text: Column) -> Column:
    """VARIANT if the *whole* text is one JSON value, else NULL.

    Text that no JSON value starts with, and text that does not end with the
    bracket or quote that closes its first one, is not parsed: a parser that
    fails leaves by an exception.
    """
    likely = F.when(text.rlike(_VALUE), text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), likely, F.lit(f',"{_END_MARK}"]')))
    # As an element of an array it is parsed once, though it is looked at twice.
    whole = lambda x: F.when(F.try_variant_get(x, "$[1]", "string") == _END_MARK, F.try_variant_get(x, "$[0]", "variant"))
    return F.get(F.transform(F.array(wrapped), whole), F.lit(0))


def empty_object() -> Column:
    return F.parse_json(F.lit("{}"))


def path(*keys: str) -> str:
    return "$" + "".join(f'["{key}"]' for key in keys)


def get(value: Column, key: str) -> Column:
    """Member of an object: NULL if absent, JSON null stays a VARIANT null.

    Read as a struct field: a path that meets nothing leaves by an exception,
    which costs more than the rest of a small record.
    """
    return fields(value, key).getField(key)


def kind(value: Column) -> Column:
    """Type text of a VARIANT, e.g. ``BIGINT``, ``STRING``, ``VOID``, ``ARRAY<..>``."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    """Shallow test: asking an object for one member never reads the others."""
    return F.try_variant_get(value, "$", "struct<`?` variant>").isNotNull()


def is_array(value: Column) -> Column:
    """Shallow test for arrays: elements that are no arrays themselves are not read."""
    return F.try_variant_get(value, "$", "array<array<variant>>").isNotNull()


def is_nonempty_object(value: Column) -> Column:
    return is_object(value) & (F.to_json(value) != "{}")


def fields(value: Column, *names: str) -> Column:
    """Several members of an object in one look; NULL for anything else.

    As with ``get``, absent members are NULL and JSON null is a VARIANT null.
    """
    listed = ",".join(f"`{name}` variant" for name in names)
    return F.try_variant_get(value, "$", f"struct<{listed}>")


def is_null(value: Column) -> Column:
    """Absent or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def items(value: Column) -> Column:
    """Elements of an array VARIANT; an empty array for anything else."""
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"), F.expr("cast(array() as array<variant>)")
    )


def members(value: Column) -> Column:
    """Members of an object VARIANT; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def keys(value: Column) -> Column:
    """Sorted key names of an object VARIANT."""
    return F.coalesce(F.map_keys(members(value)), F.expr("cast(array() as array<string>)"))


def shown_scalar(value: Column, quote: bool = False) -> Column:
    """A value as Python prints it; ``quote`` is the form used inside lists."""
    shape = kind(value)
    text = F.try_variant_get(value, "$", "string")
    if quote:
        text_shown = F.when(
            text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    else:
        text_shown = text
    return (
        F.when(value.isNull() | (shape == "VOID"), F.lit("None"))
        .when(shape == "STRING", text_shown)
        .when(shape == "BOOLEAN", F.initcap(text))
        .when(
            shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"),
            N.double_to_text(F.try_variant_get(value, "$", "double")),
        )
        .otherwise(text)
    )


def shown(value: Column) -> Column:
    """A scalar or list value as Python prints it."""
    return F.when(
        is_array(value),
        F.concat(
            F.lit("["),
            F.array_join(F.transform(items(value), lambda x: shown_scalar(x, quote=True)), ", "),
            F.lit("]"),
        ),
    ).otherwise(shown_scalar(value))


_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|\{\s*\}|\[\s*\]|[{}\[\],:]|[^\s{}\[\],:"]++', re.S)


def _laid_out(text: str, indent: int) -> str:
    out, depth = [], 0
    for token in _TOKEN.findall(text):
        depth += (token in "{[") - (token in "}]")
        line = "\n" + " " * (depth * indent)
        if token in "{[,":
            out += (token, line)
        elif token in "}]":
            out += (line, token)
        elif token == ":":
            out.append(": ")
        else:
            out.append("".join(token.split()) if token[0] in "{[" else token)
    return "".join(out)


def pretty(compact: Column, indent: int = 2) -> Column:
    """JSON text laid out over lines with ``indent`` spaces per level."""

    @arrow_udf("string")
    def laid_out(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if t is None else _laid_out(t, indent) for t in column.to_pylist()], pa.string())

    return laid_out(compact)

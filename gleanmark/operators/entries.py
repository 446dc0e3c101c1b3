"""Records to entries: one row per extracted fact, with its comparison key."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import jsonvalue as J
from gleanmark.functions import text as TX
from gleanmark.functions import values as VAL
from gleanmark.functions.numbers import double_to_text
from gleanmark.plans.settle import settle

PREDICTED, TRUTH = 0, 1
# Keys of an entry are never NULL (no unit is the empty ``unit_key``), so plain
# equality groups and joins them.
ENTRY_COLUMNS = ("side", "grp", "pos", "key", "key_norm", "unit", "unit_key", "num", "ckey", "shown")


def _first_present(value: Column, *keys: str) -> Column:
    """First member that is present; JSON null counts as present."""
    return F.coalesce(*[J.get(value, key) for key in keys])


def _cells(record: Column, grp: str, side: int) -> Column:
    """Array of untyped (side, grp, pos, key, value, unit) cells of one record group."""
    if grp == "mass":
        source = _first_present(record, V.MASS, "mass_fractions")
        key_names, value_names = (V.SUBSTANCE, "substance_name"), (V.MASS, "mass_fraction")
    else:
        source = J.get(record, V.OTHER)
        key_names, value_names = (V.PARAMETER,), V.OTHER_VALUE_KEYS

    names = (*key_names, *value_names, V.UNIT)

    def cell(member: Column, pos: Column) -> Column:
        first = lambda keys: F.coalesce(*[member["m"][key] for key in keys])
        unit = F.lit(None).cast("variant") if grp == "mass" else member["m"][V.UNIT]
        return F.struct(
            F.lit(side).alias("side"),
            F.lit(grp).alias("grp"),
            pos.cast("bigint").alias("pos"),
            first(key_names).alias("key_raw"),
            first(value_names).alias("value_raw"),
            unit.alias("unit_raw"),
        )

    members = F.transform(J.items(source), lambda item: F.struct(J.fields(item, *names).alias("m")))
    return F.filter(F.transform(members, cell), lambda c: c["key_raw"].isNotNull())


def explode_entries(
    df: DataFrame,
    records: dict[int, str],
    keep: Sequence[str],
    strict: bool = False,
    groups: Sequence[str] = ("mass", "other"),
) -> DataFrame:
    """Explode the VARIANT columns in ``records`` (side -> column) into entries.

    All sides and groups leave in a single pass over the row, so a record is
    parsed once.  Leniently, entries whose value is null are dropped.
    """
    cells = F.concat(
        *[_cells(F.col(column), grp, side) for side, column in records.items() for grp in groups]
    )
    rows = df.select(*keep, F.inline(cells))
    # Settled before it is normalized: what a query does not read of the value is not made.
    rows = settle(rows.withColumn("_parts", VAL.value_parts(F.col("value_raw"))), "_parts")
    rows = rows.withColumn("_value", VAL.norm_value(F.col("_parts"), strict))
    if not strict:
        rows = rows.filter(F.col("_value.kind") != "null")
    key_text = F.when(J.kind(F.col("key_raw")) == "STRING", F.try_variant_get("key_raw", "$", "string"))
    typed_key = F.concat(F.lit("\u0001"), F.to_json("key_raw"))
    norm = F.when(F.col("grp") == "mass", TX.norm_substance(key_text)).otherwise(key_text)
    unit_null = J.is_null(F.col("unit_raw"))
    unit_kind = J.kind(F.col("unit_raw"))
    # A mass entry is reported with its value as written, another one normalized.
    shown = F.when(F.col("grp") == "mass", J.shown(F.col("value_raw"))).otherwise(F.col("_value.shown"))
    return rows.select(
        *keep, "side", "grp", "pos",
        F.coalesce(key_text, J.shown(F.col("key_raw"))).alias("key"),
        F.coalesce(norm, typed_key).alias("key_norm"),
        F.when(~unit_null, J.shown(F.col("unit_raw"))).alias("unit"),
        F.when(unit_null, F.lit("")).when(
            unit_kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get("unit_raw", "$", "string"))
        ).otherwise(F.concat(F.lit("j:"), F.to_json("unit_raw"))).alias("unit_key"),
        F.col("_value.num").alias("num"),
        _own_key(F.col("_value.ckey")).alias("ckey"),
        shown.alias("shown"),
    )


def _own_key(ckey: Column) -> Column:
    """Values without equality get a key no other entry shares."""
    return F.coalesce(ckey, F.concat_ws(":", F.lit("x"), F.col("side"), F.col("pos")))


def number_entries(
    df: DataFrame, key: Column, number: Column, unit: Column, keep: Sequence[str]
) -> DataFrame:
    """Entries from relational columns: the same keys as for JSON records.

    ``df`` has ``side``, ``grp`` and ``pos``.
    """
    number = number.cast("double")
    norm = F.when(F.col("grp") == "mass", TX.norm_substance(key)).otherwise(key)
    return df.select(
        *keep, "side", "grp", F.col("pos").cast("bigint").alias("pos"),
        key.alias("key"), norm.alias("key_norm"),
        unit.alias("unit"), F.coalesce(F.concat(F.lit("s:"), unit), F.lit("")).alias("unit_key"),
        number.alias("num"), VAL.number_key(number).alias("ckey"),
        double_to_text(number).alias("shown"),
    ).withColumn("ckey", _own_key(F.col("ckey")))

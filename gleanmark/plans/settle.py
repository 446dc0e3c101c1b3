"""Keep costly columns computed once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Pass ``columns`` through a one-row generator.

    A filter on a derived column is normally moved in front of the projections
    that made it, with their expressions copied into the condition; for long
    chains that copies them many times over.  It is not moved in front of a
    generator, so the columns are computed once and then tested.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))

"""One-to-one matching of predicted and true entries, and the scores built on it.

Greedy matching under an equivalence gives ``sum(min(predicted, true))`` true
positives per distinct entry, so it is an aggregation.  Each level groups on a
finer key than the next and combines on the map side first; no level needs all
entries of a text, or of a key, in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.operators.entries import PREDICTED, TRUTH
from gleanmark.plans.ranks import running_total
from gleanmark.session import materialize

TEXT_KEYS = ("run_id", "text_index")
ENTRY_KEY = ("grp", "key_norm", "ckey", "unit_key")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def match_entries(entries: DataFrame, by: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """Counts per distinct entry: predicted, true and matched."""
    return entries.groupBy(*by, *ENTRY_KEY).agg(
        F.count_if(F.col("side") == PREDICTED).alias("n_pred"),
        F.count_if(F.col("side") == TRUTH).alias("n_true"),
    ).withColumn("tp", F.least("n_pred", "n_true"))


def score_keys(matches: DataFrame, by: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """tp, fp and fn per substance or parameter of a text.

    An unmatched truth only counts as missed if its key has no unmatched
    prediction: otherwise the wrong prediction already stands for it.
    """
    return matches.groupBy(*by, "grp", "key_norm").agg(
        F.sum("tp").alias("tp"),
        F.sum(F.col("n_pred") - F.col("tp")).alias("fp"),
        F.sum(F.col("n_true") - F.col("tp")).alias("unmatched_true"),
    ).withColumn("fn", F.when(F.col("fp") == 0, F.col("unmatched_true")).otherwise(0))


def rates(df: DataFrame) -> DataFrame:
    """Add precision, recall and f1 from tp, fp and fn; zero where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)}
    ).withColumn(
        "f1",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def score_texts(entries: DataFrame, by: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """Counts, score and rates per text and group."""
    per_text = score_keys(match_entries(entries, by), by).groupBy(*by, "grp").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    total = F.col("tp") + F.col("fp") + F.col("fn")
    return rates(per_text.withColumn("total", total).withColumn("score", _ratio(F.col("tp"), total)))


def quality(scores: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Micro precision, recall and f1 per run and group; accuracy is the mean text score.

    Texts without any entry do not enter the accuracy.  With ``runs`` (a table
    of ``run_id``) runs without entries appear with zeros.
    """
    out = scores.groupBy("run_id", "grp").agg(
        F.coalesce(F.avg(F.when(F.col("total") > 0, F.col("score"))), F.lit(0.0)).alias("accuracy"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum("total").alias("comparisons"),
    )
    if runs is not None:
        every = runs.select("run_id").distinct().select(
            "run_id", F.explode(F.array(F.lit("mass"), F.lit("other"))).alias("grp")
        )
        out = every.join(out, ["run_id", "grp"], "left").fillna(
            0, ["accuracy", "tp", "fp", "fn", "comparisons"]
        )
    return rates(out)


def surplus_entries(entries: DataFrame, by: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """The entries left over after matching, on either side.

    Matching consumes the earliest positions first, so of each distinct entry
    the rows ranked after the matched count remain.
    """
    entries = materialize(entries, "entries")
    matches = match_entries(entries, by).filter(F.col("n_pred") != F.col("n_true"))
    keys = [*by, *ENTRY_KEY]
    ranked = running_total(entries.join(matches, keys), [*keys, "side"], "pos", "_rank")
    return ranked.filter(F.col("_rank") > F.col("tp")).drop("_rank", "tp", "n_pred", "n_true")


def entry_errors(entries: DataFrame, by: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """One message per wrong prediction and per missed truth.

    A wrong prediction is shown with the first unmatched truth of its key; a
    truth is reported on its own only if its key has no wrong prediction.
    ``ord`` orders the messages of a text: mass before other, predictions
    before truths, then by position.
    """
    surplus = surplus_entries(entries, by)
    is_pred = F.col("side") == PREDICTED
    first_true = F.min_by(
        F.struct("shown", "unit"), F.when(~is_pred, F.col("pos"))
    )
    per_key = surplus.groupBy(*by, "grp", "key_norm").agg(
        F.count_if(is_pred).alias("n_wrong"), first_true.alias("truth")
    )
    joined = surplus.join(per_key, [*by, "grp", "key_norm"]).filter(
        is_pred | (F.col("n_wrong") == 0)
    )

    def side_text(value: Column, unit: Column) -> Column:
        shown_unit = F.when(
            (F.col("grp") == "other") & (F.coalesce(unit, F.lit("")) != ""),
            F.concat(F.lit(V.UNIT_LABEL), unit),
        )
        return F.concat(value, F.coalesce(shown_unit, F.lit("")))

    own = side_text(F.col("shown"), F.col("unit"))
    truth = F.coalesce(side_text(F.col("truth.shown"), F.col("truth.unit")), F.lit(V.ABSENT_LABEL))
    label = F.when(F.col("grp") == "mass", V.SUBSTANCE_LABEL).otherwise(V.PARAMETER_LABEL)
    message = F.concat(
        label, F.lit(" "), F.col("key"), F.lit(f": {V.PREDICTED_LABEL} "),
        F.when(is_pred, own).otherwise(F.lit(V.ABSENT_LABEL)),
        F.lit(f", {V.TRUTH_LABEL} "),
        F.when(is_pred, truth).otherwise(own),
    )
    rank = F.when(F.col("grp") == "mass", 0).otherwise(2) + F.when(is_pred, 0).otherwise(1)
    return joined.select(
        *by, "grp", "side", "pos",
        (F.shiftleft(rank.cast("bigint"), 48) + F.col("pos")).alias("ord"),
        message.alias("message"),
    )

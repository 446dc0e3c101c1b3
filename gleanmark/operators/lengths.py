"""Length and token profiles, output budgets and context headroom."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import jsonvalue as J
from gleanmark.functions import text as TX
from gleanmark.operators.salvage import parse_lenient

Counter = Callable[[Column], Column]


def answer_text(df: DataFrame, source: str, out: str) -> DataFrame:
    """Reference answer as indented JSON; text that is no JSON stays, stripped.

    Readable JSON keeps its own numbers and key order; repaired JSON is laid
    out from the parsed value.
    """
    text = F.coalesce(F.col(source), F.lit(""))
    df = parse_lenient(df, source, "_parsed").withColumn("_whole", J.parse_whole(text))
    filled = ~F.to_json("_parsed").isin("{}", "[]")
    plain = F.when(F.col("_whole").isNotNull(), text).otherwise(F.to_json("_parsed"))
    return df.withColumn(
        out, F.when(filled, J.pretty(plain)).otherwise(TX.strip(text))
    ).drop("_parsed", "_whole")


def length_profile(
    df: DataFrame, source: str, counter: Counter = TX.count_tokens, by: Sequence[str] = ()
) -> DataFrame:
    """Count, minimum, maximum, mean and nearest-rank p90/p95/p99 of text lengths.

    ``counter`` is any column function, e.g. a pandas UDF around a tokenizer,
    applied to the text with its escapes written out.  Zero lengths are left out.
    """
    lengths = df.select(
        *by, counter(TX.expand_escapes(F.coalesce(F.col(source), F.lit("")))).cast("bigint").alias("_len")
    ).filter(F.col("_len") > 0)
    # A third of the texts may share a length: count equal lengths first.
    histogram = lengths.groupBy(*by, "_len").agg(F.count(F.lit(1)).alias("_w"))

    def at_rank(q: float) -> Column:
        whole = F.floor(F.col("_n") * F.lit(q))
        return _value_at(F.when(whole == 0, F.col("_n")).otherwise(whole), "_len").alias(f"p{int(q * 100)}")

    return _ranked(histogram, by, "_len").groupBy(*by).agg(
        F.sum("_w").alias("n"), F.min("_len").alias("min_len"), F.max("_len").alias("max_len"),
        (F.sum(F.col("_len") * F.col("_w")) / F.sum("_w")).alias("mean_len"),
        *[at_rank(q) for q in (0.9, 0.95, 0.99)],
    )


def _ranked(histogram: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add ``_upto``, the weight up to and including the value, and ``_n``, that of the group.

    A group has a row for each distinct number of tokens, so at most as many
    as its longest text has tokens.
    """
    group = Window.partitionBy(*by)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumns({"_upto": F.sum("_w").over(upto), "_n": F.sum("_w").over(group)})


def _value_at(rank: Column, value: str) -> Column:
    """Aggregate: the value at a rank, counted from 1."""
    return F.min(F.when(F.col("_upto") >= rank, F.col(value)))


def recommend_budget(
    max_len: Column, margin: float = 0.15, minimum: int = 256, multiple: int = 64
) -> Column:
    """Output budget: the maximum plus a margin, at least ``minimum``, rounded up."""
    budget = F.greatest(max_len + F.floor(max_len * F.lit(margin)), F.lit(minimum))
    if multiple <= 0:
        return budget.cast("bigint")
    return (F.floor((budget + (multiple - 1)) / multiple) * multiple).cast("bigint")


def longest_example(
    df: DataFrame, prompt: str, answer: str, by: Sequence[str] = (), key: str = "text_index"
) -> DataFrame:
    """The row with the most characters in prompt plus answer, the first on ties."""
    total = F.length(prompt) + F.length(answer)
    order = F.struct(total, -F.col(key))
    row = F.struct(
        key, F.length(prompt).alias("prompt_chars"), F.length(answer).alias("answer_chars"),
        (total + 1).alias("total_chars"), F.concat_ws("\n", prompt, answer).alias("sequence"),
    )
    return df.groupBy(*by).agg(F.max_by(row, order).alias("_r")).select(*by, "_r.*")


def context_headroom(
    needs: DataFrame, limits: dict[str, int], model: str = "model_key", tokens: str = "tokens",
    default: int = V.DEFAULT_CONTEXT,
) -> DataFrame:
    """Tokens left in each model's context; ``over`` marks what does not fit.

    ``limits`` is configuration and becomes a literal map, so nothing is joined.
    """
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    limit = F.lit(default) if known is None else F.coalesce(F.try_element_at(known, F.col(model)), F.lit(default))
    return needs.withColumn("max_positions", limit.cast("bigint")).withColumns(
        {
            "remaining": F.col("max_positions") - F.col(tokens),
            "over": F.col("max_positions") < F.col(tokens),
        }
    )


def token_summary(
    results: DataFrame, by: Sequence[str] = ("model_key", "method"), prompt: str = "prompt",
    rendered: Column | None = None, counter: Counter = TX.count_tokens,
) -> DataFrame:
    """Rows, skipped empty outputs and mean and median tokens of prompt and output.

    The output is ``raw_output`` (else ``json``); a stored prompt is preferred
    over ``rendered``.
    """
    output = F.col("raw_output" if "raw_output" in results.columns else "json")
    stored = F.col(prompt) if prompt in results.columns else F.lit(None).cast("string")
    fallback = F.lit("") if rendered is None else rendered
    shown = F.when(~TX.is_blank(stored), stored).otherwise(fallback)
    counted = results.select(
        *by, TX.is_blank(output).alias("_empty"),
        counter(shown).cast("bigint").alias("prompt_tokens"),
        counter(output).cast("bigint").alias("output_tokens"),
    )
    # One pass to a histogram of token counts; all figures come from it.
    pairs = counted.groupBy(*by, "_empty", "prompt_tokens", "output_tokens").agg(F.count(F.lit(1)).alias("_w"))
    entry = lambda what, value: F.struct(F.lit(what).alias("_what"), value.alias("_value"))
    listed = F.when(F.col("_empty"), F.array(entry("skipped", F.lit(0).cast("bigint")))).otherwise(
        F.array(entry("prompt", F.col("prompt_tokens")), entry("output", F.col("output_tokens")))
    )
    histogram = (
        pairs.select(*by, "_w", F.inline(listed)).groupBy(*by, "_what", "_value").agg(F.sum("_w").alias("_w"))
    )
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    figures = _ranked(histogram, [*by, "_what"], "_value").groupBy(*by, "_what").agg(
        F.sum("_w").alias("_rows"), (F.sum(F.col("_value") * F.col("_w")) / F.sum("_w")).alias("_mean"),
        ((_value_at(low, "_value") + _value_at(high, "_value")) / 2).alias("_median"),
    )
    of = lambda what, column: F.max(F.when(F.col("_what") == what, F.col(column)))
    rows, skipped = (F.coalesce(of(what, "_rows"), F.lit(0)) for what in ("prompt", "skipped"))
    return figures.groupBy(*by).agg(
        rows.alias("rows"), (rows + skipped).alias("rows_in_file"), skipped.alias("skipped_empty_output"),
        of("prompt", "_mean").alias("avg_prompt_tokens"), of("output", "_mean").alias("avg_output_tokens"),
        of("prompt", "_median").alias("median_prompt_tokens"), of("output", "_median").alias("median_output_tokens"),
    )


def token_totals(summary: DataFrame) -> DataFrame:
    """Means over all result sets, weighted by their rows."""
    rows = F.sum("rows")
    weighted = lambda col: F.when(rows > 0, F.sum(F.col(col) * F.col("rows")) / rows)
    return summary.filter(F.col("rows") > 0).agg(
        F.count(F.lit(1)).alias("result_sets"), rows.alias("rows"),
        weighted("avg_prompt_tokens").alias("avg_prompt_tokens"),
        weighted("avg_output_tokens").alias("avg_output_tokens"),
    )


def _file_age(name: Column, mtime: Column) -> Column:
    """Sort key of a result file: a date in its name beats the file time.

    Times of four digits (hours, minutes) and six digits are both read.
    """
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    dated = r"_(\d{8})_(\d{6}|\d{4})$"
    time = F.rpad(F.regexp_extract(stem, dated, 2), 6, "0")
    return (
        F.when(
            stem.rlike(dated),
            F.struct(F.lit(2).alias("rank"),
                     F.regexp_extract(stem, dated, 1).cast("double").alias("major"),
                     time.try_cast("double").alias("minor")),
        )
        .when(
            stem.rlike(r"_\d{8}$"),
            F.struct(F.lit(1).alias("rank"),
                     F.regexp_extract(stem, r"_(\d{8})$", 1).cast("double").alias("major"),
                     F.lit(0.0).alias("minor")),
        )
        .otherwise(
            F.struct(F.lit(0).alias("rank"), mtime.cast("double").alias("major"), F.lit(0.0).alias("minor"))
        )
    )


def latest_results(files: DataFrame) -> DataFrame:
    """The newest result file of every folder; ``files`` has (folder, name, mtime)."""
    order = F.struct(_file_age(F.col("name"), F.col("mtime")).alias("age"), F.col("name"))
    return files.groupBy("folder").agg(F.max_by("name", order).alias("name"))


def attach_run(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Join result files to their run document, else to the last one in the folder.

    ``results`` has (folder, stem), ``runs`` (folder, stem, ...attributes).
    """
    attributes = [c for c in runs.columns if c not in ("folder", "stem")]
    packed = F.struct(*attributes)
    exact = runs.select("folder", "stem", packed.alias("_exact"))
    last = runs.groupBy("folder").agg(F.max_by(packed, F.col("stem")).alias("_last"))
    joined = results.join(exact, ["folder", "stem"], "left").join(last, "folder", "left")
    found = joined.withColumn("_run", F.coalesce("_exact", "_last"))
    return found.select(*results.columns, "_run.*")


def resolve_template(name: Column, folder: Column, templates: Sequence[str], default: str) -> Column:
    """Template for a stored name: itself, its alias, or without the decoder suffix.

    The folder name is the second source, ``default`` the last.
    """
    known = F.array(*[F.lit(t) for t in templates])
    exists = lambda c: F.when(F.array_contains(known, c), c)
    aliases = F.create_map(*[F.lit(x) for pair in V.TEMPLATE_ALIASES.items() for x in pair])

    def resolve(raw: Column) -> Column:
        bare = TX.strip(raw)
        cut = [
            F.when(bare.endswith(s), exists(F.left(bare, F.length(bare) - len(s))))
            for s in V.DECODER_SUFFIXES
        ]
        return F.coalesce(exists(bare), exists(F.try_element_at(aliases, bare)), *cut)

    return F.coalesce(resolve(TX.blank_to_null(name)), resolve(template_hint(folder)), F.lit(default))


def template_hint(folder: Column) -> Column:
    """The template that a folder name holds."""
    # Folder names of templates.
    return TX.blank_to_null(
        F.regexp_extract(folder, r"(DETAILED_INSTR_[A-Z0-9_]+|MINIMAL_INSTR_[A-Z0-9_]+)", 1)
    )

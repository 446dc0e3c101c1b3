"""Run registry: naming runs, counters, latest runs and flattened metrics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import numbers as N
from gleanmark.functions import text as TX

# Endings of stored names (date and time, quantization tags, time of a result file).
_DATE_SUFFIX = r"_\d{8}(_\d{4})?$"
_QUANT_TAG = r"(?i)-(q[0-9]+(?:_[0-9A-Za-z]+)*)$"
_FLOAT_TAG = r"(?i)-(fp16|bf16)$"
_FILE_TIME = r"_\d{4}$|_\d{8}_\d{4}$"


def quantization(tag: Column) -> Column:
    """Quantization part of a model tag, upper-cased; UNKNOWN without one."""
    name = TX.strip(F.coalesce(tag, F.lit("")))
    found = F.coalesce(
        TX.blank_to_null(F.regexp_extract(name, _QUANT_TAG, 1)),
        TX.blank_to_null(F.regexp_extract(name, _FLOAT_TAG, 1)),
    )
    return F.coalesce(F.upper(found), F.lit("UNKNOWN"))


def _key_from_name(model_name: Column) -> Column:
    """Model key for runs that only carry a model name."""
    name = TX.sanitize_name(F.regexp_replace(F.coalesce(model_name, F.lit("")), _DATE_SUFFIX, ""))
    parts = F.filter(F.split(name, "_"), lambda p: ~p.rlike(r"^\d{8}$"))
    last = F.try_element_at(parts, F.lit(-1))
    before = F.try_element_at(parts, F.lit(-2))
    short = (F.size(parts) > 1) & (F.length(last) <= 3)
    picked = F.when(short & (F.length(before) > 3), before).otherwise(last)
    return F.when(name.contains("_") & (F.size(parts) > 0), picked).otherwise(name)


def _without_suffix(key: Column, used: Column, suffix: str) -> Column:
    base = F.trim(F.left(key, F.length(key) - len(suffix)), F.lit("_"))
    return F.when(used & key.endswith(suffix) & (base != ""), base).otherwise(key)


def derive_method(df: DataFrame) -> DataFrame:
    """Storage key of a run: add ``run_model`` and ``method`` from its attributes.

    Needs model_key, model_name, prompt_template, agent_mode, prompt_name and
    the flags structured, outlines, guidance, ollama and vllm.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    given = TX.blank_to_null(F.col("model_key"))
    key = F.when(
        given.isNotNull(), F.regexp_replace(TX.sanitize_name(given), _DATE_SUFFIX, "")
    ).otherwise(_key_from_name(F.col("model_name")))
    key = F.coalesce(TX.blank_to_null(F.regexp_replace(key, _DATE_SUFFIX, "")), F.lit("unknown_model"))
    key = _without_suffix(key, flag("ollama"), "-ollama")
    key = _without_suffix(key, flag("vllm"), "-vllm")

    mode = TX.blank_to_null(F.col("agent_mode"))
    folder = TX.sanitize_name(
        F.concat(F.lit("MA_"), F.replace(F.upper(TX.strip(mode)), F.lit(" "), F.lit("_")))
    )
    prompt = TX.blank_to_null(F.col("prompt_name"))
    named = mode.isin(*V.MODES_WITH_PROMPT) & prompt.isNotNull()
    agent_method = F.when(TX.is_blank(mode), F.lit("MA_UNKNOWN")).otherwise(
        F.concat(folder, F.when(named, F.concat(F.lit("_"), TX.sanitize_name(prompt))).otherwise(""))
    )
    base = F.when(mode.isNotNull(), agent_method).otherwise(
        TX.sanitize_name(F.coalesce(F.col("prompt_template"), F.lit("unknown")))
    )
    decoder = (
        F.when(flag("guidance"), "_GUIDANCE").when(flag("outlines"), "_OUTLINES")
        .when(flag("structured"), "_STRUCTURED").otherwise("")
    )
    ollama = F.when(
        flag("ollama"), F.concat(F.lit("OLLAMA_"), quantization(F.col("model_name")), F.lit("_"))
    ).otherwise("")
    vllm = F.when(flag("vllm"), F.lit("VLLM_")).otherwise("")
    return df.withColumns(
        {"run_model": key, "method": F.concat(vllm, ollama, base, decoder)}
    )


def name_from_file(file_name: Column) -> Column:
    """Model name from a result file name: prefix, extension and time removed."""
    stem = F.replace(F.replace(file_name, F.lit("results_"), F.lit("")), F.lit(".csv"), F.lit(""))
    name = F.regexp_replace(stem, _FILE_TIME, "")
    cut = F.regexp_replace(stem, r"_[^_]*$", "")
    return F.when(name != "", name).when(stem.contains("_"), cut).otherwise("unknown")


def run_counters(responses: DataFrame) -> DataFrame:
    """Valid and invalid responses, error rate, response times and mean memory per run."""
    rows = F.count(F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return responses.groupBy("run_id").agg(
        rows.alias("total_samples"),
        F.count_if("is_valid").alias("valid_json_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_json_count"),
        (F.count_if(~F.col("is_valid")) / rows).alias("parsing_error_rate"),
        zero(F.avg("elapsed_s")).alias("average_response_time_seconds"),
        zero(F.min("elapsed_s")).alias("min_response_time_seconds"),
        zero(F.max("elapsed_s")).alias("max_response_time_seconds"),
        zero(F.sum("elapsed_s")).alias("total_inference_seconds"),
        zero(F.avg("gpu_gb")).alias("gpu_memory_during_inference_gb"),
    )


def outcome_status(status: Column, interrupted: Column, timeout_reason: Column) -> Column:
    """success, error, timeout or interrupted."""
    stopped = F.coalesce(interrupted, F.lit(False))
    return (
        F.when(status == "interrupted", "interrupted")
        .when(status == "error", "error")
        .when(stopped & (F.coalesce(timeout_reason, F.lit("")) != ""), "timeout")
        .when(stopped, "interrupted")
        .otherwise("success")
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Models per final status with mean speed, error rate and memory."""
    return outcomes.groupBy("status").agg(
        F.count(F.lit(1)).alias("models"),
        F.avg("avg_speed").alias("avg_speed"),
        F.avg("parsing_error_rate").alias("parsing_error_rate"),
        F.avg("memory_gb").alias("memory_gb"),
    )


def outcome_lines(outcomes: DataFrame) -> DataFrame:
    """One report line per model: figures for a success, else the (shortened) reason."""
    figures = F.concat_ws(
        "; ",
        F.coalesce(F.col("agent_mode"), F.lit("single")),
        F.concat(N.fixed(F.col("avg_speed"), 3), F.lit(" s")),
        F.concat(N.fixed(F.col("parsing_error_rate") * 100, 2), F.lit("%")),
        F.concat(N.fixed(F.col("memory_gb"), 2), F.lit(" GB")),
    )
    reason = F.when(F.col("status") == "error", F.left("message", F.lit(100))).otherwise(F.col("message"))
    return outcomes.select(
        "status", "model_key",
        F.when(F.col("status") == "success", figures).otherwise(reason).alias("line"),
    )


def latest_runs(
    runs: DataFrame, by: Sequence[str] = ("model_key", "method"), time: str = "file_mtime",
    tie: str = "file_path",
) -> DataFrame:
    """The newest run of every (model, method).

    An aggregation, not a window: each task keeps one row per key, so a key
    with a third of all runs costs nothing extra.
    """
    order = F.struct(F.col(time), F.col(tie))
    newest = F.max_by(F.struct(*runs.columns), order).alias("_run")
    return runs.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(newest).select("_run.*")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """Long (model, method, metric, value) table of run documents.

    ``runs`` has model_key, method, path_model and the metric columns; runs
    without a model key, or stored under another model's path, are dropped.
    """
    kept = runs.filter(
        (F.coalesce(F.col("model_key"), F.lit("")) != "") & (F.col("path_model") == F.col("model_key"))
    )
    metrics = {
        "f1_mass": "f1_mass", "f1_other": "f1_other", "parsed_rate": "parsed_rate",
        "raw_rate": "raw_rate", "latency": "average_response_time_seconds",
        "gpu": "gpu_memory_during_inference_gb",
    }
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value"))
            for name, col in metrics.items()
        ]
    )
    return kept.select("model_key", "method", F.inline(cells)).filter(F.col("value").isNotNull())


def validation_cell(parsed: Column, raw: Column) -> Column:
    """``parsed(raw)`` with two decimals; NULL unless both rates are known."""
    return F.concat(N.fixed(parsed, 2), F.lit("("), N.fixed(raw, 2), F.lit(")"))

"""Run registry, leaderboards, sources, error tables and monitoring."""
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import numbers as N
from gleanmark.operators import dimensions as DIM
from gleanmark.operators import errors as ER
from gleanmark.operators import leaderboard as LB
from gleanmark.operators import lengths as L
from gleanmark.operators import runs as R
from gleanmark.plans import evaluation as EV
from gleanmark.sources import tables as T
from gleanmark.streaming import monitor as MON


def test_fixed_rounds_like_printf(spark):
    values = [0.125, 2.675, 0.005, 1.005, -1.5, 0.0, 123456.785, 0.375, 1e-9, 0.045, 99.995]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", N.fixed(F.col("x"), 2).alias("a"), N.fixed(F.col("x"), 3, signed=True).alias("b")).collect():
        assert (r.a, r.b) == (f"{r.x:.2f}", f"{r.x:+.3f}")


def test_number_text(spark):
    values = [20.0, 1e7, 12345678.9, 1e16, 1e-5, 0.0001, 0.1, 1.5e300, -3.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", N.double_to_text(F.col("x")).alias("t")).collect():
        assert r.t == repr(r.x)


ATTRIBUTES = (
    "model_key string, model_name string, prompt_template string, agent_mode string, prompt_name string, "
    "structured boolean, outlines boolean, guidance boolean, ollama boolean, vllm boolean"
)


def test_derive_method(spark):
    rows = [
        ("m-ollama", "x:8b-q4_K_M", "P", None, None, True, True, True, True, False),
        ("m-vllm", "n", "P", None, None, False, True, False, False, True),
        ("m", "n", "P", "validation_fix_2agents", "Q", False, False, False, False, False),
        ("", "org/Model_20260101_1200", "P", "qa workflow", "Q", False, False, False, False, False),
        (None, "a model_it", "P", None, None, True, False, False, True, False),
    ]
    got = R.derive_method(spark.createDataFrame(rows, ATTRIBUTES)).select("run_model", "method").collect()
    assert [tuple(r) for r in got] == [
        ("m", "OLLAMA_Q4_K_M_P_GUIDANCE"), ("m", "VLLM_P_OUTLINES"), ("m", "MA_VALIDATION_FIX_2AGENTS_Q"),
        ("Model", "MA_QA_WORKFLOW"), ("model", "OLLAMA_UNKNOWN_P_STRUCTURED"),
    ]


def test_split_quant(spark):
    methods = ["OLLAMA_Q4_K_M_DETAILED_INSTR_ONESHOT", "OLLAMA_DETAILED_INSTR_ONESHOT", V.BASELINE_METHOD, "OLLAMA_X_Y"]
    df = spark.createDataFrame([("m", x) for x in methods], "model_key string, method string")
    got = {r.method: (r.quant, r.prompt, r.title) for r in LB.split_quant(df, "OLLAMA_").collect()}
    assert got[methods[0]] == ("Q4_K_M", "DETAILED_INSTR_ONESHOT", "Q4_k_m")
    assert got[methods[1]] == ("", "DETAILED_INSTR_ONESHOT", "Ollama · DETAILED_INSTR_ONESHOT")
    assert got[methods[2]][2] == "Baseline"
    assert got[methods[3]][:2] == ("X_Y", "X_Y")


def board(spark, cells, metric, **kwargs):
    df = spark.createDataFrame(cells, "model_key string, method string, value double")
    return LB.leaderboard(df, metric, **kwargs)


def test_zero_is_empty_for_f1_but_not_for_memory(spark):
    cells = [("a", "X_BASELINE", 0.5), ("a", "Y", 0.0), ("b", "Y", 0.75)]
    f1 = {(r.model_key, r.method): r for r in board(spark, cells, "f1").collect()}
    assert f1["a", "Y"].cell == "-" and f1["b", "Y"].is_best and f1["b", "Y"].cell == "0.7500"
    gpu = {(r.model_key, r.method): r for r in board(spark, cells, "gpu").collect()}
    assert gpu["a", "Y"].cell == "0.00\n(-0.50)" and gpu["a", "Y"].sign == 1
    average = {r.method: r.cell for r in LB.avg_delta(board(spark, cells, "gpu"), "gpu").collect()}
    assert average == {"X_BASELINE": "-", "Y": "-0.50"}


def test_baseline_and_ties(spark):
    cells = [("b", "Z", 0.5), ("a", "Z", 0.5), ("a", "DETAILED_INSTR_ONESHOT", 0.25), ("b", "DETAILED_INSTR_ONESHOT", 0.5)]
    rows = {(r.model_key, r.method): r for r in board(spark, cells, "f1").collect()}
    # No BASELINE: the method with the lowest title number.
    assert rows["a", "DETAILED_INSTR_ONESHOT"].delta is None and rows["a", "Z"].delta == 0.25
    assert rows["a", "Z"].is_best and not rows["b", "Z"].is_best
    wide = {r.model_key: r.asDict() for r in LB.matrix(board(spark, cells, "f1")).collect()}
    assert wide["a"]["Z"] == "0.5000\n(+0.25)"


def test_read_runs(spark, tmp_path):
    def put(model, method, name, doc, age):
        folder = tmp_path / model / method
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / name
        path.write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
        os.utime(path, (time.time() - age, time.time() - age))

    def doc(model, f1, speed=1.5):
        return {
            "model_key": model, "quality_metrics": {"массовая доля": {"f1": f1}},
            "validation_stats": {"parsed": {"validation_rate": 0.995}, "raw_output": {"validation_rate": 0.5}},
            "average_response_time_seconds": speed,
        }

    put("m1", "A B", "metrics_new.json", doc("m1", 0.9), 10)
    put("m1", "A B", "metrics_old.json", doc("m1", 0.1), 1000)
    put("m1", "A B", "raw_metrics_x.json", doc("m1", 0.2), 1)
    put("m2", "C", "metrics_x.json", doc("other", 0.3), 1)
    put("m3", "C", "metrics_x.json", doc("m3", 0.4, "slow"), 1)
    runs = T.read_runs(spark, str(tmp_path))
    assert runs.count() == 3
    flat = {(r.model_key, r.method, r.metric): r.value for r in R.flatten_runs(runs).collect()}
    assert flat["m1", "A B", "f1_mass"] == 0.9 and ("m2", "C", "f1_mass") not in flat
    assert ("m3", "C", "latency") not in flat and flat["m3", "C", "f1_mass"] == 0.4
    cell = runs.filter("model_key = 'm1'").select(R.validation_cell(F.col("parsed_rate"), F.col("raw_rate"))).first()[0]
    assert cell == f"{0.995:.2f}({0.5:.2f})"
    assert T.read_runs(spark, str(tmp_path), latest_only=False).count() == 4


def small_evaluation(spark):
    truth = json.dumps({V.MASS: [{V.SUBSTANCE: "N", V.MASS: 5}]}, ensure_ascii=False)
    corpus = spark.createDataFrame([(i, f"text {i}", truth) for i in range(4)], "text_index bigint, text string, truth_json string")
    raws = [truth, "нет", truth.replace("5", "6"), ""]
    responses = spark.createDataFrame(
        [("r", i, f"text {i}", raw, 1.0 + i, 2.0) for i, raw in enumerate(raws)],
        "run_id string, text_index bigint, text string, raw_output string, elapsed_s double, gpu_gb double",
    )
    return EV.Evaluation(responses, corpus), corpus


def test_evaluation_tables(spark, tmp_path):
    ev, corpus = small_evaluation(spark)
    q = {r.grp: r for r in ev.quality().collect()}
    assert (q["mass"].tp, q["mass"].fp, q["mass"].fn) == (1, 1, 2) and q["other"].comparisons == 0
    counters = ev.counters().first()
    assert counters.valid_json_count == 2 and counters.average_response_time_seconds == 2.5
    parse = {r.source_index: r for r in ev.parse_errors().collect()}
    assert parse[1].message == "Невалидный JSON. Ответ: нет" and parse[3].text_index is None
    assert ev.raw.quality().filter("grp = 'mass'").first().tp == 1

    runs = spark.createDataFrame([("r", "m", "A")], "run_id string, model_key string, method string")
    documents = T.run_documents(runs, ev.counters(), ev.quality(), ev.validation())
    T.write_runs(documents, ER.errors_by_text(ev.entry_errors()), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "runs"))
    assert back.first()["quality_metrics"]["массовая доля"]["tp"] == 1
    T.write_raw_runs(runs, ev.raw.quality(), ev.raw.validation(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "raw_runs")).first()["validation"]["valid_count"] == 2

    T.write_error_report(ev.entry_errors(), runs, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report" / "run_id=r" / "grp=mass")).collect())
    assert "Всего ошибок: 3" in text and "1. Текст #1: Вещество N: предсказано отсутствует, истина 5" in text
    empty = spark.read.text(str(tmp_path / "report" / "run_id=r" / "grp=other")).collect()
    assert "Ошибок не обнаружено." in [r.value for r in empty]

    stored = ev.responses.withColumns({"json_parsed": F.to_json("record"), "model_key": F.lit("m"), "method": F.lit("A")})
    T.write_responses(stored, str(tmp_path / "responses"))
    again = EV.Rescoring(T.read_responses(spark, str(tmp_path / "responses")).drop("model_key", "method"), corpus)
    assert again.counts().first().valid_json_count == 2
    assert {r.grp: r.tp for r in again.quality().collect()} == {"mass": 1, "other": 0}
    assert [r.text_index for r in again.parse_errors().collect()] == [1]
    assert again.validation().first().not_parsed == 2
    T.write_rescored(again.responses, documents, ER.errors_by_text(ev.entry_errors()), str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again" / "responses")).count() == 4


def test_rescored_responses_are_dealt_by_text_into_bounded_tasks(spark, monkeypatch):
    from functools import partial

    monkeypatch.setattr(EV, "spread", partial(EV.spread, rows=10))
    rows = [(f"r{i % 2}", i // 2, '{"прочее": []}') for i in range(200)]
    stored = spark.createDataFrame(rows, "run_id string, text_index bigint, json string").coalesce(1)
    corpus = spark.range(100).select(F.col("id").alias("text_index"), F.lit("{}").alias("truth_json"))
    dealt = EV.Rescoring(stored, corpus).responses
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 200
    places = dealt.select("text_index", F.spark_partition_id().alias("task")).distinct()
    assert places.count() == 100 and places.select("task").distinct().count() > 10


def test_long_texts_are_shortened_in_prompts(spark):
    text = "x" * 600
    columns = "run_id string, text_index bigint, message string, text string, response string, prompt string"
    parse = spark.createDataFrame([("r", None, "no response", None, None, None), ("r", 1, "bad", text, "", None)], columns)
    quality = spark.createDataFrame([("r", 1, "wrong", text, "resp", f"a {text} b {text}", 3)], columns + ", ord bigint")
    checks = spark.createDataFrame([("r", 1, None, "checked")], "run_id string, text_index bigint, prompt string, response string")
    rows = {r.text_index: r for r in ER.unified_errors(parse, quality, checks).collect()}
    assert rows[0].errors == ["no response"]
    assert rows[1].errors == ["bad", "wrong"] and rows[1].response == "checked"
    assert rows[1].prompt == f"a {'x' * 500}... b {text}"


def test_many_errors_span_parts(spark):
    rows = spark.range(2500).select(
        F.lit("r").alias("run_id"), F.lit(0).cast("bigint").alias("text_index"), F.col("id").alias("ord"),
        F.col("id").cast("string").alias("message"),
    )
    parts = ER.errors_by_text(rows).orderBy("part").collect()
    assert [len(p.errors) for p in parts] == [1000, 1000, 500]
    assert [m for p in parts for m in p.errors] == [str(i) for i in range(2500)]


def test_digest_and_report_count_texts(spark, tmp_path):
    rows = spark.range(2502).select(
        F.lit("r").alias("run_id"), F.greatest(F.lit(1), F.col("id") - 2498).alias("text_index"), F.col("id").alias("ord"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.lit("mass").alias("grp"),
    )
    texts = ER.errors_by_text(rows).withColumns({"text": F.col("text_index").cast("string"), "response": F.lit("")})
    digest = ER.error_digest(texts).first()
    assert [(t.text_index, len(t.errors)) for t in digest.texts] == [(1, 2500), (2, 1), (3, 1)]
    assert digest.texts[0].errors == [f"m{i}" for i in range(2500)]
    assert digest.lines == [f"Текст #1: m{i}" for i in range(10)]
    lines = {r.line_no: r.line for r in T.error_report_lines(rows, rows).filter("grp = 'mass'").collect()}
    assert lines[1] == "Всего ошибок: 3" and len(lines) == 5
    assert lines[2].startswith("1. Текст #1: m0; m1; ") and lines[2].endswith("; m2499") and lines[4] == "3. Текст #3: m2501"


def test_pools_and_leaderboard(spark, tmp_path):
    for name in ("few_shot_examples_m-1_20250101_1200.csv", "few_shot_examples_other.csv", "else.csv"):
        _write(tmp_path, name, "text,json\nx,y\n")
    assert {r.model_key for r in T.list_pools(spark, str(tmp_path)).collect()} == {"m-1", "other"}
    matrix = spark.createDataFrame([("b", "0.50"), ("a", "-")], "model_key string, A string")
    T.export_leaderboard(matrix, str(tmp_path / "board"))
    back = spark.read.csv(str(tmp_path / "board"), header=True).collect()
    assert [(r.model_key, r.A) for r in back] == [("a", "-"), ("b", "0.50")]


def test_truth_of_a_second_table(spark, tmp_path):
    _write(tmp_path, "texts.csv", "text\none\ntwo\nthree\n")
    spark.createDataFrame([(0, '{"a": 1}'), (2, "{}")], "text_index long, json string").write.parquet(str(tmp_path / "t.parquet"))
    corpus = T.read_corpus(spark, str(tmp_path / "texts.csv"), str(tmp_path / "t.parquet"))
    assert {r.text: r.truth_json for r in corpus.collect()} == {"one": '{"a": 1}', "two": None, "three": "{}"}


def test_corpus_and_pool(spark, tmp_path):
    path = str(tmp_path / "corpus.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('text,json_parsed\n"line one\nline two","{""a"": ""x""}"\nsecond,\n')
    corpus = T.read_corpus(spark, path).orderBy("text_index").collect()
    assert [(r.text_index, r.text, r.truth_json) for r in corpus] == [(0, "line one\nline two", '{"a": "x"}'), (1, "second", None)]
    with pytest.raises(ValueError):
        T.read_responses(spark, _write(tmp_path, "no.csv", "text\nx\n"))
    pool = spark.createDataFrame([("t", '{"a":"b"}', ["x"])], "text string, json string, responses array<string>")
    T.write_pool(pool, str(tmp_path / "pool"))
    back = T.read_pool(spark, str(tmp_path / "pool"))
    assert back.columns == ["text", "json"] and back.first().json == '{"a":"b"}'


def _write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_number_rows_over_many_files(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.parquet(str(tmp_path / "t"))
    numbers = sorted(r.text_index for r in T.number_rows(spark.read.parquet(str(tmp_path / "t"))).collect())
    assert numbers == list(range(1000))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("run_id"), (F.col("id") % 5 > 0).alias("is_valid"),
        F.col("id").cast("double").alias("elapsed_s"), F.lit(1.0).alias("gpu_gb"),
    )
    rows.repartition(6).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log"))
    state = MON.progress(log, spark.createDataFrame([("r0", 150), ("r1", 100)], "run_id string, total int"))
    MON.write_updates(state, str(tmp_path / "rows"), str(tmp_path / "check")).awaitTermination()
    got = {r.run_id: r for r in MON.latest_updates(spark, str(tmp_path / "rows"), state.schema).collect()}
    for r in R.run_counters(rows).collect():
        assert (got[r.run_id].processed, got[r.run_id].valid) == (r.total_samples, r.valid_json_count)
        assert got[r.run_id].mean_s == pytest.approx(r.average_response_time_seconds)
    assert (got["r0"].remaining, got["r1"].remaining, got["r2"].remaining) == (50, 0, None)
    assert got["r0"].eta_s == pytest.approx(50 * got["r0"].mean_s)


def test_split_quant_from_a_table(spark):
    methods = ["OLLAMA_Q4_K_M_DETAILED_INSTR_ONESHOT", "OLLAMA_DETAILED_INSTR_ONESHOT", V.BASELINE_METHOD, "OLLAMA_X_Y", "OLLAMA_", "VLLM_P"]
    df = spark.createDataFrame([("m", x) for x in [*methods, methods[0], None]], "model_key string, method string")
    shown = lambda out: sorted((str(r.method), r.quant, r.prompt, r.title, r.column_order) for r in out.collect())
    assert shown(DIM.split_quant(df, "OLLAMA_", DIM.method_dimension(spark))) == shown(LB.split_quant(df, "OLLAMA_"))
    none = DIM.method_dimension(spark).filter("false")
    assert {r.prompt for r in DIM.split_quant(df, "OLLAMA_", none).collect()} >= {"X_Y", "DETAILED_INSTR_ONESHOT"}


def test_longest_suffix_against_all_pairs(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices("ab_", k=n))
    keys = list({text(rng.randint(1, 4)) for _ in range(30)})
    names = [text(rng.randint(0, 9)) for _ in range(200)] + [None, "a" * 5000]
    found = DIM.longest_suffix(spark.createDataFrame([(n,) for n in names], "name string"), "name",
                               spark.createDataFrame([(k,) for k in [*keys, "", None]], "key string"), "key")
    wanted = {n: max((k for k in keys if n.endswith(k)), key=len, default=None) for n in names if n}
    assert {r.name: r.known for r in found.collect()} == {n: k for n, k in wanted.items() if k}


def test_endings_unlike_all_keys_are_not_sent(spark):
    names = spark.createDataFrame([("x" * 400 + f"Ж{i}_SHOT",) for i in range(20)] + [("nothing",), (None,)], "name string")
    keys = spark.createDataFrame([(f"Ж{i}_SHOT",) for i in range(0, 20, 2)], "key string")
    found = DIM.longest_suffix(names, "name", keys, "key")
    assert {r.known for r in found.collect()} == {f"Ж{i}_SHOT" for i in range(0, 20, 2)} and found.count() == 10
    assert found.inputFiles()


def test_templates_from_tables(spark):
    templates = ["DETAILED_INSTR_ONESHOT", "DETAILED_INSTR_ONESHOT_CD_RUS", "MINIMAL_INSTR_FIVESHOT"]
    rows = [(" DETAILED_INSTR_ONESHOT ", None), ("DETAILED_INSTR_ONESHOT_OUTLINES_RUS", "x"), ("MINIMAL_INSTR_FIVESHOT_GUIDANCE", "x"),
            ("unknown", "OLLAMA_MINIMAL_INSTR_FIVESHOT_OUTLINES"), (None, "DETAILED_INSTR_ONESHOT_OUTLINES_RUS"), ("", ""), (None, None)]
    df = spark.createDataFrame([*rows, rows[0]], "name string, folder string")
    table = spark.createDataFrame([(t,) for t in templates], "template string")
    got = DIM.resolve_templates(df, "name", "folder", table, DIM.template_aliases(spark), "D")
    wanted = df.withColumn("template", L.resolve_template(F.col("name"), F.col("folder"), templates, "D"))
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_method_dimension(spark):
    cells = spark.createDataFrame([("m", V.BASELINE_METHOD), ("m", "SOME_OTHER"), ("m", None)], "model_key string, method string")
    got = {r.method: (r.alias, r.method_order, r.description) for r in DIM.with_alias(cells, DIM.method_dimension(spark)).collect()}
    wanted = {r.method: (r.alias, r.method_order) for r in LB.with_alias(cells).collect()}
    assert {m: g[:2] for m, g in got.items()} == wanted
    assert got["SOME_OTHER"][2] == "SOME_OTHER" and got[V.BASELINE_METHOD][2].endswith("(baseline)")

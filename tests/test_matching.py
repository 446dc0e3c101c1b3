"""Values, entries, matching and messages against a plain Python account of the rules."""
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import jsonvalue as J
from gleanmark.functions import text as TX
from gleanmark.functions import values as VAL
from gleanmark.operators import matching as M
from gleanmark.operators.entries import PREDICTED, TRUTH, explode_entries
from gleanmark.plans import evaluation as EV


def norm(spark, values, strict):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, s string")
    rows = rows.withColumn("p", VAL.value_parts(J.parse_whole(F.col("s"))))
    out = rows.select("i", VAL.norm_value(F.col("p"), strict).alias("v")).orderBy("i").collect()
    return [r.v for r in out]


def test_norm_value(spark):
    v = norm(spark, ["53%", " 5 ", "ABC", True, [None, None], [], "1_000", "5d", "0,5"], strict=False)
    assert [x.num for x in v] == [53.0, 5.0, None, 1.0, None, None, 1000.0, None, None]
    assert v[2].shown == "abc" and v[4].kind == "null" and v[5].kind == "null" and v[7].shown == "5d"
    s = norm(spark, [[None, None], []], strict=True)
    assert [x.kind for x in s] == ["list", "list"] and s[0].shown == "[None, None]"


def test_value_key(spark):
    same = lambda a, b, strict: len({x.ckey for x in norm(spark, [a, b], strict)}) == 1
    assert same([5, 5], 5, False) and not same([5, 5], 5, True)
    assert same(["5%", 5.0], 5, False) and same([1, None], ["1", None], True)
    assert not same([1, 2], [2, 1], False) and not same("1", [1], True)
    assert same(0.1 + 0.2, 0.3, True) and same(-0.0, 0, True)
    assert norm(spark, ["nan", "inf"], False)[0].ckey is None


def test_substance(spark):
    row = spark.range(1).select(TX.norm_substance(F.lit("Р2О5 к")).alias("a")).first()
    assert row.a == "P2O5 K"


def entries(spark, pairs, strict=False):
    rows = spark.createDataFrame(
        [("r", i, json.dumps(p, ensure_ascii=False), json.dumps(t, ensure_ascii=False)) for i, (p, t) in enumerate(pairs)],
        "run_id string, text_index bigint, p string, t string",
    )
    rows = rows.select("run_id", "text_index", J.parse_whole(F.col("p")).alias("p"), J.parse_whole(F.col("t")).alias("t"))
    return explode_entries(rows, {PREDICTED: "p", TRUTH: "t"}, ["run_id", "text_index"], strict)


def mass(*pairs):
    return {V.MASS: [{V.SUBSTANCE: k, V.MASS: v} for k, v in pairs]}


def test_score_example(spark):
    pred, truth = mass(("N", 1), ("N", 1), ("K", 2)), mass(("N", 1), ("K", 3), ("P", 9))
    row = M.score_texts(entries(spark, [(pred, truth)])).first()
    assert (row.tp, row.fp, row.fn) == (1, 2, 1)


def test_present_null_stops_the_scan(spark):
    item = {V.OTHER: [{V.PARAMETER: "x", V.WEIGHT: None, V.VALUE: "y"}]}
    assert entries(spark, [(item, {})]).count() == 0
    assert entries(spark, [(item, {})], strict=True).count() == 1


def greedy(pred, truth):
    """Counts and messages of one group, matched one by one."""
    left_p, left_t = list(range(len(pred))), list(range(len(truth)))
    for j in range(len(truth)):
        hit = next((i for i in left_p if pred[i] == truth[j]), None)
        if hit is not None:
            left_p.remove(hit)
            left_t.remove(j)
    wrong = {pred[i][0] for i in left_p}
    messages = []
    for i in left_p:
        same = [truth[j][1] for j in left_t if truth[j][0] == pred[i][0]]
        messages.append(f"Вещество {pred[i][0]}: предсказано {pred[i][1]}, истина {same[0] if same else 'отсутствует'}")
    missed = [j for j in left_t if truth[j][0] not in wrong]
    messages += [f"Вещество {truth[j][0]}: предсказано отсутствует, истина {truth[j][1]}" for j in missed]
    return len(pred) - len(left_p), len(left_p), len(missed), messages


def test_against_greedy_loop(spark):
    rng = random.Random(7)
    draw = lambda: [(rng.choice("NKP"), rng.randint(1, 3)) for _ in range(rng.randint(0, 7))]
    pairs = [(draw(), draw()) for _ in range(60)]
    # One text with far more entries than the others.
    pairs.append(([("N", rng.randint(1, 40)) for _ in range(3000)], [("N", rng.randint(1, 40)) for _ in range(2500)]))
    found = entries(spark, [(mass(*p), mass(*t)) for p, t in pairs])
    scores = {r.text_index: (r.tp, r.fp, r.fn) for r in M.score_texts(found).collect()}
    messages = {}
    for r in M.entry_errors(found).orderBy("ord").collect():
        messages.setdefault(r.text_index, []).append(r.message)
    for i, (p, t) in enumerate(pairs):
        tp, fp, fn, expected = greedy(p, t)
        assert scores.get(i, (0, 0, 0)) == (tp, fp, fn)
        assert messages.get(i, []) == expected
        assert tp + fp == len(p)


def test_quality_is_micro_and_accuracy_macro(spark):
    pairs = [(mass(("N", 1)), mass(("N", 1))), (mass(("N", 1)), mass(("N", 2), ("K", 1))), ({}, {})]
    out = {r.grp: r for r in M.quality(M.score_texts(entries(spark, pairs)), spark.createDataFrame([("r",)], "run_id string")).collect()}
    assert out["mass"].accuracy == pytest.approx((1.0 + 0.0) / 2) and out["mass"].precision == 0.5
    assert out["other"].comparisons == 0 and out["other"].f1 == 0.0


def test_other_messages_carry_units(spark):
    p = {V.OTHER: [{V.PARAMETER: "m", V.WEIGHT: 50, V.UNIT: "кг"}]}
    t = {V.OTHER: [{V.PARAMETER: "m", V.WEIGHT: 50, V.UNIT: "г"}]}
    assert M.entry_errors(entries(spark, [(p, t)])).first().message == (
        "Параметр m: предсказано 50.0, единица: кг, истина 50.0, единица: г"
    )
    none = {V.OTHER: [{V.PARAMETER: "m", V.WEIGHT: 50, V.UNIT: None}]}
    bare = {V.OTHER: [{V.PARAMETER: "m", V.WEIGHT: 50}]}
    assert M.score_texts(entries(spark, [(none, bare)])).first().tp == 1


def test_stored_responses_are_read_again_only_as_far_as_needed(spark):
    rows = [
        ("r", 1, '{"a": 1}', '{"b": 2}'), ("r", 2, '```json\n{"a": 1}\n``` Ответ: {}', '{"b": 2}'),
        ("r", 3, "данных нет", '{"b": 2}'), ("r", 4, "данных нет", '{"b": 2'), ("r", 5, "", "[1]"), ("r", 6, None, None),
    ]
    df = EV.reparse_stored(spark.createDataFrame(rows, "run_id string, text_index long, json string, json_parsed string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "concat([, json_parsed#" not in plan
    got = {r.text_index: (r.p, r.reparsed, r.is_valid) for r in df.select(
        "text_index", F.to_json("prediction").alias("p"), "reparsed", "is_valid").collect()}
    assert got[3] == got[4] == ('{"b":2}', False, True)
    assert got[5] == got[6] == ("{}", False, False)
    assert got[1] == got[2] == ('{"a":1}', True, True)


def test_text_that_no_json_value_starts_with(spark):
    texts = {"данных нет": None, "": None, None: None, "]": None, ",1": None, " \n[1] ": "[1]", "-1": "-1", "true": "true",
             "null": "null", '"a"': '"a"', '{"a":1}': '{"a":1}', '{"a":1} x': None, "﻿1": None, "\x0b1": None, "+1": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.to_json(J.parse_whole(F.col("t"))).alias("v"))
    assert {r.t: r.v for r in df.collect()} == texts
    assert "RLIKE" in df._jdf.queryExecution().optimizedPlan().toString()


def test_unread_forms_of_values_are_not_made(spark):
    """Counting matches reads keys of values only, so numbers are not printed; the report of errors prints them."""
    record = '{"массовая доля": [{"вещество": "N", "массовая доля": [1.5, 2]}]}'
    rows = spark.createDataFrame([("r", 1, record)], "run_id string, text_index long, s string")
    rows = rows.withColumns({"p": J.parse_whole(F.col("s")), "t": J.parse_whole(F.col("s"))})
    for strict in (False, True):
        entries = explode_entries(rows, {PREDICTED: "p", TRUTH: "t"}, ["run_id", "text_index"], strict)
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (M.match_entries(entries), entries)]
        assert ["decimal(38,20)" in plan for plan in plans] == [False, True]
        assert M.match_entries(entries).first().tp == 1

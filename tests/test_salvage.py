"""Locating, repairing, parsing, cleaning and validating, one fixture per branch."""
import json
import time
import random

import pytest
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import jsonvalue as J
from gleanmark.operators import prompts as P
from gleanmark.operators import salvage as S
from gleanmark.operators import validate as VD


def apply(spark, step, texts, *args, json_out=True, **kwargs):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = step(rows, "s", "out", *args, **kwargs)
    out = F.to_json("out") if json_out else F.col("out")
    return [r[0] for r in rows.orderBy("i").select(out).collect()]


def test_locate(spark):
    cases = {
        'x ОТВЕТ: {"a":1} Ответ: ```json\n{"b":2}\n``` и ```{"c":3}```': '{"c":3}',
        "answer: [1] хвост": "[1] хвост",
        "ответ: нет": "нет",
        '```json\n{"a":1}\n```\nОтвет:': '{"a":1}',
        'текст [1] {"a":1': '[1] {"a":1',
        "  просто  ": "просто",
        "": "",
    }
    assert apply(spark, S.locate_json, list(cases), json_out=False) == list(cases.values())


def test_fragment(spark):
    cases = {"```\n{1}\n``` ```{2}```": "{1}", "* - [1] {2}": "{2}", "a [1": "[1", "нет": ""}
    assert apply(spark, S.fragment_json, list(cases), json_out=False) == list(cases.values())


def test_repair(spark):
    cases = {
        '{"a": 1, "b":': '{"a": 1, "b": null}',
        '{"a": "x': '{"a": "x"}',
        '{"a": 1, "b': '{"a": 1, "b": null}',
        '{"a":[{"x":1}{"x":2},]}': '{"a":[{"x":1}, {"x":2}]}',
        '{"a": 1,': '{"a": 1}',
        '{"a": None}': '{"a": null}',
        '{"a" : "x\\"y{", "b":[1,2': '{"a" : "x\\"y{", "b":[1,2]}',
    }
    assert apply(spark, S.repair_json, list(cases), json_out=False) == list(cases.values())


def test_closing_order(spark):
    broken = ['{"a":[{"b":1']
    assert apply(spark, S.parse_lenient, broken) == ["{}"]
    assert apply(spark, S.parse_lenient, broken, closing="stack") == ['{"a":[{"b":1}]}']


def test_lenient(spark):
    cases = {
        "{'a': 'x', 'b': True, 'c': None}": '{"a":"x","b":true,"c":null}',
        '{"a":"line\\nbreak"}': "{}",
        '{"a":1} {"b":2}': "{}",
        '{"a":1,"a":2}': '{"a":2}',
        "{'a': true}": "{}",
        "5": "{}", "[]": "[]", "": "{}", "нет": "{}",
    }
    assert apply(spark, S.parse_lenient, list(cases)) == list(cases.values())


def test_fast_path_changes_nothing(spark):
    """Text that skips the repair gives what the repaired text gives."""
    rng = random.Random(3)
    texts = []
    for _ in range(200):
        value = {rng.choice("abc"): rng.choice([1, "x, y", "{", [1, {"k": None}], "a]b", "it's"]) for _ in range(3)}
        text = json.dumps(value, ensure_ascii=False, indent=rng.choice([None, 2]))
        texts.append(text[: rng.randint(1, len(text))])
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = S.parse_lenient(rows, "s", "fast")
    rows = S.repair_json(S.fragment_json(rows, "s", "f"), "f", "r")
    slow = J.parse_whole(F.col("r"))
    for r in rows.select("s", F.to_json("fast").alias("fast"), F.to_json(slow).alias("slow")).collect():
        if r.slow is not None and r.slow[0] in "{[":
            assert r.fast == r.slow, r.s


def test_stack_repair_recovers_every_truncation(spark):
    """Closing in opening order turns each cut behind a complete value into valid JSON."""
    text = '{"a":[{"b":1},{"c":[true,"x"]}],"d":{"e":null}}'
    cuts = [text[:i] for i in range(1, len(text) + 1) if text[i - 1] in '}]"' or text[:i].endswith(("1", "null"))]
    for got in apply(spark, S.parse_lenient, cuts, closing="stack"):
        json.loads(got)


def test_strict(spark):
    cases = {'{"a":{"b":1}}': '{"a":{"b":1}}', 'x {"a":{"b":1}} y': '{"a":{"b":1}}', "[1]": "{}", '{"a":': "{}"}
    assert apply(spark, S.parse_strict, list(cases)) == list(cases.values())


def processed(spark, texts):
    rows = spark.createDataFrame(
        [("r", i, "t", s) for i, s in enumerate(texts)], "run_id string, text_index bigint, text string, raw_output string"
    )
    return S.process_responses(rows).orderBy("text_index").collect()


def test_process(spark):
    rows = processed(spark, [
        "[]", "{}", "[1]", '{"a":1}', "", None,
        '{"mass_fractions":[{"substance_name":"N","mass_fraction":"5%"}],"other_params":[{"parameter_name":"p","value":[]}]}',
        '{"mass_fractions":[{"substance_name":"N" "mass_fraction":1}]}',
    ])
    assert [r.is_valid for r in rows] == [False, False, False, True, False, False, True, False]
    assert [r.raw_valid for r in rows[:6]] == [False, True, False, True, False, False]
    assert rows[6].json == '{"массовая доля":[{"вещество":"N","массовая доля":"5%"}],"прочее":[{"параметр":"p"}]}'
    assert not rows[6].raw_valid and rows[6].parsed_valid
    assert rows[7].json == '{"массовая доля":[{"вещество":"N" "массовая доля":1}]}'
    assert rows[4].raw_violations == [] and not rows[4].parsed_valid


def test_clean(spark):
    record = {
        V.MASS: [{V.SUBSTANCE: "N", V.MASS: 0}, {V.SUBSTANCE: "P", V.MASS: None}, {V.SUBSTANCE: "Z", V.MASS: [None, None]},
                 {V.SUBSTANCE: "no value"}, "bare"],
        V.OTHER: [{V.PARAMETER: "", V.VALUE: []}, {}, {V.PARAMETER: "m", V.VALUE: [], "d": {"e": None, "f": ["", None]}}],
    }
    rows = spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "s string")
    rows = rows.withColumn("v", J.parse_whole(F.col("s")))
    rows = S.clean_records(S.clean_records(rows, "v", "full"), "v", "entries", drop_empty=False)
    full, kept = (json.loads(x) for x in rows.select(F.to_json("full"), F.to_json("entries")).first())
    assert full == {
        V.MASS: [{V.SUBSTANCE: "N", V.MASS: 0}, "bare"],
        V.OTHER: [{V.PARAMETER: "m", "d": {"f": ["", None]}}],
    }
    assert len(kept[V.MASS]) == 2 and kept[V.OTHER][0][V.VALUE] == []


def test_whole_text_is_parsed_once(spark):
    plan = spark.range(1).select(J.parse_whole(F.concat(F.lit("[1"), F.col("id").cast("string"), F.lit("]"))).alias("v"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    cases = {'{"a":1}': '{"a":1}', ' [1, 2] ': "[1,2]", '{"a":1} {"b":2}': None, "[1],[2]": None, '{"a":1': None, "null": "null",
             '"x"': '"x"', '"x","y"': None, "1 2": None, "": None, "true": "true", '[1,"␞"]': '[1,"␞"]'}
    rows = spark.createDataFrame([*enumerate(cases), (len(cases), None)], "i int, s string").orderBy("i")
    assert [r[0] for r in rows.select(F.to_json(J.parse_whole(F.col("s")))).collect()] == [*cases.values(), None]


@pytest.mark.parametrize("drop_empty", [True, False])
def test_clean_as_text_equals_clean_by_member(spark, drop_empty, monkeypatch):
    """Numbers, strings and members stay what they are, also where the text would not be exact."""
    rng = random.Random(7)
    scalars = ["null", '""', "[]", "{}", "0", "-0", "0.50", "2.0", "1e2", "1e400", "5e-1", "0.1234567890123456789012345678901234567",
               "123456789012345678901234567890", '"\\u0000n1"', '"a\\"b\\\\"', '"null"', "true", '"\\ud83d\\ude00é"', "[null,null]", '[""]',
               '[null,[]]', '{"b":null}', '{"a":{"b":[]},"c":1}']

    def entry():
        keys = rng.sample([V.MASS, V.SUBSTANCE, V.PARAMETER, V.VALUE, "x", ""], rng.randrange(4))
        return rng.choice(scalars) if rng.random() < 0.15 else "{" + ",".join(f'"{k}":{rng.choice(scalars)}' for k in keys) + "}"

    texts = ["{}", "[null]", "null", '{"a":' * 400 + "null" + "}" * 400]
    for _ in range(400):
        members = {V.MASS: rng.choice(scalars) if rng.random() < 0.1 else "[" + ",".join(entry() for _ in range(rng.randrange(4))) + "]",
                   V.OTHER: "[" + ",".join(entry() for _ in range(rng.randrange(4))) + "]", "extra": rng.choice(scalars)}
        texts.append("{" + ",".join(f'"{k}":{v}' for k, v in members.items() if rng.random() < 0.8) + "}")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, s string").withColumn("v", J.parse_whole(F.col("s")))
    out = lambda: S.clean_records(rows, "v", "o", drop_empty).orderBy("i").select(F.to_json("o"), J.kind(F.col("o"))).collect()
    as_text = out()
    assert sum(S.cleaned_text(t, drop_empty) is not None for t in texts[4:] if t != "{}") > 60
    monkeypatch.setattr(S, "cleaned_text", lambda *_: None)
    assert as_text == out()


def test_dedup_cap(spark):
    record = {"a": [{"x": i % 25, "y": 1} for i in range(60)], "b": {"c": [1, 1.0, True, "1"]}, "d": 5}
    rows = spark.createDataFrame([(json.dumps(record),)], "s string").withColumn("v", J.parse_whole(F.col("s")))
    out = json.loads(S.dedup_cap(rows, "v", "o").select(F.to_json("o")).first()[0])
    assert out == {"a": [{"x": i, "y": 1} for i in range(20)], "b": {"c": [1, "1"]}, "d": 5}


def test_dedup_cap_at_any_depth(spark):
    record = {"x": [5, 5], "p": {"q": {"r": {"s": {"t": {"x": [5, 5, [1, 1], [1, 1]], "y": {"z": [None, None]}}}}}}}
    rows = spark.createDataFrame([(json.dumps(record),), ("[1, 1]",), (None,)], "s string").withColumn("v", J.parse_whole(F.col("s")))
    out = [r[0] and json.loads(r[0]) for r in S.dedup_cap(rows, "v", "o").select(F.to_json("o")).collect()]
    assert out == [{"x": [5], "p": {"q": {"r": {"s": {"t": {"x": [5, [1, 1]], "y": {"z": [None]}}}}}}}, [1, 1], None]


def test_long_rows_take_linear_time(spark):
    """One row four times as long may not take much more than four times as long."""
    def seconds(n):
        echoed = "Твоя задача: найти\n" + "\n".join(f"N {i}%" for i in range(n))
        rows = spark.createDataFrame([(echoed, json.dumps({"a": list(range(n))}))], "t string, j string")
        start = time.perf_counter()
        kept, pretty = S.strip_instructions(rows, "t", "k").select("k", J.pretty(F.col("j")).alias("p")).first()
        assert kept.count("\n") == n - 1 and pretty.count("\n") == n + 3
        return time.perf_counter() - start

    seconds(100)
    small = min(seconds(16_000) for _ in range(3))
    assert seconds(64_000) < 8 * small + 1


def test_strip_instructions(spark):
    cases = {
        " без указаний ": "без указаний",
        "Твоя задача: найти\n---\nN 5%\nда\nНужно найти:\nне то\nне найдено": "N 5%\nда\nне то\nне найдено",
    }
    assert apply(spark, S.strip_instructions, list(cases), json_out=False) == list(cases.values())


def test_validate_against_pydantic(spark):
    pydantic = pytest.importorskip("pydantic")
    from typing import List, Optional, Union

    def to_number(x):
        if isinstance(x, str):
            return float(x.strip().removesuffix("%").strip().replace(",", "."))
        return x

    class Mass(pydantic.BaseModel):
        model_config = pydantic.ConfigDict(populate_by_name=True)
        name: str = pydantic.Field(alias=V.SUBSTANCE)
        share: Union[float, List[Optional[float]]] = pydantic.Field(alias=V.MASS)

        @pydantic.field_validator("share", mode="before")
        @classmethod
        def read(cls, v):
            return [to_number(x) for x in v] if isinstance(v, list) else to_number(v)

    amount = Optional[Union[float, List[Optional[float]]]]

    class Other(pydantic.BaseModel):
        name: str = pydantic.Field(alias=V.PARAMETER)
        weight: amount = pydantic.Field(None, alias=V.WEIGHT)
        value: Optional[Union[str, float]] = pydantic.Field(None, alias=V.VALUE)
        unit: Optional[str] = pydantic.Field(None, alias=V.UNIT)

    class Record(pydantic.BaseModel):
        mass: List[Mass] = pydantic.Field(default_factory=list, alias=V.MASS)
        other: List[Other] = pydantic.Field(default_factory=list, alias=V.OTHER)

    rng = random.Random(11)
    pool = [1, 2.5, "3", "4%", "0,5", "x", None, True, [1, None], [1, "2%"], ["x"], [], {}, {"a": 1}, [[1]], "", "5%%", " 7 "]

    def pick(**fields):
        return {k: rng.choice(pool) for k in fields.values() if rng.random() < 0.8}

    records = [{}, {V.MASS: None}, {V.MASS: 5}, {V.OTHER: [1]}]
    for _ in range(600):
        mass_item = {V.SUBSTANCE: rng.choice(["N", "N", "N", 5, None]), **pick(a=V.MASS)}
        other_item = {V.PARAMETER: rng.choice(["m", "m", "m", 1]), **pick(a=V.WEIGHT, b=V.VALUE, c=V.UNIT)}
        records.append({V.MASS: [mass_item]} if rng.random() < 0.5 else {V.OTHER: [other_item]})
    rows = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)], "i int, s string")
    rows = VD.validate(rows.withColumn("v", J.parse_whole(F.col("s"))), "v", "x")
    verdicts = {r.i: r.x_valid for r in rows.select("i", "x_valid").collect()}
    for i, record in enumerate(records):
        try:
            Record.model_validate(record)
            expected = True
        except Exception:
            expected = False
        assert verdicts[i] == expected, record


def test_prompt_fill_leaves_inserted_braces(spark):
    row = spark.range(1).select(
        P.fill("a {{x}} {text} {other} {text}", text=F.lit("{text} {{y}}")).alias("p")
    ).first()
    assert row.p == "a {x} {text} {{y}} {other} {text} {{y}}"


def test_render_unknown_template(spark):
    texts = spark.createDataFrame([(1, "t")], "text_index int, text string")
    with pytest.raises(KeyError):
        P.render_prompts(texts, {"a": "{text}"}, names=["b"])


def test_lists_and_members_are_seen_without_reading_paths(spark):
    """Only arrays are arrays, whatever they hold; a member is absent, JSON null or a value."""
    from pyspark.sql import functions as F

    from gleanmark.functions import jsonvalue as J

    cases = ["[]", "[1]", "[[1], 2]", "[null]", '[{"a": 1}]', "{}", '{"a": [1]}', '{"a": null}', '{"a": 2}', "1", "null", '"[1]"', "x"]
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("v", J.parse_whole(F.col("t")))
    rows = df.select("t", J.is_array(F.col("v")).alias("a"), F.to_json(J.get(F.col("v"), "a")).alias("m")).collect()
    assert {r.t for r in rows if r.a} == set(cases[:5])
    assert {r.t: r.m for r in rows if r.m is not None} == {'{"a": [1]}': "[1]", '{"a": null}': "null", '{"a": 2}': "2"}


def test_tasks_are_bounded_by_rows(spark, tmp_path):
    from gleanmark.catalog.inputs import TASK_ROWS, spread

    path = str(tmp_path / "t")
    spark.range(9 * TASK_ROWS + 1).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    assert spread(table).rdd.getNumPartitions() == 10
    keyed = spread(table, by="id")
    sizes = keyed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 10 and max(sizes) < 1.1 * TASK_ROWS and sum(sizes) == 9 * TASK_ROWS + 1


def test_parse_whole_takes_one_value(spark):
    """What does not end with the bracket of its first character is no value, also if an end mark follows the value."""
    whole = ['{"a":1}', ' {"a":[1]}\n', "[1, 2]\t", '"x"', "1.5", "true", "null", '{"a":"}{"}', "[]", "{}"]
    broken = ['{"a":1', '{"a":1]', "[1", '"x', '{"a":1},"␞"]', '{"a":1} x', "[1]]", "", " ", "нет", '{"a":1}\x0b', "{]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(whole + broken)], "i int, t string")
    got = df.select("i", J.parse_whole(F.col("t")).isNotNull().alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True] * len(whole) + [False] * len(broken)


def test_lenient_keeps_lists_and_objects_only(spark):
    texts = ['{"a":1}', "[1, 2]", "[[1]]", "[]", '{"a":[1', "1", None]
    df = S.parse_lenient(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "v")
    got = df.orderBy("i").select(F.to_json("v").alias("v")).collect()
    assert [r.v for r in got] == ['{"a":1}', "[1,2]", "[[1]]", "[]", '{"a":[1]}', "{}", "{}"]

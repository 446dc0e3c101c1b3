"""From free-text responses to records: locate, repair, parse and clean JSON.

All steps are column expressions on a row (``dedup_cap``, whose depth has no
limit, an Arrow function); nothing shuffles.  The operators work on DataFrames
so that each intermediate text is computed once.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark import vocabulary as V
from gleanmark.functions import jsonvalue as J
from gleanmark.functions import text as TX
from gleanmark.plans.settle import settle

# Patterns of fenced blocks and of one-level nested objects.
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
NESTED_OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"

MAX_ITEMS = 20


def _from_first_bracket(text: Column) -> Column:
    start = F.least(
        F.nullif(F.instr(text, "{"), F.lit(0)), F.nullif(F.instr(text, "["), F.lit(0))
    )
    return TX.blank_to_null(TX.strip(F.substr(text, start)))


def _last_fence(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    block = F.when(text.contains("```"), F.try_element_at(blocks, F.lit(-1)))
    return TX.blank_to_null(TX.strip(block))


def locate_json(df: DataFrame, source: str, out: str) -> DataFrame:
    """The part of a response that should be its JSON answer.

    After the last answer marker: the last fenced block, else the text from the
    first bracket, else all that follows.  Without a marker the same search
    runs on the whole response.
    """
    text = F.coalesce(F.col(source), F.lit(""))
    lowered = F.lower(text)
    found, temporary = [], []
    for i, marker in enumerate(V.ANSWER_MARKERS):
        name = f"_after{i}"
        tail = F.length(F.substring_index(lowered, marker, -1))
        df = df.withColumn(
            name, F.when(lowered.contains(marker), TX.strip(F.right(text, tail)))
        )
        part = F.col(name)
        found += [_last_fence(part), _from_first_bracket(part), TX.blank_to_null(part)]
        temporary.append(name)
    found += [_last_fence(text), _from_first_bracket(text), TX.strip(text)]
    return df.withColumn(out, F.coalesce(*found)).drop(*temporary)


def fragment_json(df: DataFrame, source: str, out: str) -> DataFrame:
    """The *first* fenced block, else the text from the first ``{``, else ``[``, else ''."""
    text = F.coalesce(F.col(source), F.lit(""))
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    return df.withColumn(
        out,
        TX.strip(
            F.when(text.contains("```") & text.rlike(FENCE), F.regexp_extract(text, FENCE, 1))
            .when(brace > 0, F.substr(text, brace))
            .when(bracket > 0, F.substr(text, bracket))
            .otherwise("")
        ),
    )


def _open_count(brackets: Column, opening: str, closing: str) -> Column:
    return F.aggregate(
        F.split(brackets, ""),
        F.lit(0),
        lambda depth, ch: F.when(ch == opening, depth + 1)
        .when((ch == closing) & (depth > 0), depth - 1)
        .otherwise(depth),
    )


def _open_stack(brackets: Column) -> Column:
    return F.aggregate(
        F.split(brackets, ""),
        F.lit(""),
        lambda stack, ch: F.when(ch == "{", F.concat(F.lit("}"), stack))
        .when(ch == "[", F.concat(F.lit("]"), stack))
        .when((ch != "") & (F.left(stack, F.lit(1)) == ch), F.substr(stack, F.lit(2)))
        .otherwise(stack),
    )


def repair_json(df: DataFrame, source: str, out: str, closing: str = "counts") -> DataFrame:
    """Repair broken or truncated JSON text.

    ``closing='counts'`` appends all open arrays and then all open objects;
    ``closing='stack'`` closes them in the order they were opened.
    """
    text = F.col(source)
    for escaped, raw in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        text = F.replace(text, F.lit(escaped), F.lit(raw))
    text = F.replace(TX.strip(F.replace(text, F.lit("\r"), F.lit(""))), F.lit("‚"), F.lit("'"))
    for pattern, to in (
        (r"\bNone\b", "null"), (r"\}\s*\{", "}, {"), (r"\]\s*\{", "], {"),
        (r",\s*\}", "}"), (r",\s*\]", "]"),
    ):
        text = F.regexp_replace(text, pattern, to)
    df = df.withColumn("_rp_text", text)
    # Structure only: drop escaped quotes, then closed strings, then an open one.
    bare = F.regexp_replace(F.col("_rp_text"), r'\\["\\]', "")
    df = df.withColumn("_rp_bare", F.regexp_replace(bare, r'"[^"]*+"', ""))
    in_string = F.col("_rp_bare").contains('"')
    outside = F.regexp_replace(F.substring_index(F.col("_rp_bare"), '"', 1), r"[^\[\]{}]+", "")
    df = df.withColumns({"_rp_in_string": in_string, "_rp_brackets": outside})
    closed = F.concat(F.col("_rp_text"), F.lit('"'))
    was_key = closed.rlike(r'[,{]\s*"[^"]*+"$')
    df = df.withColumn(
        "_rp_text",
        F.when(F.col("_rp_in_string") & was_key, F.concat(closed, F.lit(": null")))
        .when(F.col("_rp_in_string"), closed)
        .otherwise(F.col("_rp_text")),
    ).withColumn("_rp_bare", TX.rstrip(F.col("_rp_text")))
    trimmed = F.col("_rp_bare")
    df = df.withColumn(
        "_rp_text",
        F.when(trimmed.endswith(":"), F.concat(trimmed, F.lit(" null")))
        .when(trimmed.endswith(","), TX.rstrip(F.left(trimmed, F.length(trimmed) - 1)))
        .otherwise(F.col("_rp_text")),
    )
    brackets = F.col("_rp_brackets")
    if closing == "stack":
        closers = _open_stack(brackets)
    else:
        closers = F.concat(
            F.repeat(F.lit("]"), _open_count(brackets, "[", "]")),
            F.repeat(F.lit("}"), _open_count(brackets, "{", "}")),
        )
    fixed = F.concat(F.col("_rp_text"), closers)
    for pattern, to in ((r",\s*,+", ","), (r",\s*\}", "}"), (r",\s*\]", "]")):
        fixed = F.regexp_replace(fixed, pattern, to)
    return df.withColumn(out, fixed).drop("_rp_text", "_rp_bare", "_rp_in_string", "_rp_brackets")


def _python_literal_to_json(text: Column) -> Column:
    """JSON text of a Python-style literal: single quotes, ``True``, ``None``."""
    single = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    double = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s){double}|{single}|[^\"']++|[\"']"), F.lit(0))

    def rewrite(token: Column) -> Column:
        inner = F.substr(token, F.lit(2), F.length(token) - 2)
        inner = F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        swapped = F.concat(F.lit('"'), inner, F.lit('"'))
        # Lower-case booleans are no Python names, so such text stays unparsed.
        words = F.regexp_replace(token, r"\b(?:true|false)\b", "?")
        for name, to in (("True", "true"), ("False", "false"), ("None", "null")):
            words = F.regexp_replace(words, rf"\b{name}\b", to)
        quoted = F.length(token) > 1
        return F.replace(
            F.when(token.startswith("'") & quoted, swapped)
            .when(token.startswith('"') & quoted, token)
            .otherwise(words),
            F.lit("\t"), F.lit("\\t"),
        )

    return F.array_join(F.transform(tokens, rewrite), "")


def _outside_tabs(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[,:\[{}\]])\t+|\t+(?=[,:\[{}\]])", " ")


# Text that the repair would change, or that is not complete JSON on its own.
_NEEDS_REPAIR = r"\\|\r|‚|\bNone\b|[}\]]\s*\{|,\s*[,}\]]"


def parse_lenient(df: DataFrame, source: str, out: str, closing: str = "counts") -> DataFrame:
    """VARIANT object or array of a damaged JSON text; an empty object if hopeless.

    Text that needs no repair is parsed directly; the repair steps then see a
    NULL and cost nothing.
    """
    df = fragment_json(df, source, "_ln_fragment")
    fragment = F.col("_ln_fragment")
    df = df.withColumn(
        "_ln_parsed", F.when((fragment != "") & ~fragment.rlike(_NEEDS_REPAIR), J.parse_whole(fragment))
    )
    broken = F.col("_ln_parsed").isNull() & (fragment != "")
    df = df.withColumn("_ln_fragment", F.when(broken, fragment))
    df = repair_json(df, "_ln_fragment", "_ln_repaired", closing).withColumn(
        "_ln_parsed", F.coalesce("_ln_parsed", J.parse_whole(F.col("_ln_repaired")))
    )
    literal = _python_literal_to_json(_outside_tabs(F.col("_ln_repaired")))
    df = df.withColumn("_ln_literal", F.when(F.col("_ln_parsed").isNull(), literal))
    df = df.withColumn("_ln_parsed", F.coalesce("_ln_parsed", J.parse_whole(F.col("_ln_literal"))))
    parsed = F.col("_ln_parsed")
    df = df.withColumn(
        out, F.when(J.is_object(parsed) | J.is_array(parsed), parsed).otherwise(J.empty_object())
    ).drop("_ln_fragment", "_ln_repaired", "_ln_parsed", "_ln_literal")
    return settle(df, out)


def parse_strict(df: DataFrame, source: str, out: str) -> DataFrame:
    """The whole text as a JSON object, else the first object nested at most one level."""
    text = F.coalesce(F.col(source), F.lit(""))
    df = df.withColumn("_st_whole", J.parse_whole(text))
    nested = J.parse_whole(F.regexp_extract(text, NESTED_OBJECT, 0))
    df = df.withColumn("_st_whole", F.coalesce(F.col("_st_whole"), nested))
    return df.withColumn(
        out, F.when(J.is_object(F.col("_st_whole")), F.col("_st_whole")).otherwise(J.empty_object())
    ).drop("_st_whole")


def canonical_keys(df: DataFrame, source: str, out: str) -> DataFrame:
    """Rename latin keys at every depth, if the top level uses any."""
    value = F.col(source)
    latin = F.array(*[F.lit(k) for k in V.LATIN_KEYS])
    renamed = rename_latin_keys(F.to_json(value))
    return df.withColumn(
        out,
        F.when(F.arrays_overlap(J.keys(value), latin), F.try_parse_json(renamed)).otherwise(value),
    )


def rename_latin_keys(text: Column) -> Column:
    """Rename quoted latin keys in JSON text, also where it does not parse."""
    for latin in sorted(V.LATIN_KEYS, key=len, reverse=True):
        text = F.regexp_replace(text, rf'"{latin}"\s*:', f'"{V.LATIN_KEYS[latin]}":')
    return text


def _all_null(value: Column) -> Column:
    """A list without any value, including the empty list."""
    return J.is_array(value) & ~F.exists(J.items(value), lambda x: ~J.is_null(x))


def _is_text(value: Column, text: str) -> Column:
    return (J.kind(value) == "STRING") & (F.try_variant_get(value, "$", "string") == text)


def _drop_empty(value: Column) -> Column:
    """Remove members that are ``[]``, ``""`` or null, at every depth.

    Done on the compact JSON text.  The patterns consume every string as a
    whole, so nothing inside a string is taken for a member.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    text = F.regexp_replace(
        F.to_json(value), rf'(?s){string}:(?:""|null|\[\])(?:,|(?=\}}))|({string})', "$1"
    )
    return F.try_parse_json(F.regexp_replace(text, rf"(?s)({string})|,(?=\}})", "$1"))


def _without_empty_entries(value: Column) -> Column:
    """Drop mass entries without a value and other entries without any value."""

    def keep_mass(item: Column) -> Column:
        fraction = J.get(item, V.MASS)
        return ~J.is_object(item) | ~(J.is_null(fraction) | _all_null(fraction))

    def keep_other(item: Column) -> Column:
        filled = F.exists(
            F.map_values(J.members(item)),
            lambda v: ~(J.is_null(v) | _all_null(v) | F.coalesce(_is_text(v, ""), F.lit(False))),
        )
        return ~J.is_object(item) | filled

    def entry_list(key: Column, member: Column) -> Column:
        return (
            F.when(
                (key == V.MASS) & J.is_array(member),
                F.to_variant_object(F.filter(J.items(member), keep_mass)),
            )
            .when(
                (key == V.OTHER) & J.is_array(member),
                F.to_variant_object(F.filter(J.items(member), keep_other)),
            )
            .otherwise(member)
        )

    return F.to_variant_object(F.transform_values(J.members(value), entry_list))


# Fractions travel as marked strings, so their digits stay as they are.
_DECODER = json.JSONDecoder(parse_float="\0".__add__)
_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False)
_FRACTION = re.compile(r'"\\u0000([^"]*)"')


def _no_value(value: object) -> bool:
    return value is None or isinstance(value, list) and all(x is None for x in value)


def _no_empty_members(value: object) -> object:
    if isinstance(value, dict):
        return {k: _no_empty_members(v) for k, v in value.items() if not (v is None or v == "" or v == [])}
    return [_no_empty_members(x) for x in value] if isinstance(value, list) else value


def cleaned_text(text: str, drop_empty: bool) -> str | None:
    """Compact JSON of an object without entries that hold no value; None where that would not be exact."""
    if "\\u0000" in text:
        return None
    try:
        record = _DECODER.decode(text)
        if isinstance(found := record.get(V.MASS), list):
            record[V.MASS] = [x for x in found if not (isinstance(x, dict) and _no_value(x.get(V.MASS)))]
        if isinstance(found := record.get(V.OTHER), list):
            record[V.OTHER] = [
                x for x in found if not (isinstance(x, dict) and all(_no_value(v) or v == "" for v in x.values()))]
        out = _ENCODER.encode(_no_empty_members(record) if drop_empty else record)
    except (ValueError, RecursionError):
        return None
    return _FRACTION.sub(r"\1", out) if "\\u0000" in out else out


def clean_records(df: DataFrame, source: str, out: str, drop_empty: bool = True) -> DataFrame:
    """Drop entries without values; with ``drop_empty`` also empty members.

    Non-objects pass unchanged, and so do records whose JSON text shows that
    there is nothing to drop.  A record is cleaned as text; only where that
    could change another value it is cleaned member by member: the text of
    decimals and doubles does not tell their type, which ``drop_empty`` gives up.
    """

    @arrow_udf("string")
    def cleaned(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if t is None else cleaned_text(t, drop_empty) for t in column.to_pylist()], pa.string())

    value = F.col(source)
    no_fraction = F.exists(
        J.items(J.get(value, V.MASS)), lambda x: J.get(x, V.MASS).isNull() & J.is_object(x)
    )
    df = df.withColumn("_cr_json", F.when(J.is_object(value), F.to_json(value)))
    nothing_empty = ~F.col("_cr_json").rlike(r'null|""|\[\]|\{\}') & ~no_fraction
    dirty = F.col("_cr_json").isNotNull() & ~F.coalesce(nothing_empty, F.lit(False))
    df = df.withColumn("_cr_json", F.when(dirty, F.col("_cr_json")))
    exact = F.lit(True) if drop_empty else ~J.kind(value).rlike("DECIMAL|DOUBLE|FLOAT|VARIANT")
    df = df.withColumn("_cr_text", cleaned(F.when(F.col("_cr_json").isNotNull() & exact, F.col("_cr_json"))))
    # What is left sees a NULL where the text decides.
    left = F.col("_cr_text").isNull() & F.col("_cr_json").isNotNull()
    df = df.withColumn("_cr_left", F.when(left, value))
    df = df.withColumn("_cr_clean", F.when(left, _without_empty_entries(F.col("_cr_left"))))
    members = F.col("_cr_clean")
    if drop_empty:
        members = _drop_empty(members)
    return df.withColumn(
        out,
        F.when(F.col("_cr_json").isNull(), value)
        .when(F.col("_cr_text").isNotNull(), F.try_parse_json("_cr_text"))
        .otherwise(members),
    ).drop("_cr_clean", "_cr_left", "_cr_text", "_cr_json")


def _capped(record: dict, limit: int) -> dict:
    """``record`` with the first ``limit`` distinct items of its arrays, at any depth of nested objects."""
    out: dict = {}
    todo = [(record, out)]
    while todo:
        source, target = todo.pop()
        for key, member in source.items():
            if isinstance(member, dict):
                target[key] = {}
                todo.append((member, target[key]))
            elif isinstance(member, list):
                kept: dict = {}
                for item in member:
                    number = isinstance(item, int | float)
                    kept.setdefault(float(item) if number else json.dumps(item, ensure_ascii=False), item)
                    if len(kept) == limit:
                        break
                target[key] = list(kept.values())
            else:
                target[key] = member
    return out


def dedup_cap(df: DataFrame, source: str, out: str, limit: int = MAX_ITEMS) -> DataFrame:
    """Keep the first occurrence of every array item, and the first ``limit`` of them.

    Works on the arrays of the object and of objects nested in it at any depth,
    not on arrays inside arrays.  The limit is what the operator is for: it
    removes the endless repetitions a model can fall into.
    """

    @arrow_udf("string")
    def capped(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(
                [None if t is None else json.dumps(_capped(json.loads(t), limit), ensure_ascii=False) for t in column.to_pylist()],
                pa.string(),
            )

    value = F.col(source)
    short = capped(F.when(J.is_object(value), F.to_json(value)))
    return df.withColumn(out, F.when(J.is_object(value), F.parse_json(short)).otherwise(value))


def strip_instructions(df: DataFrame, source: str, out: str) -> DataFrame:
    """Remove echoed instructions: after each, skip up to the first line with content.

    The lines are cut into sections at the instruction lines; each section is
    kept from its first line with content on.
    """
    text = F.coalesce(F.col(source), F.lit(""))

    def mentions(line: Column, words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | line.contains(word)
        return found

    def flag(line: Column) -> Column:
        lowered = F.lower(line)
        content = line.rlike(r"[\p{Nd}²³¹⁰-⁹₀-₉]") | mentions(lowered, (*V.CONTENT_TOKENS, V.NOT_FOUND))
        return F.when(mentions(lowered, V.INSTRUCTION_PHRASES), 0).when(content, 1).otherwise(2)

    echoed = mentions(F.lower(text), V.INSTRUCTION_PHRASES)
    df = df.withColumn("_si_lines", F.when(echoed, F.split(text, "\n")))
    df = settle(df.withColumn("_si_flags", F.transform("_si_lines", flag)), "_si_lines", "_si_flags")
    n = F.size("_si_lines")
    instructions = F.filter(
        F.transform("_si_flags", lambda f, i: F.when(f == 0, i + 1).otherwise(0)), lambda at: at > 0
    )
    df = settle(df.withColumn("_si_cuts", F.concat(F.array(F.lit(0)), instructions, F.array(n + 1))), "_si_cuts")

    def section(cut: Column, i: Column) -> Column:
        stop = F.get(F.col("_si_cuts"), i + 1)
        size = F.greatest(F.lit(0), stop - cut - 1)
        first = F.array_position(F.slice("_si_flags", cut + 1, size), 1).cast("int")
        return F.when(
            first > 0, F.slice("_si_lines", cut + first, stop - cut - first)
        ).otherwise(F.expr("cast(array() as array<string>)"))

    sections = F.transform(F.slice("_si_cuts", 1, F.size("_si_cuts") - 1), section)
    kept = F.array_join(F.flatten(sections), "\n")
    return df.withColumn(
        out, TX.strip(F.when(F.col("_si_lines").isNotNull(), kept).otherwise(text))
    ).drop("_si_lines", "_si_flags", "_si_cuts")


def salvage_responses(df: DataFrame, source: str = "raw_output") -> DataFrame:
    """Salvage responses without validation: adds ``json``, ``record`` (VARIANT) and ``is_valid``.

    Works on batch and streaming tables alike.
    """
    return settle(_with_json(_salvaged(df, source)).drop("_located"), "json", "record", "is_valid")


def _salvaged(df: DataFrame, source: str) -> DataFrame:
    df = locate_json(df, source, "_located")
    df = parse_lenient(df, "_located", "_salvaged")
    df = df.withColumn("is_valid", J.is_nonempty_object(F.col("_salvaged")))
    df = canonical_keys(df, "_salvaged", "_salvaged")
    return clean_records(df, "_salvaged", "record").drop("_salvaged")


def _with_json(df: DataFrame) -> DataFrame:
    mentions_latin = F.lit(False)
    for latin in V.LATIN_KEYS:
        mentions_latin = mentions_latin | F.col("_located").contains(f'"{latin}"')
    nonempty_list = J.is_array(F.col("record")) & (F.size(J.items(F.col("record"))) > 0)
    return df.withColumn(
        "json",
        F.when(F.col("is_valid"), F.to_json("record"))
        .when(mentions_latin & ~nonempty_list, rename_latin_keys(F.col("_located")))
        .otherwise(F.col("_located")),
    )


def process_responses(df: DataFrame, source: str = "raw_output") -> DataFrame:
    """Salvage and validate responses; works on batch and streaming tables alike.

    Adds ``json``, ``record`` (VARIANT), ``is_valid`` and for both stages the
    verdict and violations.  An empty response is invalid in every respect.
    """
    from gleanmark.operators.validate import validate, validate_text

    df = _salvaged(df, source)
    df = validate_text(df, source, "_located", "raw")
    df = _with_json(validate(df, "record", "parsed"))
    answered = F.coalesce(F.col(source), F.lit("")) != ""
    no_violations = F.expr("cast(array() as array<struct<path:string,rule:string>>)")
    df = df.withColumns(
        {
            f"{stage}_valid": answered & F.col(f"{stage}_valid") for stage in ("raw", "parsed")
        }
        | {
            f"{stage}_violations": F.when(answered, F.col(f"{stage}_violations")).otherwise(no_violations)
            for stage in ("raw", "parsed")
        }
    ).drop("_located")
    checks = [f"{stage}_{what}" for stage in ("raw", "parsed") for what in ("valid", "violations")]
    return settle(df, "json", "record", "is_valid", *checks)

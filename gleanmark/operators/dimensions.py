"""Names looked up in tables: method titles, the prompt a served method ends with, templates of stored names.

The dimension tables may have any number of rows: they are joined on equal
values, never written into the plan.  Lookups run on the distinct names and
are joined back, so their cost follows the number of names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import text as TX
from gleanmark.operators import leaderboard as LB
from gleanmark.operators.lengths import template_hint
from gleanmark.session import materialize

#: Values that the head of a key is hashed to: the table of those that occur has no more rows.
HEADS = 1 << 16


def method_dimension(spark: SparkSession) -> DataFrame:
    """method, alias and description of the known methods."""
    rows = [(m, alias, V.METHOD_DESCRIPTIONS[m]) for m, alias in V.METHOD_ALIASES.items()]
    return spark.createDataFrame(rows, "method string, alias string, description string")


def template_aliases(spark: SparkSession) -> DataFrame:
    """alias and template: older template names and their present ones."""
    return spark.createDataFrame(list(V.TEMPLATE_ALIASES.items()), "alias string, template string")


def with_alias(cells: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add ``alias``, ``description`` and ``method_order`` from a dimension (method, alias, description).

    A method that is not in it gets its initials, and its name as description.
    """
    known = dimension.select(F.col("method").alias("_known"), F.col("alias").alias("_alias"), F.col("description").alias("_text"))
    titled = cells.join(known, F.col("method") == F.col("_known"), "left").withColumns(
        {"alias": F.coalesce("_alias", LB.acronym(F.col("method"))), "description": F.coalesce("_text", "method")})
    return titled.withColumn("method_order", LB.alias_number(F.col("alias"))).drop("_known", "_alias", "_text")


def longest_suffix(names: DataFrame, name: str, dimension: DataFrame, key: str) -> DataFrame:
    """``name`` and ``known``: the longest ``key`` of the dimension that each distinct name ends with, where there is one.

    Every name sends its endings, none longer than the longest key, to an equi-join; but those that differ from all keys
    in their length or their first two characters stay where they are.  The result is written once.
    """
    given = dimension.select(F.col(key).alias("_key")).filter(F.length("_key") > 0)
    longest = given.agg(F.coalesce(F.max(F.length("_key")), F.lit(0)).alias("n")).scalar()
    head = F.pmod(F.xxhash64(F.length("_key"), F.left("_key", F.lit(2))), F.lit(HEADS)).cast("int")
    heads = given.select(head.alias("_head")).distinct()
    size = F.length(name)
    measured = names.select(name).distinct().withColumn("_most", F.least(size, longest)).filter("_most > 0")
    endings = measured.select(name, F.explode(F.sequence(F.lit(1), F.col("_most"))).alias("_n"))
    endings = endings.select(name, F.right(name, F.col("_n")).alias("_key")).withColumn("_head", head)
    sent = endings.join(F.broadcast(heads), "_head", "left_semi").drop("_head")
    found = sent.join(given.distinct(), "_key").groupBy(name).agg(F.max_by("_key", F.length("_key")).alias("known"))
    return materialize(found, "endings")


def split_quant(df: DataFrame, prefix: str, dimension: DataFrame) -> DataFrame:
    """As ``leaderboard.split_quant``, with the prompts and their titles from a dimension (method, alias)."""
    served = df.filter(F.col("method").startswith(prefix)).select("method").distinct().withColumn(
        "_rest", F.substr("method", F.lit(len(prefix) + 1)))
    found = longest_suffix(served, "_rest", dimension, "method").select(F.col("_rest").alias("_found"), F.col("known").alias("_prompt"))
    known = served.join(found, F.col("_rest") == F.col("_found")).select(F.col("method").alias("_method"), "_prompt")
    split = LB.split_served(df.join(known, F.col("method") == F.col("_method"), "left"), prefix, F.col("_prompt"))
    titles = dimension.select(F.col("method").alias("_named"), F.col("alias").alias("_alias"))
    named = split.join(titles, F.col("prompt") == F.col("_named"), "left")
    out = LB.titled(named, prefix, F.coalesce("_alias", LB.acronym(F.col("prompt"))))
    return out.drop("_method", "_prompt", "_named", "_alias")


def resolve_templates(
    df: DataFrame, name: str, folder: str, templates: DataFrame, aliases: DataFrame, default: str, out: str = "template"
) -> DataFrame:
    """Add the template of a stored name, as ``lengths.resolve_template``, from the tables ``templates`` (template)
    and ``aliases`` (alias, template).
    """
    pairs = df.select(F.col(name).alias("_name"), F.col(folder).alias("_folder")).distinct()

    def tries(raw: Column, rank: int) -> list[Column]:
        bare = TX.strip(raw)
        as_is = [(bare, False), (bare, True)]
        cut = [(F.when(bare.endswith(s), F.left(bare, F.length(bare) - len(s))), False) for s in V.DECODER_SUFFIXES]
        return [F.struct(F.lit(rank + i).alias("rank"), text.alias("text"), F.lit(by).alias("by_alias"))
                for i, (text, by) in enumerate([*as_is, *cut])]

    candidates = pairs.select(
        "_name", "_folder",
        F.inline(F.array(*tries(TX.blank_to_null(F.col("_name")), 0), *tries(template_hint(F.col("_folder")), 10))),
    ).filter(F.col("text").isNotNull())
    present = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("template").alias("_present"))
    named = candidates.join(present, (F.col("text") == F.col("_alias")) & F.col("by_alias"), "left").withColumn(
        "text", F.when(F.col("by_alias"), F.col("_present")).otherwise(F.col("text")))
    known = templates.select(F.col("template").alias("_known")).distinct()
    found = named.join(known, F.col("text") == F.col("_known")).groupBy("_name", "_folder").agg(F.min_by("text", "rank").alias("_found"))
    same = F.col(name).eqNullSafe(F.col("_name")) & F.col(folder).eqNullSafe(F.col("_folder"))
    return df.join(found, same, "left").withColumn(out, F.coalesce("_found", F.lit(default))).drop("_name", "_folder", "_found")

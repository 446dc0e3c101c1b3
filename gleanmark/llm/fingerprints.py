"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``SIZE`` smallest distinct 48-bit hashes of a text's five-word shingles (a text
with fewer words has one shingle of all of them, one without words none). Sketches of parts merge into the sketch of
the whole. Two sketches give estimates of resemblance and containment, one gives the number of distinct shingles; all
are exact for texts with fewer shingles than the sketch holds.

Null texts count as empty. Two empty sketches are alike (1.0), an empty and another are not (0.0).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmark.llm.frames import free_name

SHINGLE, SIZE, HASH_BITS = 5, 256, 48
MOST_BUCKETS, BUCKET_ROWS, SEGMENTS = 1 << 16, 512, 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all shingles, repeats included. ``words`` should be a column of its own: it is read for every word."""
    hashes = F.transform(words, lambda w, i: F.shiftrightunsigned(
        F.xxhash64(w, *(F.get(words, i + j) for j in range(1, shingle))), 64 - HASH_BITS))
    n = F.size(words)
    return F.slice(hashes, 1, F.greatest(n - (shingle - 1), F.least(n, F.lit(1))))


def bottom(hashes: Column, size: int = SIZE) -> Column:
    """The smallest distinct hashes in ascending order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merge(left: Column, right: Column, size: int = SIZE) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(left, right)), 1, size)


def resemblance(left: Column, right: Column, size: int = SIZE) -> Column:
    """Estimate of the shared part of all distinct shingles of both."""
    both = merge(left, right, size)
    shared = F.size(F.array_intersect(F.array_intersect(both, left), right))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def n_distinct(sketch: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles: exact below ``size``, else from the largest hash kept."""
    largest = F.element_at(sketch, -1).cast("double")
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise(
        (size - 1) * float(1 << HASH_BITS) / largest)


def containment(left: Column, right: Column, size: int = SIZE) -> Column:
    """Estimate of the part of the left text's distinct shingles that the right one has too."""
    r = resemblance(left, right, size)
    shared = r / (1 + r) * (n_distinct(left, size) + n_distinct(right, size))
    return F.when(F.size(left) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / n_distinct(left, size)))


def as_text(sketch: Column) -> Column:
    """Base64 of the hashes, six bytes each."""
    digits = F.transform(sketch, lambda h: F.lpad(F.hex(h), HASH_BITS // 4, "0"))
    return F.base64(F.unhex(F.array_join(digits, "")))


def with_sketch(docs: DataFrame, text: str = "text", wish: str = "sketch") -> tuple[DataFrame, str]:
    """``docs`` with one more column, the sketch of its text; the column's name is returned."""
    name = free_name(docs, wish)
    words = free_name(docs, "words")
    split = docs.withColumn(words, words_of(F.col(text)))
    return split.withColumn(name, bottom(shingle_hashes(F.col(words)))).drop(words), name


def id_bucket(docs: DataFrame) -> Column:
    """Number of an id's range, ascending with the id: about ``BUCKET_ROWS`` rows each, ``MOST_BUCKETS`` at most.

    Quantiles cut the ids into segments of about equal numbers of rows, and each segment is cut evenly. Null ids come
    first, in bucket -1.
    """
    steps = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    n, marks = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", steps, 10_000)).first()
    if not n:
        return F.lit(-1).cast("long")
    marks = sorted(set(marks))
    per_segment = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)) // SEGMENTS)
    edges = F.array(*(F.lit(m).cast("long") for m in [marks[0] - 1, *marks]))
    segment = F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < F.col("doc_id"))))
    low, high = F.get(edges, segment - 1), F.coalesce(F.get(edges, segment), F.lit(marks[-1]).cast("long"))
    part = (F.col("doc_id").cast("double") - low) / F.greatest(F.lit(1.0), high.cast("double") - low) * per_segment
    inside = F.greatest(F.lit(0), F.least(F.lit(per_segment - 1), F.floor(part)))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(segment * per_segment + inside).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch and the same of the next row by (doc_id, text): next_text, next_sketch.

    After the last row comes the first. Rows are dealt by ranges of ids; the first rows of a range also go to the range
    before, so texts move once. The table of first ids has a row for each range, ``MOST_BUCKETS`` at most.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), id_bucket(docs).alias("bucket"))
    every = Window.orderBy("bucket")
    firsts = (
        rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
        .select("first_id", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(
            every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    )
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    other = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))
    dealt = (
        rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
        .select("doc_id", "text", F.explode(
            F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("to"))
        .select("doc_id", "text", "to.bucket", "to.extra").repartition("bucket")
    )
    sketched, name = with_sketch(dealt)
    order = Window.partitionBy("bucket").orderBy("extra", "doc_id", "text")
    return (
        sketched.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead(name).over(order))
        .where(~F.col("extra")).drop("bucket", "extra")
    )


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, one row per row of ``docs``.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones of the next text.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    rows, name = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col(name)).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col(name)).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        n_distinct(F.col("sketch")).alias("n_shingles"),
    )

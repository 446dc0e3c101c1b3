"""Ranks, quantiles, uncertainty, neighbours and clusters against brute force."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.operators import lengths as L
from gleanmark.operators import neighbours as NB
from gleanmark.operators import selection as SEL
from gleanmark.plans.ranks import running_total, values_at_ranks


def test_running_total_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", i * 7) for i in range(3000)] + [(f"k{rng.randint(0, 50)}", i * 1000003) for i in range(500)]
    rows += [(None, 5), (None, 2)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    got = {(r.k, r.o): r.t for r in running_total(df, ["k"], "o", "t").collect()}
    assert len(got) == len(rows)
    for k, o in rows:
        assert got[(k, o)] == sum(1 for a, b in rows if a == k and b <= o)


def test_ranges_do_not_depend_on_density(spark):
    """One key, positions all over 60 bits: the windows hold about equal shares."""
    rng = random.Random(4)
    positions = rng.sample(range(1 << 60), 4000)
    df = spark.createDataFrame([("k", o) for o in positions], "k string, o bigint").repartition(8)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        out = running_total(df, ["k"], "o", "t")
        assert sorted((r.o, r.t) for r in out.collect()) == [(o, i + 1) for i, o in enumerate(sorted(positions))]
        sizes = [r["count"] for r in df.repartitionByRange("k", "o").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.3 * len(positions)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_values_at_ranks(spark):
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 5000)) for _ in range(2000)] + [("b", 7)] * 900 + [("c", 3)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    ranks = {"first": F.lit(1), "mid": F.floor((F.col("n") + 1) / 2), "last": F.col("n")}
    for shifts in ((16, 0), (6, 3, 0)):
        for r in values_at_ranks(df, ["k"], "v", ranks, shifts=shifts).collect():
            values = sorted(v for k, v in rows if k == r.k)
            assert (r.first, r.mid, r.last) == (values[0], values[(len(values) + 1) // 2 - 1], values[-1])


def test_nearest_rank_profile(spark):
    df = spark.createDataFrame([("x" * n,) for n in range(1, 11)] + [("",)], "t string")
    row = L.length_profile(df, "t", counter=F.length).first()
    assert (row.n, row.min_len, row.max_len, row.p90) == (10, 1, 10, 9)
    one = L.length_profile(df.filter("t = 'xxx'"), "t", counter=F.length).first()
    assert (one.p90, one.p99) == (3, 3)


def test_budget(spark):
    got = spark.createDataFrame([(1000,), (10,), (256,)], "m bigint").select(L.recommend_budget(F.col("m"))).collect()
    assert [r[0] for r in got] == [1152, 256, 320]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_uncertainty(spark):
    record = lambda v: json.dumps({V.MASS: [{V.SUBSTANCE: "N", V.MASS: v}]}, ensure_ascii=False)
    cases = {
        1: [], 2: ["нет", "нет"], 3: ['{"a":1}', "нет"],
        4: [record(20), record(20.0), record(20)], 5: [record(1), json.dumps({V.MASS: [], "x": 1}, ensure_ascii=False)],
    }
    df = spark.createDataFrame(list(cases.items()), "text_index bigint, responses array<string>")
    got = {r.text_index: r for r in SEL.score_uncertainty(df).collect()}
    assert (got[1].r_fail, got[1].structural_disagreement, got[1].content_uncertainty) == (1, 1, 1)
    assert (got[2].r_fail, got[2].structural_disagreement, got[2].content_uncertainty) == (1, 1, 0)
    assert (got[3].r_fail, got[3].structural_disagreement) == (0.5, 1)
    # 20 and 20.0 are written differently, so only one of three pairs agrees.
    assert got[4].content_uncertainty == pytest.approx(1 - 1 / 3)
    # Half of the keys differ, and so does the length of the only list.
    assert got[5].structural_disagreement == pytest.approx((0.5 + 1.0) / 2)
    for i, texts in cases.items():
        pairs = [(a, b) for n, a in enumerate(texts) for b in texts[n + 1:]]
        expected = np.mean([lev(a, b) / max(len(a), len(b), 1) for a, b in pairs]) if pairs else 0.0
        assert got[i].generation_disagreement == pytest.approx(expected)
    assert got[2].json == "нет" and got[1].json == ""


def brute_scores(matrix, k):
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix / np.where(norm == 0, 1, norm)
    distance = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(distance, np.inf)
    return np.sort(distance, axis=1)[:, : min(k, len(matrix) - 1)].mean(axis=1)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_neighbours_are_exact(spark, block_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 3
    matrix = np.concatenate([c + rng.normal(size=(25, 8)) for c in centres])
    matrix = np.concatenate([matrix, np.repeat(matrix[:1], 80, axis=0), np.zeros((2, 8))])  # a hot point and zeros
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "i bigint, v array<double>")
    got = NB.knn_outliers(df, "i", "v", k=5, block_rows=block_rows).orderBy("i").toPandas()
    expected = brute_scores(matrix, 5)
    assert np.abs(got.outlier_score.to_numpy() - expected).max() < 1e-9
    clear = np.abs(expected - np.percentile(expected, 95)) > 1e-9
    assert (got.is_outlier.to_numpy() == (expected > np.percentile(expected, 95)))[clear].all()


def test_vectors_meet_a_bounded_number_of_blocks(spark):
    for total in (1_000, 20_000, 100_000, 1_000_000):
        assert -(-total // NB.rows_of_block(total, 64, 1024)) <= 16
    assert NB.rows_of_block(10**9, 64, 1024) * 64 * 8 <= 1 << 25
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "i bigint, v array<float>")
    got = NB.knn_outliers(df, "i", "v", k=5, block_rows=1).orderBy("i").toPandas()
    assert np.abs(got.outlier_score.to_numpy() - brute_scores(matrix.astype(np.float64), 5)).max() < 1e-9


def test_lone_vector_is_no_outlier(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "i bigint, v array<double>")
    row = NB.knn_outliers(df, "i", "v").first()
    assert row.outlier_score == 0 and not row.is_outlier


def test_clusters(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = SEL.cluster(df, k=8, restarts=2).persist()
    centres = {r.cluster: np.array(r.c) for r in rows.groupBy("cluster").agg(
        F.array(*[F.avg(F.col("embedding")[i]) for i in range(64)]).alias("c")).collect()}
    assert 1 < len(centres) <= 8
    first = SEL.one_per_cluster(rows, "cluster", "vec_id").collect()
    assert len(first) == len(centres)
    smallest = {r.cluster: r.m for r in rows.groupBy("cluster").agg(F.min("vec_id").alias("m")).collect()}
    assert {r.cluster: r.vec_id for r in first} == smallest


def test_drop_labeled_with_many_copies(spark):
    texts = ["копия"] * 900 + [f"t{i}" for i in range(100)] + [" t5\n"]
    unlabeled = spark.createDataFrame(list(enumerate(texts)), "text_index bigint, text string")
    labeled = spark.createDataFrame([(" t5 ",), ("t7",), ("t7",)], "text string")
    left = SEL.drop_labeled(unlabeled, labeled)
    assert left.count() == len(texts) - 3
    assert SEL.drop_labeled(unlabeled, spark.createDataFrame([("копия\n",)], "text string")).count() == 101


def test_pool(spark):
    files = spark.createDataFrame(
        [("m", "a.csv", 9), ("m", "b.xlsx", 1), ("m", "c.xlsx", 2), ("k", "d.csv", 1)], "model_key string, path string, mtime int"
    )
    assert {r.model_key: r.path for r in SEL.latest_pool(files).collect()} == {"m": "c.xlsx", "k": "d.csv"}


def test_edit_distance_equals_the_table(spark):
    """Bits of whole columns give the distances of the cell-by-cell table, also of long and of wide texts."""
    import random

    from gleanmark.operators.selection import edit_distance, generation_disagreement

    def by_table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    pairs = [(word(rng.randint(0, 9)), word(rng.randint(0, 9))) for _ in range(400)] + [(word(150), word(170)) for _ in range(8)]
    assert [edit_distance(a, b) for a, b in pairs] == [by_table(a, b) for a, b in pairs]

    rows = [(0, ["abc", "abd", "x"]), (1, ["abc"]), (2, []), (3, None), (4, ["a", None, "b"]), (5, ["", ""]), (6, ["aa", "b"])]
    got = spark.createDataFrame(rows, "id int, r array<string>").select("id", generation_disagreement(F.col("r")).alias("d"))
    assert {r["id"]: round(r["d"], 9) for r in got.collect()} == {
        0: round((1 / 3 + 1 + 1) / 3, 9), 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}

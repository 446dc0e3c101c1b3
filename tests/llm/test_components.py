import random

from gleanmark.llm.components import connected

from . import brute


def test_random_graphs(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 120)] + [(500, 500 + i) for i in range(200)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    links += [(7, 7), (2000, 2000)]
    forest = brute.Forest((n, n) for pair in links for n in pair)
    for a, b in links:
        forest.join(a, b)
    rows = connected(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["node"])
    wanted = {}
    for n in forest:
        wanted.setdefault(forest.root(n), set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in wanted.values() if len(g) > 1)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0

import random

from weftline.llm.components import components


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((x, find(x)) for x in root)


def check(spark, links):
    df = spark.createDataFrame([(*x, "k") for x in links], "a long, b long, component string")
    assert sorted(tuple(r) for r in components(df).collect()) == brute(links)


def test_shapes(spark):
    rng = random.Random(4)
    check(spark, [(k, k + 1) for k in range(60, 0, -1)])  # a chain
    check(spark, [(500, k) for k in range(300)] + [(500, 501)])  # a hub
    check(spark, [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 3), (4, None), (7, 7), (1, 2), (2, 1)])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

import numpy as np

from loamframe.operators.graph import components


def test_components_match_union_find(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5)]
    parent = {i: i for pair in links for i in pair}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    alone = {i for i in parent if all(i not in p or p[0] == p[1] for p in links)}
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: root(i) for i in parent if i not in alone}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

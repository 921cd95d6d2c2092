"""Components of links, at once and in two parts, against plain Python."""

import random

import pytest

from lexloom.llm import neardup


def least_reachable(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def shapes():
    rng = random.Random(8)
    path = list(range(40))
    rng.shuffle(path)
    yield list(zip(path, path[1:]))  # one long path in mixed order
    yield [(100, k) for k in range(60)] + [(200, k) for k in range(50, 90)]  # two hubs with common neighbours
    yield [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]  # loops and repeats among them


@pytest.mark.parametrize("links", list(shapes()))
def test_components(spark, links):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    expected = {x: r for x, r in least_reachable(links).items() if x != r}
    got = neardup.components(frame(links)).collect()
    assert len(got) == len(expected) and {r.node: r.root for r in got} == expected
    half = neardup.components(frame(links[::2]))
    got = neardup.joined_components(half, frame(links[1::2])).collect()
    assert len(got) == len(expected) and {r.node: r.root for r in got} == expected


def test_no_links(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert neardup.joined_components(neardup.components(none), none).count() == 0

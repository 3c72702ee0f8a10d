"""Traversal to any depth against breadth-first search in order of arrival."""

import random

from lexigraph.operators import graph


def breadth_first(origins, near, active, depth):
    out = set()
    for qid, start in origins:
        seen, front, distance = {start}, [start], 0
        while front and (depth is None or distance < depth):
            distance, arrived = distance + 1, []
            for a in front:
                for b in sorted(near.get(a, ())):
                    if b not in seen:
                        seen.add(b)
                        arrived.append((b, a))
            out |= {(qid, b, distance, a) for b, a in arrived if b in active}
            front = [b for b, _ in arrived if b in active]
    return out


def test_any_depth(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(24)] + [(rng.randrange(30, 90), rng.randrange(30, 90)) for _ in range(90)] + [(3, 60), (12, 7)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    active = {i for i in range(100) if i % 11 != 5}
    origins = [("x", 0), ("y", 40), ("z", 99)]
    e = spark.createDataFrame([x for x in edges if x[0] != x[1]], "src long, dst long")
    notes = spark.createDataFrame([(i, "active" if i in active else "draft") for i in range(100)], "id long, status string")
    o = spark.createDataFrame(origins, "qid string, id long")
    for depth in (1, 3, None):
        got = {tuple(r) for r in graph.traverse(o, e, notes, depth).collect()}
        assert got == breadth_first(origins, near, active, depth)
    assert max(d for _, _, d, _ in breadth_first(origins, near, active, None)) > 4

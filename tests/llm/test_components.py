import random

from geopanel.llm.components import components


def expected(edges):
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def run(spark, edges):
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    random.seed(3)
    wild = [(random.randint(200, 300), random.randint(200, 300)) for _ in range(60)]
    edges = chain + star + wild + [(500, 500), (None, 7), (8, None), (3, 4), (4, 3)]
    assert run(spark, edges) == expected(edges)


def test_nothing(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1)]) == {}

import itertools
from collections import Counter

from loomgraph.operators import history


def test_large_commits_count(spark):
    commits = {1: range(1200), 2: range(1150, 1210), 3: range(1195, 1260)}
    changes = spark.createDataFrame([(s, f"f{k:04d}") for s, items in commits.items() for k in items], "sha long, item string")
    for cell in (1000, 70):
        got = {(r["a"], r["b"]): r["together"] for r in history.co_change(changes, "item", cell=cell).collect()}
        n = Counter((f"f{a:04d}", f"f{b:04d}") for items in commits.values() for a, b in itertools.combinations(items, 2))
        assert got == {p: k for p, k in n.items() if k >= 2}
    assert history.co_change(changes, "item", most_in_commit=1000).count() == 105

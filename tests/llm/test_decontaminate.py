import random
import re
from math import ceil

from loomgraph.llm import decontaminate


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def has(doc, item):
    own = shingles(item)
    if not own:
        return None
    w = re.findall(r"\w+", (doc or "").lower())
    n = len(next(iter(own)))
    there = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    found = len(own & there)
    return (found, len(own)) if found >= ceil(0.8 * len(own) - 1e-9) else None


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(prose(rng.choice([1, 3, 5, 6, 14, 40, 200]))) for _ in range(40)] + ["", None, "- !", "Tie tie tie tie tie tie", "ß É x"]
    docs = [None, "", "tie " * 9, "SS é X ß é x"]
    for _ in range(120):
        body = prose(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items) or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                if w:
                    w[rng.randrange(len(w))] = "changed"
            if rng.random() < 0.3:
                w = [x.upper() + "," for x in w]
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append(" ".join(body))
    rows = [(k, d, 1.0) for k, d in enumerate(docs)] + [(5, docs[5], 1.0)]
    d = spark.createDataFrame([*rows, (None, docs[7], 0.0)], "doc_id long, text string, containment double")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted((k, j, *f) for k, t, _ in rows for j, x in enumerate(items) if (f := has(t, x)))
    assert len(want) > 30
    for at_once in (20_000, 7):
        got = decontaminate.contained(d, i, at_once=at_once).collect()
        assert sorted(tuple(r)[:4] for r in got if r["doc_id"] is not None) == want
    kept = {r["doc_id"] for r in decontaminate.without_items(d, i).collect()} - {None}
    assert kept == set(range(len(docs))) - {w[0] for w in want}
    twins = spark.createDataFrame([(None, "fine text", 1), (None, items[0], 2), (7, "other fine text", 3), (7, items[0], 4), (7, "other fine text", 5)], "doc_id long, text string, __leak int")
    assert sorted(r["__leak"] for r in decontaminate.without_items(twins, i, at_once=7).collect()) == [1, 3, 5]
    long = spark.createDataFrame([(1, " ".join(prose(300_000)) + " " + items[0]), (2, " ".join(prose(300_000)))], "doc_id long, text string")
    only = spark.createDataFrame([(0, "zeta eta theta iota kappa lamda mu nu"), (1, items[0])], "item_id long, text string")
    assert (1, 1) in {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(long, only).collect()}
    assert decontaminate.contained(d.limit(0), i).count() == 0 and decontaminate.contained(d, i.limit(0)).count() == 0

"""Packing: nothing lost, nothing over, and as full as best fit one item at a time."""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import packing, tokens


def one_by_one(sizes, capacity):
    gaps, n = [], 0
    for s in sorted((s for s in sizes if s), reverse=True):
        at = bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += gap == capacity and at >= len(gaps)
        insort(gaps, gap - s)
    return len(gaps)


def sweep(items, slots):
    """Largest item first, each to the smallest free slot that holds it: the sets of items and slots that are matched."""
    free, took, got = sorted(slots), [], []
    for s in sorted(items, reverse=True):
        at = bisect_left(free, s)
        if at < len(free):
            got.append(free.pop(at))
            took.append(s)
    return sorted(took), sorted(got)


def test_sweep_takes_successors(spark):
    rng = random.Random(5)
    cases = [([rng.randint(1, 12) for _ in range(rng.randint(0, 15))], [rng.randint(1, 14) for _ in range(rng.randint(0, 15))]) for _ in range(60)]
    items = spark.createDataFrame([(p, v, n, 0) for p, (i, _) in enumerate(cases) for v, n in Counter(i).items()], "p int, v long, n long, used long")
    slots = spark.createDataFrame([(p, v, n) for p, (_, s) in enumerate(cases) for v, n in Counter(s).items()], "p int, v long, ns long")
    got, left = {p: ([], []) for p in range(len(cases))}, Counter()
    for r in packing.swept(items, slots).collect():
        if r["kind"] == "match":
            assert r["slot"] >= r["v"]
            got[r["p"]][0].extend([r["v"]] * r["n"])
            got[r["p"]][1].extend([r["slot"]] * r["n"])
        else:
            left[r["p"]] += r["n"]
    for p, (i, s) in enumerate(cases):
        took, free = sweep(i, s)
        assert sorted(got[p][0]) == took and sorted(got[p][1]) == free and left[p] == len(i) - len(took), p


@pytest.mark.parametrize("most", [3, 40])
def test_ranks_are_alike_in_any_number_of_parts(spark, most):
    rows = spark.range(200).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("g"), "id")
    want = {r["id"]: r["r"] for r in packing.ranked(rows, ["g"], ["id"], "r", 1000, 200).collect()}
    got = {r["id"]: r["r"] for r in packing.ranked(rows, ["g"], ["id"], "r", most).collect()}
    assert got == want and sorted(got[i] for i in range(150)) == list(range(1, 151))


@pytest.mark.parametrize("most", [500_000, 7])
def test_rounds_against_best_fit(spark, most):
    rng = random.Random(6)
    cases = [(50, [rng.randint(1, 50) for _ in range(200)]), (100, [34] * 90), (10, [6] * 40 + [4] * 40), (1000, [int(min(1000, rng.lognormvariate(3, 1.2) + 1)) for _ in range(900)]), (7, [1] * 50), (9, [])]
    items = spark.createDataFrame([(p, v, n) for p, (_, sizes) in enumerate(cases) for v, n in Counter(sizes).items()], "p int, v long, n long")
    rows = packing.best_fit(items, [c for c, _ in cases], most).collect()
    for p, (capacity, sizes) in enumerate(cases):
        mine = [r for r in rows if r["p"] == p]
        load = Counter()
        for r in mine:
            load[r["container"]] += r["v"]
        assert sorted((r["v"], r["k"]) for r in mine) == sorted((v, k + 1) for v, n in Counter(sizes).items() for k in range(n))
        assert all(x <= capacity for x in load.values()) and len(load) <= max(one_by_one(sizes, capacity) + 1, 1.03 * one_by_one(sizes, capacity)), (p, len(load), one_by_one(sizes, capacity))


@pytest.mark.parametrize("ranked_rows", [500_000, 3])
def test_whole_documents(spark, ranked_rows):
    rng = random.Random(4)
    texts = [" ".join(["word"] * rng.choice([1, 5, 5, 5, 20, 33])) for _ in range(60)] + ["", None, "  ", "word " * 200]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, container string, p int")
    limits = spark.createDataFrame([("s", 32), ("l", 90), ("none", None), ("zero", 0), ("s", 32)], "profile string, capacity_tokens int")
    packed = packing.pack(docs, limits, ranked_rows=ranked_rows).persist()
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, ["doc_id"]).collect()}
    for profile, capacity in (("s", 32), ("l", 90)):
        rows = packed.filter(F.col("profile") == profile).collect()
        load, whole = Counter(), {}
        for r in rows:
            load[r["container"]] += r["n_tokens"]
            whole.setdefault(r["doc_id"], []).append((r["piece_no"], r["first_token"], r["n_tokens"]))
        assert max(load.values()) <= capacity and set(whole) == set(n)
        for d, pieces in whole.items():
            pieces.sort()
            assert sum(p[2] for p in pieces) == n[d] and len(pieces) == (1 if n[d] <= capacity else -(-n[d] // capacity)) and [p[0] for p in pieces] == list(range(len(pieces)))
            assert all(p[1] == sum(q[2] for q in pieces[:k]) for k, p in enumerate(pieces))
        rest = [x if x <= capacity else x % capacity for x in n.values()]
        full = sum(x // capacity for x in n.values() if x > capacity)
        assert len(load) <= one_by_one(rest, capacity) + full + 1
    assert {r["profile"] for r in packed.select("profile").distinct().collect()} == {"s", "l"}
    assert packing.pack(docs.limit(0), limits).count() == 0 and packing.pack(docs, limits.limit(0)).count() == 0
    report = {r["profile"]: r["n_tokens"] for r in packing.fill_report(packed, limits).collect()}
    assert report == {"s": sum(n.values()), "l": sum(n.values())}


def test_long_texts_count_the_same_in_parts(monkeypatch):
    with open(tokens.VOCABULARY, "rb") as f:
        enc = tokens.encoding(f.read())
    text = " ".join(random.Random(1).choice(["alpha", "beta,", "naïve", "12 34", "日本語", "x\n\ny"]) for _ in range(3000))
    whole = len(enc.encode_ordinary(text))
    monkeypatch.setattr(tokens, "PART", 100)
    assert len(list(tokens.parts(text))) > 50 and tokens.count([text, None, ""], enc) == [whole, 0, 0]
    for odd in ("保険金は、三週間以内に支払われる。" * 60, "it's (don't) 'quoted' we're <b>x</b>," * 60, "x" * 500 + "、" + "y" * 300, "12a3b" * 200, "a'sb'll" * 100):
        assert tokens.count([odd], enc) == [len(enc.encode_ordinary(odd))], odd[:20]
    assert len(list(tokens.parts("保険金は、三週間以内に支払われる。" * 60))) > 5

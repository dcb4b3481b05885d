"""Mixing: budgets by threshold against a sort, caps on repeats, unreachable shares."""

from __future__ import annotations

import random

from lodestrand.llm import mixing
from lodestrand.llm.mixing import Target


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, place long")


def corpus(seed, n=400, bits=60):
    rng = random.Random(seed)
    return [(i, rng.choice(["big", "big", "big", "mid", "tiny"]) if i > 3 else "tiny", rng.randint(1, 50), rng.getrandbits(bits)) for i in range(n)]


def test_thresholds_equal_a_sort(spark):
    for seed, bits in ((1, 60), (2, 3)):
        rows = corpus(seed, bits=bits)
        df = sized(spark, rows)
        first = mixing._histogram(df, None, 0)
        for budget in (0.0, 1.0, 777.0, 2_500.0, 1e9):
            below = mixing.thresholds(df, first, {s: budget for s in ("big", "mid", "tiny")})
            for source in ("big", "mid", "tiny"):
                own = sorted((p, t) for _, s, t, p in rows if s == source)
                sums, total, last = [0], 0, None
                for k, (p, t) in enumerate(own):
                    total += t
                    if k + 1 == len(own) or own[k + 1][0] != p:
                        sums.append(total)
                got = sum(t for p, t in own if p < below.get(source, 0))
                assert abs(got - budget) == min(abs(s - budget) for s in sums), (source, budget, got)


def test_budgets_are_nested(spark):
    df = sized(spark, corpus(5))
    wanted = [Target("big", 0.5, 1), Target("mid", 0.3, 2), Target("tiny", 0.2, 4)]
    small = {r["doc_id"]: r["repeats"] for r in mixing.draw(df, wanted, 2000).collect()}
    large = {r["doc_id"]: r["repeats"] for r in mixing.draw(df, wanted, 3500).collect()}
    assert all(large.get(d, 0) >= n for d, n in small.items()) and all(large.get(d) for d in small)


def test_shares_and_caps(spark):
    rows = corpus(6)
    wanted = [Target("absent", 0.1, 9), Target("big", 0.5, 1), Target("mid", 0.2, 2), Target("tiny", 0.2, 4)]
    drawn = mixing.draw(sized(spark, rows), wanted).collect()
    tokens = {}
    for r in drawn:
        assert 1 <= r["repeats"] <= {"big": 1, "mid": 2, "tiny": 4}[r["source"]]
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["repeats"] * r["n_tokens"]
    whole = sum(tokens.values())
    for t in wanted[1:]:
        assert abs(tokens[t.source] / whole - t.share / 0.9) < 0.02
    over = mixing.draw(sized(spark, rows), wanted, 10**9).collect()
    assert {(r["source"], r["repeats"]) for r in over} == {("big", 1), ("mid", 2), ("tiny", 4)} and len(over) == len(rows)


def test_whole_path_with_dirty_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "A-b"), (2, "gamma", " a_B "), (3, "", "a_b"), (4, None, "a_b"), (5, "delta", None), (6, "x " * 5000, "c"), (7, "eps", "other"), (2, "gamma", "a_b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a_b", 0.5, 3), ("c", 0.4, None), ("none", 0.1, 2), ("zero", None, 1)], "source string, target_share double, max_repeats int")
    got = {(r["doc_id"], r["source"]) for r in mixing.mix(docs, targets, 10.0**6).collect()}
    assert got == {(1, "a_b"), (2, "a_b"), (6, "c")}
    report = {r["source"]: r for r in mixing.share_report(docs, targets).collect()}
    assert report["none"]["supply_tokens"] == 0 and report["none"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0

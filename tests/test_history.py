"""Attribute history against a row-by-row reading, for ordinary and for cut keys."""

from __future__ import annotations

import datetime as dt
import random
import unicodedata

import pytest

from lodestrand.operators import history

SCHEMA = "update_id long, tool_id long, op string, name string, description string, effective_at timestamp_ntz, received_at timestamp_ntz, package string, hash_diff string, valid_to string"
T = dt.datetime(2025, 1, 1)


def rows_of(*updates):
    return [(i, t, op, n, d, T + dt.timedelta(hours=e) if e is not None else None, T + dt.timedelta(hours=r) if r is not None else None, "p", "clash", "clash") for i, (t, op, n, d, e, r) in enumerate(updates)]


def same(x):
    return None if x is None else unicodedata.normalize("NFC", x).replace("\r\n", "\n").replace("\r", "\n").strip()


def plain(rows):
    best = {}
    for u, t, op, n, d, e, r, *_ in rows:
        if t is None or e is None or op is None or op.strip().lower() not in ("upsert", "retire"):
            continue
        rank = (r is not None, r or T, u)
        if (t, e) not in best or rank > best[t, e][0]:
            best[t, e] = (rank, op.strip().lower(), n, d)
    out, state = set(), {}
    for (t, e), (_, op, n, d) in sorted(best.items()):
        name, text, since = state.get(t, (None, None, None))
        if op == "retire":
            if since:
                out.add((t, str(since)[:19], str(e)[:19]))
            state[t] = (name, text, None)
            continue
        new = (same(n) if n is not None else name, same(d) if d is not None else text)
        if since and new == (name, text):
            continue
        if since:
            out.add((t, str(since)[:19], str(e)[:19]))
        state[t] = (*new, e)
    return out | {(t, str(s)[:19], "open") for t, (_, _, s) in state.items() if s}


def found(spark, rows, **more):
    return sorted(tuple(r) for r in history.version_periods(spark.createDataFrame(rows, SCHEMA), **more).collect())


def test_small_cases(spark):
    rows = rows_of(
        (1, "upsert", "a", "x", 0, 1), (1, "upsert", "a ", "x\r\n", 1, 2), (1, "upsert", None, "y", 2, 3), (1, "retire", None, None, 3, 4), (1, "retire", None, None, 4, 5), (1, "upsert", None, None, 5, 6),
        (2, "retire", None, None, 0, 1), (2, "upsert", None, None, 1, 2), (2, "upsert", "b", None, 1, 1), (3, "upsert", "c", "z", 0, 1), (3, "upsert", "c", "w", 0, 9), (3, "upsert", "c", "w", 2, 9),
        (None, "upsert", "n", "n", 0, 0), (4, "upsert", "n", "n", None, 0), (5, None, "n", "n", 0, 0), (6, "upsert", "é", "", 0, None), (6, "upsert", unicodedata.normalize("NFD", "é"), "", 1, None),
    )
    rows += rows[:4]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert (1, "2025-01-01 00:00:00", "2025-01-01 02:00:00") in got and (6, "2025-01-01 00:00:00", "open") in got


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("chunk", [2_000_000, 7])
def test_random_timelines_and_cut_keys(spark, chunk):
    rng = random.Random(chunk)
    updates = []
    for _ in range(400):
        t = 1 if rng.random() < 0.4 else rng.randint(2, 40)
        updates.append((t, rng.choice(["upsert"] * 5 + ["retire"]), rng.choice([None, "a", "b"]), rng.choice([None, "x", "y", "x "]), rng.randint(0, 300), rng.randint(0, 300)))
    rows = rows_of(*updates)
    got = found(spark, rows, rows_per_chunk=chunk)
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_satellites_take_rows_only_for_changes(spark):
    rows = rows_of((1, "upsert", "a", "x", 0, 0), (1, "upsert", "a", "y", 1, 1), (1, "upsert", "a", "y", 2, 2), (1, "upsert", "a", "z", 3, 3), (1, "upsert", "b", "w", 4, 4))
    made = history.satellites(spark.createDataFrame(rows, SCHEMA))
    assert made.groups == {"sat_description_name": ("description", "name")} and history.split_by_rate({"a": 9, "b": 4, "c": 1, "d": 5}) == {"sat_a_d": ("a", "d"), "sat_b": ("b",), "sat_c": ("c",)}
    assert {r["satellite"]: r["count"] for r in made.rows().groupBy("satellite").count().collect()} == {"sat_description_name": 4, "sat_status": 1}
    view = made.view()[0].filter("satellite != 'sat_status'").orderBy("effective_at").collect()
    assert [r["valid_to"] for r in view] == [r["effective_at"] for r in view[1:]] + [None]


def periods(made, loads):
    found = history.versions(*made.view(loads), made.groups)
    return {(r["tool_id"], str(r["valid_from"])[:19], str(r["valid_to"])[:19] if r["valid_to"] else "open") for r in found.collect()}


def test_versions_come_from_the_satellites(spark):
    rows = rows_of((1, "upsert", "a", "x", 0, 0), (1, "upsert", "b", "x", 5, 5), (1, "retire", None, None, 9, 9))
    made = history.satellites(spark.createDataFrame(rows, SCHEMA))
    assert periods(made, 1) == plain(rows)
    without = made.view()[0].filter("satellite != 'sat_status'")
    assert history.versions(without, made.view()[1], made.groups).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_later_loads_append_only(spark, seed):
    """Late rows and corrections between loads: the views equal a reading of all rows, and no stored row is lost."""
    rng = random.Random(seed)
    made_up = [(rng.randint(1, 6), rng.choice(["upsert"] * 4 + ["retire"]), rng.choice([None, "a", "b"]), rng.choice([None, "x", "y"]), rng.randint(0, 12), i) for i in range(90)]
    rows = rows_of(*made_up)
    made = history.satellites(spark.createDataFrame(rows[:40], SCHEMA))
    before = sorted(map(str, made.rows().collect()))
    late = spark.createDataFrame(rows, SCHEMA)
    keys = spark.createDataFrame(rows[40:], SCHEMA).select("tool_id").distinct()
    made.load(history.attribute_changes(late.join(keys, "tool_id", "left_semi")), 1)
    after = sorted(map(str, made.rows().collect()))
    assert set(before) <= set(after) and periods(made, 2) == plain(rows)
    made.load(history.attribute_changes(late), 2)
    assert len(made.rows().collect()) == len(after)

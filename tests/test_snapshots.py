"""Snapshot comparison by bitmaps against sets and maps."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from lodestrand.operators import snapshots

SCHEMA = "snap_no int, delivered_at timestamp_ntz, package string, name string, description string, input_schema string, error string, bits string, position string"
T = dt.datetime(2025, 1, 1)


def row(s, p, n, d="x", req=None, e=None, at=0):
    return (s, T + dt.timedelta(hours=at), p, n, d, None if req is None else json.dumps({"required": req}), e, "clash", "clash")


def plain(rows):
    best, bad = {}, set()
    for s, at, p, n, d, schema, e, *_ in rows:
        if p is None or s is None:
            continue
        if e and e.strip():
            bad.add((p, s))
        elif n is not None and ((p, s, n) not in best or at > best[p, s, n][0]):
            required = (json.loads(schema) if schema else {}).get("required") or []
            best[p, s, n] = (at, (None if d is None else d.strip(), frozenset([required] if isinstance(required, str) else required)))
    by = {}
    for (p, s, n), (_, v) in best.items():
        if (p, s) not in bad:
            by.setdefault(p, {}).setdefault(s, {})[n] = v
    out = set()
    for p, at in by.items():
        for a, b in zip(sorted(at), sorted(at)[1:]):
            out |= {(p, n, b, "added") for n in at[b].keys() - at[a].keys()} | {(p, n, b, "removed") for n in at[a].keys() - at[b].keys()}
            out |= {(p, n, b, "changed") for n in at[a].keys() & at[b].keys() if at[a][n] != at[b][n]}
    return out


def found(spark, rows, **more):
    return sorted(tuple(r) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SCHEMA), **more).select("package", "tool_name", "snap_no", "kind").collect())


def test_small_cases(spark):
    rows = [
        row(1, "p", "a", req=["u", "v"]), row(2, "p", "a", req=["v", "u", "u"]), row(2, "p", "b"), row(3, "p", None, e="down"), row(4, "p", "b", d=" x\r\n"), row(4, "p", "b", d="x"), row(6, "p", "b", d=None), row(7, "p", "b", d="", req=[]),
        row(1, "q", "a"), row(2, "q", "a", d="old", at=1), row(2, "q", "a", d="x", at=2), row(1, None, "a"), row(None, "p", "z"), row(1, "r", "", req="one"), row(2, "r", "", req=["one"]), row(3, "r", "", req=None),
    ]
    got = found(spark, rows + rows[:3])
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("bucket_rows", [200_000, 5])
def test_random_snapshots_and_spread_groups(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    rows = []
    for s in range(1, 7):
        for p, n in [("hot", 150), ("b", 3), ("c", 1)]:
            if p != "hot" and rng.random() < 0.2:
                rows.append(row(s, p, None, e="down"))
                continue
            rows += [row(s, p, f"t{i}", rng.choice("xxxy"), rng.choice([["a"], ["a"], ["b", "a"]])) for i in range(n) if rng.random() < 0.8]
    got = found(spark, rows, bucket_rows=bucket_rows)
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_ordinals_persist(spark, tmp_path):
    folder = str(tmp_path / "ordinals")
    keys = spark.createDataFrame([("p", f"k{i}", 1) for i in range(100)], "package string, name string, first int")
    read = lambda df: {(r["package"], r["name"]): (r["bucket"], r["position"]) for r in df.collect()}
    was = read(snapshots.dictionary_of(keys, "package", "name", "first", folder, 30))
    more = keys.filter("name != 'k3'").unionByName(spark.createDataFrame([("p", f"n{i}", 2) for i in range(140)] + [("q", "a", 2)], keys.schema))
    now = read(snapshots.dictionary_of(more, "package", "name", "first", folder, 30))
    assert len(now) == 241 and all(now[k] == v for k, v in was.items()) and len({(k[0], *v) for k, v in now.items()}) == 241
    assert max(b for b, _ in now.values()) > max(b for b, _ in was.values())


def test_later_run_with_the_kept_dictionary(spark, tmp_path):
    rows = [row(s, "p", f"t{i}", d="y" if i == s else "x") for s in range(1, 5) for i in range(9) if (i + s) % 4]
    first = found(spark, [r for r in rows if r[0] < 3], dictionary=str(tmp_path / "d"))
    assert set(first) == plain([r for r in rows if r[0] < 3])
    assert set(found(spark, rows, dictionary=str(tmp_path / "d"))) == plain(rows)

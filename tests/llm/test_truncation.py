"""Truncation: kinds of ending, the fitted limits, and planted cuts held out."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestrand.llm import truncation as t

FOOTERS = frozenset(map(t.shape_digest, ("Exported from the store", "Internal use only")))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("It ends here.", "whole"), ("Is it so?", "whole"), ("She said “no.”", "whole"), ("終わり。", "whole"), ("", "blank"), (" \n", "blank"), (None, "blank"), ("It stops in the mid", "unfinished"), ("One. Two.\nThree is", "unfinished"), ("It stops in th [...]", "marked"), ("It stops in th…", "marked"),
        ("It stops in\n[end of message]", "unfinished"), ("It ends.\n[end of message]", "whole"), ("It stops in\nExported from the store", "unfinished"), ("Done.\nInternal use only", "whole"), ("Done.\n\n## Limits", "apart"), ("Done.\n\n-- The desk, room 4", "whole"), ("Done.\n\nTotal due: USD 3", "apart"), ("Caller: I have the", "unfinished"),
        ("Done.\n\n- one thing\n- other thing\n- Clause 4.2", "apart"), ("- One is done.\n- Two is", "unfinished"), ("| a | b |\n| c | d |", "apart"), ("| a | b |\n| c | d", "open"), ("| a | b |\n| c |", "open"), ("See the <stro", "open"), ("Text &nbs", "open"), ("the [form](https:/", "open"), ("in **", "open"), ("call `get_", "open"),
        ("```json\n{}\n```", "whole"), ("```json\n{\n", "open"), ('{"a": [1, {"b": "}"}]}', "whole"), ('{"a": [1, {"b": "x', "open"), ('[{"a": 1}, {"a"', "open"), ('{"a": "x\\\\"}', "whole"), ('{"a": "x\\"}', "open"), ('{"a": 1}\n' * 30_000 + '{"a": 1}', "whole"), ("n/a", "apart"), ("Done.\nSee https://a.example/b/3", "apart"), ("Done.\nContact: d@a.example", "apart"), ("Done.\nThe caller said: “It is", "open"),
    ],
)
def test_endings(text, kind):
    assert t.ending(text, FOOTERS)[0] == kind


def cells(lengths, kinds, limit=0, declared=0.0):
    """One cell a length, kind and place, as the fit takes them."""
    bins = np.floor(np.log1p(lengths / 250) / np.log(1.04)).astype(int)
    said = np.zeros(len(lengths), bool) | (np.arange(len(lengths)) < declared * len(lengths))
    rows, counts = np.unique(np.stack([kinds, said, np.where(lengths == limit, limit, 0), bins, lengths]), axis=1, return_counts=True)
    return rows[0], rows[1].astype(bool), rows[2], rows[3], rows[4].astype(float), counts.astype(float)


def test_fit_recovers_distribution_and_limit():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(6.2, 0.7, 20_000))
    cut = (rng.random(20_000) < 0.3) & (x > 400)
    lengths = np.where(cut, 400, x).astype(int)
    # endings say little here: nearly all are of the one kind that may be either
    kinds = np.where(rng.random(20_000) < 0.9, t.KINDS.index("apart"), t.KINDS.index("whole"))
    args = cells(lengths, kinds, 400)
    mu, sigma, r = t.fit_source(*args)
    at = (args[2] == 400) & (args[0] == t.KINDS.index("apart"))
    assert abs(mu - 6.2) < 0.05 and abs(sigma - 0.7) < 0.05 and r[at].min() > 0.9 and r[(args[2] == 0) & (args[0] == t.KINDS.index("apart"))].max() < 0.5


def test_posterior_at_the_limit_carries_the_score():
    """The same ending is cut at a limit and whole elsewhere; a whole ending is cut at a limit if more was declared."""
    rng = np.random.default_rng(2)
    lengths = np.append(rng.integers(50, 900, 3000), np.full(600, 500))
    apart, whole = t.KINDS.index("apart"), t.KINDS.index("whole")
    kinds = np.append(np.where(rng.random(3000) < 0.1, apart, whole), np.where(np.arange(600) < 500, t.KINDS.index("unfinished"), np.where(np.arange(600) < 550, apart, whole)))
    bins = np.floor(np.log1p(lengths / 250) / np.log(1.04)).astype(int)
    said = np.append(np.zeros(3000, bool), np.arange(600) % 2 == 0)
    rows, counts = np.unique(np.stack([kinds, said, np.where(lengths == 500, 500, 0), bins, lengths]), axis=1, return_counts=True)
    _, _, r = t.fit_source(rows[0], rows[1].astype(bool), rows[2], rows[3], rows[4].astype(float), counts.astype(float))
    of = lambda k, d, a: r[(rows[0] == k) & (rows[1] == d) & (rows[2] == a)].max()
    assert of(apart, 0, 500) > 0.5 > of(apart, 0, 0) and of(whole, 1, 500) > 0.5 > of(whole, 0, 0)


def test_endings_are_fitted_by_source():
    """Where most complete records end without a full stop, such an ending says less."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(50, 900, 4000)
    unfinished, whole = t.KINDS.index("unfinished"), t.KINDS.index("whole")
    few = t.fit_source(*cells(lengths, np.where(rng.random(4000) < 0.05, unfinished, whole)))
    assert few[2].max() > 0.5
    assert t.fit_source(*[a[:0] if i < 5 else a[:0] for i, a in enumerate(cells(lengths[:1], np.array([whole])))])[2].size == 0


def test_limits_of_any_length(spark):
    rng = np.random.default_rng(4)
    rows = [("s", int(v)) for v in rng.integers(1000, 300_000, 3000)] + [("s", 100_000)] * 40 + [("s", 70_000)] * 30
    rows = [(*r, i) for i, r in enumerate(rows)] + [("s", 50_000, -1)] * 40
    found = {r["at"] for r in t.candidate_limits(spark.createDataFrame(rows, "source string, rest long, of long")).collect()}
    assert found == {100_000, 70_000}


def documents(rng, n):
    subjects, verbs, ends = "The adjuster|A neighbour|The desk|One caller".split("|"), "logged|returned|asked about|photographed".split("|"), "the report|the old wall|every receipt|a burst pipe".split("|")
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(ends)} on day {rng.randint(1, 99)}." for _ in range(max(2, int(rng.lognormvariate(2.2, 0.5)))))
        declared = len(text)
        if rng.random() < 0.1:
            at = 400 if len(text) > 400 and rng.random() < 0.5 else rng.randint(60, len(text) - 2)
            if not text[:at].rstrip().endswith("."):
                text, declared = text[:at], declared if rng.random() < 0.3 else at
                cut.add(i)
        extra = rng.random()
        text += "\n[end of message]" if extra < 0.1 else "\nInternal use only" if extra < 0.2 else "\n\n## Records" if extra < 0.23 and i not in cut else ""
        rows.append((i, text, rng.choice(["notes", "Notes ", "forms", None]), declared, "clash"))
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = documents(random.Random(9), 1500)
    rows += [(9001, None, "notes", 5, "x"), (9002, "", None, None, "x"), (9003, "Whole. " * 30_000, "huge", 1, "x"), (9004, "Cut " * 30_000, "huge", 10**7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, kind string")
    got = {r[0] for r in t.truncated(docs).collect()}
    want = cut | {9004}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want), (len(got), len(want), sorted(got ^ want)[:5])
    rates = {r["source"]: r for r in t.truncation_rates(docs).collect()}
    assert set(rates) == {"notes", "forms", "unknown", "huge"} and sum(r["n_docs"] for r in rates.values()) == len(rows) and sum(r["n_cut"] for r in rates.values()) == len(got)
    assert t.truncated(docs.limit(0)).count() == 0

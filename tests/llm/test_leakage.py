"""Leaked passages against an alignment of words."""

from __future__ import annotations

import random

import pytest

from lodestrand.llm import leakage
from lodestrand.llm.folding import fold, words

WORDS = "amber basin copper delta ember fjord garnet harbor island juniper kettle lantern marble nectar orchid pepper quartz ribbon saddle timber umber velvet walnut yarrow zephyr a of the in".split()


def narrative(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(1, 99)) if rng.random() < 0.4 else "") for _ in range(n)).capitalize() + "."


def longest(a, b):
    """Most words of ``a`` that ``b`` repeats in order with at most one of them replaced, left out or followed by another."""
    n, m, best = len(a), len(b), 0
    ends = [[0] * (m + 1) for _ in range(n + 1)]
    starts = [[0] * (m + 2) for _ in range(n + 2)]
    for i in range(n):
        for j in range(m):
            if a[i] == b[j]:
                ends[i + 1][j + 1] = ends[i][j] + 1
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            if a[i] == b[j]:
                starts[i][j] = starts[i + 1][j + 1] + 1
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e = ends[i][j]
            if e:
                best = max(best, e)
                for da, db in ((1, 1), (1, 0), (0, 1)):
                    if i + da <= n and j + db <= m and (s := starts[i + da][j + db]):
                        best = max(best, e + da + s)
    return best


def found(texts, items, min_words=12):
    return set(leakage.leaks(texts, leakage.build_index(items, set(), min_words)))


def test_dress_does_not_matter():
    rng = random.Random(1)
    text = "The caretaker's café log, was “torn” at page 12 near the old Dry-Out pump while Zoë slept on the bench nearby."
    w = text.split()
    forms = [
        text, text.upper(), text.replace(" ", "\n> "), " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w)), text.replace("é", "&#233;").replace("ë", "\\u00eb"), text.replace("e", "e­"), text.replace(" ", "  "),
        "".join(c for c in text if c.isalnum() or c == " "), text.replace("é", "e").replace("ë", "e"), '{"t": "' + text.replace("“", '\\"').replace("”", '\\"').replace(" ", "\\n") + '"}', "| " + text.replace("page", "**page**"),
    ]
    noise = narrative(rng, 30)
    assert found([f"{noise} {f} {noise}" for f in forms], [("x", text)]) == {(i, "x") for i in range(len(forms))}
    shuffled = w[:]
    rng.shuffle(shuffled)
    assert found([" ".join(w[:11]), " ".join(shuffled), "", None, "   ", " ".join(w[:6] + ["new", "word"] + w[6:])[: len(text)]], [("x", text)]) - {(5, "x")} == set()


@pytest.mark.parametrize("seed", range(6))
def test_against_word_alignment(seed):
    rng = random.Random(seed)
    items = [(f"i{k}", narrative(rng, rng.randint(14, 50))) for k in range(12)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(items)[1].split()
            n = rng.randint(6, 26)
            at = rng.randint(0, max(0, len(w) - n))
            w = w[at : at + n]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(w))
                how = rng.choice("rda")
                w[k : k + 1] = [] if how == "d" and len(w) > 1 else ["changed"] if how == "r" else [w[k], "added"]
            parts += [narrative(rng, rng.randint(0, 9) + 1), " ".join(w)]
        texts.append(" ".join(parts))
    want = {(n, i) for n, t in enumerate(texts) for i, x in items if longest(words(x), words(t)) >= 12}
    assert found(texts, items) == want


def test_very_long_text_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(f"i{k}", narrative(rng, 30)) for k in range(5)]
    monkeypatch.setattr(leakage, "PIECE", 120_000)
    long = " ".join(["filler words only"] * 6_500)
    text = long + " " + items[2][1] + " " + long + items[4][1]
    assert found([text, long], items) == {(0, "i2"), (0, "i4")}
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 2)
    docs = spark.createDataFrame([(1, items[0][1], "x"), (2, None, "x"), (3, items[1][1] + items[3][1], "x"), (1, items[0][1], "x")], "doc_id long, text string, id string")
    ev = spark.createDataFrame([*items, (None, items[0][1]), ("short", "too short"), ("null", None)], "id string, narrative string")
    assert leakage.with_stock(ev.filter("id is not null and narrative is not null")).filter("size(stock) > 0").count() == 0
    assert sorted(tuple(r) for r in leakage.find_leaks(docs, ev).collect()) == [(1, "i0"), (3, "i1"), (3, "i3")]
    assert leakage.find_leaks(docs.limit(0), ev).count() == 0 and leakage.find_leaks(docs, ev.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_short_and_repeated_words_and_long_insertions(seed, monkeypatch):
    """One-letter words, words that repeat, added words of hundreds of letters, index entries in small slices."""
    rng = random.Random(100 + seed)
    pool = [list("abcdefgh123"), ["a", "b", "aa", "ab"], ["of", "the", "of", "lamp", "lampshade"], WORDS][seed % 4]
    if seed > 3:
        monkeypatch.setattr(leakage, "MOST_HITS", 50)
        monkeypatch.setattr(leakage, "PIECE", 90)
    items = [(f"i{k}", " ".join(rng.choice(pool) for _ in range(rng.randint(12, 30)))) for k in range(6)]
    texts = []
    for _ in range(120):
        w = rng.choice(items)[1].split()
        n = rng.randint(9, 20)
        at = rng.randint(0, max(0, len(w) - n))
        w = w[at : at + n]
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            k = rng.randrange(len(w))
            how = rng.choice("rdal")
            w[k : k + 1] = [] if how == "d" and len(w) > 1 else ["zz"] if how == "r" else [w[k], "q" * 300 if how == "l" else "yy"]
        texts.append(" ".join([rng.choice(pool) for _ in range(rng.randint(0, 3))] + w + [rng.choice(pool) for _ in range(rng.randint(0, 3))]))
    want = {(n, i) for n, t in enumerate(texts) for i, x in items if longest(words(x), words(t)) >= 12}
    assert found(texts, items) == want


def test_every_word_and_edit_of_short_items():
    for w in ("1 2 3 4 5 6 7 8 9 4 2 7".split(), "a b c d e f g h i j k l m n".split()):
        for k in range(len(w)):
            for edit in (["x"], [w[k], "https" + "z" * 260]):
                text = w[:k] + edit + w[k + 1 :]
                assert bool(found([" ".join(text)], [("i", " ".join(w))])) == (longest(w, text) >= 12), text


def test_long_markup_does_not_matter():
    w = "the caretaker of the old harbor mill saw a torn ribbon near the quartz saddle".split()
    image = '<img alt="x" src="data:image/png;base64,' + "A" * 5000 + '">'
    link = "[note](https://example.test/" + "b" * 3000 + ")"
    assert found([" ".join([*w[:6], image, *w[6:]]), " ".join([*w[:6], link, *w[6:]])], [("i", " ".join(w))]) == {(0, "i"), (1, "i")}
    fold("<a \"" * 100_000), fold("](" * 100_000), fold("<a '\"" * 50_000)


def test_stock_sentences_alone_are_no_leak():
    stock = "kindly confirm by letter that you got this and keep it safe for all of the coming years"
    items = [(k, f"{stock}. {narrative(random.Random(k), 20)}") for k in ("a", "b")]
    ix = leakage.build_index(items, {" ".join(words(stock))}, 12)
    assert list(leakage.leaks([stock], ix)) == [] and {k for _, k in leakage.leaks([items[0][1]], ix)} == {"a"}


def test_fold():
    assert fold("Ｆull ﬁ É ø &amp;lt; a​b") == "full fi e o < ab"
    assert fold("\\ud83d\\ude00 x\\ud800") and words("it's — Dry-Out!") == ["its", "dryout"]

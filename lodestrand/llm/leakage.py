"""Problem 2: passages of evaluation items in documents, by q-gram lemma filtering.

All items' q-grams go to every task as an index and the documents stream past it once, without a
shuffle. A passage with one edited word is two exact sides, of which the longer has at least half of the
other words; as an edit may be of any length, that side's q-grams are what a passage keeps on one diagonal
(document position less item position): the q-gram lemma's bound. Shared q-grams are counted per item in
overlapping bands of diagonals; regions that reach the bound are kept and verified by an alignment of
words in the band of three word diagonals that one edit can reach. Items whose bound is 0 or less at q = 8,
since their words are very short, stand in a second index with the q at which it is at least 1.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestrand.llm.folding import fold, words
from lodestrand.session import arrow_type, spread

Q = 8
#: Bands are twice this wide and overlap by half: any two diagonals this near share a band.
BAND = 128
TABLE_BITS = 22
#: Characters of short documents looked up together, and of a long one at once (in overlapping slices).
PIECE = 2_000_000
#: Entries of the index that are spelled out at once; a slice with more is halved.
MOST_HITS = 4_000_000
#: Items in one block of the index. All blocks meet the documents in the same scan.
ITEMS_PER_BLOCK = 5_000


@dataclass
class Item:
    id: str
    stream: str
    starts: list[int]
    ends: list[int]
    stock: list[bool]
    least: int
    #: Words before which (after which) an edit may lie inside an exact run, since words there repeat.
    repeats: list[int]
    repeats_back: list[int]


@dataclass
class Index:
    """Items with one length of q-grams: by q-gram, the items and places that have it."""

    q: int
    items: list[Item]
    grams: np.ndarray
    first: np.ndarray
    item_of: np.ndarray
    at: np.ndarray
    table: np.ndarray
    least: np.ndarray
    longest: int
    min_words: int


def _packed(stream: np.ndarray, q: int) -> np.ndarray:
    """The q <= 8 bytes from each place as one number."""
    n = max(0, len(stream) - q + 1)
    h = np.zeros(n, np.uint64)
    wide = stream.astype(np.uint64)
    for i in range(q if n else 0):
        h |= wide[i : i + n] << np.uint64(8 * i)
    return h


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _bytes(codes: np.ndarray) -> np.ndarray:
    """One byte a character, never 0; characters may share one, which verification undoes."""
    return np.where(codes < 128, codes, 128 | (codes & 127)).astype(np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sentences(narrative: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.;!?])\s+", narrative) if s.strip()]


def build_item(id_: str, narrative: str, shared: set[str], min_words: int) -> Item | None:
    """The words of an item, those of sentences in ``shared`` marked as stock; null if there are fewer than ``min_words``."""
    tokens: list[str] = []
    stock: list[bool] = []
    for s in sentences(narrative):
        own = words(s)
        tokens += own
        stock += [" ".join(own) in shared] * len(own)
    if len(tokens) < min_words:
        return None
    ends = np.cumsum([len(w) for w in tokens]).tolist()
    starts = [0, *ends[:-1]]
    side = max(1, min_words // 2)
    least = min(ends[i + side - 1] - starts[i] for i in range(len(tokens) - side + 1))
    alike = lambda a, b: a.startswith(b) or b.startswith(a)
    alike_back = lambda a, b: a.endswith(b) or b.endswith(a)
    pairs = list(zip(tokens, tokens[1:]))
    return Item(id_, "".join(tokens), starts, ends, stock, least, [i for i, p in enumerate(pairs) if alike(*p)], [i + 2 for i, p in enumerate(pairs) if alike_back(*p)])


def build_index(rows: list[tuple[str, str]], shared: set[str], min_words: int) -> list[Index]:
    """An index of the items for each q that is in use. ``shared``: word sequences of the sentences that several narratives have."""
    made = [item for id_, narrative in rows if (item := build_item(id_, narrative, shared, min_words)) is not None]
    low = max(1, min(Q, min_words // 2))
    of_q = {Q: [i for i in made if i.least >= Q], low: [i for i in made if i.least < Q]}
    return [_index(q, items, min_words) for q, items in of_q.items() if items]


def _index(q: int, items: list[Item], min_words: int) -> Index:
    grams = [_packed(_bytes(_codes(i.stream)), q) for i in items]
    owner = np.concatenate([np.full(len(g), k) for k, g in enumerate(grams)])
    at = np.concatenate([np.arange(len(g)) for g in grams])
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    unique, first = np.unique(every[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slot(unique)] = True
    least = np.array([i.least - q + 1 for i in items])
    return Index(q, items, unique, np.append(first, len(every)), owner[order], at[order], table, least, max(len(i.stream) for i in items), min_words)


# --- documents -----------------------------------------------------------------------------------

_KNOWN = 0x3100
_ALNUM = np.array([chr(c).isalnum() for c in range(_KNOWN)])
_SPACE = np.array([chr(c).isspace() for c in range(_KNOWN)])


def _alnum(codes: np.ndarray) -> np.ndarray:
    low = codes < _KNOWN
    return np.where(low, _ALNUM[np.where(low, codes, 0)], (codes < 0xFF00) | (codes > 0xFF0F))


class Stream:
    """The letters and digits of folded texts, with where words (between white space) and runs (between any other character) begin."""

    def __init__(self, texts: list[str]):
        codes = _codes("\n".join(texts))
        kept = np.flatnonzero(_alnum(codes))
        #: Place in the stream at which each text begins; the next one's is its end.
        self.bounds = np.searchsorted(kept, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.bytes = _bytes(codes[kept])
        self._codes, self._kept = codes, kept
        self._letters: str | None = None

    def spell(self) -> None:
        """What verification needs, made when the first region is kept."""
        if self._letters is None:
            codes, kept = self._codes, self._kept
            self._letters = codes[kept].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            spaces = np.cumsum((codes < _KNOWN) & _SPACE[np.minimum(codes, _KNOWN - 1)])
            new_word = np.append(True, spaces[kept[1:]] != spaces[kept[:-1]])
            self.word_starts = np.flatnonzero(new_word)
            self.run = np.append(np.append(True, kept[1:] != kept[:-1] + 1), True)

    @property
    def letters(self) -> str:
        self.spell()
        return self._letters


def leaks(texts: list[str | None], indexes: list[Index]) -> Iterator[tuple[int, str]]:
    """(place in ``texts``, item id), each once. Short texts are looked up together, a long one alone."""
    group: list[tuple[int, str]] = []
    size = 0
    seen: set[tuple[int, str]] = set()
    for n, text in enumerate(texts):
        if not text or text.isspace():
            continue
        group.append((n, fold(text)))
        size += len(group[-1][1])
        if size >= PIECE:
            seen.update(_matched(group, indexes))
            group, size = [], 0
    seen.update(_matched(group, indexes))
    yield from sorted(seen)


def _matched(group: list[tuple[int, str]], indexes: list[Index]) -> Iterator[tuple[int, str]]:
    if not group:
        return
    view = Stream([t for _, t in group])
    packed: dict[int, np.ndarray] = {}
    for index in indexes:
        if index.q not in packed:
            packed[index.q] = _packed(view.bytes, index.q)
        done: set[tuple[int, int]] = set()
        for low in range(0, len(packed[index.q]), PIECE):
            _slice(view, packed[index.q], low, low + PIECE, index, done)
        for d, i in done:
            yield group[d][0], index.items[i].id


def _slice(view: Stream, packed: np.ndarray, low: int, high: int, index: Index, done: set[tuple[int, int]]) -> None:
    """Adds the (text, item) of this part of the stream to ``done``; parts reach over into the next by the longest item, so no exact run is lost."""
    part = packed[low : high + index.longest]
    near = np.flatnonzero(index.table[_slot(part)])
    place = np.searchsorted(index.grams, part[near])
    place[place == len(index.grams)] = 0
    same = index.grams[place] == part[near]
    near, place = near[same] + low, place[same]
    if not len(near):
        return
    counts = index.first[place + 1] - index.first[place]
    total = int(counts.sum())
    if total > MOST_HITS and high - low > 2 * index.longest:
        middle = (low + high) // 2
        _slice(view, packed, low, middle, index, done)
        _slice(view, packed, middle, high, index, done)
        return
    hit = np.repeat(near, counts)
    post = np.repeat(index.first[place], counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    item, ipos = index.item_of[post], index.at[post]
    doc = np.searchsorted(view.bounds, hit, "right") - 1
    diagonal = hit - ipos
    pair = doc.astype(np.int64) * len(index.items) + item
    # each diagonal lies in two overlapping bands
    band = np.concatenate([diagonal // BAND, diagonal // BAND - 1])
    twice = np.tile(pair, 2)
    order = np.lexsort((band, twice))
    p, b = twice[order], band[order]
    edge = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (b[1:] != b[:-1])))
    n = np.diff(np.append(edge, len(p)))
    good = np.unique(p[edge[n >= index.least[p[edge] % len(index.items)]]])
    if not len(good):
        return
    # of the kept regions' hits: exact runs on one diagonal, long enough to be the longer side of an edit
    kept = np.flatnonzero(np.isin(pair, good))
    order = kept[np.lexsort((ipos[kept], diagonal[kept], pair[kept]))]
    p, g, x = pair[order], diagonal[order], ipos[order]
    begin = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (g[1:] != g[:-1]) | (x[1:] != x[:-1] + 1)))
    length = np.diff(np.append(begin, len(order)))
    enough = length >= index.least[item[order[begin]]]
    for at, size in zip(begin[enough].tolist(), length[enough].tolist()):
        d, i = divmod(int(p[at]), len(index.items))
        if (d, i) in done:
            continue
        view.spell()
        if Alignment(view, index.items[i], int(view.bounds[d]), int(view.bounds[d + 1]), index.min_words).verified(int(g[at]), int(x[at]), int(x[at]) + size + index.q - 1):
            done.add((d, i))


class Alignment:
    """Words of one item against one text of the stream."""

    def __init__(self, view: Stream, item: Item, first: int, last: int, min_words: int):
        self.letters, self.run, self.word_starts = view.letters, view.run, view.word_starts
        self.item, self.first, self.last, self.min_words = item, first, last, min_words

    def between(self, p: int) -> bool:
        """Whether a word may begin or end before place p."""
        return p == self.last or (self.first <= p < self.last and bool(self.run[p]))

    def forward(self, w: int, p: int) -> int:
        """Words of the item from w on that stand at place p."""
        item, n = self.item, 0
        if not self.between(p):
            return 0
        while w + n < len(item.starts):
            end = p + item.ends[w + n] - item.starts[w + n]
            if end > self.last or not self.letters.startswith(item.stream[item.starts[w + n] : item.ends[w + n]], p) or not self.between(end):
                break
            n, p = n + 1, end
        return n

    def backward(self, w: int, p: int) -> int:
        """Words of the item before w that end at place p."""
        item, n = self.item, 0
        if not self.between(p):
            return 0
        while w - n > 0:
            start = p - item.ends[w - n - 1] + item.starts[w - n - 1]
            if start < self.first or not self.letters.startswith(item.stream[item.starts[w - n - 1] : item.ends[w - n - 1]], start) or not self.between(start):
                break
            n, p = n + 1, start
        return n

    def next_word(self, p: int) -> int | None:
        """End of the text's word that begins at or spans p."""
        if p >= self.last:
            return None
        k = int(np.searchsorted(self.word_starts, p, "right"))
        return min(self.last, int(self.word_starts[k]) if k < len(self.word_starts) else self.last)

    def word_before(self, p: int) -> int | None:
        """Start of the text's word that ends at or spans p."""
        return None if p <= self.first else max(self.first, int(self.word_starts[int(np.searchsorted(self.word_starts, p, "left")) - 1]))

    def verified(self, d: int, low: int, high: int) -> bool:
        """Whether letters low..high of the item, exact on diagonal d, lie in a passage of ``min_words`` words with at most one edited."""
        item = self.item
        w, z = bisect_left(item.starts, low), bisect_right(item.ends, high)
        while w < z:
            n = self.forward(w, item.starts[w] + d)
            if n and 2 * n >= self.min_words - 1:
                i = w - self.backward(w, item.starts[w] + d)
                size, a, b = self.longest(i, w + n, d)
                if size >= self.min_words and not all(item.stock[a:b]):
                    return True
            w += max(1, n)
        return False

    def longest(self, i: int, j: int, d: int) -> tuple[int, int, int]:
        """The longest passage over the exact run of words i..j that takes at most one edit, on either side: (words, from, to).

        One edit leads to the same diagonal of words or one of its neighbours. Where words repeat, it may lie
        inside the run; every such place is tried.
        """
        item = self.item
        found = [(j - i, i, j)]
        for b in (j, *[x for x in reversed(item.repeats[bisect_right(item.repeats, i) : bisect_left(item.repeats, j)])]):
            end = item.ends[b - 1] + d
            over = self.next_word(end)
            for w, p in [(b + 1, end)] + ([(b + 1, over), (b, over)] if over is not None else []):
                if w <= len(item.starts) and (n := self.forward(w, p)):
                    found.append((w + n - i, i, w + n))
        for a in (i, *item.repeats_back[bisect_right(item.repeats_back, i) : bisect_left(item.repeats_back, j)]):
            start = item.starts[a] + d
            over = self.word_before(start)
            for w, p in [(a - 1, start)] + ([(a - 1, over), (a, over)] if over is not None else []):
                if w >= 0 and (n := self.backward(w, p)):
                    found.append((j - (w - n), w - n, j))
        # of those long enough one that isn't all stock counts, so prefer it
        fit = [f for f in found if f[0] >= self.min_words and not all(item.stock[f[1] : f[2]])]
        return max(fit or found)


# --- Spark -----------------------------------------------------------------------------------------


def _sentence_words(narrative: str | None) -> list[str]:
    return sorted({" ".join(w) for s in sentences(narrative or "") if (w := words(s))})


def stock_of(rows: list) -> set[str]:
    """Word sequences of the sentences that at least two of these (id, narrative) share."""
    owners: dict[str, set[str]] = {}
    for id_, narrative in rows:
        for s in _sentence_words(narrative):
            owners.setdefault(s, set()).add(id_)
    return {s for s, ids in owners.items() if len(ids) > 1}


def with_stock(items: DataFrame) -> DataFrame:
    """(id, narrative, stock): items with those of their sentences' word sequences that other items have too; for more items than one block holds."""
    split = F.arrow_udf(lambda a: pa.array([_sentence_words(x) for x in a.to_pylist()], pa.list_(pa.string())), ArrayType(StringType()))
    each = items.select("id", F.explode(split("narrative")).alias("s")).distinct()
    shared = each.groupBy("s").agg(F.count_distinct("id").alias("n")).filter("n > 1").select("s")
    own = each.join(shared, "s").groupBy("id").agg(F.collect_set("s").alias("stock"))
    return items.join(own, "id", "left").select("id", "narrative", F.coalesce("stock", F.array().cast("array<string>")).alias("stock"))


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "id", narrative: str = "narrative", min_words: int = 12) -> DataFrame:
    """(doc_id, eval_id): documents that repeat a passage of an item; see TESTDATA problem 2.

    Copies count each. Null or blank texts, items without id or with fewer than ``min_words``
    words, and empty tables give no row. Items are indexed in blocks of ITEMS_PER_BLOCK, the most
    that is gathered and sent at once; one scan of the documents meets all blocks.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_id).cast("string").alias("id"), F.col(narrative).alias("narrative")).filter("id is not null and narrative is not null").distinct()
    few = [(r[0], r[1]) for r in wanted.limit(ITEMS_PER_BLOCK + 1).collect()]
    blocks = []
    if len(few) <= ITEMS_PER_BLOCK:
        blocks.append(spark.sparkContext.broadcast(build_index(sorted(few), stock_of(few), min_words)))
    else:
        n_blocks = -(-wanted.count() // ITEMS_PER_BLOCK) + 1
        told = with_stock(wanted)
        for block in range(n_blocks):
            rows = told.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).collect()
            blocks.append(spark.sparkContext.broadcast(build_index(sorted((r[0], r[1]) for r in rows), {s for r in rows for s in r[2]}, min_words)))
    out_type = StructType([StructField("doc_id", documents.schema[doc_id].dataType), StructField("eval_id", StringType())])
    id_type = arrow_type(documents, doc_id)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for block in blocks:
                pairs = list(leaks(texts, block.value))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([p[0] for p in pairs], pa.int64())).cast(id_type), pa.array([p[1] for p in pairs], pa.string())], ["doc_id", "eval_id"])

    return spread(documents.select(doc_id, text)).mapInArrow(scan, out_type).distinct()

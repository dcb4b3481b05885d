"""Which held-out records a corpus contains: by bytes, by structure and by likeness of their text, scored apart.

Levels 0 and 1 are equi-joins on addresses. Level 2 is the cosine of TF-IDF vectors over
character n-grams within words (n = 3 to 5, padded by a blank, weights raw count times
ln((1 + N) / (1 + df)) + 1 over both sides): document frequencies are counted over everything, the
items' vectors go to the documents as one sparse matrix, an upper bound of the cosine from the items'
own n-grams picks candidates, and only candidates' exact norms are computed.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lodestrand.functions.canon import EVAL, Refused, column_address, json_canonical, json_value
from lodestrand.session import arrow_type, spread, stored

#: Relations that count as a leak, and thresholds of the sweep (fixed values: published results are told by them).
LEAK_RELATIONS = ("exact", "serialization", "structural", "paraphrase")
TAUS = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
GRAMS = (3, 4, 5)
#: Items whose vectors are gathered and sent to the tasks together; all blocks meet the corpus in the same scan.
ITEMS_PER_BLOCK = 2_000


def flat_text(value: object) -> str:
    """Keys in order, each followed by its value, joined by blanks; scalars as Python writes them."""
    if isinstance(value, str):
        return value
    parts: list[str] = []
    stack: list[tuple[bool, object]] = [(False, value)]
    while stack:
        is_key, v = stack.pop()
        if is_key or not isinstance(v, (dict, list)):
            parts.append(str(v))
        elif isinstance(v, dict):
            for k in sorted(v, reverse=True):
                stack += [(False, v[k]), (True, k)]
        else:
            stack.extend((False, x) for x in reversed(v))
    return " ".join(parts)


def flat_text_column(col: Column | str) -> Column:
    """``flat_text`` of JSON text; null and unreadable JSON are null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else flat_text(json_value(text))
        except Refused:
            return None

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(col)


def addressed(records: DataFrame, payload: str = "payload", raw: str = "raw") -> DataFrame:
    """``records`` with byte_addr (of ``raw``), eval_addr (of ``payload``; null if refused) and flat text."""
    c = json_canonical(payload, EVAL)
    return records.withColumns({"byte_addr": column_address(F.col(raw), "bytes"), "__c": c, "flat": flat_text_column(payload)}).withColumn("eval_addr", F.col("__c.addr")).drop("__c")


def equal_records(items: DataFrame, corpus: DataFrame, by: str, method: str) -> DataFrame:
    """(method, item_id, record_id, score 1.0) of records with an item's address; null addresses match nothing."""
    pairs = items.select("item_id", by).join(corpus.select("record_id", by), by)
    return pairs.select(F.lit(method).alias("method"), "item_id", "record_id", F.lit(1.0).alias("score"))


# --- level 2 -----------------------------------------------------------------------------------

def grams_of(word: str) -> list[str]:
    w = f" {word} "
    out: list[str] = []
    for n in GRAMS:
        if len(w) <= n:
            out.append(w)
            break
        out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


class GramNumbers:
    """Numbers for n-grams, and each word's n-grams as an array of them: texts repeat words, so most cost one look-up."""

    def __init__(self, known: dict[str, int] | None = None):
        self.fixed = known is not None
        self.number: dict[str, int] = known or {}
        self.words: dict[str, np.ndarray] = {}

    def of(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 500_000:
                self.words.clear()
            if self.fixed:
                found = np.array([n for g in grams_of(word) if (n := self.number.get(g)) is not None], np.int64)
            else:
                found = np.array([self.number.setdefault(g, len(self.number)) for g in grams_of(word)], np.int64)
            self.words[word] = found
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, how often) of the text's n-grams."""
        c = Counter(text.lower().split())
        parts = [self.of(w) for w in c]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, place = np.unique(np.concatenate(parts), return_inverse=True)
        return ids, np.bincount(place, np.repeat(list(c.values()), [len(p) for p in parts]), len(ids)).astype(np.int64)


def _gram_rows(texts: DataFrame, id_: str) -> DataFrame:
    """(id, gram, tf)."""
    id_type = arrow_type(texts, id_)
    out = StructType([StructField(id_, texts.schema[id_].dataType), StructField("gram", StringType()), StructField("tf", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = GramNumbers()
            ids, numbers, tf, size = [], [], [], 0

            def full() -> pa.RecordBatch:
                names = pa.array(list(index.number), pa.string())
                columns = [batch.column(0).take(pa.array(np.concatenate(ids))).cast(id_type), names.take(pa.array(np.concatenate(numbers))), pa.array(np.concatenate(tf))]
                ids.clear(), numbers.clear(), tf.clear()
                return pa.RecordBatch.from_arrays(columns, out.names)

            for k, text in enumerate(batch.column(1).to_pylist()):
                n, c = index.counts(text or "")
                ids.append(np.full(len(n), k, np.int64))
                numbers.append(n)
                tf.append(c)
                size += len(n)
                if size > 200_000:
                    yield full()
                    size = 0
            if size:
                yield full()

    return texts.mapInArrow(scan, out)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(gram, df) over a column of texts: counted per batch first, so hot n-grams reach the shuffle folded."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = GramNumbers()
            seen = [index.counts(text or "")[0] for text in batch.column(0).to_pylist()]
            df = np.bincount(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(index.number), pa.string()), pa.array(df.astype(np.int64))], ["gram", "n"])

    return texts.mapInArrow(scan, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("df"))


def lexical_matches(items: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """(method, item_id, record_id, score) of pairs with cosine >= ``least`` > 0, unrounded.

    ``items``: item_id, flat; ``corpus``: record_id, flat. Null and blank texts match nothing. A record id with
    several texts is judged by each of them.
    """
    if least <= 0:
        raise ValueError("all pairs have a cosine of 0 or more; state a threshold above 0")
    spark = corpus.sparkSession
    n_all = items.count()
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "flat").filter("item_id is not null and flat is not null")
    corpus = spread(corpus.select("record_id", F.md5("flat").alias("digest"), "flat"))
    n_items = items.count()
    n = n_all + corpus.count()
    df = stored(document_frequencies(items.select("flat").unionByName(corpus.select("flat"))), "df")
    idf = df.select("gram", (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    n_blocks = -(-n_items // ITEMS_PER_BLOCK)
    blocks = [_vectors(spark, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block), idf) for block in range(n_blocks)]
    near = stored(_near(corpus, blocks, least), "near")
    candidates = corpus.join(near.select("record_id", "digest").distinct(), ["record_id", "digest"], "left_semi").dropDuplicates(["record_id", "digest"])
    keyed = candidates.select(F.struct("record_id", "digest").alias("k"), F.xxhash64("record_id", "digest").alias("h"), "flat")
    norms = _gram_rows(keyed.select("h", "flat"), "h").join(idf, "gram").groupBy("h").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    sized = keyed.join(norms, "h").select("k.record_id", "k.digest", "norm")
    scored = near.join(sized, ["record_id", "digest"]).select(F.lit("lexical").alias("method"), "item_id", "record_id", (F.col("dot") / F.col("norm")).alias("score"))
    return scored.filter(F.col("score") >= least).groupBy("method", "item_id", "record_id").agg(F.max("score").alias("score"))


def _vectors(spark, items: DataFrame, idf: DataFrame):
    """One block's items as a broadcast sparse matrix: by n-gram the items that have it and their weights. The n-grams come to the driver as Arrow columns."""
    rows = [(r["item_id"], r["flat"]) for r in items.collect()]
    grams = _gram_rows(items, "item_id").select("gram").distinct()
    known = idf.join(grams, "gram").toArrow()
    index = {g: i for i, g in enumerate(known.column("gram").to_pylist())}
    weight = known.column("idf").to_numpy()
    numbers = GramNumbers(index)
    gram, owner, value, ids = [], [], [], []
    for id_, flat in sorted(rows):
        ix, tf = numbers.counts(flat)
        if len(ix):
            v = tf * weight[ix]
            gram.append(ix)
            owner.append(np.full(len(ix), len(ids)))
            value.append(v / np.sqrt((v**2).sum()))
            ids.append(id_)
    gram, owner, value = (np.concatenate(x) if x else np.zeros(0) for x in (gram, owner, value))
    order = np.argsort(gram, kind="stable")
    first = np.searchsorted(gram[order], np.arange(len(index) + 1))
    return spark.sparkContext.broadcast((ids, index, first, owner[order].astype(np.int64), value[order], weight))


def _near(corpus: DataFrame, blocks: list, least: float) -> DataFrame:
    """(item_id, record_id, digest, dot) of pairs whose cosine can reach ``least``, by one scan of the corpus."""
    id_type = arrow_type(corpus, "record_id")
    out = StructType([StructField("item_id", StringType()), corpus.schema["record_id"], StructField("digest", StringType()), StructField("dot", DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[int, GramNumbers] = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for b, block in enumerate(blocks):
                names, index, starts, owner, value, w = block.value
                known = numbers.setdefault(b, GramNumbers(index))
                found: list[tuple[int, int, float]] = []
                for k, text in enumerate(texts):
                    ix, tf = known.counts(text or "")
                    if not len(ix) or not names:
                        continue
                    v = tf * w[ix]
                    n = starts[ix + 1] - starts[ix]
                    at = np.repeat(starts[ix] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    dots = np.bincount(owner[at], value[at] * np.repeat(v, n), len(names))
                    # the whole norm is at least that over the items' n-grams
                    for j in np.flatnonzero(dots >= (least - 1e-9) * np.sqrt((v**2).sum())):
                        found.append((int(j), k, float(dots[j])))
                at = pa.array([f[1] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[f[0]] for f in found], pa.string()), batch.column(0).take(at).cast(id_type), batch.column(1).take(at).cast(pa.string()), pa.array([f[2] for f in found], pa.float64())], out.names
                )

    return corpus.select("record_id", "digest", "flat").mapInArrow(scan, out)


# --- scores --------------------------------------------------------------------------------------


def method_scores(detections: DataFrame, corpus: DataFrame, methods: list[str]) -> DataFrame:
    """(method, found, missed, false_positives, unlabelled, recall, precision) against ``corpus``: record_id, relation, leak_of.

    A hit on the item a record leaks is found, on another labelled record false, on an unlabelled one counted apart.
    Rates are 0 where nothing can be counted.
    """
    spark = detections.sparkSession
    truth = corpus.select("record_id", "relation", "leak_of")
    told = detections.join(truth, "record_id", "left")
    leak = F.col("relation").isin(*LEAK_RELATIONS) & (F.col("leak_of") == F.col("item_id"))
    kind = F.when(F.col("relation").isNull(), "unlabelled").when(F.coalesce(leak, F.lit(False)), "found").otherwise("false")
    per = told.withColumn("kind", kind).groupBy("method").agg(
        F.count_distinct(F.when(F.col("kind") == "found", F.struct("item_id", "record_id"))).alias("found"), F.count_if(F.col("kind") == "false").alias("false_positives"), F.count_if(F.col("kind") == "unlabelled").alias("unlabelled")
    )
    expected = truth.filter(F.col("relation").isin(*LEAK_RELATIONS) & F.col("leak_of").isNotNull()).count()
    every = spark.createDataFrame([(m,) for m in methods], "method string").join(per, "method", "left").na.fill(0)
    every = every.withColumn("missed", F.lit(expected) - F.col("found"))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    return every.select("method", "found", "missed", "false_positives", "unlabelled", rate("found", "missed").alias("recall"), rate("found", "false_positives").alias("precision"))


def tau_sweep(scores: DataFrame, corpus: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """(tau, found, false_positives) at each threshold, from scores computed once."""
    truth = corpus.select("record_id", "relation", "leak_of")
    leak = F.coalesce(F.col("relation").isin(*LEAK_RELATIONS) & (F.col("leak_of") == F.col("item_id")), F.lit(False))
    told = scores.join(truth, "record_id").select("score", leak.alias("leak"))
    at = told.select(F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"), "score", "leak")
    hit = F.col("score") >= F.col("tau")
    return at.groupBy("tau").agg(F.count_if(hit & F.col("leak")).alias("found"), F.count_if(hit & ~F.col("leak")).alias("false_positives"))


METHODS = ("byte", "structural", "lexical")


def detections(items: DataFrame, corpus: DataFrame, tau: float, backend=lexical_matches) -> DataFrame:
    """(method, item_id, record_id, score) of all three levels. ``backend`` gives the third: any function (items, corpus, tau) -> (method, item_id, record_id, score)."""
    levels = [equal_records(items, corpus, "byte_addr", "byte"), equal_records(items, corpus, "eval_addr", "structural"), backend(items, corpus, tau)]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return stored(out, "detections")


def scan_report(items: DataFrame, corpus: DataFrame, tau: float = 0.8, backend=lexical_matches) -> dict[str, DataFrame]:
    """What a scan says, as tables: ``scores`` by method, ``by_relation`` (method, relation, n) of detections,
    ``missed`` (method, item_id, record_id, relation) of labelled leaks not found, ``gain`` (structural less byte detections) and ``detections``.

    ``items``: item_id, payload, raw; ``corpus``: record_id, payload, raw and, where known, relation and leak_of. A scan with
    an empty side is refused: nothing compared with nothing isn't clean. Items without an id are numbered.
    """
    numbered = items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.concat(F.lit("item-"), F.sha2("payload", 256))))
    ev, co = addressed(numbered), addressed(_labelled(corpus))
    if ev.isEmpty() or co.isEmpty():
        raise ValueError("a scan needs items and a corpus; nothing was compared")
    found = detections(ev, co, tau, backend)
    truth = co.select("record_id", "relation", "leak_of")
    by_relation = found.join(truth, "record_id").groupBy("method", F.coalesce("relation", F.lit("unlabelled")).alias("relation")).agg(F.count("*").alias("n"))
    leaks = truth.filter(F.col("relation").isin(*LEAK_RELATIONS) & F.col("leak_of").isNotNull()).select(F.explode(F.array(*map(F.lit, METHODS))).alias("method"), F.col("leak_of").alias("item_id"), "record_id", "relation")
    missed = leaks.join(found.select("method", "item_id", "record_id"), ["method", "item_id", "record_id"], "left_anti")
    n = lambda m: F.count_if(F.col("method") == m)
    return {"scores": method_scores(found, co, list(METHODS)), "by_relation": by_relation, "missed": missed, "gain": found.agg((n("structural") - n("byte")).alias("gain")), "detections": found}


def _labelled(corpus: DataFrame) -> DataFrame:
    return corpus.withColumns({c: F.lit(None).cast("string") for c in ("relation", "leak_of") if c not in corpus.columns})


def shared_lines(items: DataFrame, corpus: DataFrame, item_id: str, item_text: str, record_id: str, record_text: str, least: int = 20) -> DataFrame:
    """(item_id, record_id, n_lines): records that have whole sentences or lines of an item, of at least ``least`` characters, that no other item has.

    A stock sentence tells no item from another and would pair every record with every item.
    """
    cut = lambda df, i, t, out: df.select(F.col(i).alias(out), F.explode(F.array_distinct(F.transform(F.split(t, r"(?<=[.!?;])\s+|\n"), F.trim))).alias("line")).filter(F.char_length("line") >= least)
    own = cut(items, item_id, item_text, "item_id").groupBy("line").agg(F.min("item_id").alias("item_id"), F.max("item_id").alias("__last")).filter("item_id = __last").drop("__last")
    pairs = own.join(cut(corpus, record_id, record_text, "record_id"), "line")
    return pairs.groupBy("item_id", "record_id").agg(F.count("*").alias("n_lines"))


def raw_json(value: object) -> str:
    """How a record is spelled in a file by default."""
    return json.dumps(value, ensure_ascii=False)

"""Problem 8: texts cut off by field limits or in transfer.

Per source, text lengths follow a log-normal distribution that a field limit censors from the
right: a record subject to limit L shows L if its true length is more. Candidate limits are lengths
that far too many records share. One maximum likelihood fit (EM) for each source finds the
distribution, the share of records under each limit, how often records are cut in transfer, and how
cut and whole records end and declare their length. A record counts as cut if its posterior is over one
half: that of being censored at the limit it stands at, or cut elsewhere, given its ending. Endings are looked
at once footers and markers that may follow a cut are taken off. Footers are learned: last lines
that many different texts share.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from lodestrand.llm.sources import source_name
from lodestrand.session import arrow_type, spread, stored

#: A last line that at least this share of all documents has, and FOOTER_LEAST different texts, is a footer, if it has a word; so there are at most 500.
FOOTER_SHARE = 0.002
FOOTER_LEAST = 4
#: Characters in which an ending's marker, open mark-up or address is looked for.
TAIL = 500
#: Least records of a candidate limit, and deviations by which they exceed what lengths about it lead to expect.
SPIKE_LEAST = 5
SPIKE_SIGMAS = 5.0

KINDS = ("open", "unfinished", "marked", "apart", "whole", "blank")
#: What is presumed before any record is seen: how cut and whole records end, declare more than they have, and what share is cut in transfer.
#: It is worth PRIOR_RECORDS records, for endings and the share also PRIOR_SHARE times the source's: endings
#: alone can't tell a source that cuts many records from one whose whole records end that way.
CUT_ENDS = (0.25, 0.60, 0.13, 0.015, 0.004, 0.001)
WHOLE_ENDS = (0.002, 0.004, 0.001, 0.10, 0.873, 0.02)
DECLARED = (0.15, 0.002)
CUT_SHARE = 0.08
PRIOR_RECORDS = 50.0
PRIOR_SHARE = 3.0

# --- endings -----------------------------------------------------------------------------------

_MARKER = re.compile(r"\s*(?:\[(?:\.\.\.|…|more|cut|truncated|continued|cont\.?|snip)\]|\((?:\.\.\.|…|more|cut|cut off|truncated|continued|cont\.?|contd\.?)\)|<(?:more|truncated|cut|snip)>|…|\.\.\.)$", re.IGNORECASE)
_FOOTER = re.compile(r"(?:\[[^\[\]]{3,60}\]|\([^()]{3,60}\)|\*{1,2} ?[^*]{3,80} ?\*{1,2}|[-=_*~]{3,}|(?:--|—|–) \S.{0,80}|Page \d+ of \d+|\d+ ?/ ?\d+)", re.IGNORECASE)
_END = re.compile(r"[.!?。！？｡][)\]\"'”’»›」』*_`]*$")
_TAG_OPEN = re.compile(r"<(?:[/!A-Za-z][^<>\n]{0,200})?$")
_ENTITY_OPEN = re.compile(r"&(?:#?\w{0,10})?$")
_LINK_OPEN = re.compile(r"\[[^\[\]\n]{0,200}\]\([^()\s]*$|!?\[[^\[\]\n]{0,200}$")
_ITEM = re.compile(r"(\s*)(?:[-*+•]|\d{1,3}[.)])\s+\S")
_LABEL = re.compile(r"([A-Z][\w .'/-]{0,30}?):\s+\S", re.UNICODE)
_ADDRESS = re.compile(r"(?:https?://\S+|\S+@\S+\.\w+)$")
_HEADING = re.compile(r"#{1,6}\s+\S")
#: Labels of speakers (fixed values): what follows them is speech, not a form's field.
SPEAKERS = {"caller", "agent", "user", "assistant", "system", "u", "a", "q", "speaker", "customer", "adjuster", "operator", "client", "bot"}
_DIGITS = re.compile(r"[0-9]+")


def shape(line: str) -> str:
    return _DIGITS.sub("0", line.strip())


def shape_digest(line: str) -> str:
    return hashlib.md5(shape(line).encode("utf-8", "surrogatepass")).hexdigest()


_JSON_START = re.compile(r"(?m)^(?=\{|\[\s*[\{\[\"\d])")
_JSON_TOKEN = re.compile(r"\\.|[\"{}\[\]]", re.DOTALL)


def _open_json(text: str) -> bool:
    """Whether a JSON value that begins a line is still open at the end."""
    for start in _JSON_START.finditer(text):
        depth, quoted = 0, False
        for token in _JSON_TOKEN.finditer(text, start.start()):
            c = token[0]
            if c == '"':
                quoted = not quoted
            elif not quoted and len(c) == 1:
                depth += 1 if c in "{[" else -1
                if depth <= 0:
                    break
        if depth > 0:
            return True
    return False


def ending(text: str | None, footers: frozenset[str]) -> tuple[str, int]:
    """(kind of ending, length of the text before footers and markers). ``footers`` are digests of shapes of lines."""
    rest = (text or "").rstrip()
    if not rest:
        return "blank", 0
    dropped = False
    for _ in range(4):
        at = rest.rfind("\n") + 1
        line = rest[at:].strip()
        if at and line and (shape_digest(line) in footers or _FOOTER.fullmatch(line)):
            rest, dropped = rest[:at].rstrip(), True
            if not rest:
                return "whole", 0
        else:
            break
    if not dropped and "\n" not in rest and (shape_digest(rest) in footers or _FOOTER.fullmatch(rest)):
        return "whole", len(rest)
    marked = _MARKER.search(rest[-TAIL:])
    if marked and len(rest) > len(marked[0]):
        before = rest[: len(rest) - len(marked[0])].rstrip()
        kind = _kind(before, False)
        return ("marked" if kind in ("unfinished", "open") else kind), len(before)
    return _kind(rest, not dropped), len(rest)


def _kind(text: str, alone: bool) -> str:
    """The kind of ending; ``alone`` if nothing was taken off, so that a few words may be all there ever was."""
    at = text.rfind("\n") + 1
    line = text[at:].strip()
    if "```" in text and sum(1 for _ in re.finditer(r"(?m)^\s*```", text)) % 2:
        return "open"
    if ("{" in text or "[" in text) and _open_json(text):
        return "open"
    if _TAG_OPEN.search(line[-TAIL:]) or _ENTITY_OPEN.search(line[-TAIL:]) or _LINK_OPEN.search(line[-TAIL:]):
        return "open"
    if line.startswith("|"):
        above = text[:at].rstrip().rpartition("\n")[2].strip()
        same = not above.startswith("|") or above.count("|") == line.count("|")
        return "apart" if line.endswith("|") and len(line) > 1 and same else "open"
    if line.replace("**", "").count("*") % 2 == 0 and line.count("**") % 2:
        return "open"
    if not line.startswith("```") and line.count("`") % 2:
        return "open"
    if _END.search(line):
        return "whole"
    if line.count("“") > line.count("”") or line.count("«") > line.count("»"):
        return "open"
    if text[-1] in "}]" or line == "```" or line.endswith("____"):
        return "whole"
    if _HEADING.match(line) or line.startswith(("-- ", "— ", "– ")) or _ADDRESS.search(line[-TAIL:]):
        return "apart"
    lines = text[:at].rstrip().split("\n") if at else []
    if _ITEM.match(text[at:]):
        above = []
        for other in reversed(lines):
            if not _ITEM.match(other):
                break
            above.append(bool(_END.search(other.strip())))
        return "unfinished" if above and all(above) or not above and len(line.split()) > 6 else "apart"
    label = _LABEL.match(line)
    if label and label[1].lower() not in SPEAKERS and not any(o.startswith(label[1] + ":") for o in lines) and len(line) < 80:
        return "apart"
    if alone and not at and len(line.split()) <= 3:
        return "apart"
    return "unfinished"


# --- lengths -----------------------------------------------------------------------------------


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _survival(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def bin_of(length: Column) -> Column:
    """Number of the length's bin; bins are 10 characters wide at first, then 4 % of the length."""
    return F.floor(F.log1p(length / F.lit(250.0)) / math.log(1.04)).cast("long")


def bin_width(number: np.ndarray) -> np.ndarray:
    edge = lambda k: np.ceil(250.0 * np.expm1(k * math.log(1.04)) - 1e-9)
    return np.maximum(edge(number + 1) - edge(number), 1.0)


def fit_source(kind: np.ndarray, declared: np.ndarray, at: np.ndarray, bins: np.ndarray, mean: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[float, float, np.ndarray]:
    """(mu, sigma of the log length, posterior of being cut for each cell), by EM over one source's cells.

    A cell holds ``counts`` records of a kind of ending (place in KINDS), declared length above the real one
    or not, candidate limit they stand at (``at``, 0 for none), bin and mean length. Classes are whole,
    cut at the limit and cut in transfer. At a limit the survival function times the fitted share of records
    under it stands against the density of lengths there.
    """
    n = counts.sum()
    x = np.log(np.maximum(mean, 1.0))
    sized = (mean > 0) & (kind != KINDS.index("blank"))
    m = max(float(counts[sized].sum()), 1.0)
    mu = float((counts * x)[sized].sum() / m)
    sigma = max(0.05, math.sqrt(float((counts * (x - mu) ** 2)[sized].sum() / m)))
    limits, of = np.unique(at, return_inverse=True)
    has = at > 0
    log_limit = np.log(np.maximum(limits.astype(float), 1.0))
    # records of the limit's bin that stand at no limit, a character
    number = np.array([bins[at == v][0] if v else 0 for v in limits])
    around = np.array([counts[(bins == k) & ~has].sum() for k in number]) / bin_width(number) / n
    cut_ends, whole_ends, share_cut, said = np.array(CUT_ENDS), np.array(WHOLE_ENDS), CUT_SHARE, np.array(DECLARED)
    share = np.full(len(limits), 0.5)
    r = np.zeros(len(counts))
    for _ in range(rounds):
        z = (log_limit - mu) / sigma
        beyond = np.maximum(_survival(z), 1e-12)
        density = np.maximum(np.maximum(_phi(z) / sigma / np.maximum(limits, 1), around), 1e-12)
        q = np.where(limits > 0, share * beyond / (share * beyond + density), 0.0)[of]
        cut = cut_ends[kind] * np.where(declared, said[0], 1 - said[0])
        whole = whole_ends[kind] * np.where(declared, said[1], 1 - said[1])
        parts = np.stack([q * cut, (1 - q) * share_cut * cut, (1 - q) * (1 - share_cut) * whole])
        at_limit, in_transfer, _ = parts / parts.sum(0)
        moved = at_limit + in_transfer
        change = float(np.abs(moved - r).max()) if len(r) else 0.0
        r = moved
        cut_n, whole_n = counts * r, counts * (1 - r)
        cut_ends, whole_ends = (
            (np.bincount(kind, w, len(KINDS)) + (prior := PRIOR_RECORDS + PRIOR_SHARE * w.sum()) * np.array(told)) / (w.sum() + prior) for w, told in ((cut_n, CUT_ENDS), (whole_n, WHOLE_ENDS))
        )
        said = np.array([((w * declared).sum() + PRIOR_RECORDS * d) / (w.sum() + PRIOR_RECORDS) for w, d in zip((cut_n, whole_n), DECLARED)])
        free_n = (counts * (1 - at_limit)).sum()
        prior = PRIOR_RECORDS + PRIOR_SHARE * free_n
        share_cut = ((counts * in_transfer).sum() + prior * CUT_SHARE) / (free_n + prior)
        censored = np.bincount(of, counts * at_limit, len(limits))
        share = np.clip(censored / np.maximum(beyond * n, 1e-9), 1e-6, 1.0)
        # moments of the true lengths: those at a limit lie beyond it
        ratio = _phi(z) / beyond
        first, second = mu + sigma * ratio, mu**2 + sigma**2 + sigma * ratio * (log_limit + mu)
        free = np.where(sized, counts * (1 - at_limit), 0.0)
        total = max(float(free.sum() + censored.sum()), 1e-9)
        new_mu = float((free * x).sum() + (censored * first).sum()) / total
        new_var = float((free * x * x).sum() + (censored * second).sum()) / total - new_mu**2
        mu, sigma = new_mu, max(0.05, math.sqrt(max(new_var, 0.0)))
        if change < 1e-6:
            break
    return mu, sigma, np.where(kind == KINDS.index("blank"), 0.0, r)


# --- Spark -----------------------------------------------------------------------------------------

EVIDENCE = StructType([StructField("source", StringType()), StructField("kind", StringType()), StructField("chars", LongType()), StructField("rest", LongType()), StructField("declared", BooleanType()), StructField("of", LongType())])


def learned_footers(documents: DataFrame, text: str = "text") -> frozenset[str]:
    """Digests of the shapes of last lines that many different texts end with, from all documents; copies of a text count once."""
    whole = F.rtrim(F.col(text), F.lit(" \t\n\r\f"))
    line = F.trim(F.substring_index(whole, "\n", -1))
    last = documents.select(F.xxhash64(whole).alias("of"), line.alias("line")).filter(F.col("line").rlike(r"\p{L}{3}"))
    shapes = last.select("of", F.md5(F.regexp_replace("line", "[0-9]+", "0").cast("binary")).alias("shape")).groupBy("shape", "of").agg(F.count("*").alias("k"))
    n = documents.count()
    least = max(FOOTER_LEAST, math.ceil(FOOTER_SHARE * n))
    many = shapes.groupBy("shape").agg(F.count("*").alias("texts"), F.sum("k").alias("n")).filter((F.col("n") >= least) & (F.col("texts") >= FOOTER_LEAST))
    return frozenset(r[0] for r in many.select("shape").collect())


def evidence(documents: DataFrame, footers: frozenset[str], doc_id: str = "doc_id", text: str = "text", source: str = "source", declared: str = "n_chars") -> DataFrame:
    """(doc_id, source, kind, chars, rest, declared, of): what each record shows; ``of`` is the text's hash."""
    known = documents.sparkSession.sparkContext.broadcast(footers)
    id_type = arrow_type(documents, doc_id)
    out = StructType([StructField("doc_id", documents.schema[doc_id].dataType), *EVIDENCE])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, said = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            ends = [ending(t, known.value) for t in texts]
            short = [s is not None and t is not None and s > len(t) and s not in (len(t.encode("utf-8", "replace")), len(t) + t.count("\n") - t.count("\r\n")) for t, s in zip(texts, said)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), batch.column(2).cast(pa.string()), pa.array([e[0] for e in ends], pa.string()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([e[1] for e in ends], pa.int64()), pa.array(short, pa.bool_()), batch.column(4).cast(pa.int64())],
                ["doc_id", *EVIDENCE.names],
            )

    return spread(documents.select(doc_id, text, source_name(F.col(source)).alias("source"), F.col(declared).cast("long").alias("declared"), F.xxhash64(text).alias("of"))).mapInArrow(look, out)


def candidate_limits(shown: DataFrame) -> DataFrame:
    """(source, rest) of lengths, before footers and markers, that far more texts of a source share than lengths about them; copies count once."""
    texts = shown.filter("rest > 0").groupBy("source", "rest", "of").agg(F.lit(1).alias("one"))
    lengths = texts.groupBy("source", "rest").agg(F.count("*").alias("n")).withColumn("bin", bin_of(F.col("rest")))
    about = lengths.groupBy("source", "bin").agg(F.sum("n").alias("total"))
    edge = lambda k: F.ceil(250.0 * F.expm1(k * math.log(1.04)) - 1e-9)
    width = F.greatest(edge(F.col("bin") + 1) - edge(F.col("bin")), F.lit(2))
    around = (F.col("total") - F.col("n")) / (width - 1)
    many = lengths.filter(F.col("n") >= SPIKE_LEAST).join(about, ["source", "bin"])
    return many.filter(F.col("n") > around + SPIKE_SIGMAS * F.sqrt(around + 0.25)).select("source", "rest", F.col("rest").alias("at"))


def fitted(shown: DataFrame) -> DataFrame:
    """(source, kind, declared, at, posterior, mu, sigma) of each kind of record of each source; ``shown`` has ``at``, 0 for none.

    A source's cells are of six kinds, a bounded number of bins, and its limits, whatever the number of its records.
    """
    cells = shown.withColumn("bin", bin_of(F.col("rest"))).groupBy("source", "kind", "declared", "at", "bin").agg(F.count("*").alias("n"), F.sum("rest").alias("total"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {k: i for i, k in enumerate(KINDS)}
        counts = pdf["n"].to_numpy().astype(float)
        mu, sigma, r = fit_source(pdf["kind"].map(place).to_numpy(), pdf["declared"].to_numpy().astype(bool), pdf["at"].to_numpy(), pdf["bin"].to_numpy(), pdf["total"].to_numpy() / counts, counts)
        return pdf[["source", "kind", "declared", "at"]].assign(posterior=r, mu=mu, sigma=sigma).drop_duplicates(["kind", "declared", "at"])

    return cells.groupBy("source").applyInPandas(fit, "source string, kind string, declared boolean, at long, posterior double, mu double, sigma double")


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, source, kind, posterior, cut) of every document.

    Null and blank texts are never cut. A source of few documents is judged by what is presumed (CUT_ENDS and so on) more than by its own.
    """
    shown = stored(evidence(documents, learned_footers(documents)), "endings")
    placed = shown.join(candidate_limits(shown), ["source", "rest"], "left").withColumn("at", F.coalesce("at", F.lit(0).cast("long")))
    posterior = fitted(placed).select("source", "kind", "declared", "at", "posterior")
    return placed.join(posterior, ["source", "kind", "declared", "at"], "left").select("doc_id", "source", "kind", "posterior", (F.col("posterior") > 0.5).alias("cut"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id,) of documents whose text was cut; see TESTDATA problem 8."""
    return scored(documents).filter("cut").select("doc_id")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, rate) of each source."""
    return scored(documents).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate"))

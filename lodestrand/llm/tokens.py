"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from lodestrand.session import arrow_type, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How this family of vocabularies cuts text before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are counted in parts, cut where the pattern cuts anyway.
PART = 100_000

_encodings: dict[int, object] = {}


def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, kept for the life of the worker."""
    key = hash(vocabulary)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


#: Before a space that a letter follows, or between a sign other than an apostrophe (or an ideographic stop) and a letter: the pattern cuts there whatever stands around.
_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])|(?<=[^\s\w'])(?=[^\W\d_])")


def parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut where the pattern cuts anyway; where there is no such place, a part goes on."""
    at = 0
    while len(text) - at > PART:
        m = _CUT.search(text, at + PART)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def count(texts: list[str | None], enc) -> list[int]:
    """Tokens of each text; null counts as empty."""
    flat, owner = [], []
    for i, t in enumerate(texts):
        for p in parts(t) if t and len(t) > PART else [t or ""]:
            flat.append(p)
            owner.append(i)
    out = [0] * len(texts)
    for i, ids in zip(owner, enc.encode_ordinary_batch(flat, num_threads=1)):
        out[i] += len(ids)
    return out


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(*keep, n_tokens) of every document. The vocabulary, under 1 MB, is read once and sent to the tasks."""
    with open(vocabulary, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())
    out = StructType([*[documents.schema[k] for k in keep], StructField("n_tokens", LongType())])
    types = [arrow_type(documents, k) for k in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(content.value)
        for batch in batches:
            n = pa.array(count(batch.column(len(keep)).to_pylist(), enc), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(t) for i, t in enumerate(types)], n], out.names)

    return spread(documents.select(*keep, text)).mapInArrow(scan, out)

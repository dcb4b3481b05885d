"""Text equality that Spark SQL lacks, as Arrow kernels (no Python per row)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _nfc(a: pa.Array) -> pa.Array:
    """Unicode composition; only texts with other than ASCII characters leave Arrow (its own kernel doesn't compose)."""
    other = pc.fill_null(pc.invert(pc.string_is_ascii(a)), False)
    n = pc.sum(other).as_py()
    if not n:
        return a
    composed = pa.array([unicodedata.normalize("NFC", t) for t in a.filter(other).to_pylist()], a.type)
    return pc.replace_with_mask(a, other, composed)


def _same_text(a: pa.Array) -> pa.Array:
    a = pc.replace_substring(a, "\r\n", "\n")
    a = pc.replace_substring(a, "\r", "\n")
    return pc.utf8_trim_whitespace(_nfc(a))


@F.arrow_udf(StringType())
def same_text(a: pa.Array) -> pa.Array:
    """The form in which two strings are equal iff they are the same text: NFC, LF line ends, trimmed. Null stays null."""
    return _same_text(a)


@F.arrow_udf(StringType())
def nfc(a: pa.Array) -> pa.Array:
    return _nfc(a)


def joined(*cols: Column) -> Column:
    """Columns as one text; null and empty differ and no two rows of different values have the same."""
    return F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in cols])


def digest(*cols: Column) -> Column:
    """SHA-256 over columns; null and empty differ and no concatenation of values collides with another."""
    return F.sha2(joined(*cols), 256)

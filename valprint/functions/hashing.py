"""32-bit value hashes, text normalisation and digests as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of 32-bit FNV-1a.
FNV_BASIS = 2166136261
FNV_PRIME = 16777619
MASK = (1 << 32) - 1


def value_hash(value: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes of a value as a long in [0, 2^32); null stays null, '' gives the basis.

    It stays in the JVM and takes time in proportion to the value's length. Hash distinct values where rows repeat them.
    """
    data = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    pairs = F.regexp_extract_all(F.hex(data.cast("binary")), F.lit("(..)"), 1)
    octets = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))
    return F.when(data.isNotNull(), F.aggregate(octets, F.lit(FNV_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))))


def fold(x: str | None) -> str | None:
    """Compatibility decomposition, full case folding, no marks."""
    if x is None:
        return None
    x = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", x).casefold())
    return "".join(c for c in x if not unicodedata.category(c).startswith("M"))


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(fold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalized_all(values: pd.Series) -> pd.Series:
    """normalized() of each element of an array."""
    return values.map(lambda xs: None if xs is None else [fold(x) for x in xs])


def normalized(value: Column | str) -> Column:
    """A value without case, accents and compatibility forms. Only values beyond ASCII go through Python."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.rlike("^[\\x00-\\x7f]*$"), F.lower(value)).otherwise(_folded(value))


def value_hash_normalized(value: Column | str) -> Column:
    """value_hash() of a normalized() value; it is bound once, as Python may not run inside the hash."""
    return F.element_at(F.transform(F.array(normalized(value)), value_hash), 1)


def sha256(data: Column | str) -> Column:
    """Lower-case hexadecimal SHA-256 of text or bytes."""
    return F.sha2((F.col(data) if isinstance(data, str) else data).cast("binary"), 256)

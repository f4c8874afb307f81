"""Hashes that names and manifests need, and the fold of a text into halves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fnv1a64(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    """FNV-1a with the public 64-bit offset basis and prime; state goes on from earlier bytes."""
    h = state
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def key_hash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in texts:
        yield x.map(lambda t: None if t is None else f"{fnv1a64(t.encode('utf-8', 'surrogatepass')):016x}")


def hashed_name(slug: Column, text: Column) -> Column:
    """slug-xxxxxxxx: the low 32 bits of the hash of text; the hash alone where there is no slug."""
    return F.concat_ws("-", F.nullif(slug, F.lit("")), F.substring(key_hash(text), 9, 8))


def half(text: Column) -> Column:
    """0 or 1: the low bit of an FNV fold, (1 + sum of the bytes' low bits) mod 2."""
    # every byte is taken as a pair, so that no match starts inside one
    odd = F.char_length(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "([0-9A-F][13579BDF])|[0-9A-F]{2}", "$1")) / 2
    return ((1 + odd) % 2).cast("int")

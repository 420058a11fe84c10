"""Time, key and vector expressions, all JVM-side."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_NS = 86_400_000_000_000
DAY_MS = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entity_key(c: Column | str) -> Column:
    """Entity of a spelling: blanks and tabs trimmed at both ends, lower case. Null stays null."""
    return F.lower(F.btrim(_col(c), F.lit(" \t")))


def floor_div(x: Column, n: int) -> Column:
    """Floor division of integers; plain division would pass through a double and lose digits."""
    q = F.call_function("div", x, F.lit(n))
    return q - F.when((x < 0) & (x % F.lit(n) != 0), F.lit(1)).otherwise(F.lit(0))


def day_number(ns: Column | str) -> Column:
    """UTC day number of nanoseconds since the epoch; exact for every bigint, also before 1970."""
    return floor_div(_col(ns), DAY_NS).cast("int")


def day_bucket(ns: Column | str) -> Column:
    """UTC day of nanoseconds since the epoch as yyyy-mm-dd."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day_number(ns)), "yyyy-MM-dd")


def ns_of(ts: Column | str) -> Column:
    """Nanoseconds since the epoch of a timestamp read as UTC."""
    return F.unix_micros(_col(ts).cast("timestamp")) * F.lit(1000)


def sorted_columns(df, columns: list[str]):
    """The given columns in the given order; a missing one is an error that names it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def msg_id_parts(c: Column | str) -> tuple[Column, Column]:
    """The two numbers of a message id written as ``ms-seq``; one that is not so written is an error when it is met."""
    c = _col(c)
    bad = F.raise_error(F.concat(F.lit("not a message id: "), c))
    ok = c.isNull() | c.rlike(r"^[0-9]{1,18}-[0-9]{1,9}$")
    part = lambda i, t: F.when(ok, F.split_part(c, F.lit("-"), F.lit(i))).otherwise(bad).cast(t)
    return part(1, "bigint"), part(2, "int")


def safe_name(c: Column | str) -> Column:
    """A name with every character but ASCII letters, digits and ``_`` replaced by ``_``."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_]", "_")


def _blake2b(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)).astype("Int64")


def stable_id(c: Column | str) -> Column:
    """A 64-bit id of a string that other systems can compute: BLAKE2b of 8 bytes over UTF-8, little endian, as a signed number."""
    return F.pandas_udf(_blake2b, T.LongType())(_col(c))

"""Row validation: accepting rows that fit a schema, giving reasons for the others."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import DType, FeatureField, FeatureSchema

MAX_ID_BYTES = 256
_TOO_LARGE = 2.0**128 - 2.0**103  # rounds to infinity in single precision
_RANGE = {DType.INT32: (-(1 << 31), (1 << 31) - 1), DType.INT64: (-(1 << 63), (1 << 63) - 1), DType.UINT8: (0, 255)}


def _whole(v: Column, dtype: DType, kind: T.DataType) -> Column:
    """An integer of a lax value: a number or numeric text without fraction, in range; else null."""
    lo, hi = _RANGE[dtype]
    if isinstance(kind, T.IntegralType):
        return F.when(v.between(lo, hi), v).cast(dtype.spark_type)
    # the decimal rounds a small fraction away, the double one of a large number
    x, d = v.try_cast("double"), v.try_cast("decimal(38,10)")
    return F.when((x == F.floor(x)) & (d == F.floor(d)) & d.between(lo, hi), d).cast(dtype.spark_type)


def _scalar(v: Column, dtype: DType, kind: T.DataType) -> Column:
    """The value cast to its dtype, null when it does not fit; ``kind`` is the type that it comes as."""
    if dtype in _RANGE:
        return _whole(v, dtype, kind)
    return v.try_cast("double").cast(dtype.spark_type)


def _typed(f: FeatureField, kind: T.DataType) -> Column:
    """The field's typed value; elements that do not fit are null."""
    c = F.col(f.name)
    for _ in f.shape:
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not f.shape:
        return _scalar(c, f.dtype, kind)
    if len(f.shape) == 1:
        return F.transform(c, lambda x: _scalar(x, f.dtype, kind))
    return F.transform(c, lambda r: F.transform(r, lambda x: _scalar(x, f.dtype, kind)))


def _reason(f: FeatureField, c: Column, v: Column) -> Column:
    """Why the value ``v`` of ``c`` is none; null when it is one."""
    missing = F.when(c.isNull(), F.lit(f"missing:{f.name}"))
    bad = F.lit(f"type:{f.name}")
    if not f.shape:
        reason = F.when(v.isNull(), bad)
        if f.dtype is DType.FLOAT32:
            # a finite number that single precision cannot hold is refused; NaN and infinity are values
            over = (F.abs(v) == F.lit(float("inf"))) & (F.abs(c.try_cast("double")) < float("inf"))
            reason = F.coalesce(reason, F.when(over, F.lit(f"overflow:{f.name}")))
        return F.coalesce(missing, reason)
    size = F.size(c) != f.shape[0]
    if len(f.shape) == 1:
        nulls = F.exists(v, lambda x: x.isNull())
    else:
        size = size | F.exists(c, lambda r: r.isNull() | (F.size(r) != f.shape[1]))
        nulls = F.exists(v, lambda r: F.exists(r, lambda x: x.isNull()))
    return F.coalesce(missing, F.when(size, F.lit(f"length:{f.name}")), F.when(nulls, bad))


def checked(df: DataFrame, schema: FeatureSchema, carried: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with typed fields in declaration order and ``_reason``, null for rows that fit.

    Reasons: entity:null, entity:empty, entity:too_long, time:null, missing:f, type:f, length:f, overflow:f; the first that
    holds is given. Columns named in ``carried`` pass. Any other column that is neither a
    field nor of the log is an error, as is a field without column.
    """
    gone = [n for n in schema.names if n not in df.columns]
    extra = [c for c in df.columns if c not in schema.names and c not in ("entity_id", "event_time_ns", "msg_id_ms", "msg_id_seq", "event_date", "_unknown", *carried)]
    if gone or extra:
        raise ValueError(f"missing fields: {gone}; unknown columns: {extra}")
    # values first, reasons over them in a second projection, so that no cast is repeated
    kinds = {x.name: x.dataType for x in df.schema.fields}
    df = df.withColumns({f"_v_{f.name}": _typed(f, kinds[f.name]) for f in schema.fields})
    e = F.col("entity_id")
    reason = F.coalesce(
        F.when(e.isNull(), F.lit("entity:null")),
        F.when(e == "", F.lit("entity:empty")),
        F.when(F.octet_length(e) > MAX_ID_BYTES, F.lit("entity:too_long")),
        F.when(F.col("event_time_ns").isNull(), F.lit("time:null")),
        F.when(F.size("_unknown") > 0, F.concat(F.lit("unknown:"), F.array_join("_unknown", ","))) if "_unknown" in df.columns else F.lit(None).cast("string"),
        *[_reason(f, F.col(f.name), F.col(f"_v_{f.name}")) for f in schema.fields],
    )
    rest = [c for c in kinds if c not in schema.names and c not in ("entity_id", "event_time_ns")]
    return df.select("entity_id", "event_time_ns", *[F.col(f"_v_{n}").alias(n) for n in schema.names], *rest, reason.alias("_reason"))


def _fits(f: FeatureField, x: object) -> str | None:
    """Why one element is none of the field's dtype, by the rules of ``checked``: ``type`` or ``overflow``; None when it is."""
    if isinstance(x, bool) or not isinstance(x, (int, float, str, np.integer, np.floating)):
        return "type"
    try:
        if f.dtype in _RANGE:
            d = Decimal(x.strip() if isinstance(x, str) else x if isinstance(x, (int, float)) else x.item())
            lo, hi = _RANGE[f.dtype]
            return None if d.is_finite() and d == d.to_integral_value() and lo <= d <= hi else "type"
        v = float(x)
    except (ValueError, ArithmeticError):
        return "type"
    if f.dtype is DType.FLOAT32 and not f.shape and math.isfinite(v) and abs(v) >= _TOO_LARGE:
        return "overflow"
    return None


def row_reason(schema: FeatureSchema, entity_id: object, values: dict) -> str | None:
    """Why one row, given as values by field, does not fit; the reasons of ``checked``. None when it fits."""
    if not isinstance(entity_id, str):
        return "entity:null" if entity_id is None else "entity:type"
    if not entity_id or len(entity_id.encode()) > MAX_ID_BYTES:
        return "entity:too_long" if entity_id else "entity:empty"
    for f in schema.fields:
        x = values[f.name]
        if x is None:
            return f"missing:{f.name}"
        flat = [x]
        for n in f.shape:
            if any(not isinstance(y, (list, tuple, np.ndarray)) or len(y) != n for y in flat):
                return f"length:{f.name}"
            flat = [z for y in flat for z in y]
        bad = next((r for z in flat if (r := _fits(f, z))), None)
        if bad:
            return f"{bad}:{f.name}"
    return None


def split_valid(df: DataFrame, schema: FeatureSchema) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, typed; and the others as JSON of how they came (``raw``), with ``_reason``."""
    both = checked(df, schema)
    good = both.where(F.col("_reason").isNull()).drop("_reason", "_unknown")
    raw = F.to_json(F.struct(*[c for c in df.columns if c != "_unknown"]))
    bad = checked(df.withColumn("_raw", raw), schema, ("_raw",)).where(F.col("_reason").isNotNull()).select("entity_id", "event_time_ns", F.col("_raw").alias("raw"), "_reason")
    return good, bad


def from_json(df: DataFrame, schema: FeatureSchema, payload: str = "payload") -> DataFrame:
    """Fields of a JSON payload as columns of text, with ``_unknown``: the keys that are no fields."""
    m = F.from_json(payload, "map<string,string>")
    out = df.withColumn("_m", F.coalesce(m, F.create_map().cast("map<string,string>")))
    for f in schema.fields:
        v = F.try_element_at("_m", F.lit(f.name))
        kind = {0: None, 1: "array<string>", 2: "array<array<string>>"}[len(f.shape)]
        out = out.withColumn(f.name, F.from_json(v, kind) if kind else v)
    return out.withColumn("_unknown", F.array_except(F.map_keys("_m"), F.array(*[F.lit(n) for n in schema.names]))).drop("_m", payload)

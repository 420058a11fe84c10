"""Feature schemas: declared, typed, versioned.

A schema is a name, an integer version and an ordered list of fields. A field is one of five dtypes with a shape of rank 0,
1 or 2 (higher ranks may be declared but have no column type). Schemas turn into Spark types whose field metadata holds
dtype and shape, into JSON, and into a fingerprint that stored tables carry.
"""

from __future__ import annotations

import enum
import hashlib
import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
MAX_ELEMENTS = 1 << 24
MAX_FIELD_BYTES = 1 << 28
MAX_ROW_BYTES = 1 << 36
RESERVED = ("entity_id", "event_time_ns", "msg_id_ms", "msg_id_seq", "event_date")


class DType(enum.IntEnum):
    """The closed set of element types; numbers are stored and must not change."""

    FLOAT32 = 1
    FLOAT64 = 2
    INT32 = 3
    INT64 = 4
    UINT8 = 5

    @property
    def short(self) -> str:
        return {1: "f32", 2: "f64", 3: "i32", 4: "i64", 5: "u8"}[self]

    @property
    def n_bytes(self) -> int:
        return {1: 4, 2: 8, 3: 4, 4: 8, 5: 1}[self]

    @property
    def spark_type(self) -> T.DataType:
        """u8 is a smallint whose range is checked, for Spark's tinyint is signed."""
        return {1: T.FloatType(), 2: T.DoubleType(), 3: T.IntegerType(), 4: T.LongType(), 5: T.ShortType()}[self]


@dataclass(frozen=True)
class FeatureField:
    name: str
    dtype: DType
    shape: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name:
            raise ValueError("a field needs a name")
        if not isinstance(self.dtype, DType):
            raise TypeError(f"{self.name}: dtype must be a DType")
        if not isinstance(self.shape, tuple) or any(isinstance(n, bool) or not isinstance(n, int) or n <= 0 for n in self.shape):
            raise ValueError(f"{self.name}: shape must be a tuple of positive integers")
        if self.n_elements > MAX_ELEMENTS:
            raise ValueError(f"{self.name}: more than {MAX_ELEMENTS} elements")
        if self.n_bytes > MAX_FIELD_BYTES:
            raise ValueError(f"{self.name}: more than {MAX_FIELD_BYTES} bytes")

    @property
    def n_elements(self) -> int:
        return math.prod(self.shape)

    @property
    def n_bytes(self) -> int:
        return self.n_elements * self.dtype.n_bytes

    @property
    def spark_type(self) -> T.DataType:
        """Type of the stored column: no nulls inside arrays."""
        return self._type(False)

    @property
    def cast_type(self) -> T.DataType:
        """Type to cast to: Spark does not cast arrays to arrays without nulls."""
        return self._type(True)

    def _type(self, nulls: bool) -> T.DataType:
        if len(self.shape) > 2:
            raise ValueError(f"{self.name}: shapes of rank {len(self.shape)} have no column type")
        out = self.dtype.spark_type
        for _ in self.shape:
            out = T.ArrayType(out, nulls)
        return out

    def to_json(self) -> dict:
        return {"name": self.name, "dtype": self.dtype.short, "shape": list(self.shape)}


_BY_SHORT = {d.short: d for d in DType}


@dataclass(frozen=True)
class FeatureSchema:
    name: str
    version: int
    fields: tuple[FeatureField, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not NAME.fullmatch(self.name):
            raise ValueError(f"bad schema name {self.name!r}")
        if isinstance(self.version, bool) or not isinstance(self.version, int):
            raise TypeError("version must be an int")
        if isinstance(self.fields, list):
            object.__setattr__(self, "fields", tuple(self.fields))
        if not isinstance(self.fields, tuple) or not self.fields or not all(isinstance(f, FeatureField) for f in self.fields):
            raise ValueError("fields must be a non-empty list of FeatureField")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"repeated fields: {sorted({n for n in names if names.count(n) > 1})}")
        if sum(f.n_bytes for f in self.fields) > MAX_ROW_BYTES:
            raise ValueError(f"a row has more than {MAX_ROW_BYTES} bytes")

    # --- lookup ---
    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> FeatureField:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def n_elements(self) -> int:
        """Length of the assembled vector."""
        return sum(f.n_elements for f in self.fields)

    def row_bytes(self, padded: bool = True) -> int:
        """Bytes of a row; padded: each field starts on a multiple of 64."""
        return sum(-(-f.n_bytes // 64) * 64 if padded else f.n_bytes for f in self.fields)

    # --- Spark ---
    def check_reserved(self) -> None:
        bad = [n for n in self.names if n in RESERVED]
        if bad:
            raise ValueError(f"reserved field names: {bad}")

    def field_types(self) -> list[T.StructField]:
        return [T.StructField(f.name, f.spark_type, False, {"dtype": f.dtype.short, "shape": list(f.shape)}) for f in self.fields]

    def log_type(self, msg_id: bool = True) -> T.StructType:
        """Columns of a feature log in their order, without the partition column."""
        self.check_reserved()
        ids = [T.StructField("msg_id_ms", T.LongType(), False), T.StructField("msg_id_seq", T.IntegerType(), False)] if msg_id else []
        return T.StructType([T.StructField("entity_id", T.StringType(), False), T.StructField("event_time_ns", T.LongType(), False), *self.field_types(), *ids])

    # --- identity ---
    def to_json(self) -> dict:
        return {"name": self.name, "version": self.version, "fields": [f.to_json() for f in self.fields]}

    @classmethod
    def from_json(cls, d: dict) -> FeatureSchema:
        return cls(d["name"], d["version"], tuple(FeatureField(f["name"], _BY_SHORT[f["dtype"]], tuple(f["shape"])) for f in d["fields"]))

    def fingerprint(self) -> str:
        """SHA-256 over name, version and ordered fields; changes when fields are reordered."""
        return hashlib.sha256(json.dumps(self.to_json(), sort_keys=True).encode()).hexdigest()

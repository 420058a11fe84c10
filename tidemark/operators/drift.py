"""Schemas that drift between files: report of changes, and reading drifting records into one typed table.

Ingestion never loses a value: what is not in the target schema or cannot be cast to its declared type is kept as JSON in
a rescue column; fields approved later are promoted, and the rescued values are replayed into their typed columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import HOT_ROWS, hot_keys, neighbours, with_blocks

# fixed values: spellings of the five dtypes and bytes per element
DTYPES = {
    "f32": ("float32", "1", 4),
    "f64": ("float64", "2", 8),
    "i32": ("int32", "3", 4),
    "i64": ("int64", "4", 8),
    "u8": ("uint8", "5", 1),
}


def canonical_dtype(c: Column) -> Column:
    """Short name of a dtype however it is spelled; an unknown one stays as it is, in lower case."""
    low = F.lower(F.trim(c))
    out = low
    for short, (long, code, _) in DTYPES.items():
        out = F.when(low.isin(short, long, code), short).otherwise(out)
    return out


def canonical_shape(c: Column) -> Column:
    """A shape as its list of integers; null, empty or without a number: a scalar, the empty list."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))


def declared_fields(schema_fields: DataFrame) -> DataFrame:
    """One row per schema, file and field name: schema_name, file_seq, field_name, pos, dtype, dims.

    Repeated rows count once; should a file declare a name twice in unlike ways, the least (position, dtype, shape) counts.
    """
    f = schema_fields.where(F.col("file_seq").isNotNull()).select("schema_name", "file_seq", "field_name", F.col("field_pos").alias("pos"), canonical_dtype(F.col("dtype")).alias("dtype"), canonical_shape(F.col("shape")).alias("dims"))
    return f.groupBy("schema_name", "file_seq", "field_name").agg(F.min(F.struct("pos", "dtype", "dims")).alias("_d")).select("schema_name", "file_seq", "field_name", "_d.pos", "_d.dtype", "_d.dims")


def file_order(fields: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each file of a schema with the file before and after it: schema_name, file_seq, prev_seq, next_seq."""
    files = fields.select("schema_name", "file_seq").distinct()
    hot = hot_keys(files, "schema_name", "file_seq", hot_rows)
    n = neighbours(with_blocks(files, "schema_name", "file_seq", hot), "schema_name", "file_seq", ["file_seq"], hot)
    return n.select("schema_name", "file_seq", F.col("_prev.file_seq").alias("prev_seq"), F.col("_next.file_seq").alias("next_seq"))


def enforced(incoming: DataFrame, target: DataFrame, on: list[str], fits: Column, how: str = "left") -> DataFrame:
    """What arrives, set against the target schema: both sides' columns and ``status``.

    ``typed``: the target has the key and it fits; ``uncastable``: it has it and it does not fit; ``unknown``: the target has
    no such key; ``absent`` (with ``how="full"``): nothing arrived for the target's key. All but typed ones are rescued.
    """
    j = incoming.withColumn("_came", F.lit(True)).join(target.withColumn("_known", F.lit(True)), on, how)
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("_came").isNull(), "absent").when(F.coalesce(fits, F.lit(False)), "typed").otherwise("uncastable")
    return j.withColumn("status", status).drop("_came", "_known")


def ingested_headers(fields: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each file's declarations, ingested with the fields of the file before it as target.

    Columns: schema_name, file_seq, field_name, new and old (structs pos, dtype, dims) and status. A first file has no target
    and is left out.
    """
    placed = fields.join(file_order(fields, hot_rows), ["schema_name", "file_seq"])
    d = F.struct("pos", "dtype", "dims")
    came = placed.where(F.col("prev_seq").isNotNull()).select("schema_name", "file_seq", "field_name", d.alias("new"))
    target = placed.where(F.col("next_seq").isNotNull()).select("schema_name", F.col("next_seq").alias("file_seq"), "field_name", d.alias("old"))
    same = F.col("new.dtype").eqNullSafe(F.col("old.dtype")) & F.col("new.dims").eqNullSafe(F.col("old.dims"))
    return enforced(came, target, ["schema_name", "file_seq", "field_name"], same, "full")


def promotable(headers: DataFrame) -> DataFrame:
    """Rescued names that may be promoted to a field which nothing arrived for: schema_name, file_seq, came, went.

    They agree in position, dtype and shape; ``came`` and ``went`` are all names of one such slot.
    """
    single = headers.where(F.col("status").isin("unknown", "absent")).withColumn("d", F.coalesce("new", "old"))
    return single.groupBy("schema_name", "file_seq", "d", F.when(F.col("d.pos").isNull(), F.col("field_name")).alias("_only")).agg(
        F.collect_set(F.when(F.col("status") == "unknown", F.col("field_name"))).alias("came"), F.collect_set(F.when(F.col("status") == "absent", F.col("field_name"))).alias("went")
    )


def field_changes(schema_fields: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Changes of each file against the one before it: schema_name, file_seq, field_name, change_kind.

    They are what ingesting the file's declarations into the schema before it had to rescue: unknown names that can be
    promoted to an absent field are renamed (under the new name), other unknown ones added, other absent ones removed, and
    uncastable ones retyped or reshaped. A first file has none. No file list is gathered in one task.
    """
    headers = ingested_headers(declared_fields(schema_fields), hot_rows)
    none = F.lit(None)
    retyped = F.when(~F.col("new.dtype").eqNullSafe(F.col("old.dtype")), "retyped").otherwise(none)
    reshaped = F.when(~F.col("new.dims").eqNullSafe(F.col("old.dims")), "reshaped").otherwise(none)
    kept = headers.where(F.col("status") == "uncastable").select("schema_name", "file_seq", "field_name", F.explode(F.array(retyped, reshaped)).alias("change_kind"))
    named = lambda c, kind: F.transform(c, lambda x: F.struct(x.alias("n"), F.lit(kind).alias("k")))
    both = (F.size("came") > 0) & (F.size("went") > 0)
    slots = promotable(headers).select("schema_name", "file_seq", F.explode(F.when(both, named("came", "renamed")).otherwise(F.concat(named("came", "added"), named("went", "removed")))).alias("c"))
    return kept.where(F.col("change_kind").isNotNull()).unionByName(slots.select("schema_name", "file_seq", F.col("c.n").alias("field_name"), F.col("c.k").alias("change_kind")))


def row_sizes(schema_fields: DataFrame) -> DataFrame:
    """Bytes of a row of each file: schema_name, file_seq, plain (sum of the fields) and padded (each field to 64 bytes).

    Null when a dtype is unknown or a size does not fit a bigint.
    """
    width = F.lit(None).cast("bigint")
    for short, (_, _, n) in DTYPES.items():
        width = F.when(F.col("dtype") == short, F.lit(n).cast("bigint")).otherwise(width)
    n = F.aggregate("dims", width, lambda acc, x: F.try_multiply(acc, x))
    padded = F.call_function("div", n + 63, F.lit(64)) * 64
    sized = declared_fields(schema_fields).select("schema_name", "file_seq", n.alias("n"), padded.alias("p"))
    known = F.count("n") == F.count(F.lit(1))
    return sized.groupBy("schema_name", "file_seq").agg(F.when(known, F.sum("n")).alias("plain"), F.when(known, F.sum("p")).alias("padded"))


def wrong_sizes(schema_fields: DataFrame, upgrade_log: DataFrame) -> DataFrame:
    """Upgrades whose reported new row size is not that of the file's fields, with the size it should be.

    A dry run reports plain sizes, an upgrade padded ones; a null ``dry_run`` is no dry run. Upgrades without a reported
    size or of a file that declares no fields cannot be judged and are left out.
    """
    right = F.when(F.coalesce("dry_run", F.lit(False)), F.col("plain")).otherwise(F.col("padded"))
    u = upgrade_log.select("upgrade_no", "schema_name", "file_seq", "dry_run", "row_size_bytes_new")
    return u.join(row_sizes(schema_fields), ["schema_name", "file_seq"]).withColumn("right_size", right).where(F.col("row_size_bytes_new") != F.col("right_size")).drop("plain", "padded")


def drift_report(schema_fields: DataFrame, upgrade_log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All changes, and ``size`` with field_name ``*`` for files with an upgrade whose row size does not fit."""
    size = wrong_sizes(schema_fields, upgrade_log).select("schema_name", "file_seq", F.lit("*").alias("field_name"), F.lit("size").alias("change_kind")).distinct()
    return field_changes(schema_fields, hot_rows).unionByName(size)


def _flat(v: Column) -> Column:
    """The numbers of a value that is written as a list, nested or not."""
    return F.transform(F.regexp_extract_all(v, F.lit(r"(-?[0-9.eE+-]+|NaN)"), 1), lambda x: x.try_cast("double"))


def _fits(v: Column, dtype: Column, dims: Column) -> Column:
    """Whether a value (as text) can be cast to the declared type; NaN and Inf are floats, text numbers are numbers."""
    real = v.try_cast("double").isNotNull()
    whole = v.rlike(r"^\s*[+-]?\d+\s*$")
    i32, i64, u8 = v.try_cast("int"), v.try_cast("bigint"), v.try_cast("int")
    scalar = F.when(dtype.isin("f32", "f64"), real).when(dtype == "i32", whole & i32.isNotNull()).when(dtype == "i64", whole & i64.isNotNull()).when(dtype == "u8", whole & u8.between(0, 255)).otherwise(F.lit(False))
    flat = _flat(v)
    count = F.aggregate(dims, F.lit(1).cast("bigint"), lambda a, x: F.try_multiply(a, x))
    vector = v.startswith("[") & (F.size(flat) == count) & F.forall(flat, lambda x: x.isNotNull())
    return F.coalesce(F.when(F.size(dims) == 0, scalar).otherwise(vector), F.lit(False))


#: The key under which a payload is rescued whole: it is no JSON object, or it has a key twice.
WHOLE = "_payload"


def parsed(payload: str) -> Column:
    """The values of a payload by key; one that is no JSON object, or that has a key twice, is also there whole, as ``WHOLE``."""
    text = F.col(payload)
    m = F.from_json(payload, "map<string,string>")
    some = F.coalesce(m, F.create_map().cast("map<string,string>"))
    entries = F.map_entries(some)
    keys = F.transform(entries, lambda e: e["key"])
    odd = (text.isNotNull() & m.isNull() & ~F.lower(F.trim(text)).isin("", "null")) | (F.size(keys) != F.size(F.array_distinct(keys)))
    # of a key that stands twice the last value counts
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), e["key"]))
    whole = F.when(odd, F.array(F.struct(F.lit(WHOLE).alias("key"), text.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.map_from_entries(F.concat(F.filter(last, lambda e: ~odd | (e["key"] != WHOLE)), whole))


def rescued_long(records: DataFrame, target: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Records in long form against a target: record_id, schema_name, source_name, field_name, value, dtype, dims, other, status, typed.

    ``target`` has schema_name, source_name, field_name, dtype, dims: under which name a key of the payload is read and as
    what. ``names``, as of ``final_names``, says for the keys that a file declares under which name they are looked up
    there (null: not at all); ``other`` is true for keys that it does not know, which are looked up as they are. ``typed``
    is true when the value fits; other values and keys without a target (field_name null) are rescued. Null values and null
    payloads give no rows; a malformed payload is one rescued value.
    """
    file = ["file_seq"] if names is not None else []
    kv = records.select("record_id", "schema_name", *file, F.explode(parsed("payload")).alias("key", "value")).where(F.col("value").isNotNull())
    if names is None:
        kv = kv.withColumns({"source_name": F.col("key"), "other": F.lit(False)})
    else:
        n = names.select("schema_name", "file_seq", F.col("source_name").alias("key"), F.col("field_name").alias("_to"), F.lit(True).alias("_told"))
        kv = kv.join(n, ["schema_name", "file_seq", "key"], "left").withColumns({"source_name": F.when(F.col("_told"), F.col("_to")).otherwise(F.col("key")), "other": F.col("_told").isNull()})
    fits = _fits(F.col("value"), F.col("dtype"), F.col("dims"))
    j = enforced(kv, target.select("schema_name", "source_name", "field_name", "dtype", "dims"), ["schema_name", "source_name"], fits)
    return j.select("record_id", "schema_name", F.col("key").alias("source_name"), "field_name", "value", "dtype", "dims", "other", "status", (F.col("status") == "typed").alias("typed"))


def unified(records: DataFrame, target: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The consistent table: one row per record with its typed values as a map and the rest as JSON.

    Columns: record_id, schema_name, entity_id, event_time_ns, features (map of field to value as text, each of which
    casts to the field's declared type) and _rescued (JSON object or null). Records whose payload has no values stay,
    with an empty map. A record is the row of its ``record_id``. Where several keys of a record fit one field, the one that
    ``names`` knows counts, then the least; the others are rescued.
    """
    long = rescued_long(records, target, names)
    g = long.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("typed"), F.struct(F.col("field_name").alias("k"), "other", "source_name", "value")))).alias("t"),
        F.collect_list(F.when(~F.col("typed"), F.struct(F.col("source_name").alias("k"), "value"))).alias("r"),
    )
    first = lambda x, i: (i == 0) | (F.get("t", i - 1)["k"] != x["k"])
    g = g.withColumn("r", F.array_sort(F.concat("r", F.transform(F.filter("t", lambda x, i: ~first(x, i)), lambda x: F.struct(x["source_name"].alias("k"), x["value"].alias("value"))))))
    # of a key that stands twice in a payload the greatest value
    last = F.filter("r", lambda x, i: (i == F.size("r") - 1) | (F.get("r", i + 1)["k"] != x["k"]))
    t = F.transform(F.filter("t", first), lambda x: F.struct(x["k"].alias("k"), x["value"].alias("value")))
    out = records.select("record_id", "schema_name", "entity_id", "event_time_ns").join(g, "record_id", "left")
    empty = F.create_map().cast("map<string,string>")
    rescued = F.when(F.size("r") > 0, F.to_json(F.map_from_entries(last)))
    return out.select("record_id", "schema_name", "entity_id", "event_time_ns", F.coalesce(F.map_from_entries(t), empty).alias("features"), rescued.alias("_rescued"))


def table_long(table: DataFrame, target: DataFrame) -> DataFrame:
    """The consistent table with a typed row per value.

    Columns: record_id, schema_name, entity_id, event_time_ns, field_name, rescued, whole (bigint: i32, i64 and u8), number
    (double: f32 and f64), vector (array of double: fields with a shape) and text (rescued values as they came, under the
    record's own key). A record without values has one row with a null name.
    """
    entries = lambda c, rescued: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("field_name"), e["value"].alias("value"), F.lit(rescued).alias("rescued")))
    kept = F.coalesce(F.from_json("_rescued", "map<string,string>"), F.create_map().cast("map<string,string>"))
    long = table.select("record_id", "schema_name", "entity_id", "event_time_ns", F.inline_outer(F.concat(entries(F.col("features"), False), entries(kept, True))))
    j = long.join(target.select("schema_name", "field_name", "dtype", "dims"), ["schema_name", "field_name"], "left")
    typed, v = F.col("field_name").isNotNull() & ~F.col("rescued"), F.trim("value")
    scalar = typed & (F.size("dims") == 0)
    return j.select(
        "record_id", "schema_name", "entity_id", "event_time_ns", "field_name", "rescued",
        F.when(scalar & F.col("dtype").isin("i32", "i64", "u8"), v.try_cast("bigint")).alias("whole"),
        F.when(scalar & (F.col("dtype") == "f32"), v.try_cast("float").cast("double")).when(scalar & (F.col("dtype") == "f64"), v.try_cast("double")).alias("number"),
        F.when(typed & (F.size("dims") > 0), _flat(v)).alias("vector"),
        F.when(F.col("rescued"), F.col("value")).alias("text"),
    )


def final_names(schema_fields: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Which field of the last file each declared name became: schema_name, file_seq, source_name, field_name (null: none).

    Names are followed through the renames of ``field_changes``; where several names left and came in one slot they cannot
    be told apart and are not followed. A name that ends but stands in the last file again is that field, unless another
    name of the same file became it. The names of a schema's files are followed in one task.
    """
    fields = declared_fields(schema_fields)
    one = promotable(ingested_headers(fields, hot_rows)).where((F.size("came") == 1) & (F.size("went") == 1))
    renames = one.select("schema_name", "file_seq", F.col("came")[0].alias("field_name"), F.col("went")[0].alias("old_name"))
    named = fields.where(F.col("schema_name").isNotNull()).select("schema_name", "file_seq", "field_name").join(renames, ["schema_name", "file_seq", "field_name"], "left")
    return named.groupBy("schema_name").applyInPandas(_followed, "schema_name string, file_seq int, source_name string, field_name string")


def _followed(p: pd.DataFrame) -> pd.DataFrame:
    """``final_names`` of one schema, from its last file back."""
    out, later, became = [], None, {}
    for seq, f in sorted(p.groupby("file_seq"), key=lambda x: -x[0]):
        declared = f["field_name"].tolist()
        if later is None:
            last = set(declared)
            to = {n: n for n in declared}
        else:
            to = {n: later.get(became.get(n, n)) for n in declared}
            taken = set(to.values())
            to |= {n: n for n in declared if to[n] is None and n in last and n not in taken}
        out += [(p["schema_name"].iloc[0], seq, n, x) for n, x in to.items()]
        later = to
        became = {old: new for old, new in zip(f["old_name"], declared, strict=True) if isinstance(old, str)}
    return pd.DataFrame(out, columns=["schema_name", "file_seq", "source_name", "field_name"])


def latest_target(schema_fields: DataFrame) -> DataFrame:
    """Target of each schema: the fields that its last file declares, under their own names."""
    f = declared_fields(schema_fields)
    last = f.groupBy("schema_name").agg(F.max("file_seq").alias("_last"))
    t = f.join(last, "schema_name").where(F.col("file_seq") == F.col("_last"))
    return t.select("schema_name", F.col("field_name").alias("source_name"), "field_name", "dtype", "dims")


def ingest(records: DataFrame, schema, aliases: dict[str, str] | None = None, payload: str = "payload") -> DataFrame:
    """Records of one schema with a typed column per field and ``_rescued``.

    ``schema`` is a FeatureSchema; ``aliases`` maps older names to fields. A key that is no field, and a value that its
    field cannot hold, stay in ``_rescued`` under the record's own key. Where a record has both a field and its alias, the
    field counts and the alias is rescued.
    """
    names = {f.name: f for f in schema.fields}
    alias = {old: new for old, new in (aliases or {}).items() if new in names and old not in names}
    df = records.withColumn("_m", parsed(payload))
    used: list[Column] = []
    for f in names.values():
        sources = [f.name, *sorted(old for old, new in alias.items() if new == f.name)]
        dims = F.array(*[F.lit(int(n)).cast("bigint") for n in f.shape]) if f.shape else F.array().cast("array<bigint>")
        value, taken = F.lit(None).cast("string"), F.lit(None).cast("string")
        for s in reversed(sources):
            v = F.try_element_at("_m", F.lit(s))
            ok = v.isNotNull() & _fits(v, F.lit(f.dtype.short), dims)
            value, taken = F.when(ok, v).otherwise(value), F.when(ok, F.lit(s)).otherwise(taken)
        typed = F.from_json(value, f.cast_type) if f.shape else F.trim(value).try_cast(f.cast_type)
        df = df.withColumn(f.name, typed)
        used.append(taken)
    left = F.map_filter("_m", lambda k, v: v.isNotNull() & ~F.coalesce(F.array_contains(F.array_compact(F.array(*used)), k), F.lit(False)))
    return df.withColumn("_rescued", F.when(F.size(left) > 0, F.to_json(left))).drop("_m", payload)


def replay(table: DataFrame, schema, aliases: dict[str, str] | None = None) -> DataFrame:
    """Promotes fields of ``schema`` that the table lacks and moves fitting rescued values into typed columns.

    A payload that was rescued whole stays so.
    """
    have = [f.name for f in schema.fields if f.name in table.columns]
    rest = [c for c in table.columns if c not in have and c != "_rescued"]
    again = ingest(table.select(*rest, F.col("_rescued").alias("_payload"), *[F.col(c).alias(f"_had_{c}") for c in have]), schema, aliases, "_payload")
    cols = [F.coalesce(F.col(f"_had_{f.name}"), F.col(f.name)).alias(f.name) if f.name in have else F.col(f.name) for f in schema.fields]
    return again.select(*rest, *cols, "_rescued")

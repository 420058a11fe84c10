"""The feature log: append-only Parquet, partitioned by the UTC day of the event time."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ConflictError
from tidemark.functions import DAY_NS, day_bucket
from tidemark.operators import features
from tidemark.operators.compaction import list_files
from tidemark.operators.validate import split_valid
from tidemark.schema import FeatureSchema
from tidemark.storage import CommitLog, Folder

_WIDTH = {"smallint": 1, "int": 2, "bigint": 3, "float": 1, "double": 2}


class LogSink(Protocol):
    """What takes validated rows: the feature log, or another sink in its place."""

    def append(self, rows: DataFrame, schema: FeatureSchema, validate: bool = True) -> DataFrame | None: ...


class NoopSink:
    """Takes rows and keeps nothing, for deployments without a log; rows that do not fit are still returned."""

    def append(self, rows: DataFrame, schema: FeatureSchema, validate: bool = True) -> DataFrame | None:
        return split_valid(rows, schema)[1] if validate else None


class FeatureLog:
    """Logs of several schemas under one folder, ``<base>/schema=<name>/event_date=<day>/``.

    The writer never removes duplicates: delivery is at least once, and readers take repeats out. Every read lists the
    files anew. ``msg_id=False`` leaves the message-id columns out. Beside the data stands a short list of the forms that
    appended files have (their fields and whether they have message ids); readers check it instead of the files.
    """

    def __init__(self, spark: SparkSession, base: str, msg_id: bool = True) -> None:
        self.spark, self.base, self.msg_id = spark, base, msg_id

    def path(self, schema: FeatureSchema) -> str:
        return f"{self.base}/schema={schema.name}"

    def _forms(self, schema: FeatureSchema) -> CommitLog:
        return CommitLog(Folder(self.spark, self.path(schema)), "_forms")

    # --- writing ---
    def _register(self, schema: FeatureSchema) -> None:
        """Adds the form of what is about to be appended, unless it is known."""
        form = {"fields": {f.name: f.cast_type.simpleString() for f in schema.fields}, "msg_id": self.msg_id}
        log = self._forms(schema)
        while True:
            n, doc = log.latest()
            if form in doc.get("forms", []):
                return
            try:
                log.append(n + 1, {"forms": [*doc.get("forms", []), form]})
                return
            except ConflictError:
                continue  # another writer added one; look again

    def append(self, rows: DataFrame, schema: FeatureSchema, validate: bool = True) -> DataFrame | None:
        """Appends rows; returns those that did not fit (``raw``, ``_reason``), which are not written.

        Late rows are filed under the day of their event time, whenever they come. Message ids are written delta-encoded
        without dictionary. Days are balanced into files by size, whatever entity their rows belong to.
        """
        bad = None
        if validate:
            rows, bad = split_valid(rows, schema)
        self._register(schema)
        cols = [f.name for f in schema.log_type(self.msg_id).fields]
        out = rows.select(*cols, day_bucket("event_time_ns").alias("event_date"))
        (
            out.hint("rebalance", F.col("event_date"))
            .write.mode("append")
            .option("compression", "zstd")
            .option("parquet.writer.version", "v2")
            .option("parquet.enable.dictionary#msg_id_ms", "false")
            .option("parquet.enable.dictionary#msg_id_seq", "false")
            .partitionBy("event_date")
            .parquet(self.path(schema))
        )
        return bad

    # --- reading ---
    def _foreign(self, schema: FeatureSchema) -> list[dict]:
        """Forms of a log without a list of them: those of its files' footers."""
        p = self.path(schema)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(p).select("path")
        fields = schema.names

        def form(batches):
            import pandas as pd
            import pyarrow.fs as pafs
            import pyarrow.parquet as pq

            for pdf in batches:
                out = []
                for x in pdf["path"]:
                    fs, name = pafs.FileSystem.from_uri(x)
                    have = pq.read_schema(name, filesystem=fs).names
                    out.append((json.dumps([f for f in fields if f in have]), "msg_id_ms" in have))
                yield pd.DataFrame(out, columns=["fields", "msg_id"])

        got = files.mapInPandas(form, "fields string, msg_id boolean").distinct().collect()  # forms, not files
        return [{"fields": {n: schema[n].cast_type.simpleString() for n in json.loads(r["fields"])}, "msg_id": r["msg_id"]} for r in got]

    def _typed(self, schema: FeatureSchema) -> tuple[DataFrame | None, tuple[str, ...]]:
        """The log after its guards, and the ids that it has; None when it is empty. A corrupt file is an error.

        Files that lack a declared field are an error, be it all of them or some; so is a mixture of files with and without
        message ids.
        """
        p = self.path(schema)
        if not any(n.startswith("event_date=") for n in Folder(self.spark, p).names()):
            return None, features.IDS if self.msg_id else ()
        forms = self._forms(schema).latest()[1].get("forms") or self._foreign(schema)
        gone = [n for n in schema.names if not any(n in f["fields"] for f in forms)]
        if gone:
            raise ValueError(f"the log lacks declared fields: {gone}")
        some = [n for n in schema.names if not all(n in f["fields"] for f in forms)]
        if some:
            raise ValueError(f"divergent files: some lack declared fields: {some}")
        if len({f["msg_id"] for f in forms}) > 1:
            raise ValueError("mixed files: some have message ids, some have none")
        ids = features.IDS if forms[0]["msg_id"] else ()
        # files of narrower types are widened by the reader
        types = {n: max((f["fields"][n] for f in forms), key=lambda t: _WIDTH.get(t, 0)) for n in schema.names}
        read = ["entity_id string", "event_time_ns bigint", *[f"`{n}` {t}" for n, t in types.items()], *(["msg_id_ms bigint", "msg_id_seq int"] if ids else []), "event_date string"]
        df = self.spark.read.schema(", ".join(read)).option("basePath", p).parquet(p)
        casts = [F.col(f.name).cast(f.cast_type).alias(f.name) for f in schema.fields]
        return df.select("entity_id", "event_time_ns", *casts, *ids, "event_date"), ids

    def scan(self, schema: FeatureSchema, lo_ns: int | None = None, hi_ns: int | None = None) -> DataFrame:
        """The log, or its rows between two event times (both inclusive); an empty typed table when there is no log."""
        df, _ = self._typed(schema)
        if df is None:
            st = T.StructType([*schema.log_type(self.msg_id).fields, T.StructField("event_date", T.StringType())])
            return self.spark.createDataFrame([], st)
        if lo_ns is None and hi_ns is None:
            return df
        return features.window_scan(df, -(1 << 62) if lo_ns is None else lo_ns, (1 << 62) if hi_ns is None else hi_ns)

    def _deduped(self, df: DataFrame, schema: FeatureSchema, ids: tuple[str, ...]) -> DataFrame:
        return features.dedup_by_message(df) if ids else features.dedup_by_time(df, schema.names)

    def read_point_in_time(self, schema: FeatureSchema, queries: DataFrame, lookback_days: int = 30, order: str | None = None) -> DataFrame:
        """Leak-free training rows; see ``features.as_of_join``. ``order`` names a query column to sort them by. Checks come in a fixed order; a missing log gives nulls."""
        if lookback_days <= 0:
            raise ValueError("lookback_days must be positive")
        need = [c for c in ("entity_id", "as_of_time") if c not in queries.columns]
        if need:
            raise ValueError(f"queries lack {need}")
        types = dict(queries.dtypes)
        if types["entity_id"] != "string":
            raise TypeError("entity_id must be a string")
        if types["as_of_time"] != "bigint":
            raise TypeError("as_of_time must be a bigint of nanoseconds")
        df, ids = self._typed(schema)
        if df is None:
            nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.log_type(bool(ids)).fields if f.name != "entity_id"]
            return queries.select("*", *nulls)
        span = lookback_days * DAY_NS
        window = features.query_window(queries, span)
        if window is None:
            return features.as_of_join(df.limit(0), queries, schema.names, span, ids, order=order)
        inside = features.window_scan(df, *window).drop("event_date")
        return features.as_of_join(self._deduped(inside, schema, ids), queries, schema.names, span, ids, order=order)

    def latest_features(self, schema: FeatureSchema, lookback_days: int = 30, as_of_time_ns: int | None = None) -> DataFrame:
        """The newest row per entity as of a time (default now), not older than the lookback."""
        if lookback_days <= 0:
            raise ValueError("lookback_days must be positive")
        df, ids = self._typed(schema)
        if df is None:
            return self.spark.createDataFrame([], schema.log_type(bool(ids)))
        at = as_of_time_ns if as_of_time_ns is not None else self.spark.range(1).select(F.unix_micros(F.current_timestamp()) * 1000).first()[0]
        inside = features.window_scan(df, at - lookback_days * DAY_NS, at).drop("event_date")
        return features.latest(inside, schema.names, ids=ids)

    def distinct_entity_ids(self, schema: FeatureSchema) -> DataFrame:
        df, _ = self._typed(schema)
        return self.spark.createDataFrame([], "entity_id string") if df is None else features.distinct_entities(df)

    def day_counts(self, schema: FeatureSchema) -> DataFrame:
        """Rows per directory."""
        return self.scan(schema).groupBy("event_date").agg(F.count(F.lit(1)).alias("n_rows"))

    def listing(self, schema: FeatureSchema) -> DataFrame:
        """The data files in the columns of ``compaction.plan_merges``."""
        return list_files(self.spark, self.path(schema))

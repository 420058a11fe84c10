"""Totals per entity and day over a stream of log files, corrected by late messages.

A micro-batch takes out the messages that earlier ones have brought (exact quotient tables), merges the rest into the keyed
state, emits upserts and diverts what is too late. Both stores skip a batch that they have committed, so a batch that died
anywhere is replayed to the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import entity_key
from tidemark.operators import late
from tidemark.operators.dedup import has_id
from tidemark.operators.quotient import QuotientStore


class TotalsStream:
    def __init__(self, spark: SparkSession, folder: str, lateness_ms: int = late.LATENESS_MS) -> None:
        self.spark, self.folder, self.lateness_ms = spark, folder, lateness_ms
        self.state, self.seen = late.KeyedTotals(spark, f"{folder}/totals"), QuotientStore(spark, f"{folder}/seen")

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        if self.seen.log.latest()[1].get("batch", -1) >= batch_id:
            return  # both have it
        rows, n, doc = self.seen.prepare(batch.where(has_id()))
        rows = rows.withColumn("entity_id", entity_key("entity_id"))
        self.state.apply(late.classify(rows, self.lateness_ms), batch_id)
        self.seen.log.append(n, doc | {"batch": batch_id})

    def totals(self) -> DataFrame:
        return self.state.totals()

    def emissions(self) -> DataFrame:
        return self.state.emissions()

    def dropped(self) -> DataFrame:
        return self.state.dropped()

    def start(self, source: str, schema, max_files: int = 1) -> StreamingQuery:
        """Runs over the log files in ``source`` that are there and not yet done."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
        w = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.folder}/checkpoint")
        return w.trigger(availableNow=True).start()

"""Messages and their copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import entity_key


def has_id() -> Column:
    """A row has a message id when both parts are there."""
    return F.col("msg_id_ms").isNotNull() & F.col("msg_id_seq").isNotNull()


def kept_rows(log: DataFrame, fields: list[str]) -> DataFrame:
    """The kept row (smallest ``delivery_no``) of each message that has an id.

    Columns: ``msg_id_ms, msg_id_seq, entity_id`` (the entity) and ``fields`` of the kept row. One shuffle of narrow
    rows; copies collapse before it, so a message with very many copies costs one row per task. Rows with a null entity
    belong to one unnamed entity. A ``delivery_no`` that is null counts as the largest.
    """
    best = F.min(F.struct(F.col("delivery_no").isNull().alias("_n"), "delivery_no", *[F.col(f).alias(f"_f_{f}") for f in fields]))
    g = log.where(has_id()).groupBy("msg_id_ms", "msg_id_seq", entity_key("entity_id").alias("_e")).agg(best.alias("_k"))
    return g.select("msg_id_ms", "msg_id_seq", F.col("_e").alias("entity_id"), *[F.col(f"_k._f_{f}").alias(f) for f in fields])

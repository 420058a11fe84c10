"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups.

Waste comes from the last containers of each group only, so groups of some thousand items lose next to nothing against
one packing of everything, and each group is one small task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 8192
PLACED = "pack_name string, capacity_tokens int, bin_id string, doc_id bigint, piece int, start_token bigint, n_tokens int"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size (given largest first). The tree's nodes hold the greatest room of the bins below them."""
    leaves = 1 << max(1, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < s:
                node += 1
        out[i] = node - leaves
        room[node] -= s
        node >>= 1
        while node:
            top = max(room[2 * node], room[2 * node + 1])
            if room[node] == top:
                break
            room[node] = top
            node >>= 1
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bins = first_fit_decreasing(pdf["n_tokens"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
    group = int(pdf["grp"].iloc[0])
    return pdf.assign(bin_id=[f"{group}-{b}" for b in bins])[["pack_name", "capacity_tokens", "bin_id", "doc_id", "piece", "start_token", "n_tokens"]]


def pack(sizes: DataFrame, containers: DataFrame, group_items: int = GROUP_ITEMS, seed: int = 7) -> DataFrame:
    """Placement of every document in containers of each capacity.

    ``sizes``: doc_id (unique), n_tokens; ``containers``: pack_name, capacity_tokens, a short table that is read to the
    driver. A document is whole in one container unless it is larger than the capacity: then it is cut into full pieces,
    which have containers of their own, and a rest, which is packed like a document. Documents without tokens or id need
    no place; capacities that are null or not positive are left out. Groups are drawn by a seeded hash of the id, so
    their sizes vary little and no key can make one large.
    """
    kinds = [(r[0], r[1]) for r in containers.where(F.col("capacity_tokens") > 0).select("pack_name", "capacity_tokens").distinct().orderBy("pack_name", "capacity_tokens").collect()]
    some = sizes.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull())
    spark = sizes.sparkSession
    if not kinds:
        return spark.createDataFrame([], PLACED)
    groups = max(1, math.ceil(some.count() / group_items))
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("string").alias("pack_name"), F.lit(int(c)).alias("capacity_tokens")) for n, c in kinds]))
    rows = some.select("doc_id", F.col("n_tokens").alias("total"), each.alias("k")).select("doc_id", "total", "k.*")
    cap = F.col("capacity_tokens")
    last = F.call_function("div", F.col("total") - 1, cap)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
    rows = rows.select(
        "pack_name",
        "capacity_tokens",
        "doc_id",
        F.col("piece_no").cast("int").alias("piece"),
        (F.col("piece_no") * cap).alias("start_token"),
        F.least(cap.cast("bigint"), F.col("total") - F.col("piece_no") * cap).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).cast("int").alias("grp"),
    )
    full = rows.where(F.col("n_tokens") == cap).select("pack_name", "capacity_tokens", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", "start_token", "n_tokens")
    rest = rows.where(F.col("n_tokens") < cap).groupBy("pack_name", "capacity_tokens", "grp").applyInPandas(_pack, PLACED)
    return full.unionByName(rest)


def fill(placed: DataFrame) -> DataFrame:
    """Per container kind: containers used, the fewest possible (all tokens over the capacity), and the share of room used."""
    per = placed.groupBy("pack_name", "capacity_tokens").agg(F.count_distinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))
    fewest = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return per.select("*", fewest.alias("fewest_bins"), (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens"))).alias("fill"))

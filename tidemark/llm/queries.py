"""Queries of the text problems 8 to 10, each over its whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, residue, tokens


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source", "lang"])


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Where each document, or piece of a document larger than the capacity, goes."""
    return packing.pack(_sizes(spark, d), table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers of each kind are filled."""
    return packing.fill(p8_pack(spark, d))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must keep: per kind the documents placed, and faults: tokens lost, too full, split though it fits."""
    sizes = _sizes(spark, d)
    placed = packing.pack(sizes, table(spark, d, "pack_sizes"))
    per_doc = placed.groupBy("pack_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"))
    docs = per_doc.join(sizes.select("doc_id", F.col("n_tokens").alias("size")), "doc_id")
    split = F.col("pieces") != F.ceil(F.col("size") / F.col("capacity_tokens"))
    faults = docs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("placed") != F.col("size")).alias("n_lost"), F.count_if(split).alias("n_split"))
    bins = placed.groupBy("pack_name", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("room"))
    full = bins.groupBy("pack_name").agg(F.count_if(F.col("room") > F.col("capacity_tokens")).alias("n_overfull"))
    loose = packing.fill(placed).select("pack_name", (F.col("fill") < 0.95).alias("loose"))
    return faults.join(full, "pack_name").join(loose, "pack_name")


#: The domain of each source of ``mix_targets``: the tree that the mix is budgeted by.
DOMAINS = {
    "journal_dump": "published", "conference_src": "published", "scan_retypeset": "published", "errata_feed": "published", "referee_reports": "published",
    "preprint_mirror": "unpublished", "thesis_repo": "unpublished", "grant_reports": "unpublished", "lecture_notes": "unpublished",
}


def _mix(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    total = float(sizes.agg(F.sum("n_tokens")).first()[0] or 0) if whole else None
    leaves = mixing.budgets(sizes, targets, DOMAINS, total)
    return mixing.select(sizes, leaves), targets, leaves


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selection: each document with the number of times it is used."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(*_mix(spark, d))


def p9_short(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix as large as the corpus, at which sources are short and pass their rest on."""
    return mixing.shares(*_mix(spark, d, whole=True))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What every mix must keep, per target source: faults of repetition, and of the share (beyond 2 % and one document)."""
    mix, targets, leaves = _mix(spark, d)
    s = mixing.shares(mix, targets, leaves)
    largest = mix.groupBy("source").agg(F.max("n_tokens").alias("n"))
    goal = F.col("budget_share") * F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # a row per source
    off = F.abs(F.col("tokens") - goal) > 0.02 * goal + F.coalesce("n", F.lit(0))
    return s.join(largest, "source", "left").select("source", (F.col("most_uses") > F.col("max_repeats")).alias("too_often"), off.alias("off_target"), (F.col("n_docs") == 0).alias("absent"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.scored(table(spark, d, "documents")).where("residue").select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without residue, without its texts."""
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "source", F.lower("lang").alias("lang"), "n_chars")


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validation(table(spark, d, "documents"))


def p10_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every record comes out once, as residue or not; those without text never as residue."""
    docs = table(spark, d, "documents")
    got = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(residue.scored(docs), "doc_id", "left")
    return got.agg(F.count(F.lit(1)).alias("n_docs"), F.count("residue").alias("n_judged"), F.count_if(F.col("residue") & (F.col("n") == 0)).alias("n_wrong"))


QUERIES = {
    f.__name__: f
    for f in (p8_pack, p8_fill, p8_invariants, p9_mix, p9_shares, p9_short, p9_invariants, p10_found, p10_clean, p10_validation, p10_invariants)
}
SQL = {
    "p8_invariants": """
select pack_name, (select count(*) from documents where text is not null and text <> '') n_docs, 0::bigint n_lost, 0::bigint n_split, 0::bigint n_overfull, false loose
from pack_sizes""",
    "p9_invariants": """
select t.source, false too_often, false off_target, not exists (select 1 from documents d where d.source = t.source and d.text is not null and d.text <> '') absent
from mix_targets t""",
    "p10_invariants": "select count(*) n_docs, count(*) n_judged, 0::bigint n_wrong from documents",
}

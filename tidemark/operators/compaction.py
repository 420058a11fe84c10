"""Consolidating small files.

Files are planned from their listings, assigned to output groups by balanced longest-first scheduling, and each group is
streamed through pyarrow into one file. The list of files that count, the manifest, is replaced by one commit after the row
counts of all outputs have been verified.
"""

from __future__ import annotations

import heapq
import uuid
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import CommitLog, Folder

SMALL_BYTES = 65_536
TARGET_BYTES = 128 << 20
#: About so many files are scheduled by one heap.
CHUNK_FILES = 20_000


def latest_listings(listings: DataFrame) -> DataFrame:
    """The latest listing (greatest ``listed_ms``, then ``listing_no``) of each file; a file without number is ignored."""
    cols = [c for c in listings.columns if c not in ("file_no", "listed_ms", "listing_no")]
    best = F.max_by(F.struct(*cols), F.struct("listed_ms", "listing_no"))
    return listings.where(F.col("file_no").isNotNull()).groupBy("file_no").agg(best.alias("_l")).select("file_no", *[F.col(f"_l.{c}").alias(c) for c in cols])


def path_partition(path: Column) -> Column:
    """The event_date in a path, percent-decoded; null when the path has none or is malformed."""
    raw = F.regexp_extract(path, r"(?:^|/)event_date=([^/]*)/", 1)
    return F.when(raw != "", F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def small_files(listings: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Files whose latest listing is live, complete, not empty, of known size and small: file_no, file_path, part, n_rows, n_bytes."""
    directories = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    ok = F.col("replaced_by").isNull() & (F.col("n_rows") > 0) & (F.col("n_bytes") < small_bytes) & ~F.array_contains(directories, "_tmp")
    return latest_listings(listings).where(ok).select("file_no", "file_path", path_partition(F.col("file_path")).alias("part"), "n_rows", "n_bytes").where(F.col("part").isNotNull())


def _schedule(pdf: pd.DataFrame, target: int) -> pd.DataFrame:
    """Longest first onto the least loaded of a fixed number of groups; ties by number, so that plans repeat."""
    pdf = pdf.sort_values(["n_bytes", "file_no"], ascending=[False, True], kind="stable")
    n = max(1, -(-int(pdf["n_bytes"].sum()) // target))
    heap = [(0, g) for g in range(min(n, len(pdf)))]
    groups = []
    for size in pdf["n_bytes"]:
        load, g = heap[0]
        groups.append(g)
        heapq.heapreplace(heap, (load + int(size), g))
    return pdf.assign(group_no=groups)[["part", "chunk_no", "group_no", "file_no", "file_path", "n_rows", "n_bytes"]]


PLAN = "part string, chunk_no int, group_no int, file_no bigint, file_path string, n_rows int, n_bytes bigint"


def plan_merges(listings: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, chunk_files: int = CHUNK_FILES) -> DataFrame:
    """Assignment of every file to be merged to an output: part, chunk_no, group_no and the file.

    A partition with one small file is left alone. A partition with very many files is cut by file number into chunks of
    about ``chunk_files``, drawn by a hash of the number, and each chunk has its own heap. Partitions are counted first; the
    counts travel by an ordinary join.
    """
    small = small_files(listings, small_bytes)
    per = small.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    chunks = F.greatest(F.call_function("div", F.col("_n"), F.lit(chunk_files)), F.lit(1))
    rows = small.join(per, "part").withColumn("chunk_no", F.pmod(F.xxhash64("file_no"), chunks).cast("int"))
    return rows.select("part", "chunk_no", "file_no", "file_path", "n_rows", "n_bytes").groupBy("part", "chunk_no").applyInPandas(lambda pdf: _schedule(pdf, target_bytes), PLAN)


MERGED = "part string, output string, n_files int, n_rows bigint, n_bytes bigint"


def _merge(root: str):
    """Streams a group's files into one and verifies its rows. The folder is named by the encoded partition, whatever it holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
        part, chunk, group = pdf["part"].iloc[0], int(pdf["chunk_no"].iloc[0]), int(pdf["group_no"].iloc[0])
        name = f"event_date={quote(part, safe='')}/merged-{chunk:05d}-{group:05d}-{uuid.uuid4().hex}.parquet"
        path = f"{base}/{name}"
        fs.create_dir(path.rsplit("/", 1)[0])
        writer, rows = None, 0
        try:
            for p in pdf.sort_values("file_no")["file_path"]:
                with fs.open_input_file(f"{base}/{p}") as source, pq.ParquetFile(source) as f:
                    for batch in f.iter_batches():
                        if writer is None:
                            writer = pq.ParquetWriter(path, batch.schema, compression="zstd", filesystem=fs)
                        writer.write_batch(batch.cast(writer.schema) if batch.schema != writer.schema else batch)
                        rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        with fs.open_input_file(path) as out, pq.ParquetFile(out) as f:
            written = f.metadata.num_rows
        if written != rows:
            raise OSError(f"{name}: {written} rows written, {rows} read")
        return pd.DataFrame({"part": [part], "output": [name], "n_files": [len(pdf)], "n_rows": [rows], "n_bytes": [fs.get_file_info(path).size]})

    return run


class CompactionTable:
    """A folder of Parquet files whose live members are named by a manifest.

    A manifest is a table of file names under ``manifests``; a numbered commit says which one counts. ``merge`` runs a plan
    and publishes it; until then readers see the old files, afterwards the new ones, and of two merges of one manifest one
    wins. No list of files passes through the driver but that of the files a reader opens. Attempts that fail leave unlisted
    files, which ``vacuum`` removes.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(Folder(spark, self.root).sub("_manifest"))

    def files(self) -> DataFrame:
        """Names of the live files: file_path."""
        _, doc = self.log.latest()
        schema = "file_path string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/_manifest/{doc['files']}") if doc else self.spark.createDataFrame([], schema)

    def _publish(self, n: int, files: DataFrame) -> None:
        name = f"files-{n:08d}-{uuid.uuid4().hex}"
        files.select("file_path").write.parquet(f"{self.root}/_manifest/{name}")
        self.log.append(n, {"files": name})

    def init(self, files: DataFrame) -> None:
        """Replaces what counts by these files (file_path)."""
        self._publish(self.log.latest()[0] + 1, files)

    def merge(self, plan: DataFrame) -> dict:
        """Merges the plan's groups of live files. Rows in and out must agree, file by file and in all."""
        n, live = self.log.latest()[0] + 1, self.files()
        # the plan's inputs and outputs are written once, so that what is published is what was merged
        work = f"{self.root}/_manifest/work-{uuid.uuid4().hex}"
        plan.join(live, "file_path", "left_semi").write.parquet(f"{work}/plan")
        plan = self.spark.read.parquet(f"{work}/plan")
        plan.groupBy("part", "chunk_no", "group_no").applyInPandas(_merge(self.root), MERGED).write.parquet(f"{work}/done")
        done = self.spark.read.parquet(f"{work}/done")
        merged = done.agg(F.sum("n_rows"), F.sum("n_files"), F.count(F.lit(1))).first()
        planned = plan.agg(F.sum("n_rows"), F.count(F.lit(1)), F.count_distinct("file_no")).first()
        if planned[1] and (merged[0] != planned[0] or merged[1] != planned[1] or planned[1] != planned[2]):
            raise OSError(f"merged {merged[0]} rows of {merged[1]} files; the listings say {planned[0]} of {planned[1]}")
        after = live.join(plan.select("file_path"), "file_path", "left_anti").unionByName(done.select(F.col("output").alias("file_path")))
        self._publish(n, after)
        return {"version": n, "merged": planned[1], "outputs": merged[2], "rows": planned[0] or 0}

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The live files, or those of some partitions (decoded); the list of files opened is the driver's, as in any Spark scan."""
        files = self.files()
        if parts is not None:
            files = files.where(path_partition(F.col("file_path")).isin(*parts))
        return self.spark.read.option("basePath", self.root).parquet(*[f"{self.root}/{r[0]}" for r in files.toLocalIterator()])

    def vacuum(self) -> int:
        """Removes merged files that the manifest does not name; returns how many."""
        fs, base = pafs.FileSystem.from_uri(self.root) if ":" in self.root else (pafs.LocalFileSystem(), self.root)
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if x.base_name.startswith("merged-")]
        have = self.spark.createDataFrame([(x[len(base) + 1 :],) for x in found], "file_path string")
        gone = have.join(self.files(), "file_path", "left_anti").collect()
        for r in gone:
            fs.delete_file(f"{base}/{r[0]}")
        return len(gone)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The data files under a folder in the columns of ``plan_merges``; rows are counted from the footers, in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").option("recursiveFileLookup", "true").load(root)

    def counted(batches):
        for pdf in batches:
            rows = []
            for x in pdf["path"]:
                fs, name = pafs.FileSystem.from_uri(x)
                with fs.open_input_file(name) as f:
                    rows.append(pq.ParquetFile(f).metadata.num_rows)
            yield pdf.assign(n_rows=rows)

    got = files.select("path", F.col("length").alias("n_bytes"), F.unix_millis("modificationTime").alias("listed_ms")).mapInPandas(counted, "path string, n_bytes bigint, listed_ms bigint, n_rows int")
    path = F.regexp_extract("path", r"(event_date=[^/]*/[^/]*)$", 1)
    return got.select(path.alias("file_path"), "n_rows", "n_bytes", "listed_ms", F.lit(None).cast("bigint").alias("replaced_by"), F.xxhash64("path").alias("file_no"), F.lit(0).cast("bigint").alias("listing_no"))


def compacted(log: DataFrame, listings: DataFrame, **options) -> DataFrame:
    """The rows of ``log`` with the output that each goes to: every message of every entity once.

    ``out_part, out_chunk, out_group`` are null for rows whose file is not merged. Copies of a message (see
    ``quotient.distinct_messages``) are taken out on the way.
    """
    from tidemark.operators.quotient import distinct_messages

    plan = plan_merges(listings, **options).select("file_no", F.col("part").alias("out_part"), F.col("chunk_no").alias("out_chunk"), F.col("group_no").alias("out_group"))
    return distinct_messages(log).join(plan, "file_no", "left")

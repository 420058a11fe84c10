"""What the operators need of a session: the package on the workers, and the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors once per application.

    Needed where the executors' path does not have it, as on a cluster without an installed package.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tidemark_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all machines see: the checkpoint folder that the cluster names.

    Where none is set, one machine may use a temporary folder; on several the setting is required.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tidemark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """A copy in the shared folder: costly columns are computed once and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

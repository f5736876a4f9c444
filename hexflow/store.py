"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet to the folder named in ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs one re-read and never a recomputation of earlier stages.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from hexflow.session import ship_package

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: On a local disk Hadoop starts a process (chmod) for the folder of each task, each file and its checksum file; until it has
#: begun, such a process counts as a second copy of the executor.  Files alone need two of the three.  Other stores don't read this.
#: The rest is a matter of how many files there are: see ``files_for``.
_ALONE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def files_for(rows: int, each: int) -> int:
    """How many files a table of at most ``rows`` rows needs at ``each`` rows a file."""
    return max(1, -(-rows // each))


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a local session gets a folder of its own and a cluster an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hexflow-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


class Scratch:
    """Tables of one run under a folder of its own; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        ship_package(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, options: dict[str, int] | None = None, conf: dict[str, str] | None = None, files: int | None = None) -> DataFrame:
        """Writes (with the writer's ``options``, under the session's ``conf``) and rereads ``df``; its shuffle files go once it is written, since nothing reads them again.

        With ``files``, at most so many tasks write: each reads several partitions, so it is for tables whose last step is cheap.
        """
        path = f"{self.base}/{name}"
        df = df.coalesce(files) if files else df
        asked = {_CLEANUP: "true"} | (conf or {})
        kept = {k: self.spark.conf.get(k, None) for k in asked}
        try:
            for k, v in asked.items():
                self.spark.conf.set(k, v)
            self._write(df, path, partition_by, options or {})
        finally:
            for k, v in kept.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, df: DataFrame, path: str, partition_by: list[str] | None, options: dict[str, int]) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd").options(**_ALONE, **options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Working tables: results that are computed once, written to the folder all executors share, and read again."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: ``spark.checkpoint.dir`` of the session.

    Only a session on local[n] (tests) that names none gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the class of its paths."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


#: Inputs of up to so many bytes for each core are dealt out anew.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files are small: one piece of a file (a row group) is read by one task.

    Larger inputs have more pieces than there are cores, and are left as they are.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) <= cores * SPREAD_BYTES
    return df.repartition(cores) if small and plan.toRdd().getNumPartitions() <= cores else df


class Staging(threading.local):
    """The working tables that each thread has made; a run deletes its own only."""

    def __init__(self) -> None:
        self.tables: dict[str, str | None] = {}

    def new_path(self, spark: SparkSession, name: str, table: str | None = None) -> str:
        """A folder for a working table, and the name that the catalog has for it, if any."""
        path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
        self.tables[path] = table
        return path

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

        A lost executor costs a re-read of the files and no recomputation of what led to them.
        """
        spark = df.sparkSession
        path = self.new_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out.working_path = path
        return out

    def bucketed(self, df: DataFrame, name: str, column: str, dealt: bool = False) -> DataFrame:
        """Like ``written``, but bucketed by ``column``: later joins on it shuffle only the other side.

        ``dealt`` says that an aggregation or join on the column has dealt the rows out already.
        """
        spark = df.sparkSession
        table = "docloom_" + uuid.uuid4().hex
        path = self.new_path(spark, name, table)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df if dealt else df.repartition(n, column)
        rows.write.bucketBy(n, column).option("compression", "zstd").option("path", path).saveAsTable(table)
        out = spark.table(table)
        out.working_path = path
        return out

    def _delete(self, spark: SparkSession, path: str) -> None:
        table = self.tables.pop(path, None)
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        fs, kind = file_system(spark, path)
        fs.delete(kind(path), True)

    def discard(self, *tables: DataFrame) -> None:
        """Delete working tables that nothing unwritten reads any more."""
        for df in tables:
            self._delete(df.sparkSession, df.working_path)

    def release(self, spark: SparkSession) -> None:
        """Delete all of this thread's working tables: call it once what was built on them is written itself."""
        for path in [*self.tables]:
            self._delete(spark, path)


#: The library's own working tables.
library = Staging()

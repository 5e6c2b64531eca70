"""Session settings shared by the pipelines, the tests and the benchmark."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("genomeframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master; on a cluster a missing
    setting is an error, since executors would not share the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="genomeframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage where several branches use one result: the branches plan
    against a table with known size and pruned columns, and a lost executor
    costs a re-read instead of a recomputation.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a table to the shared folder in buckets of ``key``, as many as there are shuffle partitions.

    Joins and aggregations by the key read it where it is; only the other side is shuffled.
    """
    spark = df.sparkSession
    number = uuid.uuid4().hex
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{number}"
    table = f"{name.replace('-', '_')}_{number}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    written = spark.table(table)
    written.written_path, written.table_name = path, table
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` or ``bucketed`` returned and nothing reads any more.

    Spark frees the shuffle files behind them once the driver's garbage collector finds
    their datasets gone, so it is asked to look.
    """
    for df in tables:
        if getattr(df, "table_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        gateway = df.sparkSession.sparkContext._jvm
        path = gateway.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()

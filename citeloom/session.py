"""Session settings and the few helpers that decide physical layout."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "citeloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster pass the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``, or a fresh local folder where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[app]


def new_location(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/citeloom-{uuid.uuid4().hex[:12]}/{name}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = new_location(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LOCAL_ROWS = 500_000


def pinned(df: DataFrame, name: str, local: bool) -> DataFrame:
    """Cut lineage of a short table. With ``local``, for which the caller has counted what bounds it, its rows become part of
    later plans (LOCAL_ROWS at most); otherwise, or if there are more, it is written."""
    if local:
        rows = df.limit(LOCAL_ROWS + 1).toArrow()
        if rows.num_rows <= LOCAL_ROWS:
            return df.sparkSession.createDataFrame(rows, schema=df.schema)
    return materialise(df, name)


UNKNOWN_BYTES = 1 << 60
BUCKET_BYTES = 16 << 20  # of a compressed table: what a task groups and sorts is many times larger
LEAST_BUCKETS, MOST_BUCKETS = 8, 65_536


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None) -> int:
    """Write a table below ``path`` bucketed and sorted by ``key``, with as many buckets as its size asks for; the number of
    buckets has to be kept to read it back."""
    buckets = buckets or pieces_of(df, BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS)
    table = f"citeloom_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
       .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    df.sparkSession.sql(f"DROP TABLE {table}")  # an external table: its files stay
    return buckets


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table as ``write_bucketed`` left it: later joins and groupings on a key set that holds ``key`` need no exchange, and
    a lookup on ``key`` reads one bucket."""
    table = f"citeloom_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def materialise_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Cut lineage by writing a bucketed table to the shared folder and reading it back."""
    path = new_location(df.sparkSession, name)
    return read_bucketed(df.sparkSession, path, key, write_bucketed(df, path, key))


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """Hint a broadcast only for a side whose size was checked; otherwise leave the join to
    Catalyst (sort-merge with AQE skew handling)."""
    return F.broadcast(df) if small else df


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


SMALL_TASK_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input that is read in too few splits: one too small by the
    optimizer's own estimate, a few large files, or the files of a streaming batch, whose size no plan knows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = plan_bytes(df)
    if size < cores * SMALL_TASK_BYTES:
        return df.repartition(cores)
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores if size >= UNKNOWN_BYTES else -(-size // SMALL_TASK_BYTES))


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a frame reads, by the optimizer's own figures. (Its estimate of a join's result multiplies both
    sides and is no use for a layout.) Rows without known size count as UNKNOWN_BYTES or more."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def pieces_of(df: DataFrame, piece_bytes: int, least: int, most: int) -> int:
    """How many pieces of about ``piece_bytes`` a table should have: by its size, never by a session's number of partitions."""
    size = plan_bytes(df)
    return least if size >= UNKNOWN_BYTES else min(most, max(least, -(-size // piece_bytes)))

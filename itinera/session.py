"""Session, table access, size-checked broadcasts and shared checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side counts as small once it has been counted.
BROADCAST_ROWS = 50_000
#: Bytes of its values up to which it does.
BROADCAST_BYTES = 16 << 20


def get_session(name: str = "itinera", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.appName(name)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; elsewhere
    a machine-local folder would lose data with its machine, so that is an error.  The
    temporary folder is deleted when Python ends.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = found.get() if found.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        known = tempfile.mkdtemp(prefix="itinera-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if a count proves at most ``most`` rows and ``most_bytes`` bytes, else unmarked.

    Past a bound the join shuffles and adaptive execution splits skewed partitions.  The
    count works ``df`` out once more, up to the bound; cut an expensive side first.
    """
    return F.broadcast(df) if is_small(df, most, most_bytes) else df


def is_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes (texts and nested values as they are long, others eight each)."""
    width = F.lit(8 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`").alias("v")))), F.lit(0))
    found = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return found["n"] <= most and found["b"] <= most_bytes


def salt(column: Column, salts: int) -> Column:
    """A subgroup number in 0..salts-1 that depends on the value alone."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")

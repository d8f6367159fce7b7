"""Writers of the domain's results."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions.transit import day_clock_of
from itinera.operators.prep import upsert
from itinera.session import small


#: Encodings that Spark reads and writes itself; texts in other one-byte encodings pass through ISO-8859-1, letter by letter.
NATIVE_ENCODINGS = {"utf-8", "iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def write_csv(df: DataFrame, path: str, append: bool = False, sep: str = ",", encoding: str = "UTF-8") -> None:
    """Header CSV with texts as they are, blanks at their ends too; letters that a one-byte encoding lacks become question marks."""
    native = encoding.lower() in NATIVE_ENCODINGS
    if not native:
        high = bytes(range(128, 256))
        there = [(c, l) for c, l in zip(high.decode(encoding, "replace"), high.decode("latin-1"), strict=True) if c != "\ufffd"]
        known, twins = ("".join(x) for x in zip(*there, strict=True))
        # Letters of neither kind first, then the known ones by their byte's letter.
        clean = lambda c: F.translate(F.regexp_replace(c, f"[^\\x00-\\x7f{known}]", "?"), known, twins).alias(c)
        df = df.select(*[clean(n) if kind == "string" else F.col(n) for n, kind in df.dtypes])
    write = df.write.mode("append" if append else "overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", encoding if native else "ISO-8859-1").csv(path)


def load_table(df: DataFrame, path: str, required: Sequence[str] = (), force: bool = False) -> None:
    """Loads once: an existing table is kept unless ``force`` replaces it; rows without a required column are left out."""
    df.dropna(subset=list(required)).write.mode("overwrite" if force else "ignore").parquet(path)


def insert_or_ignore(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> None:
    """The existing rows and those new ones whose key is new; ``path`` must differ from where ``existing`` lies."""
    upsert(new, keys, order, existing=existing).write.mode("overwrite").parquet(path)


def insert_or_replace(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> None:
    upsert(new, keys, order, last=True, existing=existing).write.mode("overwrite").parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a folder or file in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def _written(spark: SparkSession, path: str, by: Sequence[str]) -> list[tuple[str | None, ...]]:
    """Values of the partition folders below ``path``, from their names."""
    fs, where = hadoop(spark, "/".join([path, *[f"{c}=*" for c in by]]))
    found = fs.globStatus(where) or []
    values = [[part.split("=", 1)[1] for part in str(f.getPath().toString()).split("/")[-len(by) :]] for f in found]
    return [tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for v in row) for row in values]


def write_json_partitions(df: DataFrame, path: str, by: Sequence[str] = ("date", "airport"), replace: bool = False) -> None:
    """A folder per value, each written once: what exists is kept, or with ``replace`` exchanged, and other folders stay as they are."""
    if replace:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)
        return
    there = _written(df.sparkSession, path, by)
    if there:
        known = df.sparkSession.createDataFrame(there, ", ".join(f"_{c} string" for c in by))
        same = [F.col(c).cast("string").eqNullSafe(F.col(f"_{c}")) for c in by]
        df = df.join(small(known), same, "left_anti")
    df.write.mode("append").partitionBy(*by).json(path)


def write_result(paths: DataFrame, path: str, seconds: float, countries: str = "countries", start: str = "start") -> None:
    """A search's result: the paths, and beside them one row of metrics."""
    paths.write.mode("overwrite").parquet(f"{path}/paths")
    kept = paths.sparkSession.read.parquet(f"{path}/paths")
    kept.agg(F.count("*").alias("paths"), F.max(countries).alias("global_max"), F.countDistinct(start).alias("starts"), F.lit(float(seconds)).alias("seconds")).write.mode("overwrite").parquet(f"{path}/metrics")


def write_snapshot(labels: DataFrame, path: str, number: int, done: bool = False) -> None:
    """A numbered snapshot that is there as a whole or not at all; ``done`` leaves a flag that no other follows."""
    spark = labels.sparkSession
    fs, last = hadoop(spark, f"{path}/snapshot={number}")
    _, draft = hadoop(spark, f"{path}/_draft-{number}")
    labels.write.mode("overwrite").parquet(draft.toString())
    fs.delete(last, True)
    if not fs.rename(draft, last):
        raise OSError(f"snapshot {number} can't be put in place")
    if done:
        fs.create(hadoop(spark, f"{path}/_DONE")[1], True).close()


def write_checkpoint(routes: DataFrame, path: str, floor: int = 14) -> None:
    """score, route of those at the floor or at the most there is, as JSON."""
    most = routes.agg(F.max("score").alias("_m"))
    routes.join(F.broadcast(most)).where((F.col("score") >= floor) | (F.col("score") == F.col("_m"))).drop("_m").write.mode("overwrite").json(path)


def append_route_lines(routes: DataFrame, path: str, job: str = "job_idx") -> None:
    """One route a line, a folder a job, added to what is there."""
    routes.write.mode("append").partitionBy(job).json(path)


def write_elite(routes: DataFrame, path: str, rows_in_file: int = 5_000_000) -> None:
    """The elite route table: snappy Parquet, files of bounded rows, sorted within for pruning by start."""
    routes.sortWithinPartitions("start_node").write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_in_file).parquet(path)


def write_report(itinerary: DataFrame, text_path: str, json_path: str, key: str = "route_id") -> None:
    """Step by step texts, a line a step, and the same rows as JSON."""
    itinerary.write.mode("overwrite").json(json_path)
    line = F.concat_ws(" | ", F.col(key).cast("string"), F.col("pos").cast("string"), F.concat_ws(" -> ", "origin", "dest"), "mode", F.concat_ws(" - ", "departs", "arrives"), day_clock_of(F.col("elapsed")))
    itinerary.repartition(key).sortWithinPartitions(key, "pos").select(line.alias("value")).write.mode("overwrite").text(text_path)


def country_bits(countries: DataFrame, column: str) -> DataFrame:
    """country and its bit by sorted name; a mask holds at most 63."""
    names = sorted(r[0] for r in countries.where(F.col(column).isNotNull()).select(column).distinct().limit(64).collect())
    if len(names) > 63:
        raise ValueError("a mask of 64 bits holds at most 63 countries")
    return countries.sparkSession.createDataFrame([(n, 1 << i) for i, n in enumerate(names)], "country string, bit bigint")

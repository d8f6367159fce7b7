"""Readers of the domain's files; every one takes a schema, so nothing is scanned to infer one."""

from __future__ import annotations

import sqlite3
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from itinera.functions.transit import ROUTE_TYPE, decimal_comma
from itinera.sources.sinks import NATIVE_ENCODINGS, exists, hadoop

FLIGHT_DOC = (
    "flight struct<iataNumber:string,number:string>, departure struct<iataCode:string,scheduledTime:string,estimatedTime:string>, "
    "arrival struct<iataCode:string,scheduledTime:string>, status string"
)
AIRPORTS = (
    "id int, ident string, type string, name string, latitude_deg string, longitude_deg string, elevation_ft string, continent string, iso_country string, iso_region string, "
    "municipality string, scheduled_service string, icao_code string, iata_code string, gps_code string, local_code string, home_link string, wikipedia_link string, keywords string"
)
TRAIN_ROUTES = "route_origin string, route_destination string, search_date string, departure_time string, arrival_time string, legs string"
CONNECTIONS = "Origin string, Destination string, connection_time int"
GTFS = {"stops": "stop_id string, stop_name string, stop_lat double, stop_lon double", "trips": "trip_id string", "stop_times": "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string"}


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Header CSV; columns by name; bad bytes become replacement characters, bad rows null fields."""
    native = encoding.lower() in NATIVE_ENCODINGS
    read = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding if native else "ISO-8859-1").option("quote", '"').option("escape", '"')
    df = read.option("enforceSchema", False).csv(path)
    if native:
        return df
    high = bytes(range(128, 256))
    there = high.decode(encoding, "replace")
    return df.select(*[F.translate(n, high.decode("latin-1"), there).alias(n) if kind == "string" else F.col(n) for n, kind in df.dtypes])


def probed_encoding(spark: SparkSession, path: str, tried: Sequence[str] = ("utf-8-sig", "utf-8", "cp1250", "latin-1")) -> str:
    """The first encoding that decodes the first line of a file, in whichever store it lies; no more than that line is read."""
    fs, where = hadoop(spark, path)
    stream, line = fs.open(where), b""
    try:
        while b"\n" not in line and (more := bytes(stream.readNBytes(1 << 16))):
            line += more
    finally:
        stream.close()
    line = line.split(b"\n", 1)[0]
    for name in tried:
        try:
            line.decode(name)
        except UnicodeDecodeError:
            continue
        return {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}.get(name, name.upper() if name == "utf-8" else name)
    return "ISO-8859-1"


def airports_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolons, Central European encoding, decimal commas; blank and broken numbers are null."""
    raw = csv(spark, path, AIRPORTS, sep=";", encoding="cp1250")
    return raw.withColumns({"latitude_deg": decimal_comma(F.col("latitude_deg")), "longitude_deg": decimal_comma(F.col("longitude_deg")), "elevation_ft": F.trim("elevation_ft").try_cast("int")})


def cities_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The positional city file: name, ascii name, alternates, country, population; short rows are left out."""
    parts = F.split("value", "\t", -1)
    raw = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 15)
    return raw.select(F.col("p")[1].alias("name"), F.col("p")[2].alias("ascii_name"), F.nullif(F.col("p")[3], F.lit("")).alias("alternate_names"), F.col("p")[8].alias("country"), F.coalesce(F.col("p")[14].try_cast("bigint"), F.lit(0)).alias("population"))


def flight_documents(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """Raw flight documents under {root}/{date}/{airport}.json with their date and airport; a date reads its folder alone."""
    docs = spark.read.schema(FLIGHT_DOC).option("multiLine", True).json(f"{root}/{date or '*'}/*.json").withColumn("_f", F.input_file_name())
    return docs.withColumns({"date": F.regexp_extract("_f", r"([^/]+)/[^/]+\.json$", 1), "airport": F.regexp_extract("_f", r"([^/]+)\.json$", 1)}).drop("_f").where("departure is not null")


def flatten_flights(raw: DataFrame, *keep: str) -> DataFrame:
    """Flat flights: number by code or plain number, upper case; rows without a key part are left out; delay in whole minutes."""

    def code(c: str):
        return F.nullif(F.upper(F.trim(c)), F.lit(""))

    def when(c: str):
        t = F.regexp_replace(F.col(c), "[tT]", "T")
        return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")))

    flat = raw.select(
        *keep, F.coalesce(code("flight.iataNumber"), code("flight.number")).alias("flight_number"), code("departure.iataCode").alias("departure_airport"), code("arrival.iataCode").alias("arrival_airport"),
        F.col("departure.scheduledTime").alias("departure_scheduled"), F.col("departure.estimatedTime").alias("departure_estimated"), F.col("arrival.scheduledTime").alias("arrival_scheduled"), "status",
    )
    delay = ((F.unix_seconds(when("departure_estimated")) - F.unix_seconds(when("departure_scheduled"))) / 60).cast("int")
    return flat.withColumn("departure_delay_minutes", delay).dropna(subset=["flight_number", "departure_airport", "arrival_airport", "departure_scheduled"])


def checkpoint_routes(spark: SparkSession, path: str, a_line: bool = False) -> DataFrame:
    """score, ord, route of checkpoint documents {"routes": {"14": [[segment, ...], ...]}}, one a file or ``a_line``."""
    raw = spark.read.schema(f"global_max int, nodes_explored bigint, elapsed_seconds double, routes map<string,array<{ROUTE_TYPE}>>").option("multiLine", not a_line).json(path)
    return raw.select(F.explode("routes").alias("score", "list")).select(F.col("score").try_cast("int").alias("score"), F.posexplode("list").alias("ord", "route"))


def route_lines(spark: SparkSession, path: str) -> DataFrame:
    """score, route, file, block, line of one route a line; blank lines are skipped.

    Within a file, (block, line) rises in the order of the lines, so the first of equal routes can be told.
    """
    rows = spark.read.schema(f"score int, route {ROUTE_TYPE}").json(path)
    return rows.select("*", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where("route is not null")


def graph_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a stored graph that are there, in whichever store."""
    return {t: spark.read.parquet(f"{root}/{t}") for t in ("nodes", "sched_edges", "transfers", "events", "aon_edges") if exists(spark, f"{root}/{t}")}


def gtfs(spark: SparkSession, archive: str, folder: str) -> dict[str, DataFrame]:
    """The feed's tables; ids stay text.  The archive is unpacked into ``folder``, which executors must share."""
    with zipfile.ZipFile(archive) as z:
        for name in GTFS:
            z.extract(f"{name}.txt", folder)
    out = {}
    for name, schema in GTFS.items():
        want = [f.split()[0] for f in schema.split(", ")]
        raw = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
        out[name] = raw.select(*[F.col(c).try_cast(schema.split(", ")[i].split()[1]).alias(c) for i, c in enumerate(want)])
    return out


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...)``: a table in ranges of its row ids.

    Options: parts (8).  The file must be readable by the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "FLOAT": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            info = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not info:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {kinds.get(kind.upper().split('(')[0], 'string')}" for _, name, kind, *_ in info)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options), [f.name for f in schema.fields], [f.dataType.simpleString() for f in schema.fields])


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str], kinds: list[str]) -> None:
        self.options, self.columns, self.kinds = options, columns, kinds

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            lo, hi = c.execute(f'select min(rowid), max(rowid) from "{self.options["table"]}"').fetchone()
        if lo is None:
            return [InputPartition((0, -1))]
        step = max(1, -(-(hi - lo + 1) // int(self.options.get("parts", 8))))
        return [InputPartition((a, min(a + step - 1, hi))) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cast = {"bigint": lambda v: int(v) if v is not None else None, "double": lambda v: float(v) if v is not None else None}
        to = [cast.get(k, lambda v: None if v is None else str(v)) for k in self.kinds]
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            for row in c.execute(f'select {names} from "{self.options["table"]}" where rowid between ? and ?', partition.value):
                yield tuple(f(v) for f, v in zip(to, row, strict=True))


def sqlite(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("parts", str(parts)).load()

"""The llm problems over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions.text import alnum_key, letters_digits_key, not_blank
from itinera.llm.entity_match import meant_values, station_lists
from itinera.llm.formatting_dups import duplicate_groups, duplicate_rows, encode
from itinera.llm.mixing import mix, share_report
from itinera.llm.packing import fill_report, pack
from itinera.llm.reading import fit_on, levels
from itinera.llm.tokens import token_counts
from itinera.llm.topn import top_n
from itinera.operators.shred import stop_rows
from itinera.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n(table(spark, d, "master_elite_routes_full"), "start_node", "rqi_score", "route_id", 5, not_scores=(-999.0,))
    return best.select("start_node", "place", "route_id")


#: The canonical form of each field that makes flights equal.
FLIGHT_FORMS = {"flight_number": letters_digits_key, "departure_airport": alnum_key, "departure_scheduled": alnum_key, "arrival_airport": alnum_key}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_rows(encode(table(spark, d, "flights"), "id", FLIGHT_FORMS)).select(F.col("id_a").cast("bigint"), F.col("id_b").cast("bigint"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: its smallest id and its number of copies."""
    return duplicate_groups(encode(table(spark, d, "flights"), "id", FLIGHT_FORMS)).select("first_id", "copies")


def _typed_places(spark: SparkSession, d: str) -> DataFrame:
    """route_id, field, stop_no, value of every place that was typed."""
    routes = table(spark, d, "train_routes")
    ends = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("route_origin", "route_destination")])
    typed = routes.select(F.col("id").alias("route_id"), F.inline(ends)).select("route_id", "field", F.lit(0).cast("bigint").alias("stop_no"), "value")
    stops = stop_rows(routes, "id", ["legs_with_countries"], ["station"], every_entry=False).select(F.col("id").alias("route_id"), F.col("source").alias("field"), F.col("stop_no").cast("bigint"), F.col("station").alias("value"))
    return typed.unionByName(stops).where(not_blank(F.col("value")))


def _matched_places(spark: SparkSession, d: str) -> DataFrame:
    lists = station_lists(table(spark, d, "stations"), table(spark, d, "cities"), table(spark, d, "country_zones"))
    return meant_values(_typed_places(spark, d), "value", lists)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched_places(spark, d).where("station_name is not null").select("route_id", "field", "stop_no", "station_name")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report: values that mean no station, with how often they were typed."""
    return _matched_places(spark, d).where("station_name = ''").groupBy("field", "value").agg(F.count("*").alias("times"))


#: Tokens that a container holds.
CAPACITY = 4096


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each article's container; one row, or a row per piece of an article beyond the capacity."""
    return _packed(spark, d).select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, unused share and the lower bound on containers."""
    return fill_report(_packed(spark, d), CAPACITY)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text", keep=("source",))
    return mix(sizes, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mixed(spark, d).select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual share of each source beside its target."""
    return share_report(_mixed(spark, d), table(spark, d, "mix_targets"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return levels(documents, fit_on(documents, table(spark, d, "reading_labels")), keep=("lang",))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each document's reading level with the difficulty behind it."""
    return _levels(spark, d).drop("lang")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by language (two letters, "" if not stated) and level."""
    lang = F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("")).alias("lang")
    return _levels(spark, d).groupBy(lang, "reading_level").agg(F.count("*").alias("documents"), F.sum("n_sentences").alias("sentences"), F.round(F.avg("difficulty"), 4).alias("difficulty"))


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How well the model meets ratings of documents it wasn't fitted on."""
    n, exact, near, error = fit_on(table(spark, d, "documents"), table(spark, d, "reading_labels")).held_out
    return spark.createDataFrame([(n, exact, near, error)], "documents int, exact double, within_one double, mean_error double")


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_unmatched, p7_found, p7_copies, p8_containers, p8_fill, p9_mix, p9_shares, p10_levels, p10_profile, p10_held_out)}

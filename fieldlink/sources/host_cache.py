"""Host catalogue rows: column aliases, stored lookups and repair from raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlink.sources.catalog import number

# Accepted names per host column, first value that is present wins.
HOST_ALIASES = {
    "ra": ["RA_ICRS", "RAJ2000", "ra", "RA", "RAPMdeg"],
    "dec": ["DE_ICRS", "DEJ2000", "dec", "DEC", "DEPMdeg"],
    "host_id": ["Name", "objID", "AllWISE", "CatWISE", "source_id", "designation", "WISEA", "Source", "cntr"],
    "W1": ["W1mpro", "W1mag", "W1", "w1mpro", "W1MPRO", "W1mproPM", "w1mpropm"],
    "W2": ["W2mpro", "W2mag", "W2", "w2mpro", "W2MPRO", "W2mproPM", "w2mpropm"],
    "W1_snr": ["snr1", "w1snr", "W1snr", "snrW1pm", "snrw1pm", "W1SNR"],
    "W2_snr": ["snr2", "w2snr", "W2snr", "snrW2pm", "snrw2pm", "W2SNR"],
    "cc_flags": ["cc_flags", "cc_flags_1", "cc_flags_2", "ccf", "CCflags"],
    "ext_flg": ["ext_flg", "extflg", "ExtFlag", "ab_flags", "abf"],
}
STORED = (
    "query_id string, catalogue string, host_id string, host_ra double, host_dec double, w1 double, w2 double, w1_w2 double, "
    "w1_snr double, w2_snr double, cc_flags string, ext_flg string, missing_wise_columns string, raw_record string"
)


def _first(options: list[Column]) -> Column:
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def normalise_hosts(raw: DataFrame, catalogue: str, query_id: Column | None = None) -> DataFrame:
    """Host rows in the stored schema from any known column naming."""
    lower = {c.lower(): c for c in raw.columns}
    pick = {}
    for key, names in HOST_ALIASES.items():
        seen = list(dict.fromkeys(lower[n.lower()] for n in names if n.lower() in lower))
        pick[key] = _first([F.col(f"`{c}`").cast("string") for c in seen])
    w1, w2 = number(pick["W1"]), number(pick["W2"])
    return raw.select(
        (query_id if query_id is not None else F.lit("")).alias("query_id"), F.lit(catalogue).alias("catalogue"),
        F.coalesce(pick["host_id"], F.lit("")).alias("host_id"), number(pick["ra"]).alias("host_ra"), number(pick["dec"]).alias("host_dec"),
        w1.alias("w1"), w2.alias("w2"), (w1 - w2).alias("w1_w2"), number(pick["W1_snr"]).alias("w1_snr"), number(pick["W2_snr"]).alias("w2_snr"),
        F.coalesce(pick["cc_flags"], F.lit("")).alias("cc_flags"), pick["ext_flg"].alias("ext_flg"),
        F.concat_ws(",", F.when(pick["W1"].isNull(), "W1"), F.when(pick["W2"].isNull(), "W2")).alias("missing_wise_columns"),
        F.to_json(F.struct(*raw.columns)).alias("raw_record"),
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Stored lookups from JSON lines; malformed lines are skipped."""
    return spark.read.schema(STORED).option("mode", "DROPMALFORMED").json(path)


def repair(stored: DataFrame) -> DataFrame:
    """Fill missing positions and magnitudes from the raw record."""
    def raw(key: str) -> Column:
        return _first([F.get_json_object("raw_record", f"$.{n}") for n in HOST_ALIASES[key]]).try_cast("double")

    fixed = {"host_ra": raw("ra"), "host_dec": raw("dec"), "w1": raw("W1"), "w2": raw("W2")}
    filled = stored.select(*[F.coalesce(c, fixed[c]).alias(c) if c in fixed else F.col(c) for c in stored.columns])
    return filled.withColumn("w1_w2", F.coalesce("w1_w2", F.col("w1") - F.col("w2")))


def lookup_stored(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows of each distinct (query_id, catalogue)."""
    return queries.select("query_id", "catalogue").distinct().join(stored, ["query_id", "catalogue"])

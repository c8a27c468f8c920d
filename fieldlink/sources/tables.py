"""Reading, writing and resuming partitioned output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from fieldlink.lineage import location

OUTPUTS = ("merged_sources", "edges", "components", "groups", "association_edges", "association_components")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet when the table has it, else CSV with a given schema."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if schema is None:
            raise error
        return spark.read.schema(schema).option("header", True).csv(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def project(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of a schema, in its order; missing ones are NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_fields(df: DataFrame, path: str) -> None:
    """Replace only the partitions of the fields at hand.

    Rows are balanced by field first: a small field becomes one file, a large one
    several.  The schema is kept beside the table, since one without rows has no file.
    """
    df.limit(0).write.mode("ignore").parquet(f"{path}_schema")
    df.hint("rebalance", F.col("field_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("field_id").parquet(path)


def read_fields(spark: SparkSession, path: str, kind: DataType) -> DataFrame:
    """A table of :func:`write_fields`; ``kind`` is the type of field_id, which folder names do not tell ("007")."""
    system, kept = location(spark, f"{path}_schema")
    schema = spark.read.parquet(f"{path}_schema" if system.exists(kept) else path).schema
    return spark.read.schema(StructType([StructField("field_id", kind) if f.name == "field_id" else f for f in schema])).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def latest_status(status: DataFrame) -> DataFrame:
    """The last record of each field."""
    order = W.partitionBy("field_id").orderBy(F.col("time_end").desc())
    return status.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def upsert_status(old: DataFrame, new: DataFrame) -> DataFrame:
    return latest_status(old.unionByName(new, allowMissingColumns=True))


def done_fields(status: DataFrame) -> DataFrame:
    return latest_status(status).filter(F.lower(F.trim("status")) == "done").select("field_id")


def pending_fields(fields: DataFrame, status: DataFrame) -> DataFrame:
    return fields.join(done_fields(status), "field_id", "left_anti")


def missing_partials(outputs: dict[str, DataFrame], done: DataFrame) -> DataFrame:
    """Finished fields that have no rows in an output that every field must have."""
    gone = None
    for name, table in outputs.items():
        lost = done.join(table.select("field_id").distinct(), "field_id", "left_anti").select("field_id", F.lit(name).alias("output"))
        gone = lost if gone is None else gone.unionByName(lost)
    return gone


def combine(table: DataFrame, done: DataFrame) -> DataFrame:
    return table.join(done, "field_id", "left_semi")


def status_record(fields: DataFrame, status: str) -> DataFrame:
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return fields.select("field_id", F.lit(status).alias("status"), now.alias("time_end"))


def start_status(spark: SparkSession, fields_path: str, path: str) -> None:
    """An empty status table for the fields of a table, unless there is one."""
    none = spark.read.parquet(fields_path).select("field_id").limit(0)
    status_record(none, "done").write.mode("ignore").parquet(path)


def failure_summary(status: DataFrame) -> DataFrame:
    """Number of unfinished fields and the first ten of them."""
    from fieldlink.operators.ranking import top_k

    open_ = latest_status(status).filter(F.lower(F.trim("status")) != "done").select("field_id", F.lit(1).alias("_one"))
    count = open_.agg(F.count("*").alias("n_failed"))
    first = top_k(open_, ["_one"], [F.col("field_id")], 10).agg(F.array_join(F.sort_array(F.collect_list(F.col("field_id").cast("string"))), ", ").alias("first_failed"))
    return count.crossJoin(first)

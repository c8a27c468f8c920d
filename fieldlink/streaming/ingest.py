"""Fields that arrive over time: each one is associated once, its outputs are stored, and Stage 2 follows from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldlink.config import Config
from fieldlink.lineage import cut
from fieldlink.operators.parents import ParentResult
from fieldlink.plans.stage1 import associate
from fieldlink.plans.stage2 import link_parents
from fieldlink.sources import association_tables, tables


def ingest_fields(spark: SparkSession, components_path: str, pixels_path: str, fields_path: str, out: str, checkpoint: str, cfg: Config,
                  once: bool = True) -> StreamingQuery:
    """Follow a folder of field rows; run Stage 1 for every batch of new fields.

    The stream carries one row per field.  Its pixels and components are read
    from their tables by field, so a batch costs what its fields cost.  The stream
    keeps no state: fields that the status table lists as done are left out, so a
    field that arrives again, or a batch that is repeated after its status was
    written, does nothing.  A batch that fails before replaces its own output partitions.
    """
    tables.start_status(spark, fields_path, f"{out}/status")
    schema = spark.read.parquet(fields_path).schema
    arriving = spark.readStream.schema(schema).parquet(fields_path)

    def run(batch: DataFrame, epoch: int) -> None:
        done = batch.sparkSession.read.parquet(f"{out}/status")
        new = cut(tables.pending_fields(batch.dropDuplicates(["field_id"]), done))
        if not new.isEmpty():
            mine = new.select("field_id")
            comps = batch.sparkSession.read.parquet(components_path).join(mine, "field_id", "left_semi").dropDuplicates(["component_id", "field_id"])
            pixels = batch.sparkSession.read.parquet(pixels_path).join(mine, "field_id", "left_semi")
            found = associate(comps, pixels, new, cfg)
            association_tables.save(found, comps, pixels, new, out, cfg)
            tables.append(tables.status_record(mine, "done"), f"{out}/status")

    writer = arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def link_stored(spark: SparkSession, fields: DataFrame, hosts: DataFrame, out: str, cfg: Config) -> ParentResult | None:
    """Stage 2 of the fields that Stage 1 has finished and Stage 2 has not; None when there are none.

    Tables ``parent_groups``, ``parent_edges``, ``parent_candidates``,
    ``parent_review`` and, with hosts, ``host_query_log`` are stored by field.  A field is
    marked in ``parent_status`` after its tables are written, so an interrupted call is repeated whole.
    """
    tables.status_record(fields.select("field_id").limit(0), "done").write.mode("ignore").parquet(f"{out}/parent_status")
    ready = fields.join(tables.done_fields(spark.read.parquet(f"{out}/status")), "field_id", "left_semi").dropDuplicates(["field_id"])
    new = cut(tables.pending_fields(ready, spark.read.parquet(f"{out}/parent_status")))
    if new.isEmpty():
        return None
    found = link_parents(association_tables.load(spark, out, new), new, hosts, cfg)
    made = {"parent_groups": found.morph, "parent_edges": found.edges, "parent_candidates": found.candidates, "parent_review": found.review, "host_query_log": found.query_log}
    for name, table in made.items():
        if table is not None:
            tables.write_fields(table, f"{out}/{name}")
    tables.append(tables.status_record(new.select("field_id"), "done"), f"{out}/parent_status")
    return found

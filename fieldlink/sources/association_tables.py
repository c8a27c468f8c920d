"""Stage 1 results as tables partitioned by field, and the way back from them.

Six published tables: ``merged_sources``, ``edges``, ``components``, ``groups``,
``association_edges`` and ``association_components``; beside them the
``segmentation``.  ``components``, ``groups`` and ``association_edges`` keep every
column, so that Stage 2 starts from the stored tables as from a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fieldlink.config import Config
from fieldlink.functions import geometry as g
from fieldlink.operators import legacy
from fieldlink.operators.cluster import GROUP, group_name, inner_edges
from fieldlink.plans.stage1 import Association
from fieldlink.sources import catalog, segmentation, tables

#: The short form of an edge; columns that a run does not make are NULL.
EDGE = (
    "field_id {kind}, component_id_1 string, component_id_2 string, distance_arcsec double, same_pybdsf_island boolean, connected_at_3sigma boolean, "
    "connected_at_2p5sigma boolean, connected_at_2sigma boolean, bridge_snr_mean double, merge_score double, merge_decision boolean, "
    "positive_evidence string, negative_evidence string"
)
#: What a component takes over from its group.
FROM_GROUP = ("association_group_id", "group_index", "n_gaussians", "association_quality", "association_type")
SHAPE = ("morphology_class", "resolved_probability", "beam_like_score", "classification_reason")


def published(found: Association, pixels: DataFrame, fields: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """The six tables of a run."""
    members, groups = found.components, found.groups
    numbered = groups.select(*GROUP, "group_index", group_name("m").alias("merged_source_id"))
    inner = inner_edges(found.edges, members.select("field_id", "component_index", "gid"))
    own = [c for c in members.columns if c not in FROM_GROUP]
    kept = [c for c in ("component_index", "component_id", "island_id", "ra", "dec", "x", "y", *SHAPE) if c in own]
    homes = members.select(*own).join(groups.select(*GROUP, *FROM_GROUP), GROUP).select("field_id", *kept, "gid", *FROM_GROUP)
    kind = groups.schema["field_id"].dataType.simpleString()
    made = (
        legacy.measure_sources(members, numbered, inner, found.labels, pixels, fields, cfg, score="association_score"),
        tables.project(found.edges, StructType.fromDDL(EDGE.format(kind=kind))), members,
        groups.withColumn("bounding_box", g.format_box(F.col("box"))), found.edges, homes,
    )
    return dict(zip(tables.OUTPUTS, made))


def check_partition(found: Association, components: DataFrame) -> None:
    """An error names components in no final group or in several, and members that the decided edges do not join."""
    lost = catalog.partition_issues(found.components, components).orderBy("field_id", "component_index").limit(5).collect()
    if lost:
        raise ValueError("components outside exactly one group: " + ", ".join(f"{r.field_id}/{r.component_index} ({r.n})" for r in lost))
    apart = catalog.groups_match_graph(found.components, found.edges).orderBy("field_id", "component_index").limit(5).collect()
    if apart:
        raise ValueError("groups differ from the decided edges: " + ", ".join(f"{r.field_id}/{r.component_index}" for r in apart))


def save(found: Association, components: DataFrame, pixels: DataFrame, fields: DataFrame, path: str, cfg: Config) -> None:
    """Check a run and replace the partitions of its fields; nothing is written when a check fails."""
    check_partition(found, components)
    none = found.labels.select("field_id", "threshold", F.lit(0).cast("long").alias("removed")).limit(0)
    removed = none if found.removed is None else found.removed
    segmentation.save(segmentation.collected(found.snr, found.labels, removed, fields, cfg.segmentation), fields, f"{path}/segmentation")
    for name, table in published(found, pixels, fields, cfg).items():
        tables.write_fields(table, f"{path}/{name}")


def load(spark: SparkSession, path: str, fields: DataFrame) -> Association:
    """The run of the given fields; an error names fields whose segmentation is not whole."""
    kind = fields.schema["field_id"].dataType
    mine = fields.select("field_id")
    groups, members, edges = (tables.combine(tables.read_fields(spark, f"{path}/{n}", kind), mine) for n in ("groups", "components", "association_edges"))
    stored = segmentation.load(spark, f"{path}/segmentation", fields)
    return Association(members, edges, groups.drop("bounding_box"), stored.snr, stored.labels, None, None)

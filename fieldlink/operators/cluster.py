"""Groups from classified edges: strong cores, weak attachment, group order and ids.

Members carry ``gid``, the smallest component index of their group, which is
unique in a field and serves as the group key everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlink.config import Config
from fieldlink.lineage import cut
from fieldlink.operators.graph import component_labels
from fieldlink.operators.ranking import BUCKET_ROWS, running_total

KEY = ["field_id"]
GROUP = ["field_id", "gid"]


def _order_key():
    """Processing order of weak edges: score descending, then the two indices."""
    return F.struct(
        (-F.col("association_score")).alias("s"), F.col("component_index_1").alias("i"), F.col("component_index_2").alias("j")
    )


def attach_weak(edges: DataFrame, cores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide every weak edge and list which singleton joins which core.

    Sequentially, weak edges are taken by falling score and a singleton joins the
    first core it meets; cores never merge.  Cores are known up front, so the
    fate of a singleton is simply its best edge to any core, a grouped minimum.
    """
    weak = edges.filter(F.col("edge_type") == "weak").withColumn("_key", _order_key())
    for n in "12":
        side = cores.select("field_id", F.col("node").alias(f"component_index_{n}"), F.col("label").alias(f"_core_{n}"))
        weak = weak.join(side, KEY + [f"component_index_{n}"], "left")
    c1, c2 = F.col("_core_1"), F.col("_core_2")
    meets = weak.filter(c1.isNull() != c2.isNull()).select(
        "field_id", F.when(c1.isNull(), F.col("component_index_1")).otherwise(F.col("component_index_2")).alias("node"),
        F.struct(F.col("_key"), F.coalesce(c1, c2).alias("core")).alias("_try"),
    )
    joined = meets.groupBy("field_id", "node").agg(F.min("_try").alias("_try")).select(
        "field_id", "node", F.col("_try._key").alias("at"), F.col("_try.core").alias("core")
    )
    for n in "12":
        side = joined.select(
            "field_id", F.col("node").alias(f"component_index_{n}"), F.col("at").alias(f"_at_{n}"), F.col("core").alias(f"_to_{n}")
        )
        weak = weak.join(side, KEY + [f"component_index_{n}"], "left")
    placed = [F.col(f"_core_{n}").isNotNull() | F.coalesce(F.col(f"_at_{n}") < F.col("_key"), F.lit(False)) for n in "12"]
    home = [F.coalesce(f"_core_{n}", f"_to_{n}") for n in "12"]
    together = placed[0] & placed[1] & (home[0] == home[1])
    attaches = F.coalesce(F.col("_at_1") == F.col("_key"), F.lit(False)) | F.coalesce(F.col("_at_2") == F.col("_key"), F.lit(False))
    reason = (
        F.when(together, "weak_edge_already_same_group").when(attaches, "")
        .when(c1.isNotNull() & c2.isNotNull(), "weak_edge_would_merge_core_groups")
        .when(c1.isNull() & c2.isNull(), "weak_edge_no_core_group")
        .otherwise("weak_edge_would_form_chain")
    )
    decided = weak.withColumn("association_decision", attaches & ~together).withColumn("rejection_reason", reason)
    rest = edges.filter(F.col("edge_type") != "weak")
    return rest.unionByName(decided.select(*rest.columns)), joined.select("field_id", "node", F.col("core").alias("label"))


def number_groups(members: DataFrame, by_size: bool = True, smallest_first: bool = True) -> DataFrame:
    """One row per group with its size and its position in the field."""
    groups = members.groupBy(*GROUP).agg(F.count("*").alias("n_gaussians"))
    low = F.col("gid") if smallest_first else -F.col("gid")
    block = F.floor(F.col("gid") / F.lit(BUCKET_ROWS))
    coarse = [block if smallest_first else -block]
    order = [low]
    if by_size:
        coarse, order = [-F.col("n_gaussians"), *coarse], [-F.col("n_gaussians"), *order]
    return running_total(groups, KEY, coarse, order, "group_index")


def group_name(letter: str, index: str = "group_index", width: int = 3):
    return F.format_string(f"%s_{letter}%0{width}d", F.col("field_id").cast("string"), F.col(index))


def cluster_components(components: DataFrame, edges: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges with final decisions, members with gid, numbered groups)."""
    cores = cut(component_labels(edges.filter(F.col("edge_type") == "strong"), KEY, "component_index_1", "component_index_2"))
    decided, joined = attach_weak(edges, cores)
    if cfg.features.anti_chaining:
        homes = cores.unionByName(joined)
    else:
        homes = component_labels(
            edges.filter(F.col("edge_type").isin("strong", "weak")), KEY, "component_index_1", "component_index_2"
        )
    homes = homes.withColumnRenamed("node", "component_index")
    labelled = components.select("field_id", "component_index").join(homes, KEY + ["component_index"], "left").withColumn(
        "label", F.coalesce("label", "component_index")
    )
    smallest = labelled.groupBy("field_id", "label").agg(F.min("component_index").alias("gid"))
    members = labelled.join(smallest, KEY + ["label"]).select("field_id", "component_index", "gid")
    groups = number_groups(members, by_size=cfg.features.anti_chaining).withColumn("association_group_id", group_name("a"))
    return decided, members, groups


def inner_edges(edges: DataFrame, members: DataFrame, accepted_only: bool = True) -> DataFrame:
    """Edges with both ends in one group, with the group key."""
    wanted = edges.filter("association_decision") if accepted_only else edges
    one = members.select("field_id", F.col("component_index").alias("component_index_1"), "gid")
    two = members.select("field_id", F.col("component_index").alias("component_index_2"), F.col("gid").alias("_g2"))
    return wanted.join(one, KEY + ["component_index_1"]).join(two, KEY + ["component_index_2"]).filter("gid = _g2").drop("_g2")

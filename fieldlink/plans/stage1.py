"""Stage 1 over all fields: raster to regions, components to pairs, groups and checked groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldlink.config import Config
from fieldlink.functions.morphology import with_morphology
from fieldlink.lineage import cut
from fieldlink.operators import cluster, measure, raster, sanity
from fieldlink.operators.evidence import score_edges


@dataclass
class Association:
    components: DataFrame
    edges: DataFrame
    groups: DataFrame
    snr: DataFrame
    labels: DataFrame
    removed: DataFrame | None
    local: sanity.SanityResult | None


def associate(components: DataFrame, pixels: DataFrame, fields: DataFrame, cfg: Config,
              snr: DataFrame | None = None, labels: DataFrame | None = None) -> Association:
    """Group components of every field.

    ``components``: field_id, component_index, component_id, x, y, pixel_scale,
    fluxes and axes.  ``snr`` and ``labels`` may be given when a segmentation
    already exists; otherwise they are made from ``pixels``.
    """
    removed = None
    if snr is None:
        snr = cut(raster.snr_map(pixels, fields, cfg.segmentation))
    if labels is None:
        labels, removed = raster.segment(snr, fields, cfg.segmentation)
        labels = cut(labels)
    shaped = with_morphology(components, cfg)
    placed = raster.at_points(shaped, snr, labels, cfg.segmentation, "component_index")
    placed = cut(placed.join(fields.select("field_id", "width", "height"), "field_id"))
    edges = cut(score_edges(placed, snr, cfg).drop("x_1", "y_1", "x_2", "y_2"))
    decided, membership, numbered = cluster.cluster_components(placed, edges, cfg)
    decided = cut(decided)
    members = cut(placed.join(membership, ["field_id", "component_index"]))
    groups = measure.measure_groups(members, decided, labels, pixels, fields, cfg)
    groups = cut(groups.join(numbered.select("field_id", "gid", "group_index", "association_group_id"), ["field_id", "gid"]))
    if not cfg.sanity.enabled:
        return Association(members, decided, groups, snr, labels, removed, None)
    local = sanity.run_local_sanity(members, decided, groups, snr, labels, pixels, fields, cfg)
    return Association(local.members, local.edges, local.groups, snr, labels, removed, local)

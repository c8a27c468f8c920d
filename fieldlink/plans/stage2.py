"""Stage 2 over all fields: groups to endpoint classes, parent pairs, hosts and accepted parents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldlink.config import Config
from fieldlink.lineage import cut
from fieldlink.operators import parents, seeds
from fieldlink.plans.stage1 import Association


def link_parents(stage1: Association, fields: DataFrame, hosts: DataFrame, cfg: Config) -> parents.ParentResult:
    groups = cut(seeds.with_regions(stage1.groups, stage1.components, stage1.labels))
    return parents.run_parents(groups, stage1.snr, stage1.labels, fields, hosts, cfg)

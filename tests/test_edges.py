import pytest
from pyspark.sql import functions as F

from fieldlink.config import Config
from fieldlink.functions.morphology import with_morphology
from fieldlink.operators.evidence import score_edges
from fieldlink.operators.raster import at_points
from tests.scenes import bar_components, bar_snr, labels_at_or_above

CFG = Config()


def bar_edges(spark, fluxes=((10.0, 8.0), (9.0, 7.0), (8.0, 6.0))):
    snr = bar_snr(spark)
    comps = with_morphology(bar_components(spark, fluxes), CFG)
    placed = at_points(comps, snr, labels_at_or_above(snr), CFG.segmentation, "component_index")
    placed = placed.withColumn("width", F.lit(80)).withColumn("height", F.lit(40))
    return score_edges(placed, snr, CFG)


def test_golden_score(spark):
    rows = {(r.component_index_1, r.component_index_2): r for r in bar_edges(spark).collect()}
    assert sorted(rows) == [(0, 1), (0, 2), (1, 2)]
    first = rows[(0, 1)]
    assert first.flux_ratio == pytest.approx(0.9)
    assert first.flux_continuity_score == pytest.approx(0.9**0.5)
    assert first.residual_bridge_score == pytest.approx(0.9249922910515381, abs=1e-12)
    assert first.association_score == pytest.approx(5.928306470656955, abs=1e-12)
    assert {r.edge_type for r in rows.values()} == {"strong"}


@pytest.mark.parametrize("bad", [0.0, -1.0, None, float("nan"), float("inf")])
def test_unusable_flux_is_missing_evidence(spark, bad):
    edges = bar_edges(spark, ((bad, bad), (9.0, 7.0), (8.0, 6.0)))
    row = edges.filter("component_index_1 = 0 and component_index_2 = 1").first()
    assert row.flux_ratio is None and row.flux_continuity_score == 0.0 and row.association_score is not None


def test_batches_without_a_sample_join_others(monkeypatch):
    import pyarrow as pa

    from fieldlink import fixtures as fx
    from fieldlink.operators import paths

    monkeypatch.setattr(paths, "BATCH", 1)
    # The first corridor runs along pixels and the second leaves them at once; the third is outside.
    ends = {"x_1": [0.0, 0.1, 50.0], "y_1": [0.0, 0.1, 50.0], "x_2": [4.0, 4.3, 52.0], "y_2": [0.0, 3.2, 51.0]}
    rest = {"pixel_scale": 1.0, "width": 9, "height": 9, "_amp_1": 0.0, "_amp_2": 0.0, "_half_bridge": 1.0, "_half_residual": 0.0, "_exclude": 0.0, "_x0": 0.0, "_y0": 0.0}
    pairs = pa.table({**ends, **{c: [v] * 3 for c, v in rest.items()}})
    spots = [(y, x) for y in range(9) for x in range(9)]
    tile = pa.table({"ys": [[y for y, _ in spots]], "xs": [[x for _, x in spots]], "values": [[float(x) for _, x in spots]]})
    found = paths._reader(fx.SMALL)(pairs, tile).to_pydict()
    assert found["nr"] == [5, 0, 0] and found["r_sum"] == [10.0, None, None]
    assert found["nb"][0] == 10 and found["nb"][2] == 0 and found["b_max"] == [4.0, 4.0, None]

"""Settings of the engine as frozen dataclasses.

The numbers below are fixed values of the published method: the defaults a run
uses when nothing else is asked for.  They only ever reach Spark as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# The three contour levels the method names.
STRONG_SIGMA = 3.0
MIDDLE_SIGMA = 2.5
WEAK_SIGMA = 2.0

FWHM_PER_SIGMA = 2.0 * math.sqrt(2.0 * math.log(2.0))


@dataclass(frozen=True)
class Beam:
    """Restoring beam: full widths in arcsec, position angle in degrees."""

    major_arcsec: float = 6.0
    minor_arcsec: float = 6.0
    pa_deg: float = 0.0
    pixel_pa_deg: float | None = None
    ra_axis_sign: float = 1.0
    dec_axis_sign: float = 1.0

    def __post_init__(self):
        if not (self.major_arcsec > 0 and self.minor_arcsec > 0):
            raise ValueError("beam axes must be positive")

    @property
    def long_axis(self) -> float:
        return max(self.major_arcsec, self.minor_arcsec)

    @property
    def short_axis(self) -> float:
        return min(self.major_arcsec, self.minor_arcsec)

    @property
    def pixel_angle(self) -> float:
        """Angle of the long axis in the pixel plane, from +x towards +y."""
        if self.pixel_pa_deg is not None:
            angle = self.pixel_pa_deg
        else:
            pa = math.radians(self.pa_deg)
            angle = math.degrees(
                math.atan2(self.dec_axis_sign * math.cos(pa), self.ra_axis_sign * math.sin(pa))
            )
        if self.minor_arcsec > self.major_arcsec:
            angle += 90.0
        return angle % 180.0

    @property
    def size_arcsec(self) -> float:
        """Geometric mean width: the unit called "one beam"."""
        return math.sqrt(self.major_arcsec * self.minor_arcsec)

    @property
    def area_arcsec2(self) -> float:
        return math.pi * self.major_arcsec * self.minor_arcsec / (4.0 * math.log(2.0))


@dataclass(frozen=True)
class Segmentation:
    thresholds: tuple = (5.0, 4.0, 3.0, 2.5, 2.0)
    mean_mode: str = "median"
    rms_mode: str = "mad"
    smooth: bool = True
    smooth_sigma_pix: float = 1.0
    min_mask_area_pix: int = 30
    connectivity: int = 2
    opening: bool = False
    closing: bool = True
    #: Fields must come with mean and rms; otherwise missing ones are estimated from the pixels.
    require_metadata: bool = False

    def __post_init__(self):
        ts = self.thresholds
        if not ts or any(not (t > 0 and math.isfinite(t)) for t in ts) or len(set(ts)) != len(ts):
            raise ValueError("thresholds must be finite, positive and unique")
        if self.connectivity not in (1, 2) or self.min_mask_area_pix < 1:
            raise ValueError("connectivity is 1 or 2 and min_mask_area_pix at least 1")
        if self.mean_mode not in ("median", "mean", "zero") or self.rms_mode not in ("mad", "std"):
            raise ValueError("unknown background or noise mode")


@dataclass(frozen=True)
class Features:
    """Ablation switches; each one picks another column expression."""

    contours: bool = True
    ridge: bool = True
    overlap: bool = True
    pa_alignment: bool = True
    anti_chaining: bool = True
    artifact_layer1: bool = True
    artifact_layer2: bool = True
    midpoint_host: bool = True
    lobe_peak_contradiction: bool = True
    relative_scale: bool = True
    endpoint_filtering: bool = True


@dataclass(frozen=True)
class Association:
    max_pair_beams: float = 15.0
    max_pair_arcsec: float | None = 120.0
    strong_score: float = 3.0
    weak_score: float = 2.0
    min_bridge_width_beam: float = 0.8
    min_bridge_length_beam: float = 1.0
    max_only_2sigma_score: float = 0.5
    beam_aware: bool = True
    unresolved_veto: bool = True
    residual_bridge: bool = True
    residual_snr: float = 2.5
    residual_min_length_fraction: float = 0.45
    residual_min_area_beams: float = 0.25
    residual_endpoint_exclusion_beam: float = 0.6
    veto_beam_like: float = 0.70
    veto_min_bridge: float = 0.70
    veto_min_residual: float = 0.55
    veto_min_envelope_beams: float = 1.0
    veto_score_cap: float = -1.0
    support_bridge: float = 0.55
    support_ridge: float = 0.55
    support_overlap: float = 0.75
    quality_high: float = 3.5
    quality_medium: float = 2.5
    quality_low: float = 1.5


@dataclass(frozen=True)
class AssociationWeights:
    closeness: float = 1.0
    overlap: float = 1.0
    pa_alignment: float = 0.8
    conn_3sigma: float = 1.5
    conn_2p5sigma: float = 0.6
    conn_2sigma: float = 0.0
    bridge: float = 1.2
    ridge: float = 1.2
    flux_continuity: float = 0.5
    flow_alignment: float = 0.6
    valley: float = 1.5
    only_2sigma: float = 1.0
    negative_bowl: float = 1.2
    sidelobe: float = 1.5
    too_far: float = 2.0
    large_mask_swallow: float = 1.5


@dataclass(frozen=True)
class GroupTypes:
    compact_max_las: float = 4.0
    continuous_min_las: float = 4.0
    diffuse_min_las: float = 6.0
    linear_min_axis_ratio: float = 2.0
    complex_min_components: int = 5
    weak_max_quality: str = "low"
    artifact_type: bool = True


@dataclass(frozen=True)
class Morphology:
    ratio_tolerance: float = 0.35
    size_tolerance: float = 0.35
    pa_tolerance_deg: float = 20.0
    beam_like_unresolved: float = 0.70
    deconv_major_resolved: float = 0.45
    deconv_minor_resolved: float = 0.35
    deconv_major_marginal: float = 0.20
    intrinsic_resolved: float = 0.35
    intrinsic_marginal: float = 0.15
    low_snr: float = 5.0
    pa_weight_unresolved: float = 0.0
    pa_weight_beam_like: float = 0.0
    pa_weight_marginal: float = 0.35
    pa_weight_resolved: float = 1.0
    pa_weight_unknown: float = 0.15


@dataclass(frozen=True)
class LegacyGraph:
    max_pair_arcsec: float = 120.0
    max_pair_beams: float = 15.0
    merge_score: float = 3.0
    same_island: float = 0.0
    conn_3sigma: float = 2.0
    conn_2p5sigma: float = 1.0
    conn_2sigma: float = 0.3
    bridge: float = 1.0
    overlap: float = 0.8
    closeness: float = 0.8
    pa_alignment: float = 0.7
    pixel_support: float = 0.8
    valley: float = 1.5
    compact_pair: float = 1.0
    too_far: float = 2.5


@dataclass(frozen=True)
class LocalSanity:
    enabled: bool = True
    check_las_beam: float = 8.0
    check_n_gaussians: int = 6
    min_saddle: float = 0.35
    max_ridge_gap: float = 0.35
    max_weak_fraction: float = 0.50
    max_only_2sigma_fraction: float = 0.25
    split: bool = True
    mark_unsplittable: bool = True
    min_subgroup_size: int = 1
    min_split_gain: float = 0.5
    min_path_snr: float = 2.5


@dataclass(frozen=True)
class Seeds:
    enabled: bool = True
    max_box_gap_beam: float = 10.0
    strong_box_gap_beam: float = 5.0
    min_las_beam: float = 3.0
    min_mask_area_beam: float = 3.0
    min_n_gaussians: int = 2
    min_peak_snr: float = 8.0
    min_area3_beam: float = 2.0
    max_per_group: int = 1
    max_per_field: int = 10
    search_padding: float = 1.5
    compact_max_las: float = 3.0
    compact_max_area3: float = 2.0
    compact_max_mask: float = 2.0
    fallback_las_weight: float = 0.45
    fallback_count_weight: float = 0.35
    core_radius_beam: float = 3.0
    core_axial_min: float = 0.15
    core_axial_max: float = 0.85
    w_gap: float = 1.5
    w_axis: float = 1.4
    w_facing: float = 1.0
    w_flux: float = 0.7
    w_size: float = 0.6
    w_core: float = 0.8
    high_score: float = 4.0
    medium_score: float = 3.2
    low_score: float = 2.5
    axis_min: float = 0.7
    facing_min: float = 0.6
    max_flux_ratio: float = 10.0
    max_size_ratio: float = 5.0
    missing_ratio_score: float = 0.35
    strong_gap_evidence: int = 2
    wide_gap_evidence: int = 3


@dataclass(frozen=True)
class Hosts:
    enabled: bool = True
    required: bool = True
    catalogues: tuple = ("catwise2020", "allwise")
    min_radius_arcsec: float = 10.0
    max_radius_arcsec: float = 30.0
    radius_fraction: float = 0.12
    max_rows_per_lookup: int = 20
    #: The row limit keeps the best scored hosts; otherwise the nearest ones, cut before scoring as a lookup service does.
    limit_after_score: bool = True
    max_lookups: int | None = None
    score_weight: float = 1.0
    min_quality: str = "medium"
    high_score: float = 3.0
    medium_score: float = 2.0
    high_max_perp_beam: float = 1.5
    medium_max_perp_beam: float = 2.0
    high_position: tuple = (0.35, 0.65)
    medium_position: tuple = (0.25, 0.75)
    colour_min: float = 0.8
    colour_bonus: float = 0.5
    colour_required: bool = False
    w_closeness: float = 2.0
    w_axis: float = 1.5
    w_detection: float = 0.8
    w_artifact: float = 1.0
    snr_scale: float = 10.0
    catalogued_w1: float = 0.5


@dataclass(frozen=True)
class Endpoints:
    point_las_max: float = 3.0
    point_major_max: float = 1.8
    point_area_max: float = 3.0
    point_ratio_max: float = 1.7
    compact_las_max: float = 3.0
    compact_area_max: float = 2.0
    compact_major_max: float = 1.5
    compact_ratio_max: float = 1.5
    singleton_las_max: float = 3.5
    singleton_area_max: float = 2.5
    singleton_ratio_max: float = 1.6
    observed_major_max: float = 1.4
    observed_minor_max: float = 1.4
    noise_snr_min: float = 6.0
    noise_area_min: float = 1.5
    extended_las_min: float = 3.0
    extended_area_min: float = 2.5
    extended_major_min: float = 2.0
    extended_ratio_min: float = 1.5
    extended_n_min: int = 2
    multi_min_n: int = 3
    multi_min_area: float = 2.0
    multi_las_margin: float = 0.5
    self_area_margin: float = 0.5
    self_major_min: float = 2.2
    self_ratio_margin: float = 0.1


@dataclass(frozen=True)
class Rescue:
    near_gap_beam: float = 6.0
    gap_to_mean_box: float = 1.0
    gap_to_min_box: float = 1.5
    ridge_min: float = 0.45
    axis_min: float = 0.50
    facing_min: float = 0.40
    max_flux_ratio: float = 30.0
    max_size_ratio: float = 10.0
    min_n_each: int = 2
    extended_n_min: int = 3
    min_area_each: float = 2.5


@dataclass(frozen=True)
class Parents:
    enabled: bool = True
    max_box_gap_beam: float = 12.0
    max_centre_beam: float = 40.0
    min_axis: float = 0.7
    min_facing: float = 0.6
    max_flux_ratio: float = 20.0
    max_size_ratio: float = 8.0
    min_symmetry: float = 0.6
    artifact_veto: float = 1.2
    artifact_suspicious: float = 0.8
    min_ridge: float = 0.65
    bright_near_beam: float = 8.0
    bright_radial_min: float = 0.72
    bright_ratio_min: float = 5.0
    fragment_radius_beam: float = 8.0
    fragment_count: int = 12
    lobe_radius_min: float = 5.0
    lobe_radius_max: float = 10.0
    max_per_group: int = 2
    max_per_field: int = 20
    search_padding: float = 1.5
    search_gap_floor_beam: float = 6.0
    search_gap_cap_beam: float = 18.0
    very_close_beam: float = 4.0
    very_bright_ratio: float = 10.0
    very_close_score: float = 0.7
    flag_score: float = 1.4
    radial_base: float = 1.1
    radial_bonus: float = 0.5
    crowded_score: float = 0.8
    bright_count: int = 5
    bridge_low_snr: float = 2.0
    bridge_high_snr: float = 2.5
    bridge_low_fraction: float = 0.45
    bridge_high_fraction: float = 0.25
    ridge_low_weight: float = 0.6
    ridge_high_weight: float = 0.4
    neighbour_radius_beam: float = 8.0
    threshold_tolerance: float = 0.26
    w_axis: float = 0.30
    w_facing: float = 0.25
    w_midpoint: float = 0.15
    w_flux: float = 0.15
    w_size: float = 0.15
    lobe_snr_scale: float = 10.0
    lobe_w1: float = 1.0
    lobe_w2: float = 0.5
    lobe_catalogued: float = 0.5
    lobe_w_closeness: float = 1.8
    lobe_w_detection: float = 0.8
    lobe_high: float = 2.0
    lobe_medium: float = 1.2
    lobe_high_radius: float = 0.6
    high_symmetry: float = 0.70
    check_symmetry: float = 0.68
    w_symmetry: float = 1.4
    w_gap: float = 0.7
    w_core: float = 0.3
    endpoints: Endpoints = field(default_factory=Endpoints)
    rescue: Rescue = field(default_factory=Rescue)


@dataclass(frozen=True)
class Display:
    """Row selection behind review figures and zoom lists."""

    draw_all_labels: bool = False
    draw_singletons: bool = False
    label_min_components: int = 2
    max_labels: int = 30
    max_components: int = 500
    max_edges: int = 300
    edge_min_score: float | None = None
    zoom_min_components: int = 2
    zoom_top_las: int = 10
    zoom_top_score: int = 10
    zoom_max: int = 20
    zoom_padding: int = 100
    zoom_min_size: int = 256
    zoom_max_size: int = 1024


@dataclass(frozen=True)
class Config:
    beam: Beam = field(default_factory=Beam)
    preselect_margin_arcsec: float = 120.0
    pixel_scale_arcsec: float | None = None
    segmentation: Segmentation = field(default_factory=Segmentation)
    features: Features = field(default_factory=Features)
    association: Association = field(default_factory=Association)
    weights: AssociationWeights = field(default_factory=AssociationWeights)
    types: GroupTypes = field(default_factory=GroupTypes)
    morphology: Morphology = field(default_factory=Morphology)
    legacy: LegacyGraph = field(default_factory=LegacyGraph)
    sanity: LocalSanity = field(default_factory=LocalSanity)
    seeds: Seeds = field(default_factory=Seeds)
    hosts: Hosts = field(default_factory=Hosts)
    parents: Parents = field(default_factory=Parents)
    display: Display = field(default_factory=Display)

"""Parameters that are part of the results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

KEY = ["movie", "trajectory"]


@dataclass(frozen=True)
class Params:
    # Defaults a run must use to give the usual results.
    search_radius: int = 12
    same_spot_px: float = 6.0
    coloc_px: float = 4.0
    max_lag: int = 10
    min_pairs: int = 5
    eps: float = 1e-12
    step_window: int = 15
    step_passes: int = 10
    min_step: float = 100.0
    roi_half_width: int = 2
    roi_method: str = "max"
    near_roi_px: float = 5.0
    log_sigma: float = 1.5
    pixel_bins: int = 50
    snr: float = 4.0
    fit_passes: int = 2
    edge_tol_px: float = 4.0
    min_peak: float = 4.0
    background_border: float = 0.1
    fit_border: float = 0.25
    smooth_window: int = 11
    smooth_px: float = 3.0

    @property
    def crop(self) -> int:
        return int(2 * self.search_radius)


@dataclass(frozen=True)
class FinderParams:
    # Defaults of the candidate-track selection.
    prob_thresh: float = 0.97
    max_tracks: int = 240
    strict_dx: float = 1.3
    strict_overlap: float = 0.65
    dedupe_dx: float = 1.3
    dedupe_overlap: float = 0.65
    match_overlap: float = 0.45
    match_mean_dx: float = 2.2
    match_p90_dx: float = 3.4
    loose_union: float = 0.35
    loose_end_dx: float = 2.8
    loose_p90_dx: float = 4.0

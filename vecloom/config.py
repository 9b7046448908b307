"""Settings of a run: one frozen value, merged from JSON and keywords; no environment."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

#: Views in order, and whether a report shows them unless told otherwise.
VIEWS = {
    "diagnose": True, "isotropy": True, "rank_metrics": True, "cos_hist": True, "cos_density": True, "eig_spectrum": True, "pair_cos_stats": True, "k_curve": True, "rank_envelope": True, "expected_collisions_grid": True, "bandwidth_curve": True, "sigma_star": True, "stolarsky_z": True,
    "nn_sparsity": True, "nn_margin": True, "margin_hist": True, "dtm_ecdf": True, "dtm_tails": True, "pockets": True, "local_anisotropy": True, "field_hist": True, "crowding_rank": True, "shells": True, "radial_density": True, "axis_spread": True, "within_between": True, "wb_density": True, "separability": True,
    "label_analysis": True, "pca_peaks": True, "grid_hot": False, "pca_contours": False, "hexagons": False, "knn_undirected": False, "knn_bridges": False, "pca_hull": False, "pca_voids": False, "density_ratio": False, "qq_iso": False,
    "camera": False, "voxels": False, "voxel_gap": False, "mst_edges": False, "mst_hot_edges": False, "curve_export": False, "angular_pockets": False, "cluster_stability": False, "eigengap": False,
}
#: Views of two embeddings, shown where a second one is given.
COMPARED = ("cmp_overlap_hist", "cmp_overlap_by_k", "cmp_scores", "cmp_kernels", "cmp_drift_grid", "cmp_drift", "cmp_density", "cmp_uniformity")
#: Views of all pairs of rows: of more rows than `sample` they take a sample.
PAIRWISE = {
    "nn_sparsity", "nn_margin", "margin_hist", "dtm_ecdf", "dtm_tails", "pockets", "local_anisotropy", "field_hist", "crowding_rank", "separability", "label_analysis", "knn_undirected", "knn_bridges", "mst_edges", "mst_hot_edges", "curve_export", "angular_pockets", "cluster_stability", "eigengap",
}


@dataclass(frozen=True)
class Config:
    vector: str | None = None
    id: str | None = None
    label: str | None = None
    metric: str = "cosine"
    sample: int = 20_000
    pairs: int = 200_000
    k: int = 10
    seed: int = 0
    title: str = "Embedding report"
    views: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.metric not in ("cosine", "euclidean"):
            raise ValueError("metric is cosine or euclidean")

    def merged(self, given: dict | str) -> Config:
        """With the values of a dictionary or JSON text; keys that aren't settings switch views."""
        given = json.loads(given) if isinstance(given, str) else dict(given)
        own = {f.name for f in fields(self)}
        views = self.views | given.pop("views", {}) | {k: bool(v) for k, v in given.items() if k not in own}
        return replace(self, views=views, **{k: v for k, v in given.items() if k in own})

    def shows(self, view: str) -> bool:
        return self.views.get(view, VIEWS.get(view, False))

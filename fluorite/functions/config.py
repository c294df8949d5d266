"""Settings of a detection run: a flat YAML file as a typed object. Of a key given twice the last counts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    control_image: bool = False
    control_path: str | None = None
    channel_path: str | None = None
    control_threshold: float | None = None
    experiment_threshold: float | None = None
    minimal_distance: tuple[int, ...] = (2, 2, 2)
    kernel_size: tuple[float, ...] = (1.0, 1.7, 1.7)
    voxel_size: tuple[float, ...] = (361.0, 75.0, 75.0)
    spot_size: tuple[float, ...] = (600.0, 300.0, 300.0)
    control_voxel_size: tuple[float, ...] | None = None
    decomposition: tuple[float, ...] | None = (0.7, 1.0, 5.0)
    spot_radii: bool = False
    min_spots_for_clusters: int = 4
    radius_for_spots: float = 250.0
    max_levels: int = 20
    results_folder: str = "results"
    unknown: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.control_image and not self.control_path:
            raise ValueError("a control image needs a path")
        for name in ("minimal_distance", "kernel_size", "voxel_size", "spot_size"):
            if len(getattr(self, name)) != 3:
                raise ValueError(f"{name} has three values: z, y, x")
        if self.control_voxel_size is not None and len(self.control_voxel_size) != 3:
            raise ValueError("control_voxel_size has three values: z, y, x")
        if self.decomposition is not None and (len(self.decomposition) != 3 or not 0 <= self.decomposition[0] <= 1 or self.decomposition[1] <= 0 or self.decomposition[2] < 0):
            raise ValueError("decomposition_thresh has three values: alpha from 0 to 1, beta above 0, gamma from 0")

    @property
    def anisotropy(self) -> float:
        z, y, x = self.voxel_size
        return z / ((y + x) / 2)

    @property
    def spot_voxels(self) -> dict[str, float]:
        """Radius of a spot along each axis in voxels."""
        return {a: s / v for a, s, v in zip("zyx", self.spot_size, self.voxel_size, strict=True)}


#: Names of settings in files.
KEYS = {
    "controlImage": "control_image", "controlPath": "control_path", "smFISHChannelPath": "channel_path", "controlThreshold": "control_threshold",
    "experimentThreshold": "experiment_threshold", "minimal_distance": "minimal_distance", "kernel_size": "kernel_size", "voxel_size": "voxel_size",
    "spot_size": "spot_size", "min_spots_for_clusters": "min_spots_for_clusters", "radius_for_spots": "radius_for_spots", "results_folder": "results_folder",
    "control_voxel_size": "control_voxel_size", "decomposition_thresh": "decomposition", "spotsRadiusDetection": "spot_radii",
}


def from_text(text: str) -> Settings:
    import yaml

    raw = yaml.safe_load(text) or {}
    kinds = {f.name for f in fields(Settings)}
    own = {KEYS[k]: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in KEYS and v is not None}
    return Settings(**{k: v for k, v in own.items() if k in kinds}, unknown={k: v for k, v in raw.items() if k not in KEYS})

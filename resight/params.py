"""Parameter presets: one dataclass per operator family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace


# Published defaults per body part.
_SCALES = {
    "fluke": (0.02, 0.04, 0.06, 0.08),
    "dorsal": (0.04, 0.06, 0.08, 0.10),
    "ridge": (0.04, 0.06, 0.08, 0.10),
    "ear": (0.02, 0.04, 0.06, 0.08),
}
_FRAME = {
    "fluke": (1152, 576),
    "dorsal": (1024, 1024),
    "ridge": (1024, 1024),
    "ear": (1024, 1024),
}
_TRANSPOSE = {"fluke": True, "dorsal": False, "ridge": False, "ear": True}


@dataclass(frozen=True)
class ContourParams:
    """Frame and radii of the curvature of one body part."""

    scales: tuple[float, ...]
    width: int
    height: int
    transpose: bool

    @property
    def radii(self) -> list[float]:
        return [s * max(self.width, self.height) for s in self.scales]


def contour_preset(part: str) -> ContourParams:
    width, height = _FRAME[part]
    return ContourParams(_SCALES[part], width, height, _TRANSPOSE[part])


@dataclass(frozen=True)
class DescriptorParams:
    length: int = 1024
    feat_dim: int = 32
    num_keypoints: int = 32
    smooth_sigma: float = 5.0
    extremum_order: int = 3
    # The first maximum and the last minimum decide whether the ends are added.
    unsorted_ends: bool = True


@dataclass(frozen=True)
class GaussParams:
    scales: tuple[tuple[int, int], ...] = ((2, 1), (2, 2), (2, 4), (2, 8))
    length: int = 1024
    feat_dim: int = 16
    num_keypoints: int = 50
    uniform: bool = False
    keypoint_m: int = 8
    keypoint_s: int = 2


@dataclass(frozen=True)
class IndexParams:
    trees: int = 10
    annots_per_tree: int = 2500
    k: int = 2
    search_factor: int = 1


@dataclass(frozen=True)
class ForestParams:
    """Projection trees: rows of a leaf, levels fitted in a round and the rows they are fitted on.

    The number of trees, and of leaves a search looks into, follow the index rule where they are not given.
    """

    index: IndexParams = field(default_factory=IndexParams)
    leaf: int = 512
    levels: int = 3
    sample: int = 512
    trees: int | None = None
    search_k: int | None = None


@dataclass(frozen=True)
class NeighbourParams:
    """How vectors are cut into bounded blocks before distances are taken."""

    block_rows: int = 1024
    # A database block is larger: one meeting returns `count` rows per query whatever its size.
    db_block_rows: int = 8192
    blocks_per_salt: int = 4
    # Whole searches cut a scale's database into parts and its queries into hands, few and large ones: a query goes once to a
    # part, a database row once to a hand. A part holds `part_rows` or more, and there are no more than `max_parts` until one
    # would hold more than `full_part`.
    part_rows: int = 2048
    max_parts: int = 8
    max_hands: int = 8
    full_part: int = 1 << 20
    pivots: int = 512
    max_pivot_cells: int = 20_000
    forest: ForestParams = field(default_factory=ForestParams)
    lsh_tables: int = 10
    lsh_leaf: int = 64
    lsh_max_bits: int = 24
    seed: int = 7


@dataclass(frozen=True)
class LnbnnParams:
    k: int = 2
    level: str = "name"
    minimum_score: float = -1e-5
    method: str = "exact"
    neighbours: NeighbourParams = field(default_factory=NeighbourParams)

    def with_(self, **changes) -> "LnbnnParams":
        return replace(self, **changes)


@dataclass(frozen=True)
class WarpParams:
    window: int = 8
    length: int = 128
    cost: str | Callable = "chi_square"
    block_rows: int = 64
    blocks_per_salt: int = 8


@dataclass(frozen=True)
class SplitParams:
    strategy: str = "random"
    num_db: int = 10
    runs: int = 1
    seed: int = 0
    unknown: str = "____"


@dataclass(frozen=True)
class SnapshotParams:
    reuse_hours: int = 48
    expire_hours: int = 168

"""Parameters of matching, acceptance, tiers and objects, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Multiples of wall thickness and of mesh resolution for each length scale; fixed values.
SCALE_FACTORS = {
    "coarse": (0.15, 2.3),
    "stage1": (0.06, 0.9),
    "tight": (0.01, 0.15),
    "facing": (0.3, 1.0),
    "gap": (0.03, 0.45),
    "seam": (0.12, 1.8),
    "near": (0.5, 4.0),
    "pen": (0.06, 0.9),
    "icp": (0.04, 0.6),
    "nms": (0.5, 0.0),
}


@dataclass(frozen=True)
class Acceptance:
    """A candidate join is accepted when every test holds; a value that can't be measured fails."""

    min_tight: float = 0.25
    max_gap: float = 0.03
    max_pen: float = 0.005
    min_seam: float = 3.0
    min_cont: float = 0.8


@dataclass(frozen=True)
class TierRule:
    """Stricter tests for a confirmed join, and the independent support that it needs."""

    min_tight: float = 0.35
    max_gap: float = 0.015
    min_seam: float = 5.0
    min_cont: float = 0.9
    max_pen: float = 0.0
    max_slide: float = 0.25
    min_support: int = 1
    min_margin: float = 2.0
    #: How far away, in walls, the second placement has to lie for a margin over it to count, and whether it has to be refused.
    min_moved: float = 0.0
    rival_refused: bool = False


@dataclass(frozen=True)
class Params:
    thick_ratio: float = 2.5
    dihedral_tol: float = 25.0
    keep: int = 5
    rot_tol_deg: float = 10.0
    trans_tol: float = 0.5
    k_mad: float = 3.0
    min_members: int = 3
    acceptance: Acceptance = field(default_factory=Acceptance)
    tier: TierRule = field(default_factory=TierRule)

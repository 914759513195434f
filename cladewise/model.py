"""Parameters of profile and tree queries, as dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

POLICIES = ("pair_delete", "complete_delete", "as_allele", "absolute_distance")
MATRICES = ("symmetric", "asymmetric", "asymmetric_wgMLST", "blockwise")
METHODS = ("MSTreeV2", "MSTree", "goeBurst", "NJ", "RapidNJ", "ninja", "fastme", "distance")
HEURISTICS = ("eBurst", "harmonic")


@dataclass(frozen=True)
class DistanceSpec:
    """Which distance: the matrix, what to do with missing alleles, and the penalty of a blockwise run."""

    matrix: str = "symmetric"
    missing: str = "pair_delete"
    block_penalty: float = 0.01

    def __post_init__(self):
        if self.matrix not in MATRICES or self.missing not in POLICIES:
            raise ValueError(f"unknown distance {self.matrix}, {self.missing}")

    @property
    def directed(self) -> bool:
        """Whether d(a, b) may differ from d(b, a)."""
        return self.matrix.startswith("asymmetric")

    @property
    def scaled(self) -> bool:
        """Whether a normalised distance is divided by the number of loci."""
        return self.missing != "absolute_distance" and self.matrix != "blockwise"


@dataclass(frozen=True)
class TreeSpec:
    """Which tree: the method, its distance, the tie-break and local rearrangement of branches."""

    method: str = "MSTreeV2"
    distance: DistanceSpec = DistanceSpec()
    heuristic: str = "eBurst"
    recraft: bool = False

    def __post_init__(self):
        if self.method not in METHODS or self.heuristic not in HEURISTICS:
            raise ValueError(f"unknown method {self.method}, {self.heuristic}")

    def resolved(self) -> "TreeSpec":
        """MSTreeV2 spelt out; a blockwise matrix has neither rearrangement nor directed trees."""
        if self.distance.matrix == "blockwise":
            return TreeSpec("MSTree" if self.method == "MSTreeV2" else self.method, self.distance, self.heuristic, False)
        if self.method == "MSTreeV2":
            return TreeSpec("MSTree", DistanceSpec("asymmetric", self.distance.missing), "harmonic", True)
        return self


@dataclass(frozen=True)
class CategorySpec:
    """How a metadata column is counted: numeric or not, sorted by size or value, least count, and how many values stand alone."""

    column: str
    numeric: bool = False
    by_size: bool = True
    least: int = 1
    top: int = 30

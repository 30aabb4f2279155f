"""Alignment parameters: the engine's whole configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace

MAX_HITS_LIMIT = 65_525
MAX_QUERY_LENGTH = 32_000
MAX_ID_LENGTH = 200
NO_COMPETITOR_MAPQ = 250
UNSET_MAPQ = 255


@dataclass(frozen=True)
class AlignParams:
    """Defaults are the fixed values of the aligner's command line; flags in comments."""

    word_len: int = 15  # -L
    skip_dist: int = 1  # -S
    max_hits: int = 650  # -H while aligning
    index_max_hits: int = MAX_HITS_LIMIT  # -H while indexing
    band_width: int = 5  # -BW
    max_gap: int = 50  # -G
    max_intron: int | None = None  # -I, else max_gap
    min_match: int = 25  # -M
    min_raw_score: int | None = None  # -R, else min_match
    max_desert: int = 50  # -MD
    min_identity: float = 0.9  # -P
    x_cutoff: int = 25  # -X
    affine: bool = True  # -AGS
    gap_open: int = 5  # -GOC
    gap_extend: int = 2  # -GEC
    match: int = 1  # -MS
    replace: int = 3  # -RC
    optimal_coverage: bool = True  # -OQC
    breakpoint_penalty: int = 5  # -BP
    max_distance_log: int = 5  # -MGDP
    min_non_overlap: int | None = None  # -MNO, else min_match
    similar: bool = False  # -FBS
    reciprocal_length: float = 0.9  # -PRL
    score_ratio: float = 0.9  # -PSS
    max_query_length: int = MAX_QUERY_LENGTH

    def __post_init__(self) -> None:
        if not 1 <= self.word_len < 16:
            raise ValueError("word_len must be from 1 to 15")
        if not 1 <= self.skip_dist <= self.word_len:
            raise ValueError("skip_dist must be from 1 to word_len")
        if not 0 < self.min_identity <= 1:
            raise ValueError("min_identity must be over 0 and at most 1")
        for name, value in (
            ("max_hits", min(self.max_hits, MAX_HITS_LIMIT)),
            ("index_max_hits", min(self.index_max_hits, MAX_HITS_LIMIT)),
            ("max_intron", self.max_gap if self.max_intron is None else self.max_intron),
            ("min_raw_score", self.min_match if self.min_raw_score is None else self.min_raw_score),
            ("min_non_overlap", max(1, self.min_match if self.min_non_overlap is None else self.min_non_overlap)),
            ("max_distance_log", min(9, max(1, self.max_distance_log))),
        ):
            object.__setattr__(self, name, value)
        if not self.affine:
            for name, value in (("match", 1), ("replace", 1), ("gap_extend", 1), ("gap_open", 0)):
                object.__setattr__(self, name, value)

    @property
    def min_extension(self) -> int:
        """The fewest bases worth extending over: that many matches outweigh the cheapest error."""
        return min(self.replace, self.gap_open + self.gap_extend) // self.match + 2

    def gap_cost(self, n: int) -> int:
        return -(self.gap_open + n * self.gap_extend) if n else 0

    def with_(self, **changes) -> AlignParams:
        return replace(self, **changes)

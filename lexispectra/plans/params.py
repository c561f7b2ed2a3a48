"""Training parameters with one set of defaults; invalid values are refused."""

from __future__ import annotations

from dataclasses import dataclass

from lexispectra.functions.weights import weighting_code
from lexispectra.operators.windows import check_window


@dataclass(frozen=True)
class TrainParams:
    min_count: int = 10
    max_vocab: int = 0  # 0: no limit
    window: int = 10
    weighting: int | str = 1
    symmetric: bool = True
    pmi_cutoff: float | None = -2.5
    pmi_shift: float | None = 2.5
    dimension: int = 100
    method: str = "block"  # see operators.svd

    def __post_init__(self) -> None:
        if self.min_count < 0 or self.max_vocab < 0:
            raise ValueError("min_count and max_vocab must not be negative")
        if self.dimension < 1:
            raise ValueError("dimension must be at least 1")
        check_window(self.window)
        weighting_code(self.weighting)

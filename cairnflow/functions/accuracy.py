"""Error guarantees of the summaries, and the smallest size that meets a target."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

# Fixed size lists from which a summary is chosen, smallest first.
KLL_SIZES = (26, 52, 132, 269, 547, 1404, 2863)
DDSKETCH_ALPHAS = (0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)
HLL_SIZES = (13, 15, 17, 18)
KMV_SIZES = (1118, 4323, 26656, 106263)


@dataclass(frozen=True)
class Target:
    """Error at most `epsilon` with probability 1 - `delta`, for each of `values` results together (union bound)."""

    epsilon: float
    delta: float = 0.01
    values: int = 1

    @property
    def each(self) -> float:
        return self.delta / max(1, self.values)


def _normal_tail(delta: float) -> float:
    """Two-sided quantile of the normal distribution."""
    low, high = 0.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) > delta else (low, mid)
    return high


def kll_error(k: int, delta: float = 0.01) -> float:
    """Rank error, scaled from the published 99 % figure."""
    return 2.296 / k**0.9723 * _normal_tail(delta) / _normal_tail(0.01)


def hll_error(p: int, delta: float = 0.01) -> float:
    return 1.04 / math.sqrt(2**p) * _normal_tail(delta)


def kmv_error(k: int, delta: float = 0.01) -> float:
    return _normal_tail(delta) / math.sqrt(max(1, k - 2))


def count_min_size(target: Target) -> tuple[int, int]:
    """(width, depth) for an error of epsilon times the total weight."""
    return math.ceil(math.e / target.epsilon), max(1, math.ceil(math.log(1 / target.each)))


def count_sketch_size(target: Target) -> tuple[int, int]:
    """(width, depth) for an error of epsilon times the L2 norm; a row misses with 1/3 at most, so odd medians of depth rows fail rarely."""
    depth = 1
    while sum(math.comb(depth, i) * (1 / 3) ** i * (2 / 3) ** (depth - i) for i in range(depth // 2 + 1, depth + 1)) > target.each:
        depth += 2
    return math.ceil(3 / target.epsilon**2), depth


def smallest(sizes: Sequence, error, target: Target):
    """The first size whose error meets the target, or None: then the exact result is the only one allowed."""
    if target.epsilon <= 0:
        return None
    return next((s for s in sizes if error(s, target.each) <= target.epsilon), None)


def kll_size(target: Target) -> int | None:
    return smallest(KLL_SIZES, kll_error, target)


def hll_size(target: Target) -> int | None:
    return smallest(HLL_SIZES, hll_error, target)


def kmv_size(target: Target) -> int | None:
    return smallest(KMV_SIZES, kmv_error, target)


def ddsketch_alpha(target: Target) -> float | None:
    """Deterministic relative error; needs values of one sign."""
    return smallest(DDSKETCH_ALPHAS, lambda alpha, _: alpha, target)

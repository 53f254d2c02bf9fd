"""Further signature positions go on with the sequential test where the signature's stop."""

from __future__ import annotations

import numpy as np

from parleynet.llm.near_duplicates import Settings


def _pairs(likeness: float, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """n pairs (rows 2i, 2i + 1) whose further positions are equal with the chance `likeness`, and their signatures' equal positions."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (2 * n, s.further), dtype=np.uint8)
    same = rng.random((n, s.further)) < likeness
    rows[1::2] = np.where(same, rows[::2], rows[1::2])
    return rows, rng.binomial(s.bands * s.rows, likeness, n)


def test_pairs_at_the_threshold_stay_and_pairs_well_below_go():
    s = Settings()
    for likeness, least, most in ((0.8, 2000, 2000), (1.0, 2000, 2000), (0.65, 0, 20), (0.5, 0, 0)):
        rows, matches = _pairs(likeness, 2000, s)
        at = np.arange(0, 4000, 2)
        stayed = len(s.survives_further(matches, rows, at, at + 1))
        assert least <= stayed <= most, (likeness, stayed)


def test_no_pairs():
    s = Settings()
    none = np.zeros(0, dtype=np.int64)
    assert len(s.survives_further(none, np.zeros((0, s.further), np.uint8), none, none)) == 0

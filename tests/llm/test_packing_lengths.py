"""Packing: lengths chosen jointly from the sizes left."""

from __future__ import annotations

import numpy as np
import pytest

from litloom.llm import packing


def cost(fit) -> tuple[int, int]:
    return int(fit[1].sum()), len(fit[1])


@pytest.mark.parametrize("kind", ["mid", "many", "large", "zeros", "none", "one", "full"])
def test_joint_choice_is_valid_and_never_dearer(kind):
    r = np.random.default_rng(5)
    sizes = {
        "mid": r.integers(240, 512, 2000), "many": np.minimum(r.geometric(1 / 300, 4000), 1024), "large": r.integers(600, 1025, 500), "zeros": np.r_[np.zeros(7, int), 5], "none": np.zeros(0, int),
        "one": np.array([700]), "full": np.full(9, 1024),
    }[kind]
    sizes = np.sort(sizes)[::-1].copy()
    where, final = packing.best_fit(sizes)
    assert (np.bincount(where, weights=sizes, minlength=len(final)) <= final).all() and set(final) <= set(packing.LENGTHS) and len(where) == len(sizes)
    one, _ = packing._single(sizes, 1024)
    only = cost((one, np.full(int(one.max()) + 1 if len(one) else 0, 1024)))
    assert cost((where, final))[0] <= only[0]
    if kind in ("mid", "many", "large"):
        assert cost((where, final))[0] - sizes.sum() < 0.5 * (only[0] - sizes.sum())  # less than half of the unused tokens
    if kind == "mid":
        assert (final < 1024).sum() > 100  # shorter ones are opened where nothing fills the longest

"""One seed for all that draws: NumPy, random, and a number for each named draw."""

from __future__ import annotations

import hashlib
import random

import numpy as np

#: Fixed value: the seed of all protocols.
SEED = 20260920


def seed_all(seed: int = SEED) -> np.random.Generator:
    """Seeds the process's generators (the driver's; tasks draw by `named`) and returns a new one."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return np.random.default_rng(seed)


def named(name: str, seed: int = SEED) -> int:
    """A seed of 63 bits for a draw, such as rand(seed) of a column or a task's generator, that does not depend on other draws."""
    return int.from_bytes(hashlib.sha256(f"{seed}|{name}".encode()).digest()[:8], "big") >> 1

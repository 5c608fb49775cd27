"""Packing of partitions whose tails fill a few windows only."""

import random

import numpy as np
import pytest
from ledgerwright.llm import packing


@pytest.mark.parametrize("n", [0, 1, 2, 7, 20, 30, 300])
def test_small_partitions_cut_two_windows_at_most(n):
    rnd, packer = random.Random(n), packing.Packer(256, 0, 64)
    lengths = [rnd.randrange(1, 600) for _ in range(n)]
    for key, length in enumerate(lengths):
        packer.add(key, np.arange(length, dtype="<u4"))
    packer.finish()
    rows, cut = packer.drain(), 0
    for key, length in enumerate(lengths):
        pieces = sorted(((r[1], r[2]) for r in rows if r[0] == key), key=lambda p: p[0])
        assert np.concatenate([p for _, p in pieces]).tolist() == list(range(length))
        cut += length % 256 if len(pieces) > -(-length // 256) else 0
    assert cut <= 2 * 256
    assert max([0, *np.bincount([r[4] for r in rows], [len(r[2]) for r in rows])]) <= 256 if rows else not lengths

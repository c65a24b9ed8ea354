"""The chain lengths prune before the full Hamming check."""

from __future__ import annotations

import numpy as np

from millrace.llm.simhash import Ring, _forest


def test_chain_prunes_before_the_full_check():
    ring = Ring(2, 8)
    rng = np.random.default_rng(5)
    for start in range(8):
        flips = rng.integers(0, 2**64, 300, dtype=np.uint64) & ~ring.run_masks[start]
        near = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64)) & ~ring.run_masks[start] for _ in range(60)])
        fps = np.unique(np.concatenate([flips, near, flips[:60] ^ near]))
        a, b = ring.chained(start, fps, fps)
        x = fps[a] ^ fps[b]
        # all that link are left, and each of the lengths 4 to 7 holds for what is left
        full = fps[:, None] ^ fps[None]
        assert ring.linked(start, x).sum() == ring.linked(start, full).sum()
        assert len(a) < full.size / 8
        for length in range(ring.run + 1, ring.m):
            mask = np.bitwise_or.reduce(ring.masks[[(start + i) % 8 for i in range(length)]])
            assert (np.bitwise_count(x & mask) <= ring.bound[length]).all()
        u, v = _forest(fps, ring, start)
        assert len(u) == len(fps) - parts(ring.linked(start, full))


def parts(linked):
    reach = linked.copy()
    for _ in range(12):
        reach |= (reach.astype(int) @ reach.astype(int)) > 0
    return len({tuple(r) for r in reach})

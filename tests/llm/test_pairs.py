"""Re-Pair with the production values leaves no frequent pair."""

from collections import Counter

import numpy as np

from ledgerloom.llm import repair


def test_long_repeats_become_one_symbol():
    rng = np.random.default_rng(5)
    passage = rng.integers(3, 40_000, 1000)
    ids = np.concatenate([np.r_[rng.integers(3, 40_000, 5), passage, 2] for _ in range(8)]).astype(np.int32)
    rules, sequence = repair.compressed(ids)
    base = int(ids.max()) + 1
    assert repair.expanded(sequence, rules, base).tolist() == ids.tolist()
    assert max(repair.lengths(rules, base)) >= 1000 and len(sequence) <= 8 * 7


def test_no_pair_is_left_that_is_seen_often():
    ids = np.random.default_rng(6).integers(3, 30, 20_000).astype(np.int32)
    rules, sequence = repair.compressed(ids)
    assert repair.expanded(sequence, rules, 30).tolist() == ids.tolist()
    left = Counter(zip(sequence[:-1].tolist(), sequence[1:].tolist()))
    assert max(left.values()) < repair.LEAST

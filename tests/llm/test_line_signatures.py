"""Contents under which lines are posted: no matching pair is lost, and few other pairs meet."""

import random

import numpy as np
import pyarrow as pa

from fityard.llm import line_dedup
from fityard.llm.sketch import buckets_of
from fityard.llm.textcols import texts_words


def test_lines_meet_under_contents_of_parts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    lines = []
    for _ in range(60):
        own = rng.sample(words, rng.choice([3, 4, 5, 7, 8, 9, 15, 16, 31, 40, 64, 100, 130]))
        lines.append(own)
        for _ in range(2):
            other = [w for w in own if rng.random() > 0.08]
            lines.append(other + rng.sample(words, rng.randint(0, len(own) // 8)) or own)
    sets = [frozenset(x) for x in lines]
    column = pa.array([" ".join(x) for x in lines])
    counts = np.zeros(1 << 22, dtype=np.int64)
    for _, _, hashes, _ in texts_words(column):
        np.add.at(counts, buckets_of(hashes), 1)
    levels = np.where(counts > 0, 1 + np.floor(2 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)
    (_, _, hashes, to), = line_dedup.line_sets(column)
    tokens, at = line_dedup.distinct_tokens(hashes, to, levels)
    parity, counted = line_dedup._parities(tokens, at, 1)[:, 0], line_dedup._counts(tokens, at)
    for percent in (30, 50, 80, 95):
        posted = [set() for _ in sets]
        for content, line, _ in line_dedup.signatures(tokens, at, int(levels.max()), percent):
            for c, k in zip(content.tolist(), line.tolist()):
                posted[k].add(c)
        matching = met = 0
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                differ = len(x ^ y)
                assert np.bitwise_count(parity[i] ^ parity[j]) <= differ
                assert line_dedup._counts_apart(counted[i:i + 1], counted[j:j + 1])[0] <= differ
                if x != y and 100 * len(x & y) >= percent * len(x | y):
                    matching += 1
                    assert posted[i] & posted[j]
                elif x != y and percent == 80:
                    met += bool(posted[i] & posted[j])
        assert matching
        assert percent != 80 or met < 200  # of 16,000 pairs

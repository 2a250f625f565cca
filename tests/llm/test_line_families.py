"""Large families of lines that match each other: every pair counts once, and few are compared."""

import random

import numpy as np

from fityard.llm import line_dedup

U64 = np.uint64


def test_lines_that_have_met_one_are_not_compared_again(monkeypatch):
    n, compared = 3000, []
    told = (U64(7) << U64(17)) | np.sort(np.arange(n) % 3 + 100).astype(U64) << U64(1) | U64(1)
    rows = np.stack([told, np.arange(1, n + 1).astype(U64), np.full(n, 0x1111111111111111, U64)], axis=1)
    rows[n // 2, 2] = 0x8888888888888888  # a line that is like no other one
    counts_apart = line_dedup._counts_apart
    monkeypatch.setattr(line_dedup, "_counts_apart", lambda x, y: (compared.append(len(x)), counts_apart(x, y))[1])
    out, = line_dedup._compared(rows[:, 0] >> U64(17), rows, 80, line_dedup.WIDE)
    assert sorted(out.column(1).to_pylist()) == [i for i in range(1, n + 1) if i != n // 2 + 1]
    assert sum(compared) < 5 * n


def test_pairs_meet_in_their_first_unit_only(monkeypatch):
    rng = random.Random(5)
    members = [sorted(rng.sample(range(1, 1200), rng.choice([1, 3, 30, 300]))) for _ in range(80)]
    sizes = [rng.randint(50, 90) for _ in members]
    rows = sorted((u, sizes[k], k) for k, units in enumerate(members) for u in units)
    unit, size, line = (np.array(x) for x in zip(*rows))
    earlier = [[v for v in members[k] if v < u] for u, _, k in rows]
    at = np.concatenate([[0], np.cumsum([len(x) for x in earlier])])
    values = np.array([v for x in earlier for v in x], dtype=U64)
    expected = sorted((a, b) for a in range(80) for b in range(a) if set(members[a]) & set(members[b])
                      and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b]))
    for words, at_once in ((8, 1 << 20), (2, 1 << 20), (8, 100)):
        monkeypatch.setattr(line_dedup, "MARK_WORDS", words)
        monkeypatch.setattr(line_dedup, "VALUES_AT_ONCE", at_once)
        met = [(max(p), min(p)) for i, j in line_dedup._first_meetings(unit, size, values, at, 80)
               for p in zip(line[i].tolist(), line[j].tolist())]
        assert sorted(met) == expected


def test_marks_bound_what_sets_have_in_common(monkeypatch):
    rng = random.Random(6)
    group, sets = np.repeat([4, 2, 9], [40, 1, 60]), []
    for g in group:
        sets.append(sorted(rng.sample(range(g * 1000, g * 1000 + 300), rng.randint(0, 90))))
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    values = np.array([v for x in sets for v in x], dtype=U64)
    for words in (1, 2, 8):
        monkeypatch.setattr(line_dedup, "MARK_WORDS", words)
        bits, rest = line_dedup._marks(group, values, at)
        for i in range(len(sets)):
            for j in range(i):
                if group[i] == group[j]:
                    common, marked = len(set(sets[i]) & set(sets[j])), int(np.bitwise_count(bits[i] & bits[j]).sum())
                    assert marked <= common <= marked + min(rest[i], rest[j])
                    assert line_dedup._common(values, at, np.array([i]), np.array([j]))[0] == common if sets[i] + sets[j] else not common
        assert words < 8 or not rest.any()

"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Two sets with ``100 * intersection >= percent * union`` differ in at most
``d = (100 - percent) * (sum of sizes) // (100 + percent)`` tokens. If hashes deal all tokens out to ``k = d + g`` parts, at
least ``g`` parts of the two sets are equal, and the strongest of those, the one with the rarest tokens by the levels of
``sketch``, is among the ``d + 1`` strongest parts of both (the sets differ in ``d`` parts at most, whatever stands before it
is one of them). So a line is posted under the contents of its ``d + 1`` strongest parts, and not under parts with
a token that no other line has. ``k`` is fixed for all lines whose size has the same number of binary digits; a line is also
posted in the terms of the next such class if a matching line can be that long. What is posted under the same content is
compared by size and by 64 bits, parities or small counts, that bound from below in how many tokens two sets differ. What is left is verified on
the full sets. A line goes if an earlier line of the corpus matches it.

1. Count tokens. 2. Post the lines; postings travel in arrays, cut by the first bits of their contents. Compare what is
posted under one content in the order of sizes, in pairs of blocks if it is much. Lines that had a candidate under a content
are a unit; contents with the same such lines are one unit. 3. Read the texts again for the places of all lines, and the full
sets of those in units. A pair is verified in the first unit its lines share: keep the lines that have such a partner in a unit,
gather units with their sets, verify, and sum up links by line; no row is made for a pair. Only pairs with a line of more than ``WIDE`` tokens are joined with their sets one
by one, as such a set is too long to be sent with every unit. 4. Join the decisions back to the lines, gather them by
document, and cut the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fityard.llm.sketch import buckets_of, occurrence_levels
from fityard.llm.textcols import U64, buffers, mix, pieces, released, texts_words, whole_groups, word_hashes
from fityard.runtime import drop_old_shuffles, written

BLOCK = 8192           # rows of one content that are compared with each other at once
WIDE = 512             # tokens up to which a line's set is sent with its units
TOKEN_BITS = 42        # bits of a token's hash that tell tokens apart inside a set
UNIT_BITS = 48
PARITY_DIGITS = 6      # binary digits of the sizes up to which postings tell parities, and counts beyond
SKETCH_WORDS = 8       # of 64 parity bits, where units are compared
MARK_WORDS = 8         # of 64 bits, for the most frequent values in a unit
VALUES_AT_ONCE = 1 << 20
SLICE_BITS = 12        # first bits of a content by which postings are cut into arrays
MAX_SIZE = (1 << 16) - 1  # of a set, as postings tell it
TEXT_AT_ONCE = 1 << 18
LINES_AT_ONCE = 60_000
POSTINGS_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 15
PLACE = "struct<id:bigint,line:bigint>"  # of a line; places are ordered by id, then line
_LOW = U64((1 << TOKEN_BITS) - 1)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of the texts begin (and the end), and each text's first line."""
    cut = np.flatnonzero(data == 10) + 1
    starts = np.union1d(cut, offsets[:-1][np.diff(offsets) > 0])
    starts = starts[starts < len(data)]
    bounds = np.concatenate([starts, [len(data)]])
    return bounds, np.searchsorted(starts, offsets)


def line_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of lines with words: row, line number in the text, token hashes, where each line's begin.
    A line ends at a line feed; an empty last line counts for nothing."""
    data, offsets = buffers(column)
    for a, b in pieces(offsets, TEXT_AT_ONCE):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if not len(part):
            continue
        bounds, first = _lines(part, at)
        words, word_at = word_hashes(part, bounds)
        row = np.repeat(np.arange(a, b), np.diff(first))
        number = np.arange(len(row)) - np.repeat(first[:-1], np.diff(first))
        used = np.flatnonzero(np.diff(word_at) > 0)
        for k in range(0, len(used), LINES_AT_ONCE):
            pick = used[k:k + LINES_AT_ONCE]
            size = word_at[pick + 1] - word_at[pick]
            to = np.concatenate([[0], np.cumsum(size)])
            index = np.repeat(word_at[pick] - to[:-1], size) + np.arange(to[-1])
            yield row[pick], number[pick], words[index], to


def distinct_tokens(words: np.ndarray, to: np.ndarray, levels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct tokens in rarity order, as level and hash bits in one integer, and where they
    begin. Without levels the order is that of the hashes."""
    line = np.repeat(np.arange(len(to) - 1, dtype=U64), np.diff(to))
    level = U64(0) if levels is None else levels[buckets_of(words)].astype(U64)
    key = np.sort(line << U64(48) | level << U64(TOKEN_BITS) | (words & _LOW))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & U64((1 << 48) - 1), np.searchsorted(key >> U64(48), np.arange(len(to), dtype=U64))


def _keys(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that lines with equal sets have in common."""
    return (np.add.reduceat(mix(tokens), at[:-1]), np.add.reduceat(mix(tokens ^ U64(0x5851F42D4C957F2D)), at[:-1]))


def _parities(tokens: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Each line's parity bits, in so many integers: bit i tells whether an odd number of tokens hash to it. Two sets differ in
    at least as many tokens as their bits differ."""
    where = mix(tokens)
    line = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.zeros((len(at) - 1) * words, dtype=U64)
    np.bitwise_xor.at(out, line * words + (where >> U64(6) & U64(words - 1)).astype(np.int64), U64(1) << (where & U64(63)))
    return out.reshape(-1, words)


def _counts(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of each line's tokens hash to each of 16 places, modulo 16, in the four bits of each place."""
    n = len(at) - 1
    place = np.repeat(np.arange(n) * 16, np.diff(at)) + (mix(tokens) & U64(15)).astype(np.int64)
    by_line = (np.bincount(place, minlength=16 * n) & 15).astype(np.uint8).reshape(-1, 2)
    return (by_line[:, 0] | by_line[:, 1] << 4).view(U64)


def _counts_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many tokens two sets differ at least by their counts."""
    x, y = (np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8) for v in (x, y))
    out = np.zeros(len(x), dtype=np.int64)
    for one, other in ((x & 15, y & 15), (x >> 4, y >> 4)):
        d = one - other & 15
        out += np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
    return out


def signatures(tokens: np.ndarray, at: np.ndarray, most_level: int,
               percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each step, 0 for a line's own class of sizes and 1 or more for the following ones: the contents under which lines
    are posted in the terms of that class, hashed, and their lines. Tokens have levels and come line by line."""
    n = np.diff(at)
    most = 100 * n // percent  # size of a matching line
    digits = np.frexp(n)[1].astype(np.int64)
    where = mix(tokens ^ U64(0x2545F4914F6CDD1D))
    level = (tokens >> U64(TOKEN_BITS)).astype(np.int64)
    # The logarithm of a token's share; a token that occurs once outweighs all.
    weight = np.where(level > 1, most_level + 2 - level, 1 << 20)
    step = -1
    while True:
        step += 1
        up = (1 << digits + step) - 1
        fits = most >= (up >> 1) + 1 if step else n > 0
        if not fits.any():
            return
        apart = (100 - percent) * (n + np.minimum(up, most)) // (100 + percent)
        pick = np.flatnonzero(fits & (apart > 0))
        if not len(pick):
            continue
        widest = 2 * (100 - percent) * up[pick] // (100 + percent)
        parts = widest + 1 + widest // 2
        base = np.concatenate([[0], np.cumsum(parts)])
        size = n[pick]
        to = np.cumsum(size)
        index = np.repeat(at[pick] - to + size, size) + np.arange(to[-1])
        owner = np.repeat(np.arange(len(pick)), size)
        h = where[index]
        cell = base[owner] + ((h >> U64(32)) * parts[owner].astype(U64) >> U64(32)).astype(np.int64)
        content = np.zeros(base[-1], dtype=U64)
        np.add.at(content, cell, mix(h))
        strength = np.minimum(np.bincount(cell, weights=weight[index], minlength=base[-1]).astype(np.int64), (1 << 20) - 1)
        # Lines, then their parts by strength, then by number: an order that is the same for all lines of a class.
        owner = np.repeat(np.arange(len(pick)), parts)
        number = np.arange(base[-1]) - base[owner]
        key = np.sort(owner.astype(U64) << U64(48) | ((1 << 20) - 1 - strength).astype(U64) << U64(28) | number.astype(U64))
        owner, number = (key >> U64(48)).astype(np.int64), (key & U64((1 << 28) - 1)).astype(np.int64)
        rank = np.arange(base[-1]) - base[owner]
        live = (rank <= apart[pick][owner]) & (key >> U64(28) & U64((1 << 20) - 1) > 0)
        owner, number = owner[live], number[live]
        line = pick[owner]
        terms = number.astype(U64) << U64(8) | (digits[line] + step).astype(U64)
        yield mix(content[base[owner] + number] ^ mix(terms)), line, step


def _postings(texts: DataFrame, levels, percent: int) -> DataFrame:
    """``(slice, postings)``: arrays of content, class and sketch (parities or counts), 64 bits each. The last bits of a content are
    replaced by the line's size (up to ``MAX_SIZE``) and whether the content is in the terms of its own class of sizes."""
    def sliced(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows[:, 0])]
        if len(rows) > 1:
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        at = np.searchsorted(rows[:, 0] >> U64(64 - SLICE_BITS), np.arange((1 << SLICE_BITS) + 1).astype(U64))
        used = np.flatnonzero(np.diff(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([rows[at[k]:at[k + 1]].tobytes() for k in used], pa.binary())],
            names=["slice", "postings"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_level, held = int(levels.value.max()), []
        for batch in batches:
            for _, _, words, to in line_sets(batch.column(0)):
                tokens, at = distinct_tokens(words, to, levels.value)
                one, _ = _keys(tokens, at)
                if len(one) > 1 and len(once := np.sort(np.unique(one, return_index=True)[1])) < len(one):
                    size = np.diff(at)[once]
                    end = np.cumsum(size)
                    tokens = tokens[np.repeat(at[once] - end + size, size) + np.arange(end[-1])]
                    one, at = one[once], np.concatenate([[0], end])
                parity, counts = _parities(tokens, at, 1)[:, 0], _counts(tokens, at)
                digits, size = np.frexp(np.diff(at))[1], np.minimum(np.diff(at), MAX_SIZE).astype(U64)
                for content, line, step in signatures(tokens, at, most_level, percent):
                    told = content & ~U64((1 << 17) - 1) | size[line] << U64(1) | U64(step == 0)
                    sketch = np.where(digits[line] + step > PARITY_DIGITS, counts[line], parity[line])
                    held.append(np.stack([told, one[line], sketch], axis=1))
                if sum(len(x) for x in held) >= POSTINGS_AT_ONCE:
                    yield from sliced(held)
                    held = []
        if held:
            yield from sliced(held)

    return texts.select("text").mapInArrow(released(post), "slice int, postings binary")


def _near_rows(group: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one group whose sizes are near enough. Sizes ascend in a group."""
    if not len(group):
        return
    number = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]])) << 32
    # How many of the following rows are near enough.
    span = np.searchsorted(number | size, number | 100 * size // percent, side="right") - np.arange(1, len(group) + 1)
    left, s = np.flatnonzero(span > 0), 1
    while len(left):
        yield left, left + s
        s += 1
        left = left[span[left] >= s]


def _slack(one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """In how many tokens matching sets of these sizes may differ."""
    both = one + other
    return both - 2 * -(-percent * both // (100 + percent))


_FOUND = "unit bigint, a bigint, b bigint, content bigint, sketch bigint, n bigint"


def _found(unit=None, a=None, b=None, content=None, sketch=None, n=None) -> pa.RecordBatch:
    given = [unit, a, b, content, sketch, n]
    rows = next(len(x) for x in given if x is not None)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(rows, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in given],
        names=[c.split()[0] for c in _FOUND.split(", ")])


def _compared(group: np.ndarray, rows: np.ndarray, percent: int, wide: int,
              block: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``_FOUND`` for postings that come by group and size: unit and a for the members of units, a and b for pairs
    with a line of more than ``wide`` tokens. Groups of more than ``block`` rows are passed on: content, a, sketch and n."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    number = np.cumsum(first) - 1
    n = np.bincount(number)
    if block and (n > block).any():
        large = n[number] > block
        yield _found(a=rows[large, 1].copy(), content=rows[large, 0].copy(), sketch=rows[large, 2].copy(), n=n[number[large]])
        number, rows = number[~large], rows[~large]
    cls, sketch, own = rows[:, 1].copy(), rows[:, 2].copy(), rows[:, 0] & U64(1) > 0
    size = (rows[:, 0] >> U64(1) & U64(MAX_SIZE)).astype(np.int64)
    hit, pairs = np.zeros(len(cls), dtype=bool), []
    for i, j in _near_rows(number, size, percent):
        # Two lines that have met another one need not be compared: only of lines beyond ``wide`` (never hit) pairs are told.
        ok = ~(hit[i] & hit[j])
        i, j = i[ok], j[ok]
        # Contents are in the terms of the larger line's class of sizes, else another content tells of the pair.
        ok = own[j] & (cls[i] != cls[j])
        i, j = i[ok], j[ok]
        slack = _slack(size[i], size[j], percent)
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).astype(np.int64)
        by_counts = size[j] >= 1 << PARITY_DIGITS
        apart[by_counts] = _counts_apart(sketch[i[by_counts]], sketch[j[by_counts]])
        ok = (apart <= slack) | (size[j] == MAX_SIZE)
        i, j = i[ok], j[ok]
        long = size[j] > wide
        hit[i[~long]] = hit[j[~long]] = True
        if long.any():
            x, y = cls[i[long]].view(np.int64), cls[j[long]].view(np.int64)
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    if hit.any():
        unit = np.zeros(len(n), dtype=U64)
        np.add.at(unit, number[hit], mix(cls[hit]))
        yield _found(unit=(unit[number[hit]] >> U64(64 - UNIT_BITS)), a=cls[hit])
    if pairs:
        both = np.unique(np.concatenate(pairs), axis=0)
        yield _found(a=both[:, 0].copy(), b=both[:, 1].copy())


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Rows of ``_FOUND`` for the lines that are posted under the same contents."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1000):
            rows = np.frombuffer(b"".join(table.column(1).to_pylist()), dtype=U64).reshape(-1, 3)
            order = np.argsort(rows[:, 0])
            content = rows[order, 0] >> U64(17)
            same = content[1:] == content[:-1]
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            rows = rows[order]
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            if len(rows):
                rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
                yield from _compared(rows[:, 0] >> U64(17), rows, percent, WIDE, BLOCK)

    return (postings.repartition("slice").sortWithinPartitions("slice").mapInArrow(released(compare), _FOUND))


def _block_candidates(large: DataFrame, percent: int) -> DataFrame:
    """Rows of ``_FOUND`` for the contents that many lines are posted under, in pairs of blocks of lines."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 20_000):
            group, *rows = (table.column(i).to_numpy().view(U64) for i in range(4))
            yield from _compared(group, np.stack(rows, axis=1), percent, WIDE)

    nb = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    at = F.pmod(F.xxhash64("a", "block_of"), F.col("nb")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: j != F.col("at"))
    rows = (large.withColumn("block_of", F.expr("shiftrightunsigned(content, 17)")).withColumn("nb", nb).withColumn("at", at)
            .withColumn("other", F.explode(others)))
    blocks = F.xxhash64("block_of", F.least("at", "other"), F.greatest("at", "other"))
    return (rows.select(blocks.alias("blocks"), "content", "a", "sketch")
            .repartition("blocks").sortWithinPartitions("blocks", F.expr("content & 131071"), "a")
            .mapInArrow(released(compare), _FOUND))


def _common(values: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values of 48 bits the sets i and j have in common."""
    sets = np.concatenate([i, j])
    pair = np.tile(np.arange(len(i), dtype=U64), 2)
    size = at[sets + 1] - at[sets]
    to = np.cumsum(size)
    index = np.repeat(at[sets] - to + size, size) + np.arange(to[-1])
    key = np.sort(np.repeat(pair, size) << U64(48) | values[index])
    return np.bincount((key[:-1][key[1:] == key[:-1]] >> U64(48)).astype(np.int64), minlength=len(i))


def _marks(group: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets of 48-bit values, which of their group's ``64 * MARK_WORDS`` most frequent values they have, as bits, the most
    frequent first, and how many other ones that another set of the group has too. Sets of a group come together."""
    bits, rest = np.zeros((len(group), MARK_WORDS), dtype=U64), np.zeros(len(group), dtype=np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    for x, y in pieces(at[bounds], VALUES_AT_ONCE):
        rows, value = slice(bounds[x], bounds[y]), values[at[bounds[x]]:at[bounds[y]]]
        if not len(value):
            continue
        row = np.repeat(np.arange(rows.start, rows.stop), np.diff(at[rows.start:rows.stop + 1]))
        number = np.repeat(np.arange(y - x), np.diff(at[bounds[x:y + 1]]))
        if y - x <= 1 << 16:
            order = np.argsort(number.astype(U64) << U64(48) | value)
        else:
            order = np.lexsort((value, number))
        number, value, row = number[order], value[order], row[order]
        first = np.concatenate([[True], (number[1:] != number[:-1]) | (value[1:] != value[:-1])])
        which = np.cumsum(first) - 1
        n, number = np.bincount(which), number[first]
        order = np.lexsort((-n, number))
        rank = np.empty(len(n), dtype=np.int64)
        rank[order] = np.arange(len(n)) - np.searchsorted(number, number)
        n, rank = n[which], rank[which]
        marked = (n > 1) & (rank < 64 * MARK_WORDS)
        np.bitwise_or.at(bits, (row[marked], rank[marked] >> 6), U64(1) << (rank[marked] & 63).astype(U64))
        rest[rows] = np.bincount(row[(n > 1) & ~marked] - rows.start, minlength=rows.stop - rows.start)
    return bits, rest


def _first_meetings(unit: np.ndarray, size: np.ndarray, earlier: np.ndarray, at: np.ndarray, percent: int,
                    hit: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one unit that are near enough by size and have no earlier unit in common, up to ``PAIRS_AT_ONCE`` together;
    but not two rows that are both ``hit``. Earlier units come row by row."""
    bits, rest = _marks(unit, earlier, at)
    top, held, n = bits[:, 0].copy(), [], 0

    def apart(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = ~(bits[i, 1:] & bits[j, 1:]).any(axis=1)
        unsure = np.flatnonzero(ok & (rest[i] > 0) & (rest[j] > 0))
        if len(unsure):
            ok[unsure] = _common(earlier, at, i[unsure], j[unsure]) == 0
        return i[ok], j[ok]

    for i, j in _near_rows(unit, size, percent):
        ok = top[i] & top[j] == 0
        if hit is not None:
            ok &= ~(hit[i] & hit[j])
        held.append((i[ok], j[ok]))
        n += len(held[-1][0])
        if n >= PAIRS_AT_ONCE:
            i, j = (np.concatenate(x) for x in zip(*held))
            for k in range(0, n, PAIRS_AT_ONCE):
                yield apart(i[k:k + PAIRS_AT_ONCE], j[k:k + PAIRS_AT_ONCE])
            held, n = [], 0
    if n:
        yield apart(*(np.concatenate(x) for x in zip(*held)))


def _first_units(classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``(unit, class)`` of the given ones whose class has one near enough in the unit with which it shares no earlier unit.
    They are compared by their sizes and parities only."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                rows = batch.slice(k, 2048)
                sets = rows.column(1).to_pylist()
                size = np.array([len(x) // 8 for x in sets])
                parity = _parities(np.frombuffer(b"".join(sets), dtype=U64), np.concatenate([[0], np.cumsum(size)]), SKETCH_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(size), pa.array([x.tobytes() for x in parity], pa.binary())],
                    names=["class", "size", "parity"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 20_000):
            unit, cls, size = (table.column(c).to_numpy() for c in ("unit", "class", "size"))
            parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), dtype=U64).reshape(-1, SKETCH_WORDS)
            hit = np.zeros(len(cls), dtype=bool)
            for i, j in _first_meetings(unit, size, *_lists(table.column("earlier")), percent, hit):
                ok = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1) <= _slack(size[i], size[j], percent)
                hit[i[ok]] = hit[j[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(unit[hit]), pa.array(cls[hit])], names=["unit", "class"])

    sketches = _narrow(classes).select("class", "tokens").mapInArrow(released(sketch), "class bigint, size bigint, parity binary")
    lists = members.groupBy("class").agg(F.sort_array(F.collect_set("unit")).alias("units"))
    return (lists.join(sketches, "class").select(F.posexplode("units").alias("pos", "unit"), "class", "size", "parity", "units")
            .select("unit", "class", "size", "parity", F.expr("slice(units, 1, pos)").alias("earlier"))
            .repartition("unit").sortWithinPartitions("unit", "size", "class")
            .mapInArrow(released(check), "unit bigint, class bigint"))


def _narrow(classes: DataFrame) -> DataFrame:
    """``(class, place, tokens)`` of the sets that are sent with their units."""
    return classes.filter(f"tokens is not null and octet_length(tokens) <= {8 * WIDE}").select(
        F.col("k1").alias("class"), "place", "tokens")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The units of all rows, and where each row's begin."""
    lists = pa.concat_arrays(column.chunks)
    return (np.asarray(lists.flatten()).view(U64),
            np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64))


def _sets_by_unit(classes: DataFrame, members: DataFrame) -> DataFrame:
    """``(unit, class, size, earlier, place, tokens)`` of the members of units; earlier has the class's units before this one."""
    units = members.groupBy("class").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    return _narrow(classes).join(units, "class").select(
        F.posexplode("units").alias("pos", "unit"), "class", (F.octet_length("tokens") / 8).cast("bigint").alias("size"),
        "units", "place", "tokens").select(
        "unit", "class", "size", F.expr("slice(units, 1, pos)").alias("earlier"), "place", "tokens")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """``(class, n_links, earliest)`` by unit, of the pairs that match and whose first common unit it is."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 20_000):
            unit, cls, size = (table.column(c).to_numpy() for c in ("unit", "class", "size"))
            place = table.column("place").combine_chunks()
            place = pa.concat_arrays(place.chunks) if isinstance(place, pa.ChunkedArray) else place
            order = np.lexsort([np.asarray(place.field(c)) for c in ("line", "id")])
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            at = np.concatenate([[0], np.cumsum(size)])
            tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), dtype=U64)
            bits, rest = _marks(unit, tokens, at)
            n_links = np.zeros(len(cls), dtype=np.int64)
            earliest = np.full(len(cls), len(cls))
            for i, j in _first_meetings(unit, size, *_lists(table.column("earlier")), percent):
                least = -(-percent * (size[i] + size[j]) // (100 + percent))
                n = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
                ok = n >= least
                unsure = np.flatnonzero(~ok & (n + np.minimum(rest[i], rest[j]) >= least))
                if len(unsure):
                    ok[unsure] = _common(tokens, at, i[unsure], j[unsure]) >= least[unsure]
                for one, other in ((i[ok], j[ok]), (j[ok], i[ok])):
                    np.add.at(n_links, one, 1)
                    np.minimum.at(earliest, one, rank[other])
            some = np.flatnonzero(n_links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[some]), pa.array(n_links[some]), place.take(pa.array(order[earliest[some]]))],
                    names=["class", "n_links", "earliest"])

    return (sets.repartition("unit").sortWithinPartitions("unit", "size", "class")
            .mapInArrow(released(check), f"class bigint, n_links bigint, earliest {PLACE}"))


def _places(texts: DataFrame, levels, wanted) -> DataFrame:
    """``(id, line, k1, k2, tokens)`` of the lines; with tokens, once a batch, if the key may be in a candidate pair."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, number, words, to in line_sets(batch.column(1)):
                tokens, at = distinct_tokens(words, to, levels.value)
                one, two = _keys(tokens, at)
                full = np.zeros(len(one), dtype=bool)
                full[np.unique(one, return_index=True)[1]] = True
                full &= wanted.value[buckets_of(mix(one))] > 0
                size = np.where(full, np.diff(at), 0)
                sets = tokens[np.repeat(full, np.diff(at))]
                ends = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(number, pa.int64()),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.Array.from_buffers(pa.binary(), len(one), [
                         pa.py_buffer(np.packbits(full, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(sets)])],
                    names=["id", "line", "k1", "k2", "tokens"])

    return texts.mapInArrow(released(emit), "id bigint, line bigint, k1 bigint, k2 bigint, tokens binary")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(class, n_links, earliest)`` of given pairs: how many of the other classes match, and the first place among them."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            some = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(4), some.column(5)],
                                             names=["a", "b", "place_a", "place_b"])

    side = {c: classes.filter("tokens is not null").select(
        F.col("k1").alias(c), F.col("tokens").alias(f"tokens_{c}"), F.col("place").alias(f"place_{c}")) for c in "ab"}
    held = (pairs.join(side["a"], "a").join(side["b"], "b")
            .select("a", "b", "tokens_a", "tokens_b", "place_a", "place_b")
            .mapInArrow(released(check), f"a bigint, b bigint, place_a {PLACE}, place_b {PLACE}"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("place_b").alias("place")),
                             F.struct(F.col("b").alias("class"), F.col("place_a").alias("place"))))
    return held.select(ways.alias("w")).groupBy(F.col("w.class").alias("class")).agg(
        F.count("*").alias("n_links"), F.min("w.place").alias("earliest"))


def matched_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``(id, line, n_links, first_id, removed)`` for the lines that match another one, and the texts ``(id, text, row)`` they refer to. ``n_links`` counts the other
    distinct token sets that match the line's, ``first_id`` is the id of the earliest matching line (of the line
    itself, if it is the first)."""
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"),
                        F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text_col)).alias("row"))
    known = texts.filter("id is not null").select("id", "text")
    levels = occurrence_levels(known.select("text"), lambda batch: (
        words for _, _, words, _ in texts_words(batch.column(0), limit=TEXT_AT_ONCE)))
    found = written(_candidates(_postings(known, levels, percent), percent), "line-candidates")
    in_blocks = written(_block_candidates(found.filter("content is not null"), percent), "block-candidates")
    found = found.filter("content is null").unionByName(in_blocks)
    wanted = occurrence_levels(found.select("a", "b"), lambda batch: [
        mix(np.asarray(batch.column(i).drop_null()).view(U64)) for i in range(2)])
    drop_old_shuffles(docs.sparkSession)
    places = written(_places(known, levels, wanted), "lines")
    classes = written(places.groupBy("k1", "k2").agg(
        F.min(F.struct("id", "line")).alias("place"), F.min("tokens").alias("tokens"), F.count("*").alias("n"))
        .filter("n > 1 or tokens is not null"), "line-sets")
    drop_old_shuffles(docs.sparkSession)
    members = found.filter("unit is not null").select("unit", F.col("a").alias("class"))
    pairs = found.filter("b is not null").select("a", "b").distinct()
    links = written(_links(_sets_by_unit(classes, _first_units(classes, members, percent)), percent)
                    .unionByName(_verified(pairs, classes, percent)).groupBy("class")
                    .agg(F.sum("n_links").alias("n_links"), F.min("earliest").alias("earliest")), "line-links")
    decided = written(classes.select("k1", "k2", "place", "n").join(links.withColumnRenamed("class", "k1"), "k1", "left")
                      .filter("n > 1 or n_links is not null").drop("n"), "line-decisions")
    drop_old_shuffles(docs.sparkSession)
    lines = places.select("id", "line", "k1", "k2").join(decided, ["k1", "k2"])
    is_first = (F.col("id") == F.col("place.id")) & (F.col("line") == F.col("place.line"))
    lines = lines.select("id", "line", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                         F.least(F.col("place.id"), F.coalesce("earliest.id", "place.id")).alias("first_id"),
                         (~is_first | F.coalesce(F.col("earliest") < F.col("place"), F.lit(False))).alias("removed"))
    return lines, texts


def _cut_rows(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``(row, text, n_lines, n_links, class_id, n_removed)``; row has all columns but the text."""
    lines, texts = matched_lines(docs, id_col, text_col, percent)
    by_doc = lines.groupBy("id").agg(
        F.collect_set(F.when(F.col("removed"), F.col("line"))).alias("gone"),
        F.sum("n_links").alias("n_links"), F.min("first_id").alias("first_id"))
    joined = texts.join(by_doc, "id", "left").select(
        "id", "row", "text", F.col("gone"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.least("id", F.coalesce("first_id", "id")).alias("class_id"))
    parts = F.split("text", "\n", -1)
    n_lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(
        F.size(parts) - F.when(F.col("text").endswith("\n"), 1).otherwise(0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text and gone:
                    text = _without(text, set(gone))
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), *batch.columns[3:],
                 pa.array([len(g or ()) for g in batch.column(2).to_pylist()], pa.int64())],
                names=["row", "text", "n_lines", "n_links", "class_id", "n_removed"])

    rows = joined.select("row", "text", "gone", n_lines.cast("bigint").alias("n_lines"), "n_links", "class_id")
    return rows.mapInArrow(released(cut), StructType([
        rows.schema["row"], rows.schema["text"], *(StructField(c, LongType()) for c in (
            "n_lines", "n_links", "class_id", "n_removed"))]))


def deduplicated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           percent: int = 80) -> DataFrame:
    """All rows and columns of ``docs``, the texts without their repeated lines (see ``dedup_lines``). A document
    that has lost all its lines stays, with an empty text."""
    cut = _cut_rows(docs, id_col, text_col, percent)
    return cut.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``(id_col, text, n_lines, n_removed, n_links, class_id)`` for every row: the text without the lines
    that an earlier line of the corpus matches.

    Lines end at line feeds; words are runs without white space, A-Z lower-cased; two lines match if ``100 *
    intersection >= percent * union`` of their word sets. The order of lines is that of (id, line number). Every earlier line
    counts, also one that goes itself. Lines without words stay and match nothing. A removed line goes with its
    line feed. ``n_links`` is the sum over the lines of how many other distinct word sets match; ``class_id`` is
    the smallest id that has a line which matches one of this document's, or its own.

    Null texts stay null, with 0 lines. Rows with a null id are returned unchanged and match nothing. Rows that repeat an id
    count as one document: a line number that several of them have counts as one line, and goes in all of them. Other columns
    are not read. An empty table gives an empty table.
    """
    cut = _cut_rows(docs, id_col, text_col, percent)
    return cut.select(F.col(f"row.`{id_col}`").alias(id_col), "text", "n_lines", "n_removed", "n_links", "class_id")


def _without(text: str, drop: set[int]) -> str:
    parts = text.split("\n")
    ended = [p + "\n" for p in parts[:-1]] + parts[-1:]
    return "".join(p for i, p in enumerate(ended) if i not in drop)

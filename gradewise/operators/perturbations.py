"""K3 / J5 over batches: the statement changes of many puzzles at once, in numpy.

``perturb`` (puzzles.py) numbers the statements each speaker could make instead; the one first in a
seeded order (an md5 of seed, key and number) among those that leave one other solution is the
answer, so every valid candidate of every puzzle needs its md5: 590 a puzzle of 2 to 8 people on
average.  Here the puzzles of one size are tried together.  The assignments that the other speakers
leave a speaker become the bits of one small word (more words beyond 64 of them), each leaf is such
a word, and a candidate is valid when it differs from "the speaker is a knave" in one bit.  Nothing is
held beyond a piece of ``PIECE`` candidates.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Candidates tried together, and texts hashed together.
PIECE = 1 << 21
HASHED = 1 << 15
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(np.sin(np.float64(i + 1))) * 2**32) for i in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_begin(words: list, size: int) -> np.ndarray:
    """The first 60 bits of the md5 of ``size`` texts of one block, whose sixteen words are given as
    arrays, or as a number where all have the same."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _BEGIN)
    t = np.empty(size, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            g = 7 * i % 16
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        word = words[g]
        fixed = isinstance(word, int)
        np.add(t, a, out=t), np.add(t, np.uint32((_SINES[i] + (word if fixed else 0)) & 0xFFFFFFFF), out=t)
        if not fixed:
            np.add(t, word, out=t)
        np.left_shift(t, np.uint32(_SHIFTS[i]), out=a), np.right_shift(t, np.uint32(32 - _SHIFTS[i]), out=t)
        np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    a, b = ((x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in zip((a, b), _BEGIN))
    return (a << np.uint64(28)) | (b >> np.uint64(4))


@lru_cache(64)
def _tails(numbers: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number the words of its digits and the byte that ends a text, behind ``offset`` bytes
    of the first word; and its count of digits."""
    digits = [b"%d" % i for i in range(numbers)]
    width = -(-(offset + len(digits[-1]) + 1) // 4)
    text = b"".join((b"\0" * offset + x + b"\x80").ljust(4 * width, b"\0") for x in digits)
    return np.ascontiguousarray(np.frombuffer(text, "<u4").reshape(numbers, width).T), np.array([len(x) for x in digits], np.uint32)


def draws(starts: list[bytes | None], of: np.ndarray, number: np.ndarray, numbers: int) -> np.ndarray:
    """First 15 hex digits of the md5 of each text ``starts[of] + str(number)``, as numbers; 0 where the
    start is null.  All ``number`` are below ``numbers``."""
    out = np.zeros(of.size, np.uint64)
    sizes = np.array([-1 if s is None else len(s) for s in starts])
    most = len(str(numbers - 1))
    for size in np.unique(sizes[sizes >= 0]).tolist():
        mine = np.flatnonzero(sizes[of] == size)
        if size + most > 55:  # more than one block
            out[mine] = [int(hashlib.md5(starts[o] + b"%d" % i).hexdigest()[:15], 16) for o, i in zip(of[mine].tolist(), number[mine].tolist())]
            continue
        full = size // 4
        heads = np.array([s if s is not None and len(s) == size else b"" for s in starts], f"S{4 * full + 4}").view("<u4").reshape(len(starts), -1).T
        tails, digits = _tails(numbers, size % 4)
        for at in range(0, mine.size, HASHED):
            these = mine[at:at + HASHED]
            o, i = of[these], number[these]
            words = [heads[w][o] for w in range(full)] + [tail[i] for tail in tails]
            words[full] |= heads[full][o]
            words += [0] * (14 - len(words)) + [(digits[i] + np.uint32(size)) * np.uint32(8), 0]
            out[these] = _md5_begin(words, these.size)
    return out


@lru_cache(64)
def _knights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """"Person i is a knight" over all assignments as words, with a row of zeros for people who are not
    there, and the bits in use."""
    a = np.arange(1 << max(n, 6))
    bits = np.stack([(a >> i & 1).astype(bool) & (a < 1 << n) for i in range(n)] + [a < 0, a < 1 << n])
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return words[:-1], words[-1]


def _said(op: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Truth of statements from their operators (places in OPS) and the truth of their leaves."""
    return np.select([op == 0, op == 1, op == 2, op == 3, op == 4], [a, ~a, a & b, a | b, ~a | b], ~(a ^ b))


def _leaves(code: np.ndarray, knights: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Truth of leaves given as bytes (128 for "lying", plus who)."""
    words = knights[np.minimum(code & 127, len(knights) - 1)]
    return np.where((code >= 128)[..., None], words ^ valid, words)


@lru_cache(64)
def _pairs(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs a < b of leaf options, and the place of (a, b) and of (b, a) among the ordered pairs."""
    a, b = np.triu_indices(m, 1)
    return a, b, a * (m - 1) + (b - a - 1) % m, b * (m - 1) + (a - b - 1) % m


def _hits(left: np.ndarray, solution: np.ndarray, people: int, n: int, few: int):
    """The valid candidates: arrays of rows of ``left`` (puzzle by puzzle, speaker by speaker: the
    assignments the others leave) and numbers of statements, piece by piece."""
    m = 2 * n - 1
    row, a = np.nonzero(np.unpackbits(left.view(np.uint8), axis=1, bitorder="little"))
    size = np.bincount(row, minlength=len(left))
    place = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
    width = np.select([size <= w for w in (8, 16, 32, 64) if w <= few], [w for w in (8, 16, 32, 64) if w <= few], -(-size // 64) * 64) \
        if few >= 8 else np.maximum(-(-size // 64), 2) * 64
    for bits in np.unique(width[size > 1]).tolist():
        rows = np.flatnonzero((width == bits) & (size > 1))  # the only assignment left is the solution
        back = np.full(len(left), -1)
        back[rows] = np.arange(rows.size)
        kept = back[row] >= 0
        r, t, of = back[row[kept]], place[kept], a[kept]

        def words(held):
            wide = np.zeros((rows.size, bits), bool)
            wide[r, t] = held
            return np.packbits(wide, axis=1, bitorder="little").view(f"<u{min(bits, 64) // 8}")
        p = rows % people
        mask, other = words(True), words(of == solution[rows // people][r])
        knight = np.stack([words(of >> i & 1 == 1) for i in range(n)] + [np.zeros_like(mask)])
        at = np.arange(rows.size)
        knave = knight[np.minimum(p, n), at] ^ mask
        v = np.concatenate([knight[:n], np.stack([knight[w + (w >= p), at] ^ mask for w in range(n - 1)])]) if n > 1 else knight[:n]

        def found(stated):
            x = stated ^ knave
            if x.shape[-1] == 1:
                x, one = x[..., 0], other[:, 0]
                return np.nonzero((x & (x - x.dtype.type(1)) == 0) & (x != 0) & (x != one))
            return np.nonzero((np.bitwise_count(x).sum(-1, dtype=np.int64) == 1) & (x != other).any(-1))

        def pairs(stated, *places):
            i, r = found(stated)
            return [(rows[r], q[i]) for q in places]
        first, second, ab, ba = _pairs(m)
        every = m * (m - 1)
        yield from pairs(v, np.arange(m))
        yield from pairs(v ^ mask, m + np.arange(m))
        va, vb = v[first], v[second]
        yield from pairs(va & vb, 2 * m + ab, 2 * m + ba)
        yield from pairs(va | vb, 2 * m + every + ab, 2 * m + every + ba)
        yield from pairs((va ^ mask) | vb, 2 * m + 2 * every + ab)
        yield from pairs((vb ^ mask) | va, 2 * m + 2 * every + ba)
        yield from pairs(va ^ vb ^ mask, 2 * m + 3 * every + ab, 2 * m + 3 * every + ba)


def _leaf_codes(j: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
    return np.where(j < n, j, j - n + np.where(j - n >= p, 129, 128))


def _tried(starts: list[bytes | None], codes: np.ndarray, solution: np.ndarray, n: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """``first_changes`` of puzzles with ``n`` people and equally many statements."""
    count, people = codes.shape
    m = 2 * n - 1
    each = 2 * m + 4 * m * (m - 1)
    knights, valid = _knights(n)
    speaker = knights[np.minimum(np.arange(people), n)]
    stated = _said((codes >> 16)[..., None], _leaves(codes >> 8 & 255, knights, valid), _leaves(codes & 255, knights, valid))
    agrees = ~(stated ^ speaker) & valid
    left = np.empty_like(agrees)
    before = np.broadcast_to(valid, agrees[:, 0].shape)
    for p in range(people):
        left[:, p] = before
        before = before & agrees[:, p]
    after = np.broadcast_to(valid, agrees[:, 0].shape)
    for p in range(people - 1, -1, -1):
        left[:, p] &= after
        after = after & agrees[:, p]
    best, chosen = np.full(count, NONE), np.full(count, -1, np.int64)
    hits = list(_hits(left.reshape(count * people, -1), solution, people, n, few))
    if hits:
        row, i = (np.concatenate(x) for x in zip(*hits))
        of, cand = row // people, row % people * each + i
        drawn = draws(starts, of, cand, people * each)
        np.minimum.at(best, of, drawn)
        first = np.flatnonzero(drawn == best[of])
        first = first[np.lexsort((cand[first], of[first]))[::-1]]  # the smallest number is written last
        chosen[of[first]] = cand[first]
    bit = np.full(count, -1, np.int64)
    got = np.flatnonzero(chosen >= 0)
    if got.size:
        p, i = chosen[got] // each, chosen[got] % each
        place = np.where(i < 2 * m, 0, (i - 2 * m) % max(m * (m - 1), 1))
        one = np.where(i < 2 * m, i % m, place // max(m - 1, 1))
        two = (one + 1 + place % max(m - 1, 1)) % m
        op = np.where(i < 2 * m, i // m, 2 + (i - 2 * m) // max(m * (m - 1), 1))
        words = _said(op[:, None], *(_leaves(_leaf_codes(j, n, p), knights, valid) for j in (one, two)))
        words = left[got, p] & ~(words ^ speaker[p])
        bit[got] = np.nonzero(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"))[1]
    return chosen, bit


def first_changes(starts: pa.Array, n: pa.Array, codes: pa.Array, solution: pa.Array, few: int = 64) -> pa.Array:
    """For each puzzle an array with the number and the solution of its change, or without any: list<struct<cand, bit>>.

    ``starts`` is the text before the number in the draws, ``codes`` the statements as numbers.  Up to
    ``few`` assignments are looked at in one word."""
    count = len(n)
    cand, bit = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
    known = np.flatnonzero(np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in (n, codes, solution)]))
    sizes = np.nan_to_num(codes.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    begins = codes.offsets.to_numpy()
    people, values = n.fill_null(0).to_numpy(), codes.values.to_numpy()
    solved = solution.fill_null(-1).to_numpy().astype(np.int64)
    texts = [None if s is None else s.encode() for s in starts.to_pylist()]
    kinds = np.stack([people[known], sizes[known]], 1)
    for one, statements in np.unique(kinds, axis=0).tolist():
        if one < 1 or statements < 1:
            continue
        m = 2 * one - 1
        of_kind = known[(kinds == (one, statements)).all(1)]
        step = max(1, PIECE // (statements * max(2 * m + 4 * m * (m - 1), 1 << max(one, 6))))
        for at in range(0, of_kind.size, step):
            these = of_kind[at:at + step]
            given = values[begins[these][:, None] + np.arange(statements)].astype(np.int64)
            cand[these], bit[these] = _tried([texts[t] for t in these.tolist()], given, solved[these], one, few)
    found = cand >= 0
    rows = pa.StructArray.from_arrays([pa.array(cand[found], pa.int32()), pa.array(bit[found], pa.int32())], ["cand", "bit"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]), pa.int32()), rows)

"""Words, word hashes and five-word shingle hashes of many texts at once, in numpy.

Everything works on the UTF-8 bytes of an Arrow string column. A-Z are lower-cased; a
word is a run of bytes other than space, TAB, LF, VT, FF and CR. Word hashes are 64-bit
polynomial sums over a table of random byte codes, followed by a bit mixer; the slices a
buffer is cut into end at white space, so memory stays bounded for texts of any length
(a single word is the only thing that must fit)."""

from __future__ import annotations

import numpy as np

U = np.uint64
SLICE = 1 << 20
_rng = np.random.default_rng(20240607)
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
for _c in range(65, 91):
    CODES[_c] = CODES[_c + 32]
BASE = int(0x9E3779B97F4A7C15) | 1
BASE_INV = pow(BASE, -1, 1 << 64)
STEP = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SHINGLE = 5

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = h ^ U(seed & (1 << 64) - 1)
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, 1 << (n - 1).bit_length())
    if size not in _powers:
        if size > SLICE:  # an oversized word: do not keep its tables
            _powers.clear()
        with np.errstate(over="ignore"):
            tables = []
            for b in (BASE, BASE_INV):
                t = np.full(size + 1, U(b & (1 << 64) - 1))
                t[0] = 1
                tables.append(np.multiply.accumulate(t))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null texts are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32,
                            count=column.offset + len(column) + 1)[column.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, first): hash and byte start of every word, and for each text the
    index of its first word (one more entry at the end)."""
    hashes, starts = [], []
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)  # a text begins here: no word runs across
    cut[offsets] = True
    at = 0
    while at < n:
        end = min(n, at + SLICE)
        while end < n:
            space = np.flatnonzero(SPACE[data[at:end]] | cut[at + 1:end + 1])
            if len(space):
                end = at + int(space[-1]) + 1
                break
            end = min(n, at + 2 * (end - at))
        x = data[at:end]
        inside = ~SPACE[x]
        before = np.empty(len(x), dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (~before | cut[at:end]))
        if len(s):
            after = np.empty(len(x), dtype=bool)
            after[-1] = False
            after[:-1] = inside[1:]
            e = np.flatnonzero(inside & (~after | cut[at + 1:end + 1]))
            up, down = _power_tables(len(x))
            with np.errstate(over="ignore"):
                total = np.cumsum(CODES[x] * up[:len(x)], dtype=np.uint64)
                base = np.where(s > 0, total[s - 1], U(0))
                hashes.append(mix((total[e] - base) * down[s]))
            starts.append(s + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    st = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, st, np.searchsorted(st, offsets)


def shingles(h: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles; a text with
    fewer words has its whole sequence as one shingle, a text without words none."""
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled = rolled * STEP + h[k:len(h) - width + 1 + k]
        rolled = mix(rolled, width)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                v = U(0)
                for x in h[a:b]:
                    v = v * STEP + x
            out.append(mix(np.array([v], dtype=np.uint64), int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches(column, limit: int = 4 << 20):
    """Row ranges [a, b) of a string array with at most ``limit`` bytes each (one row at
    least)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    a, total = 0, 0
    for i, s in enumerate(size):
        if i > a and total + s > limit:
            yield a, i
            a, total = i, 0
        total += int(s)
    if a < len(size):
        yield a, len(size)

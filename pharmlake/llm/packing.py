"""Packing documents into near-equal token windows by Karmarkar-Karp differencing.

A document's ids are the tokenizer's ids plus one end id. It is cut into full windows of
``window`` ids, which need no packing, and a rest cut into pieces of at most
``max_piece`` ids. Pieces of consecutive documents of one task are gathered until they
hold ``group_windows`` windows; each such group is split by multiway differencing: every
piece starts as a partial partition (its length and zeros), and the two partitions with
the largest imbalance are merged with opposing order, until one partition of k windows
is left. k starts at the least possible count and rises while a window is over capacity.

Everything happens inside the task that reads the documents: no shuffle, memory bounded
by one group, and a lost task is simply run again over the same rows.

Defined cases: null text is the empty text (one id, the end id); repeated rows are packed
as often as they occur; null doc_id stays null; extra columns are ignored; an empty table
gives no rows. Sequence ids are (task number, running number) in one long."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .tables import lean

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
TOKENIZER = "word_bpe_49k.json"
# Characters for which the tokenizer's normaliser and splitter are reproduced exactly by
# the cached path below; any other text goes through the tokenizer as a whole.
PLAIN = re.compile("[\t\n\r -~¡-įĲ-ňŊ-ž]*")
_LETTER = "a-zªµºÀ-ÖØ-öø-ž"
_NUMBER = "0-9²³¹¼-¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+|\n")
CACHE_CHARS = 4 << 20  # of pieces kept between slices: about 100 MB at most, dropped at task end


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """uint32 ids of texts, many texts at once. The tokenizer never joins across white space,
    so the different white-space separated chunks of a slice are encoded once each; their
    pieces are numbered and kept, up to a bound, for the next slices."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_map = {}
        for c in range(256):
            try:
                ch = bytes([c]).decode("ascii")
            except UnicodeDecodeError:
                continue
            self.byte_map[c] = level.pre_tokenize_str(ch)[0][0]
        for c in range(0x80, 0x800):  # two-byte characters show the letters of bytes 0x80-0xdf
            enc = chr(c).encode()
            out = level.pre_tokenize_str(chr(c))[0][0]
            for b, o in zip(enc, out):
                self.byte_map.setdefault(b, o)

    def learn(self, pieces) -> None:
        """Numbers new pieces."""
        for piece in pieces:
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_map)
            self.ids.extend([t.id for t in self.model.tokenize(mapped)])
            self.ends.append(len(self.ids))
            self.chars += len(piece)
        self.pieces.update(zip(pieces, range(len(self.pieces), len(self.ends))))

    def forget(self) -> None:
        """Piece 0, the end of a chunk, has no ids; those of piece k are ids[ends[k - 1]:ends[k]]."""
        self.pieces, self.ids, self.ends, self.chars = {"\n": 0}, array("I"), array("i", [0]), 0

    def chunks(self, chunks: list[str]):
        """The ids of each chunk, as an Arrow list array."""
        import pyarrow as pa

        if self.chars > CACHE_CHARS:
            self.forget()
        found = PIECES.findall("\n".join([*chunks, ""]))
        self.learn(list(set(found).difference(self.pieces)))
        number = np.fromiter(map(self.pieces.__getitem__, found), dtype=np.int32, count=len(found))
        ids = pa.ListArray.from_arrays(pa.array([0, *self.ends], pa.int32()), pa.array(np.array(self.ids, dtype=np.uint32)))
        ids = ids.take(pa.array(number))
        ends = ids.offsets.to_numpy()[1:][number == 0]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), ids.values)

    def encode(self, column) -> list[np.ndarray]:
        """The ids of each text of an Arrow string array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = column.to_pylist()
        plain = [t is not None and "<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(plain, pa.bool_()), column, "")))
        words = lists.flatten().dictionary_encode()
        ids = self.chunks(words.dictionary.to_pylist()).take(words.indices)
        ends = ids.offsets.to_numpy()[np.cumsum(pc.list_value_length(lists).to_numpy())]
        ids = ids.values.to_numpy()
        out = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for i, text in enumerate(texts):
            if text and not plain[i]:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return out


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Split sizes into k near-equal windows: (window of each piece, largest sum)."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, dtype=np.int64), int(sizes.sum())
    # state: sums in ascending order; nodes[i] = (left, right): right's slots are reversed
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def vector(i: int) -> np.ndarray:
        if i in sums:
            return sums.pop(i)
        v = np.zeros(k, dtype=np.int64)
        v[-1] = sizes[i]
        return v

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vector(a) + vector(b)[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = total
        heapq.heappush(heap, (int(total[0] - total[-1]), node))
    # walk back: where[node] = window of each slot of the node
    where: dict[int, np.ndarray] = {n + len(merges) - 1 if merges else 0: np.arange(k)}
    window = np.zeros(n, dtype=np.int64)
    for j in range(len(merges) - 1, -1, -1):
        a, b, order = merges[j]
        slots = np.empty(k, dtype=np.int64)
        slots[order] = where.pop(n + j)
        for child, w in ((a, slots), (b, slots[::-1])):
            if child < n:
                window[child] = w[-1]
            else:
                where[child] = w
    if not merges:
        window[0] = k - 1
    return window, int(np.bincount(window, weights=sizes, minlength=k).max())


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each piece, no window above capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, top = difference(sizes, k)
        if top <= capacity:
            return window
        k += 1


def pack_documents(docs: DataFrame, window: int = 2048, max_piece: int = 512, group_windows: int = 128,
                   end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """One row per piece (see SCHEMA)."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = _encoder(path)
        base, made = TaskContext.get().partitionId() << 36, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        waiting: list[tuple] = []
        held = 0
        cols: list[list] = [[] for _ in range(7)]

        def put(piece, sequence, offset):
            for c, v in zip(cols, (*piece, sequence, offset)):
                c.append(v)

        def close():
            nonlocal made, waiting, held
            if waiting:
                where = pack(np.array([p[2] for p in waiting], dtype=np.int64), window)
                used: dict[int, list[int]] = {}
                for piece, w in zip(waiting, where.tolist()):
                    slot = used.get(w)
                    if slot is None:
                        slot = used[w] = [base + made, 0]
                        made += 1
                    put((piece[0], piece[1], piece[2], piece[3], piece[4]), slot[0], slot[1])
                    slot[1] += piece[2]
            waiting, held = [], 0

        def flush():
            nonlocal cols
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in cols],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            cols = [[] for _ in range(7)]
            return out

        def encoded():
            for batch in batches:
                for a, e in T.batches(batch.column(1)):
                    yield from zip(batch.column(0).slice(a, e - a).to_pylist(), encoder.encode(batch.column(1).slice(a, e - a)))

        for doc_id, ids in encoded():
            ids = ids.tobytes() + end
            n = len(ids) // 4
            full = n // window * window
            for a in range(0, full, window):
                put((doc_id, a, window, zlib.crc32(ids[4 * a:4 * (a + window)]), n), base + made, 0)
                made += 1
            # the rest in pieces as equal as possible
            rest = n - full
            if rest:
                parts = -(-rest // max_piece)
                for j in range(parts):
                    a, b = full + rest * j // parts, full + rest * (j + 1) // parts
                    waiting.append((doc_id, a, b - a, zlib.crc32(ids[4 * a:4 * b]), n))
                    held += b - a
                    if held >= group_windows * window:
                        close()
            if len(cols[0]) >= 50_000:
                yield flush()
        close()
        if cols[0]:
            yield flush()
        encoder.forget()

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return clean.mapInArrow(lean(run), SCHEMA)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

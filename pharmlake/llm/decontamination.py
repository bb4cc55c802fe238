"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every task turns the texts it reads into shards of at most ``SHARD_BYTES`` and builds one
suffix array of each (word positions, sorted by packed leading words and then by prefix
doubling). Words that occur in no test item end a suffix: no verbatim match runs across
them. A group of equal prefixes is sorted deeper only where a test suffix falls into it, so
the array is exact wherever it is searched. Every test suffix is binary-searched in every
shard, one word deeper at a time; the range it ends with gives its longest verbatim match
and all places of that match, the range at the window length gives the occurrences of its
window.

The test items are dealt into blocks of about ``BLOCK_BYTES`` and every block goes over all
texts in a pass of its own, so what travels to the tasks is bounded whatever the size of
the benchmark. Texts are never shuffled; a lost task is run again over its rows.

Words: A-Z are lower-cased, a word is a run of ASCII letters, digits and non-ASCII
characters. Words are compared by their bytes, never by a hash alone.

Defined cases: a null text has no words; items without words match nothing; an item of
fewer than ``window`` words is one window; several rows under one item id are one item with
all their windows; a null item id is written as the empty string; repeated documents each
give a row; null doc_ids stay null; extra columns pass through; an empty table gives no
rows, an empty benchmark hits nothing. One text and its word arrays (about 30 bytes a
character) must fit a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .textarrays import STEP, mix, text_bytes

U = np.uint64
WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
SPANS = "array<struct<start:bigint,stop:bigint>>"


class Words:
    """Words of many texts: byte start and length, key (the word itself up to 8 bytes, else
    a hash), and for each text the index of its first word (one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        low = np.zeros(n + 8, dtype=np.uint8)
        low[:n] = LOWER[data]
        inside = IN_WORD[low[:n]]
        edge = np.zeros(n + 1, dtype=bool)  # a text begins here: no word runs across
        edge[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.length = np.flatnonzero(inside & (~after | edge[1:])) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)
        # the 8 bytes from any place on, as one little-endian number
        self.eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=low.data, strides=(1,))
        self.key = self.chunk(np.arange(len(self.start)), 0)
        at, k = np.flatnonzero(self.length > 8), 1
        with np.errstate(over="ignore"):
            while len(at):
                self.key[at] = mix(self.key[at] * STEP + self.chunk(at, k), 1)
                k += 1
                at = at[self.length[at] > 8 * k]

    def chunk(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the words ``at`` (all longer than 8k), zeros after the end."""
        return self.eight[self.start[at] + 8 * k] & MASK[np.minimum(self.length[at] - 8 * k, 8)]

    def same(self, at: np.ndarray, other: Words, other_at: np.ndarray) -> np.ndarray:
        """Whether words ``at`` equal the words ``other_at`` of ``other``, byte for byte."""
        equal = self.length[at] == other.length[other_at]
        left, k = np.flatnonzero(equal), 0
        while len(left):
            equal[left] = self.chunk(at[left], k) == other.chunk(other_at[left], k)
            k += 1
            left = left[equal[left] & (self.length[at[left]] > 8 * k)]
        return equal


class Tests:
    """One block of test items: their words as numbers from 1, and their windows."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import pyarrow as pa

        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        data, offsets = text_bytes(pa.array([text for _, text in items], pa.large_string()))
        self.words = w = Words(data, offsets)
        size = np.diff(w.first)
        # words with one key are kept apart by their bytes
        by_key = np.argsort(w.key, kind="stable")
        self.ids = np.zeros(len(by_key), dtype=np.int64)
        keys, example = [], []
        starts = np.flatnonzero(np.r_[True, w.key[by_key][1:] != w.key[by_key][:-1]]) if len(by_key) else []
        for group in np.split(by_key, starts[1:] if len(by_key) else []):
            while len(group):
                equal = w.same(group, w, np.full(len(group), group[0]))
                keys.append(w.key[group[0]])
                example.append(group[0])
                self.ids[group[equal]] = len(keys)
                group = group[~equal]
        self.keys, self.example = np.array(keys, np.uint64), np.array(example, np.int64)
        self.deepest_tie = int(np.unique(self.keys, return_counts=True)[1].max()) if len(keys) else 0
        self.item = np.repeat(np.array([number[name] for name, _ in items], np.int64), size)
        self.at = np.arange(len(self.ids)) - np.repeat(w.first[:-1], size)  # word of the item
        self.rest = np.repeat(size, size) - self.at  # words from here to the item's end
        whole = np.repeat(size, size)
        self.window = np.where(whole >= window, np.where(self.rest >= window, window, 0), np.where(self.at == 0, whole, 0))
        self.longest = int(size.max()) if len(size) else 0
        self.shortest = int(self.window[self.window > 0].min()) if len(self.ids) else 1
        self.bits = max(1, int(len(keys)).bit_length())
        self.packed = max(1, min(62 // self.bits, max(1, self.longest)))
        padded, prefix = np.r_[self.ids, np.zeros(self.packed, np.int64)], np.zeros(len(self.ids), np.int64)
        for j in range(self.packed):
            prefix = (prefix << self.bits) | np.where(self.rest > j, padded[np.arange(len(self.ids)) + j], 0)
        self.prefixes = np.unique(prefix)

    def number(self, words: Words) -> np.ndarray:
        """The numbers of ``words``, 0 for words that no item holds."""
        out = np.zeros(len(words.start), np.int64)
        if not len(self.keys) or not len(out):
            return out
        place = np.searchsorted(self.keys, words.key)
        at = np.arange(len(out))
        for _ in range(self.deepest_tie):  # more than one turn only where two keys are equal
            ok = place < len(self.keys)
            at, place = at[ok], place[ok]
            ok = self.keys[place] == words.key[at]
            at, place = at[ok], place[ok]
            equal = words.same(at, self.words, self.example[place])
            out[at[equal]] = place[equal] + 1
            at, place = at[~equal], place[~equal] + 1
        return out


class Shard:
    """A suffix array over the words of some texts, exact wherever ``tests`` can reach."""

    def __init__(self, words: Words, tests: Tests):
        self.tests, n = tests, len(words.start)
        self.ids = ids = tests.number(words)
        ends = np.zeros(n + 1, dtype=bool)
        ends[words.first] = True
        ends[:n] |= ids == 0
        place = np.where(ends, np.arange(n + 1), n)
        self.run = np.minimum.accumulate(place[::-1])[::-1][1:]  # the first end after each word
        self.run = np.where(ids > 0, self.run - np.arange(n), 0)
        begins = np.flatnonzero((ids > 0) & np.r_[True, ends[1:n] | (ids[:-1] == 0)]) if n else np.zeros(0, np.int64)
        sizes = self.run[begins]
        begins, sizes = begins[sizes >= tests.shortest], sizes[sizes >= tests.shortest]
        self.order = self._sorted(np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))

    def _sorted(self, pos: np.ndarray) -> np.ndarray:
        t, n = self.tests, len(self.ids)
        padded, key = np.r_[self.ids, np.zeros(t.packed, np.int64)], np.zeros(len(pos), np.int64)
        run = self.run[pos]
        for j in range(t.packed):
            key = (key << t.bits) | np.where(run > j, padded[pos + j], 0)
        by = np.argsort(key)
        order, key = pos[by], key[by]
        if not len(order):
            return order
        rank = np.zeros(n + 1, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0)) + 1
        left, right = np.searchsorted(key, t.prefixes, "left"), np.searchsorted(key, t.prefixes, "right")
        left, size = left[right - left > 1], (right - left)[right - left > 1]
        open_ = np.repeat(left - np.cumsum(size) + size, size) + np.arange(size.sum())
        depth = t.packed
        while len(open_) and depth < t.longest:
            u = order[open_]
            deeper = np.where(self.run[u] > depth, rank[np.minimum(u + depth, n)], 0)
            both = rank[u] * (n + 2) + deeper
            by = np.argsort(both)
            u, both = u[by], both[by]
            order[open_] = u
            new = np.r_[True, both[1:] != both[:-1]]
            rank[u] = open_[np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))] + 1
            alone = new & np.r_[new[1:], True]
            open_ = open_[~alone]
            depth *= 2
        return order

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """First places in [lo, hi) whose word at ``depth`` is not below (or is above) ``word``."""
        lo, hi = lo.copy(), hi.copy()
        last = len(self.ids) - 1
        while True:
            left = np.flatnonzero(lo < hi)
            if not len(left):
                return lo
            mid = (lo[left] + hi[left]) >> 1
            s = self.order[mid]
            found = np.where(self.run[s] > depth, self.ids[np.minimum(s + depth, last)], 0)
            go = found <= word[left] if after else found < word[left]
            lo[left[go]] = mid[go] + 1
            hi[left[~go]] = mid[~go]

    def search(self) -> tuple[np.ndarray, ...]:
        """(length, lo, hi) of the longest match of every test suffix, as a range of the
        suffix array, and (wlo, whi) of its window (empty where it has none)."""
        t, total = self.tests, len(self.order)
        count = len(t.ids)
        heads = self.ids[self.order]
        lo, hi = np.searchsorted(heads, t.ids, "left"), np.searchsorted(heads, t.ids, "right")
        length = (hi > lo).astype(np.int64)
        wlo, whi = np.zeros(count, np.int64), np.zeros(count, np.int64)
        one = t.window == 1
        wlo[one], whi[one] = lo[one], hi[one]
        live = np.flatnonzero((hi > lo) & (t.rest > 1))
        depth = 1
        while total and len(live):
            word = t.ids[live + depth]
            a = self._bound(lo[live], hi[live], depth, word, False)
            b = self._bound(a, hi[live], depth, word, True)
            ok = b > a
            live, a, b = live[ok], a[ok], b[ok]
            lo[live], hi[live], length[live] = a, b, depth + 1
            depth += 1
            w = t.window[live] == depth
            wlo[live[w]], whi[live[w]] = a[w], b[w]
            live = live[t.rest[live] > depth]
        return length, lo, hi, wlo, whi


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers lo[i], ..., lo[i] + size[i] - 1, one range after the other."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


def _shards(batches: Iterator, limit: int) -> Iterator:
    """Record batches of at most ``limit`` bytes of text (or one row); the texts are in the
    field ``text`` of the column ``row``."""
    import pyarrow as pa

    kept, held = [], 0
    for batch in batches:
        text = batch.column("row").field("text")
        size = np.diff(text_bytes(text)[1])
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(size[at:]), limit - held, "right"))
            if fit == 0 and not kept:
                fit = 1
            if fit:
                kept.append(batch.slice(at, fit))
                held += int(size[at:at + fit].sum())
                at += fit
            if at < batch.num_rows:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, held = [], 0
    if kept and sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _places(shard: Shard, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of array ranges, one range after the other, and their texts."""
    pos = shard.order[_ranges(lo, hi - lo)]
    return pos, np.searchsorted(first, pos, "right") - 1


def _mark(tests: Tests, shard_bytes: int):
    import pyarrow as pa

    def lists(values, owner: np.ndarray, n: int):
        """A list array: ``values`` belong to the rows ``owner`` (ascending)."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)

    def one(batch):
        n = batch.num_rows
        words = Words(*text_bytes(batch.column("row").field("text")))
        shard, first, total = Shard(words, tests), words.first, len(words.start)
        _, _, _, wlo, whi = shard.search()
        hit = np.flatnonzero(whi > wlo)
        # equal windows have equal ranges and lengths: their places are listed once
        kind, which = np.unique(np.stack([wlo[hit], whi[hit], tests.window[hit]], axis=1), axis=0, return_inverse=True)
        pos, text = _places(shard, first, kind[:, 0], kind[:, 1])
        size = kind[:, 1] - kind[:, 0]
        width = np.repeat(kind[:, 2], size)
        earlier = batch.column("spans")
        owner = np.repeat(np.arange(n), np.diff(earlier.offsets.to_numpy()))
        flat = earlier.flatten()
        begin = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + first[owner]
        stop = flat.field("stop").to_numpy(zero_copy_only=False).astype(np.int64) + first[owner]
        change = np.bincount(np.r_[pos, begin].astype(np.int64), minlength=total + 1) \
            - np.bincount(np.r_[pos + width, stop].astype(np.int64), minlength=total + 1)
        covered = np.cumsum(change)[:total] > 0
        head, tail = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        head[first] = True
        tail[first] = True
        previous, following = np.r_[False, covered[:-1]], np.r_[covered[1:], False]
        start = np.flatnonzero(covered & (~previous | head[:total]))
        end = np.flatnonzero(covered & (~following | tail[1:])) + 1
        owner = np.searchsorted(first, start, "right") - 1
        spans = lists(pa.StructArray.from_arrays([pa.array(start - first[owner], pa.int64()), pa.array(end - first[owner], pa.int64())],
                                                 ["start", "stop"]), owner, n)
        # (text, window) pairs to (text, item) pairs
        pair = np.unique(np.stack([text, np.repeat(np.arange(len(kind)), size)], axis=1), axis=0)
        link = np.unique(np.stack([which.reshape(-1), tests.item[hit]], axis=1), axis=0)
        a, b = np.searchsorted(link[:, 0], pair[:, 1], "left"), np.searchsorted(link[:, 0], pair[:, 1], "right")
        pair = np.unique(np.stack([np.repeat(pair[:, 0], b - a), link[_ranges(a, b - a), 1]], axis=1), axis=0)
        before = batch.column("items")
        owner = np.repeat(np.arange(n), np.diff(before.offsets.to_numpy()))
        names = before.flatten().to_pylist() + [tests.names[i] for i in pair[:, 1]]
        found = sorted(set(zip(np.r_[owner, pair[:, 0]].tolist(), names)))
        items = lists(pa.array([x for _, x in found], pa.string()), np.array([i for i, _ in found], np.int64), n)
        return pa.record_batch({"row": batch.column("row"), "n_words": pa.array(np.diff(first), pa.int64()),
                                "spans": spans, "items": items})

    def run(batches: Iterator) -> Iterator:
        for batch in _shards(batches, shard_bytes):
            yield one(batch)

    return run


def _item_rows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    return items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                        F.col(text).cast("string").alias("text")).where("text is not null").distinct()


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
                block_bytes: int = BLOCK_BYTES) -> Iterator[Tests]:
    """The test items in blocks of about ``block_bytes``, one after the other; one block
    without items where there are none."""
    rows = _item_rows(items, item_id, text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        yield Tests([(r["item"], r["text"]) for r in mine], window)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of all its columns), ``n_words``, ``spans``
    (disjoint word ranges inside occurrences of windows, ascending) and ``items`` (ids of
    the items that hold those windows, as text, sorted)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.struct(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*others or [F.lit(0)]).alias("rest"))
    out = docs.select(row.alias("row"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    for k, tests in enumerate(item_blocks(items, item_id, item_text, window, block_bytes)):
        if k:  # one block at a time in a task
            out = stored(out, "decontamination-pass")
        out = out.mapInArrow(_mark(tests, shard_bytes), out.schema)
    return out


def longest_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", min_words: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per suffix of an item whose longest verbatim match in any document has at least
    ``min_words`` words: item, item_start (its first word), length, places (how often a
    match of that length occurs), doc_id and doc_start of the first place."""
    import pyarrow as pa

    key = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.struct(F.col("text").cast("string").alias("text"), F.col(doc_id).alias("id")).alias("row"))
    parts = []
    for tests in item_blocks(items, window=min_words, block_bytes=block_bytes):
        tests.shortest = min(tests.shortest, min_words)

        def find(batches: Iterator, tests=tests) -> Iterator:
            for batch in _shards(batches, shard_bytes):
                words = Words(*text_bytes(batch.column("row").field("text")))
                shard = Shard(words, tests)
                length, lo, hi, _, _ = shard.search()
                hit = np.flatnonzero((length >= min_words) & (hi > lo))
                pos, text = _places(shard, words.first, lo[hit], hi[hit])
                suffix = np.repeat(hit, (hi - lo)[hit])
                # one row per (suffix, text): how often, and the first place
                by = np.lexsort((pos, text, suffix))
                suffix, text, pos = suffix[by], text[by], pos[by]
                new = np.flatnonzero(np.r_[True, (suffix[1:] != suffix[:-1]) | (text[1:] != text[:-1])]) if len(by) else by
                count = np.diff(np.r_[new, len(by)])
                s, d = suffix[new], text[new]
                yield pa.record_batch({
                    "item": pa.array([tests.names[i] for i in tests.item[s]], pa.string()), "item_start": pa.array(tests.at[s], pa.int64()),
                    "length": pa.array(length[s], pa.int64()), "places": pa.array(count, pa.int64()),
                    "doc_id": batch.column("row").field("id").take(pa.array(d, pa.int64())),
                    "doc_start": pa.array(pos[new] - words.first[d], pa.int64())})

        parts.append(rows.mapInArrow(find, f"item string, item_start long, length long, places long, doc_id {key}, doc_start long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    per_length = found.groupBy("item", "item_start", "length").agg(
        F.sum("places").alias("places"), F.min(F.struct("doc_id", "doc_start")).alias("place"))
    best = per_length.groupBy("item", "item_start").agg(F.max(F.struct("length", "places", "place")).alias("b"))
    return best.select("item", "item_start", "b.length", "b.places", "b.place.doc_id", "b.place.doc_start")


def hit_words(spans: str | Column = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns as they were."""
    clean = matches(docs, items, window=window).where(F.size("spans") == 0)
    return clean.select(*[(F.col("row.text") if c == "text" else F.col(f"row.rest.`{c}`")).alias(c) for c in docs.columns])


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digest columns per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = matches(docs.select("doc_id", "text"), items)
    n_hit = hit_words()
    return out.select(F.col("row.rest.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))

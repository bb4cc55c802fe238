"""Line dedup by an exact set-similarity join.

A line's set is its distinct words (A-Z lower-cased, white space separates). Two lines
match when 100 * |A and B| >= percent * |A or B|. A line is removed when any earlier line
matches it, in the order (doc_id, line number); earlier lines count whether or not they
are kept themselves.

1. A fixed-size count table of words gives the rarity order; any order is valid, so its
   size only affects speed. Each line's words are sorted by it.
2. Lines with equal sets form a class, named by its first line; all later lines of a
   class match the first. Classes too small to match any other set (at 80 percent, those
   of one to three words) are done here; the others enter the joins.
3. Star rounds, which only save work: classes are listed under three keys, each made of the
   words that come first in three random orders, so that most near copies meet; the shorter
   lists are left to the join round, and all of them if the groups around their first classes
   hold few pairs for the number of classes. Else each class is tested against the first class
   of its lists; what is found later than a match needs no further search. The rest (without
   hubs and matched classes) is tested against the first 16 of its lists, again and again until
   a round adds little. So a large group of near copies costs a bounded number of pairs a class
   and round.
4. Join round: the prefix words of all classes are joined with each other; a pair shares
   a word inside the prefixes that both sizes together allow and passes the length and
   positional filters, a bound on the overlap from 128-bit parity signatures (each differing
   word flips at most one bit), and only if the later line is still unmatched. Postings are
   dealt by word to blocks of a bounded size, in which lists are sorted by size; those of very
   common words, which may not fit a block, are joined by Spark. The sets of the remaining
   pairs are compared exactly.

Words and sets are named by 64-bit hashes. Defined cases: lines end at ``\\n`` only; lines
with fewer than ``min_words`` distinct words are never compared and stay (1 compares every
line that has a word); null text stays
null; empty text and texts without removed lines stay as they are; rows with equal doc_id
are ordered by a hash of their texts, and rows with equal doc_id and text are treated
alike; null doc_id comes first; other columns are kept; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textarrays as T
from .sketches import COUNTS, bit_rows, bit_table, bucket_of, bucket_rows, count_classes, in_bitmap_bucket, with_bit
from .tables import lean, removed, shuffles_removed, stored

COUNT_BITS = 20
REF_BITS = 22  # bitmap of lines whose sets are wanted
KEYS, KEY_WORDS = 3, 3  # star keys of a line, and minimum words a key is made of
LISTED = 32  # lists of at most so many classes are left to the join round
FEW = 16  # and so are all lists, if groups around their hubs hold at most so many pairs a class
HUBS = 16  # of a list, in the star rounds after the first
ENOUGH = 16  # rounds end when one gives at most 1/16 of what all of them matched
COMMON = 120  # words counted more than 2 ** (COMMON / 8) times are common: their postings may be too many for one task
BLOCK, PAIRS = 1 << 19, 1 << 20  # postings in a block of the join round, and pairs of them that are looked at at once
NO_DOC = -(1 << 63)
U = np.uint64
KEY = ("doc", "tid", "line")  # document, 64-bit hash of its text, line number
STAR = (*KEY, "n", "sig", "sig_1")
REFS = [f"{k}_{s}" for s in "ab" for k in KEY]
POSTING = 7  # columns of a posting: word << 32 | n, position << 1 | open, sig, sig_1, doc, tid, line
LINES = "doc long, tid long, line long, cid long, n int, sig long, sig_1 long, keys array<long>, prefix array<int>, common boolean"


def _clean(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"),
                       F.xxhash64(text).alias("tid"), text.alias("text"))


def line_words(column, wanted=None):
    """(row and line number of each line, line and hash of every word) of a string array; lines
    are in order. Of lines that ``wanted`` (rows, numbers to a mask) leaves out nothing is read."""
    data, offsets = T.text_bytes(column)
    ends = np.flatnonzero(data == 10)
    cuts = np.union1d(offsets, ends + 1)
    start, stop = cuts[:-1], cuts[1:]  # the last line of a text ending in a line feed has no words
    row = np.searchsorted(offsets, start, side="right") - 1
    number = np.searchsorted(ends, start) - np.searchsorted(ends, offsets[row])
    if wanted is not None:
        hit = wanted(row, number)
        data, row, number = data[np.repeat(hit, stop - start)], row[hit], number[hit]
        cuts = np.concatenate(([0], np.cumsum((stop - start)[hit])))
    h, _, first = T.words(data, cuts)
    return row, number, np.repeat(np.arange(len(row)), np.diff(first)), h


def by_line(line: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order of ascending (line, key); ``line`` is ascending. Sorted by the line with as
    much of the key as fits beside it; in full where that leaves two keys of a line equal."""
    bits = max(1, int(line[-1]).bit_length()) if len(line) else 1
    both = (line.astype(U) << U(64 - bits)) | (key >> U(bits))
    order = np.argsort(both)
    k, both = key[order], both[order]
    if ((both[1:] == both[:-1]) & (k[1:] != k[:-1])).any():
        return np.lexsort((key, line))
    return order


def word_classes(docs: DataFrame) -> np.ndarray:
    def count(batches):
        def hashes(b):
            col = b.column(0)
            for a, e in T.batches(col):
                data, offsets = T.text_bytes(col.slice(a, e - a))
                yield T.words(data, offsets)[0]

        return bucket_rows(batches, hashes, COUNT_BITS)

    return count_classes(docs.select("text").mapInArrow(lean(count), COUNTS), COUNT_BITS)


def line_sets(column, classes: np.ndarray, min_words: int, wanted=None):
    """Sets of the lines of a string array: (row, line number, n, first token of each
    line, tokens); the tokens of a line are distinct and ascending in rarity order."""
    row, number, index, h = line_words(column, wanted)
    key = (classes[bucket_of(h, COUNT_BITS)].astype(U) << U(56)) | (T.mix(h, 1) >> U(8))
    order = by_line(index, key)
    key, index = key[order], index[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (index[1:] != index[:-1])
    key, index = key[new], index[new]
    start = np.flatnonzero(np.diff(index, prepend=-1))
    n = np.diff(start, append=len(key))
    long_enough = n >= min_words
    keep = np.repeat(long_enough, n)
    line = index[start[long_enough]]
    n = n[long_enough]
    return row[line], number[line], n, np.cumsum(n) - n, key[keep]


def sets_of(batch, classes, min_words, wanted=None):
    """Per slice of a batch with columns doc, tid, text: (doc, tid, line, n, first, tokens), of all
    lines or those that ``wanted`` (doc, tid, line to a mask) names."""
    docs, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    col = batch.column(2)
    for a, e in T.batches(col):
        asked = wanted and (lambda row, number: wanted(docs[a + row], tids[a + row], number))
        row, number, n, first, tokens = line_sets(col.slice(a, e - a), classes, min_words, asked)
        yield docs[a + row], tids[a + row], number, n, first, tokens


def ref_bit(doc: np.ndarray, tid: np.ndarray, line: np.ndarray) -> np.ndarray:
    m = 1 << REF_BITS
    return (np.mod(doc, m) * 31 + np.mod(tid, m) * 131 + np.mod(line, m) * 7919) % m


def ref_bit_column():
    m = F.lit(1 << REF_BITS)
    doc, tid, line = (F.pmod(F.col(c), m) for c in KEY)
    return ((doc * 31 + tid * 131 + line * 7919) % m).cast("int")


def ref_bits(rows: DataFrame) -> np.ndarray:
    return bit_table(rows.select(ref_bit_column().alias("b")), REF_BITS)


def star_key(tokens: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hash of the KEY_WORDS words of each line that come first in orders of their own; lines
    of Jaccard similarity j have equal keys with probability about j ** KEY_WORDS."""
    key = np.full(len(first), k, dtype=U)
    for i in range(KEY_WORDS):
        key = T.mix(key ^ np.minimum.reduceat(T.mix(tokens, 10 + KEY_WORDS * k + i), first), 6)
    return key


def lines_table(docs: DataFrame, classes, percent: int, min_words: int) -> DataFrame:
    """One LINES row per compared line; the words of its prefix are 31 bits of a hash, and whether the word is common."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, tid, line, n, first, tokens in sets_of(batch, classes.value, min_words):
                if not len(n):
                    continue
                with np.errstate(over="ignore"):
                    cid = T.mix(np.add.reduceat(T.mix(tokens, 2), first) ^ T.mix(n.astype(U), 3))
                at = T.mix(tokens, 4) & U(127)
                bit = U(1) << (at & U(63))
                sigs = [np.bitwise_xor.reduceat(np.where(at >> U(6) == i, bit, U(0)), first) for i in (0, 1)]
                keys = np.stack([star_key(tokens, first, k) for k in range(KEYS)], axis=1)
                length = n + (-percent * n) // 100 + 1
                place = np.arange(len(tokens)) - np.repeat(first, n)
                short = tokens[place < np.repeat(length, n)]
                common = (short >> U(56) > U(COMMON)).astype(U)
                short = (T.mix(short, 5) >> U(33) << U(1) | common).astype(np.uint32).view(np.int32)
                ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(tid), pa.array(line), pa.array(cid.view(np.int64)), pa.array(n.astype(np.int32)),
                     *[pa.array(x.view(np.int64)) for x in sigs],
                     pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, KEYS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(short)),
                     pa.array(np.logical_or.reduceat(short & 1 == 1, ends[:-1]))],
                    names=["doc", "tid", "line", "cid", "n", "sig", "sig_1", "keys", "prefix", "common"])

    return docs.mapInArrow(lean(run), LINES)


def verified(pairs: DataFrame, docs: DataFrame, classes, percent: int, min_words: int) -> DataFrame:
    """The later lines (doc, tid, line) of the pairs whose sets match. pairs: doc_a, tid_a,
    line_a (earlier), doc_b, tid_b, line_b. Sets are made anew from the texts that hold a wanted line;
    a bit table of their rows (at most 2**14 rows of 64 bits, so it may be broadcast)
    keeps the others away from Python."""
    def end(s):
        return [F.col(f"{k}_{s}").alias(k) for k in KEY]

    wanted = stored(pairs.select(*end("a")).union(pairs.select(*end("b"))).distinct(), "wanted")
    lines = docs.sparkSession.sparkContext.broadcast(ref_bits(wanted))
    bit = in_bitmap_bucket("tid")
    rows = (wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("i"))
            .agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("w")))
    texts = (docs.withColumn("b", bit).join(F.broadcast(rows), F.shiftright("b", 6) == F.col("i"))
             .where("shiftrightunsigned(w, b % 64) & 1 = 1").select("doc", "tid", "text"))

    def hit(doc, tid, line):
        return lines.value[ref_bit(doc, tid, line)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, tid, line, n, first, tokens in sets_of(batch, classes.value, min_words, hit):
                if len(n):
                    ends = np.concatenate((first, [len(tokens)])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc), pa.array(tid), pa.array(line),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))],
                        names=["doc", "tid", "line", "items"])

    sets = texts.mapInArrow(lean(run), "doc long, tid long, line long, items array<long>")
    sets = stored(sets.join(wanted, list(KEY), "left_semi").dropDuplicates(list(KEY)), "sets")
    a, b = (sets.select(*[F.col(k).alias(f"{k}_{s}") for k in KEY], F.col("items").alias(s)) for s in ("a", "b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(a, [f"{k}_a" for k in KEY]).join(b, [f"{k}_b" for k in KEY])
            .where((100 + percent) * both >= percent * (F.size("a") + F.size("b")))
            .select(*end("b")).distinct())


def alike(a: str, b: str, percent: int):
    """Length and signature filter."""
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = (F.bit_count(F.col(f"sig_{a}").bitwiseXOR(F.col(f"sig_{b}")))
             + F.bit_count(F.col(f"sig_1_{a}").bitwiseXOR(F.col(f"sig_1_{b}"))))
    # |A or B| - |A and B| >= apart, so |A and B| <= (n + m - apart) / 2
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * (n + m - apart) >= 2 * percent * (n + m))


def near(a: str, b: str, percent: int):
    """Length, positional and signature filter for a word shared at places pos_a, pos_b."""
    n, m, p, q = (F.col(c) for c in (f"n_{a}", f"n_{b}", f"pos_{a}", f"pos_{b}"))
    most = 1 + F.least(p, q) + F.least(n - p, m - q) - 1
    return alike(a, b, percent) & ((100 + percent) * most >= percent * (n + m))


def before(a: str, b: str):
    (doc_a, tid_a, line_a), (doc_b, tid_b, line_b) = ([F.col(f"{k}_{s}") for k in KEY] for s in (a, b))
    return (doc_a < doc_b) | ((doc_a == doc_b) & ((tid_a < tid_b) | ((tid_a == tid_b) & (line_a < line_b))))


def star_lists(c: DataFrame) -> DataFrame:
    """Classes (STAR, key) under each star key that more than LISTED of them hold, and some
    others: a bit table of those keys keeps most of the rest away from the shuffle."""
    bucket = F.shiftrightunsigned("key", 64 - REF_BITS).cast("int")
    shared = c.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > LISTED)
    bits = stored(bit_rows(shared.select(bucket.alias("b"))), "bits")
    return with_bit(c.select(*STAR, F.explode("keys").alias("key")), bucket, bits).where("bit").drop("bit")


def hub_round(lists: DataFrame, hubs: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, hubs): the classes of each list with its first ``hubs`` classes, at most that many
    pairs a row; hubs are picked by a partial limit in each task before their shuffle."""
    place = F.row_number().over(W.partitionBy("key").orderBy(*KEY))
    first = lists.withColumn("r", place).where(F.col("r") <= hubs).drop("r")
    a, b = (df.select("key", *[F.col(x).alias(f"{x}_{s}") for x in STAR]) for df, s in ((first, "a"), (lists, "b")))
    pairs = a.join(b, "key").where(before("a", "b") & alike("a", "b", percent)).select(*REFS).distinct()
    return pairs, first.select("key", *KEY)


def pairs_around_hubs(lists: DataFrame, percent: int) -> float:
    """About how many pairs the groups of near copies in the lists hold: a hub and the classes
    alike to it count as a group."""
    group = hub_round(lists, HUBS, percent)[0].groupBy(*REFS[:len(KEY)]).count()
    with shuffles_removed(lists.sparkSession):
        return group.agg(F.sum(F.col("count").cast("double") * F.col("count") / 2)).first()[0] or 0


def with_open(c: DataFrame, matched: DataFrame) -> DataFrame:
    """Classes with ``open``: no match found yet. The exact test is a join only for lines
    whose bit is set."""
    bits = stored(bit_rows(matched.select(ref_bit_column().alias("b"))), "bits")
    marked = with_bit(c.select(*KEY, "n", "sig", "sig_1", "prefix", "common"), ref_bit_column(), bits)
    sure = marked.where(~F.col("bit")).drop("bit").withColumn("open", F.lit(True))
    asked = marked.where("bit").drop("bit").join(matched.distinct().withColumn("m", F.lit(True)), list(KEY), "left")
    return sure.unionByName(asked.withColumn("open", F.col("m").isNull()).drop("m"))


def list_pairs(key, pos, opened, sigs, percent: int):
    """Index pairs (i, j) of postings, ascending by key = word << 32 | n, under the same word that
    pass the length, prefix, positional and signature filters, at least one of them open."""
    n = key & 0x7FFFFFFF
    most = (100 + percent) * (n - pos) // percent - n  # the largest other size that this place of the prefix allows
    size = np.clip(np.minimum(most, 100 * n // percent), 0, 0x7FFFFFFF)
    row = np.arange(len(key))
    count = np.maximum(np.searchsorted(key, key - n + size, side="right") - row - 1, 0)
    done = np.concatenate(([0], np.cumsum(count)))
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, side="right")) - 1)
        i = np.repeat(row[a:b], count[a:b])
        j = np.arange(done[a], done[b]) - np.repeat(done[a:b] - row[a:b] - 1, count[a:b])
        a = b
        keep = (most[j] >= n[i]) & (opened[i] | opened[j])
        i, j = i[keep], j[keep]
        shared = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
        keep = (100 + percent) * shared >= percent * (n[i] + n[j])
        i, j = i[keep], j[keep]
        apart = sum(np.bitwise_count((s[i] ^ s[j]).view(U)).astype(np.int64) for s in sigs)
        keep = (100 + percent) * (n[i] + n[j] - apart) >= 2 * percent * (n[i] + n[j])
        yield i[keep], j[keep]


def posting_blocks(lines: DataFrame, blocks: int) -> DataFrame:
    """Postings of the words that are not common, dealt by word to ``blocks`` blocks: a row holds
    those that some lines have in a block, as longs (POSTING columns after each other)."""
    def rows(table):
        import pyarrow as pa

        prefix = table.column("prefix").combine_chunks()
        ends = prefix.offsets.to_numpy()
        token = prefix.flatten().to_numpy().astype(np.int64)
        length = np.diff(ends)
        pos = np.arange(len(token)) - np.repeat(ends[:-1] - ends[0], length)
        n, opened, *others = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "open", "sig", "sig_1", *KEY))
        at = np.repeat(np.arange(len(n)), length)
        rare = token & 1 == 0
        token, pos, at = token[rare], pos[rare], at[rare]
        block = (T.mix(token.view(U), 7) % U(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        token, pos, at, block = token[order], pos[order], at[order], block[order]
        data = np.stack([token << 32 | n[at], pos << 1 | opened[at], *(x[at] for x in others)])
        first = np.flatnonzero(np.diff(block, prepend=-1))
        for a, e in zip(first, [*first[1:], len(block)]):
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a])], pa.int32()), pa.array([data[:, a:e].tobytes()], pa.binary())],
                                             names=["block", "postings"])

    def run(batches):
        import pyarrow as pa

        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += len(batch.column(7).flatten())
            if size >= BLOCK:
                yield from rows(pa.Table.from_batches(kept))
                kept, size = [], 0
        if size:
            yield from rows(pa.Table.from_batches(kept))

    lines = lines.select("n", "open", "sig", "sig_1", *KEY, "prefix")
    return lines.mapInArrow(lean(run), "block int, postings binary")


def rare_pairs(lines: DataFrame, blocks: int, percent: int) -> DataFrame:
    """REFS (earlier, later) of the lines that share a word that is not common and pass all filters,
    the later one open. A list is at most as long as its word is frequent, so blocks stay bounded; in
    a block, lists are sorted by size, and only postings of fitting sizes meet."""
    def run(table):
        import pyarrow as pa

        parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(POSTING, -1) for x in table.column("postings")]
        data = np.concatenate(parts, axis=1)
        key, pos, *sigs, doc, tid, line = data[:, np.argsort(data[0])]
        opened = pos & 1 == 1
        found = [np.zeros((2 * len(KEY), 0), np.int64)]
        for i, j in list_pairs(key, pos >> 1, opened, sigs, percent):
            same = doc[i] == doc[j]
            first = (doc[i] < doc[j]) | (same & ((tid[i] < tid[j]) | ((tid[i] == tid[j]) & (line[i] < line[j]))))
            keep = np.where(first, opened[j], opened[i])
            a, b = np.where(first, i, j)[keep], np.where(first, j, i)[keep]
            found.append(np.stack([x[s] for s in (a, b) for x in (doc, tid, line)]))
        return pa.table([pa.array(x) for x in np.concatenate(found, axis=1)], names=REFS)

    return posting_blocks(lines, max(1, blocks)).groupBy("block").applyInArrow(run, ", ".join(f"{c} long" for c in REFS))


def common_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """What ``rare_pairs`` gives, as a join: Spark divides lists that are too long for a task."""
    def side(df, s):
        return df.select("token", *[F.col(x).alias(f"{x}_{s}") for x in (*KEY, "n", "sig", "sig_1", "open", "pos")])

    # both sides are one exchange: what either prefix may hold depends on both sizes. In whole
    # numbers, the rarest test last: this runs once for every two postings of a word
    def inside(s):
        return (100 + percent) * (F.col(f"n_{s}") - F.col(f"pos_{s}")) >= percent * (F.col("n_a") + F.col("n_b"))

    x, y = side(postings, "a"), side(postings, "b")
    sized = (F.col("n_a") <= F.col("n_b")) & inside("a") & inside("b")
    smaller = (F.col("n_a") < F.col("n_b")) | before("a", "b")
    useful = F.when(before("a", "b"), F.col("open_b")).otherwise(F.col("open_a"))
    found = x.join(y, "token").where(sized & near("a", "b", percent) & smaller & useful)
    first = before("a", "b")
    found = found.select(*[F.when(first, F.col(f"{k}_a")).otherwise(F.col(f"{k}_b")).alias(f"{k}_a_") for k in KEY],
                         *[F.when(first, F.col(f"{k}_b")).otherwise(F.col(f"{k}_a")).alias(f"{k}_b_") for k in KEY])
    return found.toDF(*REFS)


def star_rounds(lists: DataFrame, docs: DataFrame, classes, percent: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(tested pairs as REFS, matched lines): classes against the first of their lists, until a round adds little."""
    hubs, total, tested, matched = 1, 0, None, None
    while True:
        pairs, first = hub_round(lists, hubs, percent)
        pairs = stored(pairs.join(tested, REFS, "left_anti") if tested else pairs, "pairs")
        found = stored(verified(pairs, docs, classes, percent, min_words), "matched")
        tested, matched = (tested.union(pairs), matched.union(found)) if tested else (pairs, found)
        latest = found.count()
        total += latest
        if latest * ENOUGH <= total:
            return tested, matched
        lists = lists.join(first, ["key", *KEY], "left_anti").join(found, list(KEY), "left_anti")
        lists, hubs = stored(lists.select(*STAR, "key"), "lists"), HUBS


def removed_lines(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """(doc, tid, line): every removed line. docs: doc, tid, text."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(word_classes(docs))
    lines = stored(lines_table(docs, classes, percent, min_words), "lines")
    c = lines.groupBy("cid").agg(F.min(F.struct(*STAR, "keys", "prefix", "common")).alias("f"), F.count("*").alias("copies"))
    firsts = stored(c.select("cid", "copies", "f.*"), "classes")
    first = firsts.where("copies > 1").select("cid", *[F.col(k).alias(f"first_{k}") for k in KEY])
    other = (F.col("doc") != F.col("first_doc")) | (F.col("tid") != F.col("first_tid")) | (F.col("line") != F.col("first_line"))
    later = stored(lines.select("cid", *KEY).join(first, "cid").where(other).select(*KEY), "later")
    removed(lines)
    # a set matches another one only if it may match itself and one word more
    c = firsts.where(100 * F.col("n") >= percent * (F.col("n") + 1))

    # star rounds
    postings, n_classes = c.agg(F.sum(F.size("prefix")), F.count("*")).first()
    lists, tested, matched = stored(star_lists(c), "lists"), None, None
    if pairs_around_hubs(lists, percent) > FEW * n_classes:
        tested, matched = star_rounds(lists, docs, classes, percent, min_words)
    flagged = with_open(c, matched) if matched else c.withColumn("open", F.lit(True))

    # join round
    common = (flagged.where("common").select(*KEY, "n", "sig", "sig_1", "open", F.posexplode("prefix").alias("pos", "token"))
              .where(F.col("token").bitwiseAND(1) == 1))
    found = rare_pairs(flagged, -(-(postings or 0) // BLOCK), percent).union(common_pairs(common, percent)).distinct()
    found = stored(found.join(tested, REFS, "left_anti") if tested else found, "pairs")
    more = verified(found, docs, classes, percent, min_words)

    return later.union(matched).union(more) if matched else later.union(more)


def line_dedup(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """docs with their removed lines taken out of ``text``; ``removed_lines`` holds the
    numbers (from 0) of the removed lines of each row, ``n_lines`` their count before."""
    gone = stored(removed_lines(_clean(docs), percent, min_words), "removed")
    per_text = stored(gone.groupBy("doc", "tid").agg(F.collect_set("line").alias("lines")), "removed")
    bits = stored(bit_rows(per_text.select(in_bitmap_bucket("tid").alias("b"))), "bits")
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"),
                       F.xxhash64(F.col("text").cast("string")).alias("tid"),
                       F.col("text").cast("string").alias("text"))

    rows = with_bit(rows, in_bitmap_bucket("tid"), bits)
    clean = rows.where(~F.col("bit")).withColumn("lines", F.lit(None).cast("array<long>"))
    other = rows.where("bit").join(per_text, ["doc", "tid"], "left")
    # texts that lose lines are split, once; the others stay as they are
    parts = F.when(F.col("lines").isNotNull(), F.split("text", "\n"))
    other = other.withColumn("_parts", parts)
    gone = F.array_sort("lines")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_parts").cast("long") - 1), "lines")
    text = F.array_join(F.transform(left, lambda i: F.get("_parts", i.cast("int"))), "\n")
    other = other.withColumn("text", F.when(F.col("lines").isNotNull(), text).otherwise(F.col("text"))).withColumn("lines", gone)
    both = clean.unionByName(other.select(*clean.columns))
    whole = F.col("row.text").cast("string")
    n_lines = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return both.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns],
                       F.when(whole.isNull(), 0).otherwise(n_lines).alias("n_lines"),
                       F.coalesce("lines", F.array().cast("array<long>")).alias("removed_lines"))

"""Near-duplicate documents by an exact n-gram Jaccard join with several global orders.

A document's set is its distinct five-word shingles. Two sets link when
100 * |A and B| >= percent * |A or B|. Sets that are equal form one class; classes are
joined:

1. Every shingle has a place in several global orders, each (frequency class, hash under
   its own seed). The frequency class comes from a fixed-size count table over all
   shingles of all documents; any function of the shingle is a valid order, so its size
   only affects speed. Two similar sets share a shingle in their prefixes under *every*
   order.
2. Postings of the first order's prefixes are grouped by shingle. Each document of a list
   is paired with one hub of the list: the one with the fewest rarer shingles, which is
   the least edited of a group of copies (lists of very frequent shingles are first split by
   a salt, and the hubs of the splits are paired with each other). Pairs pass the length and positional
   filters, a bound on the overlap from parity signatures as wide as the sets, then
   the prefix filters of the second and third order, then the exact check.
3. The links give components. Lists whose documents are still in different components
   are joined once more, now all pairs across components, with the same filters, a bound
   on the overlap from 512-bit parity signatures inside the join, and the exact check. So
   no link between different components is lost, and large groups of near copies cost
   about one pair per document instead of all pairs.

The result is components, not links: links between different texts of one component are
mostly never verified, so no number of links per class is returned.

Shingles and classes are named by 64-bit hashes (the expected number of accidental
collisions among n classes is n**2 / 2**65).

Defined cases: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document with 1-4
words has one shingle, its whole sequence; null or blank text gives an empty set, linked
with nothing (its component is its own doc_id); repeated rows fall into one class; a null
doc_id is kept and never the name of a component unless all its members are null; extra
columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textarrays as T
from .components import components
from .sketches import COUNTS, bit_rows, bucket_rows, class_of, count_classes, in_bitmap_bucket, with_bit
from .tables import lean, stored

COUNT_BITS = 18
CLASS_BITS = 22  # bit table of classes with several documents
SIGNATURE_WORDS = 8  # of 64 bits, in the signatures that the second join compares
SIGNATURE = tuple(f"sig_{i}" for i in range(SIGNATURE_WORDS))
ORDERS = (0x51ED27, 0xA3C59A, 0x7F4A7C)  # seeds of the global orders
HOT_LIST = 200_000  # estimated documents of a shingle above which its list is split
SALTS = 64


def probe_length(n, percent):
    """Prefix of a set that must meet the prefix of any smaller or equal similar set."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent):
    """Shorter prefix that is enough for the smaller set of a pair."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def order_keys(h: np.ndarray, classes: np.ndarray, seed: int) -> np.ndarray:
    c = classes[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
    return (c << np.uint64(56)) | (T.mix(h, seed) >> np.uint64(8))


def prefix(h: np.ndarray, classes: np.ndarray, seed: int, length: int) -> np.ndarray:
    k = order_keys(h, classes, seed)
    if length < len(h):
        part = np.argpartition(k, length - 1)[:length]
        return h[part[np.argsort(k[part])]]
    return h[np.argsort(k)]


def set_name(h: np.ndarray) -> int:
    """64-bit name of a set, from its sorted elements."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(h: np.ndarray, words: int) -> np.ndarray:
    """Parity signature of ``words`` (a power of two) 64-bit words: each element that only one
    of two sets has flips one bit, so the number of different bits is at most the symmetric
    difference. Adding up (xor) its halves gives the signature of half the words."""
    m = T.mix(h, 0x3C6E)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(out, ((m >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64),
                      np.uint64(1) << (m & np.uint64(63)))
    return out.view(np.int64)


def wide_parity(h: np.ndarray) -> np.ndarray:
    """Parity signature of at least as many bits as the set has elements."""
    return parity(h, 1 << max(0, (len(h) - 1) >> 6).bit_length())


def sets_of(col):
    """(first row, shingle sets) of a string array, a few megabytes of text at a time."""
    for a, b in T.batches(col):
        data, offsets = T.text_bytes(col.slice(a, b - a))
        h, _, first = T.words(data, offsets)
        yield a, T.shingles(h, first)


def _clean(docs: DataFrame) -> DataFrame:
    """doc_id, text and tid, a 64-bit hash of the text (rows may share a doc_id)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("tid"))


def shingle_classes(docs: DataFrame) -> np.ndarray:
    def count(batches):
        return bucket_rows(batches, lambda b: (s for _, sets in sets_of(b.column(0)) for s in sets if len(s)), COUNT_BITS)

    return count_classes(_clean(docs).select("text").mapInArrow(lean(count), COUNTS), COUNT_BITS)


def signatures(docs: DataFrame, classes, percent: int) -> DataFrame:
    """(doc_id, tid, n, cid, hot_from, prefix, the SIGNATURE columns, wide) per document."""
    hot = class_of(HOT_LIST)

    def sign(batches):
        import pyarrow as pa

        table = classes.value
        for batch in batches:
            ids, tids = batch.column(0), batch.column(2)
            for a, sets in sets_of(batch.column(1)):
                ns, cids, hots, flat, ends, sigs, wide = [], [], [], [], [0], [], []
                for h in sets:
                    n = len(h)
                    ns.append(n)
                    cids.append(set_name(h) if n else None)
                    sigs.append(parity(h, SIGNATURE_WORDS))
                    wide.append(wide_parity(h))
                    p = prefix(h, table, ORDERS[0], probe_length(n, percent)) if n else h
                    c = table[(p >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                    hots.append(int(np.searchsorted(c, hot)))
                    flat.append(p)
                    ends.append(ends[-1] + len(p))
                values = pa.array(np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(sets)), tids.slice(a, len(sets)), pa.array(ns, pa.int32()), pa.array(cids, pa.int64()),
                     pa.array(hots, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                     *[pa.array(x) for x in np.stack(sigs, axis=1)],
                     pa.array(wide, pa.list_(pa.int64()))],
                    names=["doc_id", "tid", "n", "cid", "hot_from", "prefix", *SIGNATURE, "wide"])

    schema = f"doc_id long, tid long, n int, cid long, hot_from int, prefix array<long>, {', '.join(f'{c} long' for c in SIGNATURE)}, wide array<long>"
    return _clean(docs).mapInArrow(lean(sign), schema)


def one_per_class(sig: DataFrame) -> DataFrame:
    """(cid, n, hot_from, prefix) of every class. Only rows whose bit is set in a table of the
    classes with several documents (2**16 rows at most) are shuffled."""
    bucket = in_bitmap_bucket("cid", CLASS_BITS)
    several = sig.where("n > 0").groupBy("cid").count().where("count > 1")
    bits = stored(bit_rows(several.select(bucket.alias("b"))), "bits")
    rows = with_bit(sig.where("n > 0").select("cid", "n", "hot_from", "prefix"), bucket, bits)
    grouped = rows.where("bit").groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "hot_from", "prefix")])
    return rows.where(~F.col("bit")).drop("bit").unionByName(grouped)


def near(pa_: str, na: str, pb: str, nb: str, percent: int):
    """Length and positional filter for a shared shingle at (0-based) places pa, pb."""
    a, b, x, y = F.col(na), F.col(nb), F.col(pa_), F.col(pb)
    most = F.least(x, y) + 1 + F.least(a - x, b - y) - 1
    return ((100 * F.least(a, b) >= percent * F.greatest(a, b))
            & ((100 + percent) * most >= percent * (a + b)))


def plausible(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that a bound from their wide parity signatures lets pass: each
    element of only one set flips one bit. The longer signature is halved once; where that is
    not enough (percent below 50 only), the pair passes."""
    marks = sig.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
    a = marks.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("wide_a"))
    b = marks.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("wide_b"))
    words = F.least(F.size("wide_a"), F.size("wide_b"))

    def half(name, i):
        x = F.col(name)
        return F.when(F.size(x) > words, F.get(x, i).bitwiseXOR(F.get(x, i + words))).otherwise(F.get(x, i))

    apart = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0),
                        lambda s, i: s + F.bit_count(half("wide_a", i).bitwiseXOR(half("wide_b", i))))
    total = F.col("n_a") + F.col("n_b")
    return (pairs.join(a, "a").join(b, "b")
            .where((F.greatest(F.size("wide_a"), F.size("wide_b")) > 2 * words)
                   | ((100 + percent) * (total - apart) >= 2 * percent * total)).select("a", "b"))


def texts_of(wanted: DataFrame, docs: DataFrame, sig: DataFrame) -> DataFrame:
    """(cid, text) of the wanted classes: the text of one of their documents each. A bit
    table of their doc_ids (at most 2**14 rows of 64 bits, so it may be broadcast) keeps
    the other texts out of the shuffle."""
    reps = (sig.select("doc_id", "tid", "cid").join(wanted, "cid").groupBy("cid")
            .agg(F.min(F.struct("doc_id", "tid")).alias("d")).select("cid", "d.doc_id", "d.tid"))
    reps = stored(reps, "wanted")
    bit = in_bitmap_bucket("doc_id")
    bits = (reps.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("i"))
            .agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("w")))
    near_ = (_clean(docs).withColumn("b", bit).join(F.broadcast(bits), F.shiftright("b", 6) == F.col("i"))
             .where("shiftrightunsigned(w, b % 64) & 1 = 1").select("doc_id", "tid", "text"))
    found = near_.alias("x").join(reps.alias("r"), F.col("x.doc_id").eqNullSafe(F.col("r.doc_id"))
                                  & (F.col("x.tid") == F.col("r.tid")))
    return stored(found.select("cid", "text").dropDuplicates(["cid"]), "texts")


def verified(pairs: DataFrame, docs: DataFrame, sig: DataFrame, classes, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose sets are similar. Texts are joined to the
    pairs, as they are smaller than the sets; a task makes the sets of a slice of pairs,
    each class once."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    texts = texts_of(wanted, docs, sig)
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))

    def views(h, freq):
        """The set and its sorted prefixes under the further orders."""
        length = probe_length(len(h), percent)
        return [h] + [np.sort(prefix(h, freq, ORDERS[o], length)) for o in (1, 2)]

    def similar(x, y):
        # the prefix filters of the further orders, intersected
        if not all(len(np.intersect1d(x[o], y[o], assume_unique=True)) for o in (1, 2)):
            return False
        both = len(np.intersect1d(x[0], y[0], assume_unique=True))
        return 100 * both >= percent * (len(x[0]) + len(y[0]) - both)

    def check(batches):
        import pyarrow as pa

        freq = classes.value
        for whole in batches:
            for start, end in T.batches(whole.column(3)):
                batch = whole.slice(start, end - start)
                names = [batch.column(i).to_numpy() for i in (0, 1)]
                made: dict[int, list] = {}
                for ids, col in zip(names, batch.columns[2:]):
                    once = [i for i in np.unique(ids, return_index=True)[1] if int(ids[i]) not in made]
                    part = col.take(pa.array(once, pa.int64()))
                    for at, sets in sets_of(part):
                        for k, h in enumerate(sets):
                            made[int(ids[once[at + k]])] = views(h, freq)
                ok = pa.array([similar(made[int(u)], made[int(v)]) for u, v in zip(*names)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["u", "v"])

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(lean(check), "u long, v long"))


def members(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, tid, n_shingles, component_id, component_tid) per document: the component
    is named by its first document in the order (doc_id with nulls last, tid), so
    documents are told apart where they share a doc_id or have none."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(shingle_classes(docs))
    sig = stored(signatures(docs, classes, percent), "signatures")

    # one row per distinct set, then its prefix postings
    distinct = one_per_class(sig)
    postings = (distinct.select("cid", "n", "hot_from", F.posexplode("prefix").alias("pos", "token"))
                .select("token", F.when(F.col("pos") >= F.col("hot_from"), 1 + F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
                        .otherwise(0).cast("int").alias("salt"), "cid", "n", "pos"))
    w = W.partitionBy("token", "salt")
    lists = stored(
        postings.withColumn("members", F.count("*").over(w))
        .withColumn("hub", F.min(F.struct("pos", "cid", "n")).over(w))
        .where("members > 1 or salt > 0")
        .select("token", "salt", "cid", "n", "pos", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n"),
                F.col("hub.pos").alias("hub_pos")), "lists")

    def pair(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    stars = lists.where("cid <> hub").where(near("pos", "n", "hub_pos", "hub_n", percent)).select(*pair("cid", "hub"))
    subs = lists.where("salt > 0 and cid = hub").select("token", "cid", "n", "pos")
    tops = subs.groupBy("token").agg(F.min(F.struct("pos", "cid", "n")).alias("t")).select(
        "token", F.col("t.cid").alias("hub"), F.col("t.n").alias("hub_n"), F.col("t.pos").alias("hub_pos"))
    stars = stars.union(subs.join(tops, "token").where("cid <> hub")
                        .where(near("pos", "n", "hub_pos", "hub_n", percent)).select(*pair("cid", "hub")))
    tested = stored(plausible(stars.distinct(), sig, percent), "pairs")
    links = stored(verified(tested, docs, sig, classes, percent), "links")
    roots = components(links)

    # lists that still hold several components: all pairs across them
    placed = (lists.select("token", "cid", "n", "pos").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
              .select("token", "cid", "n", "pos", F.coalesce("root", "cid").alias("root")))
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    open_ = placed.join(mixed.select("token"), "token")
    marks = sig.where("n > 0").groupBy("cid").agg(*[F.first(c).alias(c) for c in SIGNATURE])
    open_ = stored(open_.join(marks, "cid"), "open")
    kept = ("cid", "n", "pos", "root", *SIGNATURE)
    x = open_.select("token", *[F.col(c).alias(c + "_a") for c in kept])
    y = open_.select("token", *[F.col(c).alias(c + "_b") for c in kept])
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNATURE), F.lit(0))
    # |A and B| <= (n + m - apart) / 2
    close = (100 + percent) * (F.col("n_a") + F.col("n_b") - apart) >= 2 * percent * (F.col("n_a") + F.col("n_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cid_a") < F.col("cid_b")))
    short = (F.col("n_a") - F.ceil(2 * percent * F.col("n_a") / (100 + percent)) + 1)
    rest = (x.where(F.col("pos_a") < short).join(y, "token")
            .where(smaller & (F.col("root_a") != F.col("root_b")))
            .where(near("pos_a", "n_a", "pos_b", "n_b", percent) & close)
            .select(*pair("cid_a", "cid_b")).distinct().join(tested, ["a", "b"], "left_anti"))
    rest = stored(plausible(rest, sig, percent), "pairs")
    more = stored(verified(rest, docs, sig, classes, percent), "links")
    roots = components(links.union(more))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("first")
    firsts = sig.where("n > 0").groupBy("cid").agg(first)
    joined = roots.join(firsts, roots["node"] == firsts["cid"]).select("node", "root", "first")
    named = joined.groupBy("root").agg(F.min("first").alias("name"))
    names = (firsts.join(joined.join(named, "root").select(F.col("node").alias("cid"), "name"), "cid", "left")
             .select("cid", F.coalesce("name", "first").alias("name")))
    return (sig.select("doc_id", "tid", "n", "cid").join(names, "cid", "left")
            .select("doc_id", "tid", F.col("n").cast("long").alias("n_shingles"),
                    *[F.when(F.col("n") > 0, F.col(f"name.{x}")).otherwise(F.col(x)).alias(f"component_{y}")
                      for x, y in (("doc_id", "id"), ("tid", "tid"))]))


def ngram_join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    return members(docs, percent).select("doc_id", "n_shingles", "component_id")

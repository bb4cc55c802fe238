"""Threshold-scaled document fingerprints, DataFrame functions only.

A document's fingerprint holds every five-word shingle hash below a fixed fraction of the
64-bit range; a document without such a hash keeps its smallest one. Fingerprints of any
documents can be merged (union, then the same rule), and the share of one fingerprint's
hashes found in another estimates containment at any two sizes; it is unknown (null) for a
document without a hash below the limit, unless the other one keeps the same hash.

Words are runs without white space of the lower-cased text; with one to four words the
whole sequence is the single shingle. Defined cases: null text is the empty text with an
empty fingerprint; two empty fingerprints have likeness 1, an empty and a non-empty one 0;
equal texts have equal fingerprints; repeated rows and ties in doc_id are separate
documents, ordered by doc_id, then text; null doc_id comes first; a single row is its own
next document; extra columns are ignored; an empty table gives no rows. A text must fit
one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import count_below, range_bounds

SHINGLE = 5
FRACTION = 1 / 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """Hashes of all shingles, from a column of words (read once per shingle: a plain
    column, not an expression)."""
    rolled = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) == 0, F.array().cast("array<long>")).otherwise(rolled)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def threshold(fraction: float) -> Column:
    """Hashes below this are kept."""
    return F.lit(int(-(1 << 63) + (1 << 64) * fraction)).cast("long")


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1. Null where a holds only its
    smallest hash, above the threshold, and b does not show it: b may well have it."""
    both = F.size(F.array_intersect(a, b))
    blind = (F.size(a) == 1) & (F.get(a, F.lit(0)) >= threshold(fraction)) & (both == 0)
    return F.when(F.size(a) == 0, 1.0).when(~blind, both / F.size(a))


def as_text(a: Column) -> Column:
    """A fingerprint as one string: its hashes in hex, ascending, comma-joined."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ",")


def with_fingerprint(df: DataFrame, text: str, name: str, fraction: float) -> DataFrame:
    """Adds the fingerprint of a text column. Every step is a column of its own that the
    next reads more than once, so none is evaluated again inside a lambda."""
    limit = threshold(fraction)
    return (df.withColumn("_words", words(F.col(text))).withColumn("_all", shingle_hashes(F.col("_words")))
            .withColumn("_kept", F.sort_array(F.array_distinct(F.filter("_all", lambda h: h < limit))))
            .withColumn(name, F.when((F.size("_kept") == 0) & (F.size("_all") > 0), F.array(F.array_min("_all"))).otherwise(F.col("_kept")))
            .drop("_words", "_all", "_kept"))


def following(docs: DataFrame, columns, range_bytes: int, max_ranges: int) -> DataFrame:
    """Each document, ``columns`` added by a function of the frame, with the next one
    (``next``), in ascending (doc_id, text), the first after the last. Ranges of doc_id
    are ordered each by itself; only the first document of every range is passed to the
    range before."""
    total, lowest, nulls = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    bounds = sorted(set(range_bounds(docs, "doc_id", int(min(max_ranges, (total or 0) // range_bytes + 1)))))
    # a boundary is a doc_id of the table: the first one of its range
    firsts = F.col("doc_id").eqNullSafe(F.lit(None if nulls else lowest).cast("long")) | F.col("doc_id").isin(bounds)

    def ranged(d):
        return d.withColumn("r", count_below(F.col("doc_id"), bounds, inclusive=True))

    heads = columns(ranged(docs.where(firsts))).select("r", "doc_id", F.struct("fingerprint", "text").alias("next"))
    heads = heads.groupBy("r").agg(F.min_by("next", F.struct("doc_id", "next.text")).alias("head"))
    numbers = W.orderBy("r")  # one row per range
    before = heads.select("head", F.coalesce(F.lag("r").over(numbers), F.max("r").over(W.partitionBy())).alias("r"))
    w = W.partitionBy("r").orderBy("doc_id", "text")
    inside = columns(ranged(docs)).withColumn("next", F.lead(F.struct("fingerprint", "text")).over(w))
    return inside.join(before, "r", "left").withColumn("next", F.coalesce("next", "head")).drop("r", "head")


def fingerprints(docs: DataFrame, fraction: float = FRACTION, range_bytes: int = 16 << 20,
                 max_ranges: int = 4096) -> DataFrame:
    """Contract columns of op6 per document, containment estimates besides."""
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def printed(d):
        return with_fingerprint(d, "text", "fingerprint", fraction).withColumn("n_chars", F.length("text").cast("long"))

    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = following(clean, printed, range_bytes, max_ranges).withColumn(
        "edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half),
                           F.col("next.text").substr(F.lit(1), half)))
    edited = edited.select("doc_id", "n_chars", "fingerprint", "edited", F.col("next.fingerprint").alias("next_fingerprint"))
    both = with_fingerprint(edited, "edited", "edited_fingerprint", fraction)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        containment(F.col("fingerprint"), F.col("edited_fingerprint"), fraction).alias("in_edited"),
        containment(F.col("fingerprint"), F.col("next_fingerprint"), fraction).alias("in_next"))

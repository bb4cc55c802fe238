"""Language of words and documents by a linear-chain conditional random field.

Every word is a position of the chain. Its features are the word itself (lexicon), its
prefixes and suffixes and its byte n-grams, hashed into one weight table per label;
transitions between neighbouring words are learned with them. Training maximises the
conditional likelihood of word labels on spliced sequences: windows of labelled documents
are put one after the other so that languages switch inside a sequence. Prediction runs forward-backward
over the whole text (exactly, by blocks whose transfer matrices are multiplied), giving
the label probabilities of every word; a document's language has the largest mean
probability over its words with letters, and that mean is its score.

Training rows: at most ``per_label`` documents of each label are drawn by a hash of
doc_id, and two windows of ``window`` words from each; this bound is a parameter, everything else covers
all data. The model is a fixed-size table on the driver.

Defined cases: null text, and text without any letter (Unicode category L), is `und` with score 0; words
without a letter take no part in the score; null or empty lang is not a label; if no
labelled row exists every document is `und`; rows are independent, so ties, repeated rows
and null doc_id need no rule (equal scores: the label first in order); extra columns are ignored; an
empty table gives no rows. A text must fit one row; words are handled in blocks."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .tables import lean

U = np.uint64
TABLE_BITS = 18
BLOCK = 32
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[0x80:] = True  # bytes of other characters
HAS_LETTER = regex.compile(r"\p{L}")
SLICE_BYTES = 1 << 19  # text handled at once in a task
AFFIX = 4
GRAMS = (2, 3, 4)
SCHEMA = ("doc_id long, lang_pred string, score double, words long, switches long, "
          "runs array<struct<lang: string, words: int>>")


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """(hash, start, end, first word of each text)."""
    h, start, first = T.words(data, offsets)
    gap = np.flatnonzero(T.SPACE[data])
    stops = np.sort(np.concatenate((gap, offsets[1:])))
    return h, start, stops[np.searchsorted(stops, start, side="right")] if len(start) else start, first


def trimmed(data, start, end):
    """Spans without leading and trailing bytes that are no letters."""
    start, end = start.copy(), end.copy()
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live])]
        off = ~LETTER[data[start[live]]]
        start[live[off]] += 1
        live = live[off]
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live])]
        off = ~LETTER[data[end[live] - 1]]
        end[live[off]] -= 1
        live = live[off]
    return start, end


def features(data, start, end):
    """(feature numbers, word of each) of words given by byte spans."""
    start, end = trimmed(data, start, end)
    size = np.maximum(end - start, 0)
    words = np.arange(len(start))
    low = T.CODES[data]  # A-Z as a-z
    ids, owner = [], []

    def add(words, h, seed):
        ids.append((T.mix(h, seed) >> U(64 - TABLE_BITS)).astype(np.int64))
        owner.append(words)

    step = U(0x100000001B3)
    with np.errstate(over="ignore"):
        pre = np.zeros(len(start), dtype=np.uint64)
        suf = np.zeros(len(start), dtype=np.uint64)
        for k in range(1, AFFIX + 1):
            live = words[size >= k]
            pre[live] = pre[live] * step + low[start[live] + k - 1]
            suf[live] = suf[live] * step + low[end[live] - k]
            add(live, pre[live], 10 + k)
            add(live, suf[live], 20 + k)
        total = int(size.sum())
        if total:
            owner_of = np.repeat(words, size)
            place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(start, size) + place
            left = np.repeat(size, size) - place
            gram = np.zeros(total, dtype=np.uint64)
            for k in range(1, max(GRAMS) + 1):
                ok = left >= k
                gram[ok] = gram[ok] * step + low[at[ok] + k - 1]
                if k in GRAMS:
                    add(owner_of[ok], gram[ok], 30 + k)
            word = np.zeros(len(start), dtype=np.uint64)
            live = words[size > 0]
            word[live] = np.add.reduceat(T.mix(low[at] + place.astype(U) * step, 7), (np.cumsum(size) - size)[live])
            add(live, word[live], 8)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), size > 0
    return np.concatenate(ids), np.concatenate(owner), size > 0


def emissions(weights: np.ndarray, ids, owner, n: int) -> np.ndarray:
    out = np.empty((n, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(owner, weights=weights[ids, k], minlength=n)
    return out


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions


def train(labels: list[str], samples: list[tuple[int, str]], rounds: int = 40, rate: float = 0.3,
          decay: float = 1e-4, seed: int = 2) -> Model:
    """Full-batch likelihood ascent (per-weight step sizes). samples: (label number,
    window); all sequences are four windows long."""
    k = len(labels)
    weights, transitions = np.zeros((1 << TABLE_BITS, k), dtype=np.float32), np.zeros((k, k))
    samples = [s for s in samples if s[1].split()]
    if k < 2 or not samples:
        return Model(labels, weights, transitions)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    words, tags = [], []
    for a in range(0, len(order), 4):
        row = [(w, samples[i][0]) for i in order[a:a + 4] for w in samples[i][1].split()]
        words.append([w for w, _ in row])
        tags.append([t for _, t in row])
    length = max(map(len, words))
    mask = np.array([[j < len(w) for j in range(length)] for w in words])
    gold = np.zeros(mask.shape, dtype=np.int64)
    gold[mask] = np.concatenate([np.array(t) for t in tags])
    kinds, which = np.unique(np.array([w for row in words for w in row], dtype=object).astype(str), return_inverse=True)
    data = np.frombuffer(" ".join(kinds).encode(), dtype=np.uint8)
    size = np.array([len(w.encode()) for w in kinds])
    start = np.cumsum(size + 1) - size - 1
    ids, owner, _ = features(data, start, start + size)
    word = np.zeros(mask.shape, dtype=np.int64)
    word[mask] = which
    hot = np.eye(k)[gold] * mask[..., None]
    g_w, g_t = np.full(weights.shape, 1e-8, dtype=np.float32), np.full((k, k), 1e-8)
    for _ in range(rounds):
        e = emissions(weights, ids, owner, len(kinds))[word]
        p, pair = sequence_posteriors(e, transitions, mask)
        per_word = np.zeros((len(kinds), k))
        np.add.at(per_word, word[mask], (hot - p)[mask])
        grad = np.stack([np.bincount(ids, weights=per_word[owner, j], minlength=len(weights)) for j in range(k)], 1)
        grad = grad / len(words) - decay * weights
        both = mask[:, 1:]
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        grad_t = (seen - pair) / len(words) - decay * transitions
        g_w += (grad * grad).astype(np.float32)
        g_t += grad_t * grad_t
        weights += (rate * grad / np.sqrt(g_w)).astype(np.float32)
        transitions += rate * grad_t / np.sqrt(g_t)
    return Model(labels, weights, transitions)


def sequence_posteriors(e, transitions, mask):
    """Forward-backward over padded sequences [n, t, k]: (label probabilities, expected
    transition counts)."""
    n, length, k = e.shape
    x = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    alpha, beta = np.zeros((n, length, k)), np.ones((n, length, k))
    alpha[:, 0] = x[:, 0] / x[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        step = (alpha[:, t - 1] @ a) * x[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step / step.sum(1, keepdims=True), alpha[:, t - 1])
    pair = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        nxt = x[:, t + 1] * beta[:, t + 1]
        joint = alpha[:, t, :, None] * a[None] * nxt[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pair += joint[mask[:, t + 1]].sum(0)
        step = nxt @ a.T
        beta[:, t] = np.where(mask[:, t + 1, None], step / step.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    return p / p.sum(2, keepdims=True), pair


def posteriors(e: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word [w, k] of texts whose words start at ``first``:
    forward-backward by blocks."""
    k = e.shape[1]
    n_words = np.diff(first)
    blocks = -(-n_words // BLOCK)
    begin = np.cumsum(blocks) - blocks  # first block of each text
    total = int(blocks.sum())
    if not total:
        return np.zeros((0, k))
    text = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(first[-1]) - first[:-1][text]
    x = np.exp(e - e.max(1, keepdims=True)).astype(np.float32)
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    # a word multiplies by the transitions, then by its own weights; a text's first word has
    # no transition, the padding behind its last word is the identity
    own, moves = np.ones((total, BLOCK, k), dtype=np.float32), np.zeros((total, BLOCK), dtype=bool)
    blk, pos = begin[text] + place // BLOCK, place % BLOCK
    own[blk, pos], moves[blk, pos] = x, True
    moves[begin[n_words > 0], 0] = False

    def scaled(v, axes):
        return v / v.sum(axes, keepdims=True)

    through = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k))
    for t in range(BLOCK):
        through = scaled(np.where(moves[:, t, None, None], through @ a, through) * own[:, t, None, :], (1, 2))
    # vectors at the block borders, all texts at once, block after block
    into, out = np.full((total, k), 1 / k, dtype=np.float32), np.ones((total, k), dtype=np.float32)
    by_size = np.argsort(-blocks, kind="stable")
    sizes = blocks[by_size]
    for j in range(1, int(sizes[0])):
        at = begin[by_size[:np.searchsorted(-sizes, -j, side="left")]] + j
        into[at] = scaled((into[at - 1][:, :, None] * through[at - 1]).sum(1), 1)
    for j in range(1, int(sizes[0])):
        some = by_size[:np.searchsorted(-sizes, -j, side="left")]
        at = begin[some] + blocks[some] - 1 - j
        out[at] = scaled((through[at + 1] * out[at + 1][:, None, :]).sum(2), 1)
    alpha = np.empty((total, BLOCK, k), dtype=np.float32)
    v = into
    for t in range(BLOCK):
        v = scaled(np.where(moves[:, t, None], v @ a, v) * own[:, t], 1)
        alpha[:, t] = v
    v = out
    for t in range(BLOCK - 1, -1, -1):
        alpha[:, t] *= v
        v = own[:, t] * v
        v = scaled(np.where(moves[:, t, None], v @ a.T, v), 1)
    p = alpha[blk, pos]
    return p / p.sum(1, keepdims=True)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_windows(docs: DataFrame, per_label: int, window: int) -> list[tuple[str, str]]:
    """Bounded sample (label, window) of the rows that may be learned from."""
    rows = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / float(1 << 53)
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_label / r["count"])]), F.col("lang"))
    chosen = rows.where(u < share).select("lang", "doc_id", "text")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], []]
            for lang, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                for a in {len(words) // 4, len(words) * 5 // 8}:
                    piece = " ".join(words[a:a + window])
                    if HAS_LETTER.search(piece):
                        for c, v in zip(out, (lang, doc, piece[:window * 64])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                             names=["lang", "doc_id", "piece"])

    got = (chosen.mapInArrow(cut, "lang string, doc_id long, piece string")
           .orderBy(F.xxhash64("doc_id", F.lit(6)), "piece", "lang").limit(3 * per_label * len(counts)).collect())
    return [(r["lang"], r["piece"]) for r in got]


def fit(docs: DataFrame, per_label: int = 800, window: int = 24) -> Model:
    found = training_windows(docs, per_label, window)
    labels = sorted({lang for lang, _ in found})
    number = {x: i for i, x in enumerate(labels)}
    return train(labels, [(number[lang], piece) for lang, piece in found])


def label_batch(model: Model, column):
    """For a string array of bounded size, per text: number of its top label, that label's
    mean probability (its share of the text), words, runs, then the label and length of
    each run, and per text the words counted and their mean largest probability (how sure
    the model is, whatever number of languages the text mixes)."""
    labels, k = model.labels, len(model.labels)
    data, offsets = T.text_bytes(column)
    h, start, end, first = word_spans(data, offsets)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    ids, owner, lettered = features(data, start[one], end[one])
    n = len(one)
    e = emissions(model.weights, ids, owner, n)[which] if n else np.zeros((0, k))
    p = posteriors(e, first, model.transitions)
    counted = lettered[which] if n else np.zeros(0, bool)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    mass = np.stack([np.bincount(text[counted], weights=p[counted, j], minlength=len(column)) for j in range(k)], 1)
    amount = np.bincount(text[counted], minlength=len(column))
    best = p.argmax(1) if n else np.zeros(0, np.int64)
    change = np.ones(len(best), dtype=bool)
    if len(best):
        change[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    run_at = np.flatnonzero(change)
    run_len = np.diff(run_at, append=len(best))
    runs = np.bincount(text[run_at], minlength=len(column))
    top = mass.argmax(1)
    score = mass[np.arange(len(column)), top] / np.maximum(amount, 1)
    sure = np.bincount(text[counted], weights=p[counted].max(1) if n else None, minlength=len(column))
    return top, score, np.diff(first), runs, best[run_at], run_len, amount, sure / np.maximum(amount, 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """SCHEMA per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for a, b in T.batches(batch.column(1), SLICE_BYTES):
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                count = b - a
                letters = np.array([t is not None and HAS_LETTER.search(t) is not None for t in texts.to_pylist()])
                if not m.labels:
                    letters[:] = False
                    top = np.zeros(count, np.int64)
                    score, words, runs = np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
                    run_lang, run_len, amount = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(count)
                else:
                    top, score, words, runs, run_lang, run_len, amount, _ = label_batch(m, texts)
                names = np.array([*m.labels, "und"], dtype=object)
                known = letters & (amount > 0)
                ends = np.concatenate(([0], np.cumsum(runs))).astype(np.int32)
                pieces = pa.StructArray.from_arrays(
                    [pa.array(names[run_lang], pa.string()), pa.array(run_len.astype(np.int32))], names=["lang", "words"])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names[np.where(known, top, len(m.labels))], pa.string()),
                     pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(words.astype(np.int64)),
                     pa.array(np.maximum(runs - 1, 0).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pieces)],
                    names=["doc_id", "lang_pred", "score", "words", "switches", "runs"])

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return clean.mapInArrow(lean(run), SCHEMA)


def identify(docs: DataFrame, per_label: int = 800, window: int = 24) -> DataFrame:
    """doc_id, held_out, lang_pred, score, words, switches, runs per document."""
    out = predict(docs, fit(docs, per_label, window))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "words", "switches", "runs")


def keep_identified(docs: DataFrame, min_confidence: float = 0.5, **options) -> DataFrame:
    """The rows of docs (all columns) whose words are labelled with at least
    min_confidence: the mean over words of the largest label probability, so texts in
    several languages stay when each word's language is clear."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))
    at = docs.columns.index("text")

    def known(batches):
        m = model.value
        for batch in batches:
            for a, b in T.batches(batch.column(at), SLICE_BYTES):
                part = batch.slice(a, b - a)
                if m.labels:
                    text = part.column(at)
                    *_, amount, sure = label_batch(m, text)
                    letters = np.array([t is not None and HAS_LETTER.search(t) is not None for t in text.to_pylist()])
                    yield part.take(np.flatnonzero(letters & (amount > 0) & (sure >= min_confidence)))

    clean = docs.withColumn("text", F.col("text").cast("string"))
    return clean.mapInArrow(lean(known), clean.schema)

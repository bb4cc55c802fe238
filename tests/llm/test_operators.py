"""The numbered operators against brute force on small fixtures: nulls, empty and very
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pharmlake.llm import (chat_format, fingerprints, language_id, line_dedup, mixing, ngram_join, packing, sharding,
                           vector_search, warc)
from pharmlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid long, r int, prefix string"
LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))
TEXTS = [None, "", "  \n\t ", "one two", "ONE two", "one two three four five six", "one two three four five six",
         BASE, BASE, BASE + " tail", BASE.replace("tok30", "other"), BASE.replace("tok0 ", "x "), LONG, LONG + " end",
         "Ein kurzer Satz mit Wörtern hier\n" + BASE + "\nun dernier vers pour finir ici", "12 34 !!",
         BASE + "\n" + BASE + "\nlast words of a text that differ", "###  </turn> \\ odd", "a" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, ""][i % 4], "s" + str(min(i // 6, 2)) if i % 7 else None, 0, 5, 6, "p") for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[5], (None, BASE + " tail", "en", "s0", 0, 5, 6, "p")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def jaccard(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_line_dedup(docs, none):
    rows = [r for r in docs.collect() if r.text is not None]
    seen, want = [], {}
    for r in sorted(rows, key=lambda r: -1 if r.doc_id is None else r.doc_id):
        for k, line in enumerate(r.text.split("\n")):
            s = set(words(line))
            if s:
                seen.append((r.doc_id, k, s))
    # repeated rows are treated alike: a line is removed when an earlier (doc_id, line) matches
    order = lambda d: -1 if d is None else d
    gone = {(d, k) for d, k, s in seen for e, j, t in seen if (order(e), j) < (order(d), k) and jaccard(s, t)}
    for r in rows:
        want[r.doc_id] = "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in gone)
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == docs.count()
    assert all(r.text == want.get(r.doc_id) for r in got)
    assert {(r.doc_id, k) for r in got for k in r.removed_lines} == gone
    assert line_dedup.line_dedup(none).count() == 0


@pytest.mark.parametrize("hubs, keys", [(2, 1), (16, 3)])
def test_line_dedup_of_a_large_group_of_near_copies(spark, monkeypatch, hubs, keys):
    # each copy has its own edits, so that no single member matches all the others
    monkeypatch.setattr(line_dedup, "HUBS", hubs)
    monkeypatch.setattr(line_dedup, "KEYS", keys)
    rng = np.random.default_rng(5)
    rows, sets = [], []
    for i in range(240):
        line = [f"base{j}" for j in range(40)]
        for j in rng.choice(40, rng.integers(2, 7), replace=False):
            line[j] = f"edit{rng.integers(0, 900)}"
        rows.append((i, " ".join(line)))
        sets.append(set(line))
    want = {i for i in range(240) if any(jaccard(sets[i], sets[j]) for j in range(i))}
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert 20 < len(want) < 239
    assert {r.doc_id for r in got if r.removed_lines} == want


def test_postings_of_a_word_meet_in_fitting_sizes_only(monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRS", 40)
    rng = np.random.default_rng(3)
    m, percent = 300, 80
    n = rng.integers(4, 40, m)
    key = np.sort(rng.integers(-2, 2, m) << 32 | n)
    n = key & 0x7FFFFFFF
    pos = (rng.random(m) * (n // 5 + 1)).astype(np.int64)
    opened = rng.random(m) < 0.7
    sigs = [rng.integers(-(1 << 63), 1 << 63, 3)[rng.integers(0, 3, m)] for _ in "ab"]

    def fits(i, j):
        apart = sum(((int(s[i]) ^ int(s[j])) & (1 << 64) - 1).bit_count() for s in sigs)
        a, b, p, q = (int(x) for x in (n[i], n[j], pos[i], pos[j]))
        shared = min(p, q) + min(a - p, b - q)
        return (key[i] >> 32 == key[j] >> 32 and (opened[i] or opened[j]) and 100 * a >= percent * b
                and 180 * (a - p) >= percent * (a + b) and 180 * (b - q) >= percent * (a + b)
                and 180 * shared >= percent * (a + b) and 180 * (a + b - apart) >= 2 * percent * (a + b))

    got = [(int(i), int(j)) for x in line_dedup.list_pairs(key, pos, opened, sigs, percent) for i, j in zip(*x)]
    want = {(i, j) for i in range(m) for j in range(i + 1, m) if fits(i, j)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert [len(i) for i, _ in line_dedup.list_pairs(key[:0], pos[:0], opened[:0], [s[:0] for s in sigs], percent)] == []


@pytest.mark.parametrize("common, few, block, rounds", [(120, 16, 1 << 19, 0), (0, 16, 300, 0), (0, -1, 300, 1)])
def test_line_dedup_by_rare_and_common_words(spark, monkeypatch, common, few, block, rounds):
    for name, value in (("COMMON", common), ("FEW", few), ("BLOCK", block)):
        monkeypatch.setattr(line_dedup, name, value)
    asked, star = [], line_dedup.star_rounds
    monkeypatch.setattr(line_dedup, "star_rounds", lambda *a: asked.append(1) or star(*a))
    rng = np.random.default_rng(11)
    rows, seen = [], []
    for d in range(40):
        lines = []
        for k in range(5):
            line = [f"w{x}" for x in rng.integers(0, 25, rng.integers(1, 14))]
            if seen and rng.random() < 0.5:
                line = [*seen[rng.integers(0, len(seen))][2], f"edit{rng.integers(0, 9)}"][rng.integers(0, 2):]
            seen.append((d, k, line))
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    gone = {(d, k) for d, k, s in seen for e, j, t in seen if (e, j) < (d, k) and jaccard(set(s), set(t))}
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, k) for r in got for k in r.removed_lines} == gone and len(gone) > 30
    assert len(asked) == rounds


def test_line_sets_of_wanted_lines_only():
    import pyarrow as pa

    texts = ["", "a b\n\nc a a\n", None, "\n", "é x\x0bx\n y", "tail\n", "A b z " * 40 + "\nlast"]
    classes = np.arange(1 << line_dedup.COUNT_BITS).astype(np.uint8)
    column = pa.array(["skipped", *texts]).slice(1)

    def sets(wanted=None):
        row, number, n, first, tokens = line_dedup.line_sets(column, classes, 1, wanted)
        assert n.sum() == len(tokens)
        return {(r, k): tokens[a:a + m].tolist() for r, k, m, a in zip(row.tolist(), number.tolist(), n.tolist(), first.tolist())}

    every = sets()
    assert {k: len(v) for k, v in every.items()} == {
        (i, k): len(set(words(x))) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if words(x)}
    assert all(v == sorted(set(v)) for v in every.values())
    asked = []
    some = sets(lambda row, number: asked.append(len(row)) or (row + number) % 2 == 0)
    assert asked and some == {k: v for k, v in every.items() if sum(k) % 2 == 0} != every
    assert sets(lambda row, number: row < 0) == {}


def test_words_of_a_line_are_grouped_when_their_keys_differ_in_the_last_bits_only():
    line = np.array([0, 0, 0, 1, 1, 1, 5, 5])
    key = np.array([9, 8, 9, 3, 2, 3, 1 << 63, 1], dtype=np.uint64)
    order = line_dedup.by_line(line, key)
    assert list(zip(line[order].tolist(), key[order].tolist())) == sorted(zip(line.tolist(), key.tolist()))
    assert len(line_dedup.by_line(line[:0], key[:0])) == 0


def test_counts_reach_spark_eight_buckets_a_row():
    from pharmlake.llm import sketches

    hashes = np.random.default_rng(7).integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1)
    rows = [r for b in sketches.bucket_rows([0], lambda _: [hashes, hashes[:10]], 10) for r in b.to_pylist()]
    assert len(rows) == 128
    got = [r[f"n{j}"] for r in sorted(rows, key=lambda r: r["i"]) for j in range(8)]
    assert got == np.bincount(np.concatenate((hashes, hashes[:10])) >> np.uint64(54), minlength=1024).tolist()


def test_line_dedup_without_doc_ids_loses_no_line(spark):
    rows = [(None, f"only line {i} of number {i * 7919 % 6007} {'x' * (i % 17)}y{i}\nshared footer of every page", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_lines int").repartition(4)
    got = line_dedup.line_dedup(docs.drop("removed_lines")).collect()
    assert len(got) == 6000 and sum("shared footer" in r.text for r in got) == 1
    assert {r.text.split("\n")[0] for r in got} == {t.split("\n")[0] for _, t, _ in rows}


def test_ngram_join(docs, none):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]):
                root[find(i)] = find(j)
    name = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            name[find(i)] = min(name.get(find(i), r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), len(s), name.get(find(i)) if s else r.doc_id) for i, (r, s) in enumerate(zip(rows, sets)))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect())
    assert got == want
    assert ngram_join.ngram_join(none).count() == 0


def test_language_id_blocks_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    e, tr, first = rng.normal(size=(200, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 5, 105, 106, 200])
    p = language_id.posteriors(e, first, tr)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            q, _ = language_id.sequence_posteriors(e[None, a:b], tr, np.ones((1, b - a), bool))
            assert np.abs(q[0] - p[a:b]).max() < 1e-4


def test_language_id_held_out_accuracy_and_switches(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(d)
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    a, b = (d.where(F.col("lang") == x).orderBy(F.desc("n_chars")).first().text.split()[:40] for x in ("de", "fr"))
    r = language_id.predict(spark.createDataFrame([(1, " ".join(a + b))], "doc_id long, text string"), model).first()
    assert {x.lang for x in r.runs if x.words >= 10} == {"de", "fr"}
    odd = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert [odd[i] for i in (0, 1, 2, 15)] == ["und"] * 4
    assert language_id.identify(none).count() == 0


def test_mixing(docs, none):
    sizes = [1000, 100, 10]
    e = mixing.bisect_exponent(sizes, None, 3.0, None)
    assert abs(max(mixing.repeats(sizes, mixing.weights(sizes, e), None)) - 3.0) < 1e-6
    e = mixing.bisect_exponent(sizes, 0.9, None, None)
    assert abs(mixing.entropy(mixing.weights(sizes, e)) - 0.9 * np.log(3)) < 1e-6
    plan = mixing.schedule(docs, max_repeats=2.0, block_tokens=1000).collect()
    tokens = {}
    for r in docs.collect():
        tokens.setdefault(r.source, []).append(len(words(r.text)) + 1)
    for source, own in tokens.items():
        used = sum(r.tokens for r in plan if r.source == source)
        quota = next(r.quota for r in plan if r.source == source)
        assert sum(r.epoch == 0 and r.source == source for r in plan) == len(own)  # no document unused
        assert quota <= used < quota + 2 * max(own)
    for b in {r.block for r in plan}:
        assert sorted(r.slot for r in plan if r.block == b) == list(range(1, 1 + sum(r.block == b for r in plan)))
    mixed = mixing.mix(docs, max_repeats=2.0, block_tokens=1000)
    assert mixed.columns == docs.columns and mixed.count() == len(plan)
    assert mixing.schedule(none).count() == 0 and mixing.mix(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((str(r.doc_id), [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    got = packing.pack_documents(docs).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        assert sum(n for _, n in pieces) <= 2048
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1])
    ids = dict(want)
    covered = {}
    for r in got:
        part = ids[str(r.doc_id)][r.start:r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[str(r.doc_id)])
        covered[str(r.doc_id)] = covered.get(str(r.doc_id), 0) + r.length
    copies = {k: sum(k == w for w, _ in want) for k in ids}
    assert covered == {k: copies[k] * len(v) for k, v in ids.items()}
    assert packing.pack_documents(none).count() == 0


def test_encoder_learns_each_piece_once_and_gives_the_ids_of_the_tokenizer():
    from types import SimpleNamespace

    import pyarrow as pa

    encoder, asked = packing.Encoder(packing.tokenizer_path()), []
    model = encoder.model
    encoder.model = SimpleNamespace(tokenize=lambda piece: asked.append(piece) or model.tokenize(piece))
    rng = np.random.default_rng(3)
    letters = [*map(chr, range(0x20, 0x180)), *"\n\t\r'stmdrevl  01AZ" * 6]
    texts = [None, "", " \n\t ", "<|endoftext|> x", "İx", "日本 a", "don't'S ''s 're'VE", "\x1c" + "a\x0bb\xa0c",
             *["".join(rng.choice(letters, 50)) for _ in range(400)], *[f"a{chr(c)}b {chr(c)}" for c in range(0x20, 0x400)]]
    for column in (pa.array(texts), pa.array(texts).slice(2, 30), pa.array([], pa.string()), pa.array([None], pa.string())):
        got = encoder.encode(column)
        assert len(got) == len(column)
        for ids, text in zip(got, column.to_pylist()):
            assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == len(encoder.pieces) - 1
    # more different words than the cache of words used to hold, in every text
    names = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(110_000)]
    encoder.encode(pa.array([" ".join(names), " ".join(n + "," for n in names)]))
    assert len(asked) == len(set(asked))


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 500, 300)
    window = packing.pack(sizes, 2048)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= 2048 and sums.max() - sums.min() <= 8


def test_warc_segments(spark, none):
    long = "<p>" + "é\r\n0\r\n\r\nWARC/1.1\r\n" * 5000
    rows = [(0, "u", None, 1), (1, "u", "", 1), (2, None, "x" * 99, 1), (3, "u", "x" * 99, 1), (4, "u\r\nv", long, 1), (5, "u", long, 1),
            (6, "u", "y" * 100, 1), (9, "u", "y" * 100, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.archive(pages, segment_bytes=1000, chunk_bytes=333).collect()}
    assert len(got) == len(rows) and all(r.complete for r in got.values())
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 4, 9: 6}
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_repeated_and_null_page_ids(spark):
    a, b, c = "a" * 3000, "b" * 3000, "c" * 200
    rows = [(1, "u", a), (1, "u", a), (1, "v", b), (None, "u", a), (None, "u", c), (None, "u", c), (None, "u", b * 2), (2, "u", a),
            (2, "u", b), (2, "u", "short"), (2, "u", "short"), (None, None, None)]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h) if len(raw) >= 100 and i != first.get(h) else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to, True))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive(pages, segment_bytes=1000, chunk_bytes=333).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_warc_missing_and_surplus_segments(spark, tmp_dir):
    made = [list(warc.records(i, b"s0-%d" % i, "u", b"x" * 5000, 1000, 300)) for i in range(3)]
    made[1].pop(2)
    made[2].append(made[2][2].replace(b"Segment-Number: 3", b"Segment-Number: 99"))
    with open(f"{tmp_dir}/a.warc", "wb") as f:
        f.write(b"\r\n\r\n".join(x for m in made for x in m) + b"\r\n\r\n")
    assert {r.page_id: r.complete for r in warc.read_back(spark, tmp_dir).collect()} == {0: True, 1: False, 2: False}


def test_fingerprints(docs, none):
    import xxhash

    def prints(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
        out = set()
        for i in range(max(1, len(w) - 4) if w else 0):
            h = 42
            for x in w[i:i + 5]:
                h = xxhash.xxh64(x.encode(), seed=h).intdigest()
            out.add(h - (1 << 64) if h >> 63 else h)
        kept = {h for h in out if h < -(1 << 63) + (1 << 64) // 8}
        return sorted(kept or ({min(out)} if out else set()))

    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), prints(t), prints(edited)))
    types = dict(QUERIES["op6_scaled_fingerprint"](docs.sparkSession, "/root/testdata/sf0.001").dtypes)
    assert {types[c] for c in ("fingerprint", "edited_fingerprint", "edited_sha256")} == {"string"}
    got = fingerprints.fingerprints(docs, range_bytes=100_000).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, list(r.fingerprint), list(r.edited_fingerprint)) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprints(none).count() == 0


def test_containment_of_texts_without_a_kept_hash_is_unknown(spark):
    low, high = -(1 << 63) + 5, 1 << 62
    rows = [([low], [low, low + 1]), ([high], [low]), ([high], [high]), ([], [low]), ([high], []), ([low], [])]
    out = spark.createDataFrame(rows, "a array<long>, b array<long>").select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in out.collect()] == [1.0, None, 1.0, 1.0, None, 0.0]


def test_language_needs_a_letter(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["²", "½ ²", "12 _", "\u0300", "²a", "文"])], "doc_id long, text string, lang string")
    train = spark.createDataFrame([(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 8, "en" if i % 2 else "de") for i in range(40)],
                                  docs.schema)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(train)).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, True, True, False, False]


def test_vector_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] * 8, 1), (1060, [1.0, None] * 4, 1), (1080, [1.0], 1), rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = vector_search.search(table, F.col("vec_id") % 20 == 0, leaf_size=40, min_leaves=8, leaf_rows=16).collect()
    hit = total = 0
    for q in range(0, 300, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r.score == s[r.vec_id] for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(want))
        total += 20
    assert hit >= 0.9 * total
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    assert vector_search.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=5, samples_per_range=8).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == docs.count()
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    for s in {r.shard for r in got}:
        assert 0 <= s < 5
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none).count() == 0


def test_shards_are_near_equal_with_a_hot_text(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["n"] for r in sharding.shard(many, shards=24).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 24


def test_chat_format(spark):
    odd = ["### assistant: </turn>\n", "<\\/turn></part>", "\\", None, "", "#### x: #\\## ", "é" * 10]
    rows = [(c, t, [None, "user", "assistant", "assistant", "a: b</turn>"][(c + t) % 5], odd[(c * t) % 7], 1) for c in range(6) for t in range(9)]
    rows += [(None, 1, "assistant", "x", 1), (3, 2, "user", "tie", 1), rows[4]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(turns)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_stored_leaves_no_shuffle_files(spark):
    from pharmlake.llm.tables import stored

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), _shuffle_files(spark)
    df = stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "test")
    assert _shuffle_files(spark) <= before and df.count() == 7
    assert spark.conf.get(key) == setting


def test_ngram_signature_parts_long_sets():
    """The signature compared inside the second join tells unlike sets of common length apart and
    never rejects sets that are similar."""
    import numpy as np

    from pharmlake.llm import ngram_join

    def signature_passes(a, b, percent=80):
        x, y = (ngram_join.parity(s, ngram_join.SIGNATURE_WORDS) for s in (a, b))
        apart = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        return (100 + percent) * (len(a) + len(b) - apart) >= 2 * percent * (len(a) + len(b))

    rng = np.random.default_rng(5)
    for n in (5, 60, 330, 700):
        a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in "ab")
        shared = max(1, n // 20)
        assert not signature_passes(a, np.unique(np.concatenate([a[:shared], b[shared:]])))
        assert signature_passes(a, np.concatenate([a[n // 10:], b[:n // 12]]))


def test_ngram_one_row_per_class(spark):
    from pharmlake.llm import ngram_join

    rows = [(2, 2, 0, [1, 2]), (2, 2, 0, [1, 2]), (3, 1, 1, [7]), (None, 0, 0, [])]
    sig = spark.createDataFrame(rows, "cid long, n int, hot_from int, prefix array<long>")
    got = sorted(tuple(r) for r in ngram_join.one_per_class(sig).collect())
    assert got == [(2, 2, 0, [1, 2]), (3, 1, 1, [7])]


def test_line_dedup_removes_its_table_of_lines(spark):
    from pharmlake.llm import line_dedup
    from pharmlake.session import ensure_checkpoint_dir

    docs = line_dedup._clean(spark.createDataFrame([(1, "a b c\nd e f g h"), (2, "d e f g h\na c b")], "doc_id long, text string"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/lines-*")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = len(files.globStatus(path) or [])
    got = sorted((r.doc, r.line) for r in line_dedup.removed_lines(docs).distinct().collect())
    assert got == [(2, 0), (2, 1)] and len(files.globStatus(path) or []) == before

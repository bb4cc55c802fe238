"""Decontamination against a plain search of every window in every text."""

import hashlib
import random
import re

import pytest

from pharmlake.llm import decontamination

DOCS = "doc_id long, text string, n_words long, row string, items int, rest int"
ITEMS = "item_id long, text string, extra int"
PASSAGE = "The QUICK brown fox, jumps over thirteen lazy dogs near the muddy river bank at noon"
SHARED = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(items):
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            yield "" if item is None else str(item), w[i:i + n]


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item, x in windows(items):
            for i in range(len(w) - len(x) + 1):
                if w[i:i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    named.add(item)
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(11)
    vocabulary = SHARED.split() + ["supercalifragilistic", "supercalifragilistix", "ß", "x1", "7", "longwordof16byte", "longwordof16bytf"]
    texts = [" ".join(rng.choices(vocabulary[:5], k=rng.choice([3, 9, 10, 11, 40, 200]))) for _ in range(40)]
    texts += [None, "", " ,;\n", PASSAGE, PASSAGE.upper() + "!", "intro " + PASSAGE.replace(" ", " -- ") + " outro", SHARED,
              " ".join([SHARED] * 30), "a b a b a b a b a b a b a b a b", "the quick brown fox jumps over thirteen lazy dogs nearly",
              "word " * 5000 + SHARED, "supercalifragilistix ß x1 7", "supercalifragilistic ß x1 7", "longwordof16bytf", "alpha\x00beta"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, PASSAGE), (43, PASSAGE), (43, PASSAGE)]
    items = [(1, PASSAGE), (2, SHARED + " nu xi omikron"), (10, SHARED), (10, "a b a b a b a b a b a b"), (None, "x " + PASSAGE),
             (3, None), (4, "..."), (5, "supercalifragilistic ß x1"), (6, "7"), (7, "longwordof16byte"), (1, PASSAGE),
             (8, texts[3]), (9, texts[5])]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = fixture()
    return (spark.createDataFrame([(d, t, 1, "r", 2, 3) for d, t in docs], DOCS).repartition(3),
            spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS))


def test_against_brute_force(frames):
    docs, items = fixture()
    got = decontamination.digests(*frames)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
                                "items_sha256": "string", "contaminated": "boolean"}
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


@pytest.mark.parametrize("block_bytes,shard_bytes", [(200, 1 << 20), (60, 300), (1 << 20, 1)])
def test_blocks_and_shards(frames, block_bytes, shard_bytes):
    docs, items = fixture()
    out = decontamination.matches(*frames, block_bytes=block_bytes, shard_bytes=shard_bytes)
    got = sorted(((r.row.rest.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"]),
                   hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in out.collect()), key=repr)
    assert got == brute(docs, items)
    for r in out.collect():
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_removal_keeps_clean_documents_as_they_are(frames):
    docs, items = fixture()
    kept = decontamination.decontaminate(*frames)
    assert kept.columns == frames[0].columns
    dirty = {r[0] for r in brute(docs, items) if r[5]}
    want = sorted([(d, t, 1, "r", 2, 3) for d, t in docs if d not in dirty], key=repr)
    assert sorted(map(tuple, kept.collect()), key=repr) == want and len(want) > 3


def test_longest_matches(spark, frames):
    docs, items = fixture()
    want = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w)):
            best = (0, 0, None)
            for n in range(len(w) - i, 9, -1):
                x, places = w[i:i + n], []
                for d, t in docs:
                    dw = words(t)
                    places += [(-1 if d is None else d, j) for j in range(len(dw) - n + 1) if dw[j:j + n] == x]
                if places:
                    best = (n, len(places), min(places))
                    break
            key = ("" if item is None else str(item), i)
            if best[0] and (key not in want or best > want[key]):
                want[key] = best
    # items with one row each, so that a suffix has one text
    single = [k for k in want if k[0] not in ("10",)]
    got = {(r["item"], r.item_start): (r.length, r.places, (-1 if r.doc_id is None else r.doc_id, r.doc_start))
           for r in decontamination.longest_matches(*frames, block_bytes=150, shard_bytes=400).collect()}
    assert {k: got[k] for k in single} == {k: want[k] for k in single} and set(got) == set(want)


def test_empty_tables(spark, frames):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontamination.digests(no_docs, frames[1]).collect() == []
    rows = decontamination.digests(frames[0], no_items).collect()
    assert len(rows) == frames[0].count() and not any(r.contaminated for r in rows)
    assert {r.n_words for r in rows} == {len(words(t)) for _, t in fixture()[0]}
    assert decontamination.longest_matches(frames[0], no_items).collect() == []


def test_random_texts_over_few_words(spark):
    rng = random.Random(4)
    for _ in range(3):
        docs = [(i, " ".join(rng.choices("ab", k=rng.randrange(0, 60)))) for i in range(30)]
        items = [(i, " ".join(rng.choices("abc", k=rng.choice([1, 4, 8, 12, 30])))) for i in range(8)]
        got = decontamination.digests(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)

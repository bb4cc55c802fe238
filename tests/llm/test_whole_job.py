"""Cases that cuts in the operators and the pipeline used to leave out."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from pharmlake.llm import language_id  # noqa: E402
from pharmlake.llm.tables import stored  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Written and read back, as the stages get their rows."""
    return stored(spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA), "docs")


def test_line_dedup_compares_short_lines(spark):
    docs = table(spark, [
        (1, "Home\n\nAbout us\na b c d\nunten steht mehr", "s"), (2, "home\n\nus about\nd c b a e\nthree more words", "s"),
        (3, "整段没有空格的文字\na b c\nnew", "s"), (4, "整段没有空格的文字\na b d\nold", "s")])
    got = {r.doc_id: (r.text, r.n_chars) for r in P.dedup_lines(spark, docs, SF).collect()}
    assert got == {1: ("Home\n\nAbout us\na b c d\nunten steht mehr", 39), 2: ("\nthree more words", 17),
                   3: ("整段没有空格的文字\na b c\nnew", 19), 4: ("a b d\nold", 9)}


def test_dedup_documents_keeps_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = table(spark, [
        (1, a, "s"), (1, a, "r"), (1, a, "s"), (2, a + " end", "s"),  # repeated rows that name their component
        (3, b, "s"), (4, b + " end", "s"), (4, c, "s"),  # a near copy and a unique text under one doc_id
        (None, b + " tail", "s"), (None, d, "s"), (None, d, "s"), (None, d + " end", "s"),  # without doc_id
        (7, "", "s"), (7, "", "s"), (8, None, "s"), (None, None, "s")])
    got = sorted((str(r.doc_id), r.text or "", r.source) for r in P.dedup_documents(spark, docs, SF).collect())
    left = [x for x in got if x[1] in (d, d + " end")]
    assert len(left) == 1 and left[0][0] == "None"
    assert sorted(x for x in got if x not in left) == sorted([
        ("1", a, "r"), ("3", b, "s"), ("4", c, "s"), ("7", "", "s"), ("7", "", "s"), ("8", "", "s"), ("None", "", "s")])


def test_language_stage_keeps_a_text_in_three_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [" ".join(d.where(f"lang = '{x}'").orderBy(F.desc("n_chars"), "doc_id").first().text.split()[:60])
             for x in ("de", "en", "fr")]
    extra = table(spark, [(-1, " ".join(parts), "s"), (-2, "12 34 !!", "s"), (-3, None, "s")])
    docs = stored(d.select(*P.COLUMNS).unionByName(extra), "docs")
    r = language_id.predict(extra, language_id.fit(docs)).where("doc_id = -1").first()
    assert r.score < 0.5 and {x.lang for x in r.runs if x.words >= 20} == {"de", "en", "fr"}
    kept = {r.doc_id for r in P.identify_language(spark, docs, SF).select("doc_id").collect()}
    assert -1 in kept and not {-2, -3} & kept


def test_whole_pipeline(spark, tmp_dir):
    """run() over a small table: what each stage has to drop or keep is known beforehand."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    a = " ".join(f"the word number {i} of this english text" for i in range(40))
    extra = spark.createDataFrame([(9001, a, "en", "new", 1), (9002, a + " end", "en", "new", 1), (9003, "12 34 !!", "en", "new", 1),
                                   (9004, None, None, None, None), (9005, "", "en", "new", 0)], SCHEMA)
    given.unionByName(extra).repartition(2).write.parquet(f"{tmp_dir}/documents.parquet")
    out = P.run(spark, tmp_dir).collect()
    kept = {r.doc_id for r in out}
    assert 9001 in kept and not {9002, 9003, 9004, 9005} & kept
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():  # gapless and within the window
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_dir}/none/documents.parquet")
    assert P.run(spark, f"{tmp_dir}/none").collect() == []

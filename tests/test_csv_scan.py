"""CSV files with differing headers are one scan, in the order of their rows."""

import csv
import gzip

from pharmlake import api
from pharmlake.sources import readers as RD

SCHEMA = "smiles string, name string, year int"


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_many_headers_one_scan(spark, tmp_dir):
    heads = [["smiles", "name", "year"], ["year", "smiles"], ["x", " NAME ", "", "Smiles", "smiles"]]
    names = ["a b.csv", "c%20d.csv", "e+ü.csv.gz"]
    for i, (head, name) in enumerate(zip(heads, names)):
        with (gzip.open if name.endswith("gz") else open)(f"{tmp_dir}/{name}", "wt", encoding="utf-8", newline="") as f:
            f.write("\ufeff\n" if i == 1 else "")
            w = csv.writer(f)
            w.writerow(head)
            w.writerows([[f"{h.strip().lower()}{i}{r}" if h.strip().lower() != "year" else f"200{r}" for h in head]
                         for r in range(3)])
            f.write("only\n")  # a short row
    df = RD.read_csv(spark, [f"{tmp_dir}/{n}" for n in names], SCHEMA)
    want = [(f"smiles0{r}", f"name0{r}", 2000 + r) for r in range(3)] + [("only", None, None)]
    want += [(f"smiles1{r}", None, 2000 + r) for r in range(3)] + [(None, None, None)]
    want += [(f"smiles2{r}", f"name2{r}", None) for r in range(3)] + [(None, None, None)]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert _scans(df) == 1
    both, bad = RD.read_dir_with_provenance(spark, tmp_dir, "*.csv*", types="year int")
    assert not bad and _scans(both) == 1
    assert both.columns == ["smiles", "name", "year", "x", "_c2", "source", "file_rank"]
    assert {(r.source, r.file_rank) for r in both.collect()} == {("a b", 0), ("c%20d", 1), ("e+ü.csv", 2)}
    assert both.where("smiles = 'smiles21'").select("name", "year", "x", "_c2").first() == ("name21", None, "x21", "21")


def test_quoted_line_ends_in_header_and_rows(spark, tmp_dir):
    with open(f"{tmp_dir}/m.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["two\nlines", "name"], ["a\nb", 'say "x"'], ["c", "d"]])
    got = RD.read_csv(spark, f"{tmp_dir}/m.csv", "`two\nlines` string, name string", multi_line=True).collect()
    assert sorted(map(tuple, got)) == [("a\nb", 'say "x"'), ("c", "d")]


def test_empty_files_and_absent_columns(spark, tmp_dir):
    for name, text in (("a.csv", ""), ("b.csv", "other\n1\n"), ("c.csv", "smiles\n")):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    assert RD.read_csv(spark, f"{tmp_dir}/a.csv", SCHEMA).collect() == []
    got = RD.read_csv(spark, [f"{tmp_dir}/{x}.csv" for x in "abc"], SCHEMA)
    assert [tuple(r) for r in got.collect()] == [(None, None, None)]
    empty = RD.read_csv(spark, [], SCHEMA, order_col="at")
    assert empty.columns == ["smiles", "name", "year", "at"] and empty.count() == 0


def test_load_order_does_not_depend_on_splits(spark, tmp_dir):
    sizes = {"s/b": 400, "s/a": 3, "t/c": 50}
    import os

    for path, n in sizes.items():
        os.makedirs(os.path.dirname(f"{tmp_dir}/{path}"), exist_ok=True)
        with open(f"{tmp_dir}/{path}.csv", "w") as f:
            f.write("name,smiles,status\n" + "".join(f"{path}{i},C{i},approved\n" for i in range(n)))
    want = [f"t/c{i}" for i in range(50)] + [f"s/a{i}" for i in range(3)] + [f"s/b{i}" for i in range(400)]
    paths = {"t": [f"{tmp_dir}/t/c.csv"], "s": [f"{tmp_dir}/s/b.csv", f"{tmp_dir}/s/a.csv"]}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for most in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = api.load_sources(spark, paths, "smiles string, name string, status string")
            assert [r.name for r in got.orderBy("row_id").collect()] == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

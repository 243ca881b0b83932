"""Files cut into small blocks: rows in file order, and records whose cells hold line breaks."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from folioscope.plans import jobs
from folioscope.sources import tables as tb
from folioscope.sources.blocks import first_rows, quoted_records, row_place
from folioscope.sources.dump import scan_dump


@pytest.fixture
def small_blocks(spark):
    """Sets how many bytes a block has."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write_diffs(folder, seed, rows, files=2, end="\n"):
    r = random.Random(seed)
    pieces = ["word", "a,b", 'say "x"', "\n", "\n\n", "é", '"', " ", "null ", "long" * 40]
    for k in range(files):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        for n in range(rows):
            cells = ["c0", "c1", f"2001-01-{n % 28 + 1:02d}", "c3", "".join(r.choices(pieces, k=2)), "".join(r.choices(pieces, k=r.randrange(9))).strip(" ")]
            writer.writerow(cells)
            if r.random() < 0.1:
                out.write(end)
        (folder / f"part{k}.csv").write_text(out.getvalue(), encoding="utf-8", newline="")


def whole_files(spark, folder):
    schema = ", ".join(f"{c} STRING" for c in tb.DIFF_COLUMNS)
    rows = spark.read.schema(schema).options(escape='"', multiLine=True).csv(folder)
    words = F.when(F.col("words").isin(*tb.MISSING_WORDS), "").otherwise(F.coalesce("words", F.lit("")))
    return sorted(map(tuple, rows.select("time", words).collect()))


@pytest.mark.parametrize("size", [40, 300, 5_000, 10_000_000])
def test_diffs_with_line_breaks_are_read_in_blocks(spark, small_blocks, tmp_path, size):
    write_diffs(tmp_path, size, 120 if size == 40 else 400)
    want = whole_files(spark, str(tmp_path))
    small_blocks(size)
    got = tb.scan_diffs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
    if size < 10_000_000:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5


def test_one_record_over_many_blocks(spark, small_blocks, tmp_path):
    text = 'a,b,2001-01-01,c,d,"' + "one\ntwo ""\n" * 200 + '"\na,b,2001-01-02,c,d,end'
    (tmp_path / "x.csv").write_text(text)
    small_blocks(50)
    rows = [tuple(r) for r in tb.scan_diffs(spark, str(tmp_path)).orderBy("time").collect()]
    assert rows == [("2001-01-01", "one\ntwo ""\n" * 200), ("2001-01-02", "end")]
    (tmp_path / "x.csv").write_text('1,"open\nto the end\n\nof the file')
    assert [r["record"] for r in quoted_records(spark, str(tmp_path)).collect()] == ['1,"open\nto the end\n\nof the file']


def test_carriage_returns(spark, small_blocks, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'a,b,2001-01-01,c,d,"x\r\ny"\r\n\r\na,b,2001-01-02,c,d,z\r\n')
    small_blocks(10)
    assert sorted(map(tuple, tb.scan_diffs(spark, str(tmp_path)).collect())) == [("2001-01-01", "x\ny"), ("2001-01-02", "z")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert tb.scan_diffs(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 100, 399, 400, 1000])
def test_first_rows_in_file_order(spark, small_blocks, tmp_path, n):
    lines = [f"line {(k * 271) % 400:03d} " + "x" * (k % 50) for k in range(400)]
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("\n".join(lines[:100] if k == 0 else lines[100:120] if k == 1 else lines[120:]))
    small_blocks(700)
    rows = spark.read.text(str(tmp_path)).withColumn("place", row_place())
    kept = rows.filter(~F.contains("value", F.lit("3 x"))).select("value", "place")
    got = [r["value"] for r in first_rows(kept, n).collect()]
    want = [x for x in lines if "3 x" not in x][:n]
    assert sorted(got) == sorted(want)


def test_dumps_are_limited_in_their_order(spark, small_blocks, tmp_path):
    page = "<page><title>T{0}</title><ns>{1}</ns><id>{0}</id><revision><id>1</id><timestamp>2005-03-01T01:02:03Z</timestamp><text>body {0}</text></revision></page>\n"
    ids = [(k * 37) % 101 for k in range(101)]
    (tmp_path / "dump.xml").write_text("<mediawiki>" + "".join(page.format(k, k % 5 == 0) for k in ids).replace("True", "1").replace("False", "0") + "</mediawiki>")
    small_blocks(900)
    dump = str(tmp_path / "dump.xml")
    kept = [k for k in ids if k % 5]
    assert scan_dump(spark, dump, place=True).rdd.getNumPartitions() > 3
    for n in (1, 17, 40):
        stored = jobs.load_articles(spark, dump, str(tmp_path / f"article{n}"), limit=n)
        assert sorted(r["aid"] for r in stored.collect()) == sorted(kept[:n]) and "place" not in stored.columns
    by_id = jobs.load_articles(spark, dump, str(tmp_path / "by-id"), limit=5, by_id=True)
    assert sorted(r["aid"] for r in by_id.collect()) == [1, 2, 3, 4, 6]
    jobs.load_documents(spark, dump, str(tmp_path / "docs"), limit=9)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "docs/document")).collect()) == sorted(ids[:9])

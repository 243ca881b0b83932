import bz2
import datetime as dt
import hashlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioscope.operators import articles as art
from folioscope.plans import jobs
from folioscope.sources import sinks
from folioscope.sources.dump import scan_dump, scan_dump_raw

PAGE = """  <page>
    <title>{title}</title>
    <ns>{ns}</ns>
    <id>{id}</id>{redirect}
    <revision>
      <id>{rid}</id>
      <parentid>7</parentid>
      <timestamp>2005-03-0{day}T01:02:03Z</timestamp>
      <contributor><username>Some &amp; one</username><id>99</id></contributor>
      <text xml:space="preserve"{text}
    </revision>
  </page>
"""
HEAD = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" version="0.10" xml:lang="en">\n  <siteinfo><sitename>S</sitename></siteinfo>\n'

PAGES = [
    (1, 0, "Start", None, "  \n[[Chain 1]] &amp;nbsp;[[#sec]] [[File:a|x [[y]] z]] &lt;ref&gt;n&lt;/ref&gt; [[end|E]]  \n"),
    (2, 0, "End", None, "long&amp;amp;er body {{t}} &quot;quoted&quot;"),
    (3, 0, "Empty", None, None),
    (4, 1, "Talk:Start", None, "[[End]] chatter"),
    (5, 0, "Lower", None, "#redirect [[End]]"),
    (6, 0, "Upper", None, "#REDIRECT [[End]]"),
    (7, 0, "Mixed", None, "#Redirect [[End]]"),
    (10, 0, "Chain 1", "Chain 2", "#REDIRECT [[Chain 2]]"),
    (11, 0, "Chain 2", "Chain 3", "#REDIRECT [[Chain 3]]"),
    (12, 0, "Chain 3", "Chain 4", "#REDIRECT [[Chain 4]]"),
    (13, 0, "Chain 4", "End", "#REDIRECT [[End]]"),
    (14, 0, "Loop A", "Loop B", "#REDIRECT [[Loop B]]"),
    (15, 0, "Loop B", "Loop A", "#REDIRECT [[Loop A]]"),
    (16, 0, "Self", "Self", "#REDIRECT [[Self]]"),
    (17, 0, "Out", "User:X", "#REDIRECT [[User:X]]"),
] + [(20 + n, 0, t + "x y", None, "body") for n, t in enumerate(art.SKIPPED_TITLES)]


@pytest.fixture(scope="session")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "dump.xml"
    body = "".join(
        PAGE.format(
            id=i, ns=ns, title=title, rid=i + 100, day=1 + i % 9,
            redirect="" if target is None else f'\n    <redirect title="{target}" />',
            text=" />" if text is None else f">{text}</text>",
        )
        for i, ns, title, target, text in PAGES
    )
    path.write_text(HEAD + body + "</mediawiki>\n", encoding="utf-8")
    return str(path)


def test_scan_gives_every_page(spark, dump):
    rows = {r["id"]: r for r in scan_dump(spark, dump).collect()}
    assert len(rows) == len(PAGES)
    for i, ns, title, target, text in PAGES:
        row = rows[i]
        assert (row["ns"], row["title"], row["redirect"], row["rid"]) == (ns, title, target, i + 100)
        assert (row["text"] is None) == (text is None)
    assert rows[1]["date"] == dt.datetime(2005, 3, 2, 1, 2, 3)
    assert rows[1]["text"] == "  \n[[Chain 1]] &nbsp;[[#sec]] [[File:a|x [[y]] z]] <ref>n</ref> [[end|E]]  \n"


def test_one_file_is_read_by_many_tasks(spark, dump):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = scan_dump(spark, dump)
        assert split.rdd.getNumPartitions() > 3
        whole = scan_dump(spark, dump, many_files=True)
        assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_packed_file_is_split_at_its_blocks(spark, dump, tmp_path):
    body = "".join(
        PAGE.format(id=n, ns=0, title=f"T{n}", rid=n, day=1, redirect="", text=f">{hashlib.sha512(b'%d' % n).hexdigest() * 2}é</text>")
        for n in range(3000)
    )
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress((HEAD + body + "</mediawiki>\n").encode(), 1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = scan_dump(spark, str(path))
        assert split.rdd.getNumPartitions() > 3
        got = {r["id"]: r["text"] for r in split.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {n: hashlib.sha512(b"%d" % n).hexdigest() * 2 + "é" for n in range(3000)}


def test_namespace_is_dropped_before_parsing(spark, dump):
    for many in (False, True):
        assert {r["ns"] for r in scan_dump(spark, dump, many_files=many, namespace=0).select("ns").collect()} == {0}


def test_bad_records_are_counted(spark, dump, tmp_path):
    bad = tmp_path / "bad.xml"
    bad.write_text(open(dump, encoding="utf-8").read().replace("<id>4</id>", "<id>four</id>"), encoding="utf-8")
    counts = art.load_counts(scan_dump(spark, str(bad), bad="keep")).first()
    assert (counts["stored"], counts["failed"]) == (len(PAGES) - 1, 1)
    assert scan_dump(spark, str(bad), bad="drop").count() == len(PAGES) - 1


def test_raw_scan_keeps_articles_with_blanks(spark, dump, tmp_path):
    path = tmp_path / "nbsp.xml"
    path.write_text(open(dump, encoding="utf-8").read().replace("long", "lo\u00a0ng"), encoding="utf-8")
    rows = {r["id"]: r for r in scan_dump_raw(spark, str(path)).collect()}
    assert 10 not in rows and 4 not in rows and 5 in rows
    assert rows[2]["text"].startswith("lo ng&amp;er")


def test_filters(spark, dump):
    pages = scan_dump(spark, dump)
    ids = lambda df: {r["id"] for r in df.select("id").collect()}
    everything = {p[0] for p in PAGES}
    skipped = {20 + n for n in range(len(art.SKIPPED_TITLES))}
    assert ids(art.with_article_title(pages)) == everything - skipped - {4}
    assert ids(art.with_body(pages)) == everything - {3}
    redirect_text = {5, 6, 10, 11, 12, 13, 14, 15, 16, 17}
    assert ids(art.without_redirect_text(art.with_body(pages))) == everything - redirect_text - {3}
    assert ids(art.without_redirect_element(pages)) == everything - {10, 11, 12, 13, 14, 15, 16, 17}
    counts = {r["type"]: r["pages"] for r in art.kind_counts(pages).collect()}
    assert counts == {0: len(PAGES) - 9, 1: 8, 2: 1, -1: len(PAGES)}


def test_articles_are_loaded_reset_and_limited(spark, dump, tmp_path):
    out = str(tmp_path / "article")
    stored = jobs.load_articles(spark, dump, out)
    rows = {r["aid"]: r for r in stored.collect()}
    assert 3 in rows and rows[3]["text"] == "" and rows[3]["wiki"] == ""
    assert 5 not in rows and 7 in rows and 4 not in rows
    assert rows[2]["text"] == "long amp er body t quoted"
    with pytest.raises(AnalysisException):
        jobs.load_articles(spark, dump, out)
    assert jobs.load_articles(spark, dump, out, reset=True, limit=2).count() == 2
    raw = jobs.load_articles(spark, dump, str(tmp_path / "raw"), raw=True)
    assert {r["aid"] for r in raw.collect()} == {1, 2, 3, 5, 6, 7} | {20 + n for n in range(len(art.SKIPPED_TITLES))}


def test_documents_and_features(spark, dump, tmp_path):
    out = str(tmp_path / "docs")
    jobs.load_documents(spark, dump, out)
    docs = {r["id"]: r for r in spark.read.parquet(f"{out}/document").collect()}
    assert set(docs) == {1, 2, 7}
    assert docs[2]["body"] == 'long&er body {{t}} "quoted"'
    assert docs[1]["body"].startswith("  \n[[Chain 1]]  [[#sec]]")
    features = spark.read.parquet(f"{out}/feature")
    assert sorted((r["type"], r["value"]) for r in features.filter("id = 2").collect()) == [
        ("body", "body"), ("body", "long"), ("body", "quoted"),
    ]
    more = spark.createDataFrame([(50, "More words", "more more")], "id BIGINT, title STRING, body STRING")
    sinks.insert_documents(more, out)
    added = spark.read.parquet(f"{out}/feature").filter("id = 50").select("type", "value").collect()
    assert sorted(map(tuple, added)) == [("body", "more"), ("body", "more"), ("title", "more"), ("title", "words")]
    gone = spark.createDataFrame([(1,), (99,)], "id BIGINT")
    left = art.delete_by_id(spark.read.parquet(f"{out}/document"), gone)
    assert {r["id"] for r in left.collect()} == {2, 7, 50}


def test_lookups(spark, dump, tmp_path):
    docs = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "B", "c")], "id BIGINT, title STRING, body STRING")
    keys = spark.createDataFrame([(1,), (9,)], "id BIGINT")
    assert sorted(map(tuple, art.fetch(keys, docs, "title", "body").collect())) == [(1, "A", "a"), (9, None, None)]
    titles = spark.createDataFrame([("B",), ("Z",)], "title STRING")
    assert sorted(map(tuple, art.link_by_title(titles, docs).collect())) == [("B", 2), ("Z", None)]


def test_graph_tables(spark, dump, tmp_path):
    tables = jobs.build_graph(spark, dump, str(tmp_path / "graph"))
    rows = lambda name, *cols: sorted(map(tuple, tables[name].select(*cols).collect()))
    page = {r["id"]: r for r in tables["page"].collect()}
    assert set(page) == {p[0] for p in PAGES} - {4}
    text = PAGES[0][4].replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    assert page[1]["length"] == len(text) and page[3]["length"] == 0 and page[10]["type"] == 1
    decoded = text.replace("&nbsp;", " ")
    expected = [
        ("Start", "Chain 1", decoded.index("[[Chain")), ("Start", "End", decoded.index("[[end")),
        ("Start", "File:a", decoded.index("[[File")),
    ]
    links = tables["title_link"].filter("src = 'Start'")
    assert sorted(map(tuple, links.select("src", "dst", "pos").collect())) == expected
    assert all(r["frac"] == r["pos"] / len(text) for r in links.collect())
    assert rows("redirect", "src", "dst") == sorted((p[2], p[3]) for p in PAGES if p[3])
    assert rows("id_redirect", "src", "dst") == [(10, 11), (11, 12), (12, 13), (13, 2), (14, 15), (15, 14), (16, 16)]
    assert rows("final_redirect", "src", "dst") == [(10, 2), (11, 2), (12, 2), (13, 2)]
    final = set(rows("final_link", "src", "dst0", "dst"))
    assert (1, 10, 2) in final and (1, 2, 2) in final and len([f for f in final if f[0] == 1]) == 2


def test_graph_limit_counts_all_pages(spark, dump, tmp_path):
    tables = jobs.build_graph(spark, dump, str(tmp_path / "graph"), limit=4)
    assert {r["id"] for r in tables["page"].collect()} == {1, 2, 3}


def test_page_rows_use_a_stored_length(spark, dump):
    pages = scan_dump(spark, dump)
    with_length = pages.withColumn("length", art.text_length(pages))
    plan = art.page_rows(with_length.drop("text"))
    assert plan.agg(F.sum("length")).first()[0] == art.page_rows(pages).agg(F.sum("length")).first()[0]


def flawed(spark, folder):
    from folioscope.sources.dump import page_xml

    rows = [(1, 0, "One", None, 11, None, "a [[Two]]"), (2, 0, "Two", None, 12, None, "b"), (3, 0, "Three", None, 13, None, "c")]
    pages = spark.createDataFrame(rows, "id long, ns int, title string, redirect string, rid long, date timestamp, text string")
    pages = pages.withColumn("date", F.lit("2020-01-01").cast("timestamp"))
    lines = page_xml(pages, F.when(F.col("id") == 2, F.lit("<id>x")).otherwise(F.lit("<id>")))
    lines.select(F.regexp_replace("value", "^<page>(<title>Three)", '<page v="1">$1')).write.text(folder)
    return folder


def test_unreadable_pages_are_not_lost(spark, tmp_path):
    dump = flawed(spark, str(tmp_path / "dump"))
    assert sorted(r.id for r in scan_dump(spark, dump, bad="drop").collect()) == [1, 3]
    with pytest.raises(Exception, match="could not be read"):
        scan_dump(spark, dump).collect()
    jobs.load_articles(spark, dump, str(tmp_path / "article"), rejects=str(tmp_path / "rejects"))
    assert tuple(jobs.load_result(spark, str(tmp_path / "article"), str(tmp_path / "rejects")).first()) == (2, 1)
    assert "<title>Two" in spark.read.parquet(str(tmp_path / "rejects")).first()["record"]


def test_delete_takes_features_along(spark, tmp_path):
    from folioscope.sources import sinks

    docs = spark.createDataFrame([(1, "Alpha", "words here"), (2, "Beta", "other words")], "id long, title string, body string")
    sinks.write_documents(docs, str(tmp_path / "stored"))
    jobs.delete_documents(spark, str(tmp_path / "stored"), spark.createDataFrame([(1,)], "id long"), str(tmp_path / "left"))
    for name in ("document", "feature"):
        assert {r.id for r in spark.read.parquet(str(tmp_path / "left" / name)).collect()} == {2}

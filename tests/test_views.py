import json

from folioscope.operators import history as hist
from folioscope.sources import tables as tb
from folioscope.streaming import views as st

MESSAGES = [
    ("https://en.wikipedia.org/wiki/Cat", 1000.0), ("http://de.wikipedia.org/wiki/C%2B%2B+x", 3000.5),
    ("https://en.wikipedia.org/wiki/Cat#Top", 2000.0), ("https://en.wikipedia.org/wiki/#1#x", 4000.0),
    ("https://www.wikipedia.org/wiki/No", 5000.0), ("https://en.wikipedia.org/w/index.php", 6000.0),
    ("https://en.wikipedia.org.evil.net/wiki/x", 6500.0), ("https://enxwikipedia.org/wiki/x", 6600.0),
    ("https://en.wikipedia.org/wiki/Cat", 7000.0), ("ftp://en.wikipedia.org/wiki/x", 8000.0),
]
VIEWS = [
    ("en", 1000.0, "Cat"), ("de", 3000.5, "C%2B%2B+x"), ("en", 2000.0, "Cat#Top"), ("en", 4000.0, ""), ("en", 7000.0, "Cat"),
]


def put(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"url": u, "timestamp": t}) + "\n" for u, t in messages))


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "timestamp", "title").collect())


def test_views_of_messages(spark, tmp_path):
    put(tmp_path / "in", "a.json", MESSAGES)
    messages = tb.scan_view_events(spark, str(tmp_path / "in"))
    assert rows(hist.view_rows(messages)) == sorted(VIEWS)
    cut = rows(hist.view_rows(messages, strip_fragment=True))
    assert ("en", 2000.0, "Cat") in cut and ("en", 2000.0, "Cat#Top") not in cut


def test_reports(spark):
    views = spark.createDataFrame(VIEWS, "lang STRING, timestamp DOUBLE, title STRING")
    shown = [tuple(r) for r in hist.recent_views(views, n=2).collect()]
    assert shown == [
        ("1970-01-01 05:00", "https://en.wikipedia.org/wiki/Cat", "Cat"), ("1970-01-01 05:00", "https://en.wikipedia.org/wiki/", ""),
    ]
    assert hist.recent_views(views.filter("lang = 'de'")).first()["title"] == "C+++x"
    assert [r["title"] for r in hist.seen_history(views).collect()] == ["", "C%2B%2B+x", "Cat#Top", "Cat"]


def test_stream_stores_each_message_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "view"), str(tmp_path / "state")
    put(source, "a.json", MESSAGES[:4])
    run = lambda: st.stream_views(tb.scan_view_events(spark, str(source), stream=True), out, state, once=True)
    run().awaitTermination()
    put(source, "b.json", MESSAGES[4:])
    for _ in range(2):
        run().awaitTermination()
    assert rows(spark.read.parquet(out)) == sorted(VIEWS)


def test_recent_table_follows_the_stream(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "recent"), str(tmp_path / "state")
    for n, message in enumerate(MESSAGES):
        put(source, f"{n}.json", [message])
        if n in (3, 5, 9):
            messages = tb.scan_view_events(spark, str(source), stream=True)
            st.stream_recent_views(messages, out, state, n=3, once=True).awaitTermination()
    assert rows(st.read_recent(spark, out)) == sorted(sorted(VIEWS, key=lambda r: -r[1])[:3])


def test_old_batches_go_and_a_batch_can_run_again(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "recent"), tmp_path / "state"
    for n in range(5):
        put(source, f"{n}.json", [(f"https://en.wikipedia.org/wiki/P{n}", 1000.0 * n)])
        messages = tb.scan_view_events(spark, str(source), stream=True)
        st.stream_recent_views(messages, out, str(state), n=3, once=True).awaitTermination()
    assert st.stored_batches(spark, out) == [3, 4]
    want = [("en", 1000.0 * n, f"P{n}") for n in (2, 3, 4)]
    assert rows(st.read_recent(spark, out)) == want
    # as if the last batch had failed before it was committed
    for name in ("4", ".4.crc"):
        (state / "commits" / name).unlink()
    st.stream_recent_views(tb.scan_view_events(spark, str(source), stream=True), out, str(state), n=3, once=True).awaitTermination()
    assert st.stored_batches(spark, out) == [3, 4] and rows(st.read_recent(spark, out)) == want
    # a table that was not finished does not count
    (tmp_path / "recent" / "batch=5").mkdir()
    assert rows(st.read_recent(spark, out)) == want

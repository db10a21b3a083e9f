import hashlib

from pyspark.sql import functions as F

from tabforge.llm import warc

BIG = "<p>" + "x" * 1200
TORN = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "é" * 600


def brute(rows):
    raw = {i: (h or "").encode() for i, _, h in rows}
    top = {}
    for i, b in raw.items():
        if len(b) >= 1000:
            top[b] = max(top.get(b, i), i)
    return {(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if top.get(b, i) != i else "response", top[b] if top.get(b, i) != i else None) for i, b in raw.items()}


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h.example/{i}?q#f", t) for i, t in enumerate([BIG, None, "", "small", "small", BIG, TORN, BIG, TORN, "end\r\n\r\n", "日本" * 400, "WARC/1.1\r\n\r\n"])]
    rows += [(40, None, "x"), (41, "not a url\r\nEvil: 1", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    out = warc.round_trip(df.withColumn("value", F.lit(1)), f"file://{tmp_path}/a")
    assert set(map(tuple, out.collect())) == brute(rows)
    nested = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/a"))
    r = nested.filter("response.uri = 'http://h.example/3?q#f'").head()
    assert r.response.payload == "small" and r.requests[0].block.startswith("GET /3?q HTTP/1.1\r\nHost: h.example\r\n") and len(r.metadata) == 1
    assert nested.filter("NOT response.complete").count() == 0


def test_repeats_nulls_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", BIG), (1, "u", BIG), (None, "v", "z")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.record_type) for r in warc.round_trip(df, f"file://{tmp_path}/b").collect())
    assert {g[0] for g in got} == {0, 1} and all(t == "response" for _, t in got)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/c").count() == 0


def test_links_named_by_the_capture(spark, tmp_path):
    block = "HTTP/1.1 200 OK\r\n\r\nhi"
    rec = lambda t, i, more, b: f"WARC/1.1\r\nWARC-Type: {t}\r\nWARC-Record-ID: <{i}>\r\n{more}Content-Length: {len(b)}\r\n\r\n{b}\r\n\r\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.warc").write_bytes((rec("warcinfo", "w", "", "") + rec("request", "q", "", "GET /") + rec("response", "r", "WARC-Concurrent-To: <q>\r\nWARC-Concurrent-To: <m>\r\n", block) + rec("metadata", "m", "", "page-id: 5") + rec("request", "lost", "", "GET /l")).encode())
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/d")).collect()}
    assert got["<r>"].response.payload == "hi" and got["<r>"].requests[0].record_id == "<q>" and got["<r>"].metadata[0].record_id == "<m>"
    assert got["<lost>"].response is None

"""Readers on small files, and the streaming forms on a folder of them."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import feeds, files
from tessera.streaming import ingest


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


def test_rss_atom_and_news_sitemap(spark, put):
    rss = put("a.xml", """<rss><channel><item><title>Flood &amp; rain</title><link>http://x/1</link><guid>g1</guid><pubDate>Wed, 21 Aug 2024 10:00:00 +0600</pubDate><description>&lt;p&gt;Water  rises&lt;/p&gt;</description></item>
<item><title>Old</title><link>http://x/2</link><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item><item><title></title><link>http://x/3</link></item></channel></rss>""")
    rows = feeds.rss(spark, rss)
    now = F.to_timestamp(F.lit("2024-08-22 00:00:00"))
    got = feeds.recent(rows, now).select("id", "title", "link", F.unix_timestamp("published").alias("t"), "summary").collect()
    assert [tuple(r) for r in got] == [("g1", "Flood & rain", "http://x/1", 1724212800, "Water rises")]
    atom = put("b.xml", """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>Storm</title><link rel="self" href="http://s"/><link rel="alternate" href="http://y/1"/><updated>2024-08-21T10:00:00Z</updated><summary>Wind</summary></entry></feed>""")
    assert [tuple(r) for r in feeds.atom(spark, atom).select("id", "title", "link", "summary").collect()] == [("e1", "Storm", "http://y/1", "Wind")]
    sm = put("c.xml", """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>http://z/1</loc><news:news><news:publication_date>2024-08-21</news:publication_date><news:title>Quake</news:title></news:news></url><url><loc>http://z/2</loc><lastmod>2024-08-20</lastmod></url></urlset>""")
    assert [tuple(r) for r in feeds.news_sitemap(spark, sm).select("id", "title").collect()] == [("http://z/1", "Quake")]
    assert sorted(r["url"] for r in feeds.sitemap(spark, sm).collect()) == ["http://z/1", "http://z/2"]


def test_dated_addresses(spark):
    assert feeds.expanded("http://x/{date}/s.xml", 1724270400.0 - 3600) == "http://x/2024-08-22/s.xml"
    assert [r["url"] for r in feeds.addresses(spark, "http://x/{date}", "2024-02-28", "2024-03-01").collect()] == ["http://x/2024-02-28", "http://x/2024-02-29", "http://x/2024-03-01"]


def test_alerts_and_reports(spark, put):
    feature = lambda kind, x, y, country: {"geometry": {"coordinates": [x, y]}, "properties": {"eventtype": kind, "eventid": "7", "name": "N", "alertlevel": "Red", "fromdate": "2024-08-21", "country": country, "url": {"report": "http://r"}}}
    path = put("g.json", json.dumps({"features": [feature("FL", 90.0, 23.0, "X"), feature("XX", 90.0, 23.0, "X"), feature("TC", 10.0, 50.0, "France"), feature("TC", 10.0, 50.0, "Bangladesh, India")]}))
    assert sorted((r["external_id"], r["event_type"], r["severity"]) for r in files.alerts(spark, path).collect()) == [("FL7", "flood", "severe"), ("TC7", "cyclone", "severe")]
    path = put("r.json", json.dumps({"data": [{"id": "1", "fields": {"title": "T", "body": "<b>B</b>", "disaster_type": [{"name": "Flood"}], "date": {"created": "2024-08-21"}}}, {"id": "2", "fields": {"title": "no date"}}]}))
    assert [(r["id"], r["text"], r["kinds"]) for r in files.reports_api(spark, path).collect()] == [("1", "B", ["flood"])]


def test_tables_and_lines(spark, put, tmp_path):
    path = put("t.csv", "Title,URL,Published,Publisher,Severity\nA long title,http://x/1,2024-08-21,P,\nShrt,http://x/2,2024-08-21,P,\nA long title,ftp://x,2024-08-21,P,\nA long title,http://x/3,soon,P,\nA long title,http://x/4,2024-08-21,,\nA long title,http://x/5,2024-08-21,P,awful\nAnother title,http://x/1,2024-08-22,P,severe\n,,,,\n")
    got = {(r["title"], r["url"]): r["message"] for r in files.imported(spark, path).collect()}
    assert got[("A long title", "http://x/1")] is None and sum(m is not None for m in got.values()) == 6 and len(got) == 7
    with pytest.raises(ValueError, match="publisher"):
        files.imported(spark, put("u.csv", "title,url,published\n"))
    good, bad = files.json_lines(spark, put("l.jsonl", '{"a": 1}\n\nnot json\n{"a": 2}\n'), "a long")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["value"] for r in bad.collect()] == ["not json"]
    path = put("m.tsv", "a\tb\tc\t1\tSite.com\thttp://s/1\tx\na\tb\tc\t2\tSite.com\thttp://s/2\tx\na\tb\tc\t1\tSite.com\thttp://s/1\tx\nshort\n")
    assert [tuple(r) for r in files.mentions(spark, path).collect()] == [("site.com", "http://s/1")]
    path = put("cdx.txt", "20240821000000 http://www.x.com/a?q=1\n20240820000000 https://x.com/a\nbad line\n")
    assert [tuple(r) for r in files.captures(spark, path).collect()] == [("x.com/a", "20240820000000")]
    row = files.articles(spark, put("p.html", "<html><head><title>T &amp; U</title></head><body><p>Hello</p><script>x</script></body></html>")).first()
    assert (row["title"], row["text"]) == ("T & U", "Hello")
    out = str(tmp_path / "out")
    files.export(spark.createDataFrame([(1, "a"), (2, "b")], "x int, d string"), out, ["d"])
    files.export(spark.createDataFrame([(3, "b")], "x int, d string"), out, ["d"])
    assert sorted((r["x"], r["d"]) for r in spark.read.json(out).collect()) == [(1, "a"), (3, "b")]


def test_streamed_upserts(spark, tmp_path):
    schema = "source long, external_id long, seq long, content long"
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[(1, 1, 1, 5), (1, 1, 2, 6), (1, 2, 3, 7)], [(1, 1, 4, 6), (1, 2, 5, 8), (2, 1, 6, 9)]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("source", "external_id", "seq", "content"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest.upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / "cp"), schema, ["source", "external_id"], "seq", ["content"]).awaitTermination(60)
    table = ingest.current(spark, str(tmp_path / "table"), schema)
    assert sorted(map(tuple, table.select("source", "external_id", "content").collect())) == [(1, 1, 6), (1, 2, 8), (2, 1, 9)]
    ledger = lambda: {(r["batch"], r["action"]): r["n"] for r in spark.read.json(str(tmp_path / "table" / "ledger")).collect()}
    assert ledger() == {(0, "created"): 2, (1, "created"): 1, (1, "skipped"): 1, (1, "updated"): 1}
    # the last batch is tried again, as after a crash before its commit: same table, same ledger
    for f in (tmp_path / "cp" / "commits").glob("*1*"):
        f.unlink()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    ingest.upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / "cp"), schema, ["source", "external_id"], "seq", ["content"]).awaitTermination(60)
    table = ingest.current(spark, str(tmp_path / "table"), schema)
    assert sorted(map(tuple, table.select("source", "external_id", "content").collect())) == [(1, 1, 6), (1, 2, 8), (2, 1, 9)]
    assert ledger() == {(0, "created"): 2, (1, "created"): 1, (1, "skipped"): 1, (1, "updated"): 1}


def test_streamed_rate_limit_of_late_rows(spark, tmp_path):
    """A late row counts what lies before it, not after it."""
    (tmp_path / "in").mkdir()
    for k, minutes in enumerate([(20, 21, 22), (9, 12, 13, 14), (15, 23)]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"who": "a", "at": f"2024-01-01 00:{m:02d}:00"}) for m in minutes))
        stream = spark.readStream.schema("who string, at timestamp").json(str(tmp_path / "in"))
        writer = ingest.limited(stream, "who", "at", 3, 10.0, late="1 day").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        writer.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((str(r["at"])[11:16], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("00:14", 3), ("00:15", 4), ("00:23", 5)]


def test_streamed_rate_limit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", f"2024-01-01 00:0{m}:00") for m in (0, 1, 2, 3)] + [("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:00:00")]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"who": w, "at": t}) for w, t in rows))
    stream = spark.readStream.schema("who string, at timestamp").json(str(tmp_path / "in"))
    query = ingest.limited(stream, "who", "at", 3, 10.0).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["who"], str(r["at"]), r["n"]) for r in spark.table("limits").collect()) == [("a", "2024-01-01 00:03:00", 3), ("a", "2024-01-01 00:10:00", 3)]

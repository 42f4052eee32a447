"""Readers and writers on small files."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from vigilis.sources import adapters, datasource, readers, writers


def test_mapped_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("judul;isi;tautan\nÉbola;body one;http://x/1\nflu;\"two\nlines\";\n".encode("latin-1"))
    df = readers.read_mapped_csv(spark, str(tmp_path / "a.csv"), {"title": "judul", "body": "isi", "url": "tautan", "date": "tanggal"}, ";", "ISO-8859-1")
    rows = {r.title: r for r in df.collect()}
    assert rows["Ébola"].row_key == "http://x/1" and rows["Ébola"].text == "Ébola\n\nbody one"
    assert len(rows["flu"].row_key) == 64 and rows["flu"].body == "two\nlines" and rows["flu"].date is None


def test_posts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("post_id,video_link,comment,comment_date\np1,,first,2024-01-01\np1,http://v,second,\n")
    (tmp_path / "b.csv").write_text("id,url,text,date,post_content\np2,http://u,hello,2024-02-01,cap\n")
    rows = {r.post_id: r for r in readers.read_posts(spark, str(tmp_path)).collect()}
    assert rows["p1"].url == "http://v" and rows["p1"].comments == ["first", "second"] and rows["p1"].date == "2024-01-01"
    assert rows["p2"].caption == "cap" and rows["p2"].comments == ["hello"]


def test_enveloped_json(spark, tmp_path):
    bodies = [[{"a": 1}, {"a": 2}], {"data": [{"a": 3}]}, {"result": {"records": [{"a": 4}]}}, {"a": 5}]
    for i, b in enumerate(bodies):
        (tmp_path / f"{i}.json").write_text(json.dumps(b))
    got = readers.read_enveloped_json(spark, str(tmp_path)).select(F.try_variant_get("record", "$.a", "int").alias("a")).collect()
    assert sorted(r.a for r in got) == [1, 2, 3, 4, 5]


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<rss><channel><item><title> A </title><link>http://a</link><description>&lt;b&gt;bold&lt;/b&gt; text</description><pubDate>Mon</pubDate></item><item><title>no link</title></item></channel></rss>")
    (tmp_path / "s.xml").write_text('<feed><entry><title>B</title><link rel="self" href="http://s"/><link href="http://b"/><summary>sum</summary><updated>2024</updated></entry></feed>')
    rows = {r.kind: r for r in readers.read_feed_items(spark, str(tmp_path)).collect()}
    assert (rows["rss"].title, rows["rss"].link, rows["rss"].summary) == ("A", "http://a", "bold text")
    assert (rows["atom"].link, rows["atom"].published) == ("http://b", "2024")


def test_sitemap(spark):
    files = [
        ("root", "<sitemapindex><sitemap><loc>one</loc></sitemap><sitemap><loc>two</loc></sitemap></sitemapindex>", True),
        ("one", "<urlset><url><loc>http://a</loc><lastmod>2024</lastmod></url></urlset>", False),
        ("two", "<sitemapindex><sitemap><loc>three</loc></sitemap></sitemapindex>", False),
        ("three", "<urlset><url><loc>http://b</loc></url></urlset>", False),
    ]
    df = spark.createDataFrame(files, "location string, content string, is_root boolean")
    assert {r.url: r.depth for r in readers.read_sitemap(spark, df, 3).collect()} == {"http://a": 1, "http://b": 2}
    assert [r.url for r in readers.read_sitemap(spark, df, 2).collect()] == ["http://a"]


def test_point_layers(spark, tmp_path):
    (tmp_path / "h.csv").write_text("latitude,longitude,brightness\n1,101,300\n2,102,310\n50,50,400\n")
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"id": "q", "geometry": {"coordinates": [101.5, 1.5, 3]}, "properties": {"mag": 5.1}}]}))
    (tmp_path / "s.json").write_text(json.dumps({"states": [["abc", "c", "x", 1, 2, 103.0, 3.0, 900.0]]}))
    box = (0, 100, 10, 110)
    assert [r.value for r in readers.read_point_layer(spark, str(tmp_path / "h.csv"), "hotspots", box, 1).collect()] == [310.0]
    assert [(r.lat, r.lon, r.value) for r in readers.read_point_layer(spark, str(tmp_path / "g.json"), "geojson", box).collect()] == [(1.5, 101.5, 5.1)]
    assert [(r.id, r.lat) for r in readers.read_point_layer(spark, str(tmp_path / "s.json"), "states", box).collect()] == [("abc", 3.0)]


def test_scan_pushes_down(spark):
    plan = adapters.scan(spark, "/root/testdata/sf0.001", "lineitem", ["l_orderkey"], "l_quantity < 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,3.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_ledger_csv(spark, tmp_path):
    df = spark.createDataFrame([("r1", 'say "hi"', 3), ("r2", None, None)], "report_id string, title string, cases int")
    writers.write_ledger_csv(df, str(tmp_path / "out"), 5)
    lines = next((tmp_path / "out").glob("part*")).read_text("utf-8").splitlines()
    assert lines[0].startswith("\ufeffNo,Source Country,Surveillance Scope,Case Country,Language,Source URL,") and len(lines) == 3 and len(writers.LEDGER) == 31
    assert lines[0].count(",") == 30 and lines[1].startswith('"1",') and lines[2].startswith('"2",')
    assert any('"r1"' in x and '"say ""hi"""' in x for x in lines)


def test_ledger_shows_summaries(spark):
    df = spark.createDataFrame([("a", 3, "three", 1.5, 2.5, "A; B"), ("b", 4, "", 1.5, 2.5, None)], "report_id string, cases int, cases_display string, lat double, lon double, geo_summary string")
    got = [r.line.split('","') for r in writers.ledger_lines(df).orderBy("no").collect()]
    at = {h: i for i, (h, _) in enumerate(writers.LEDGER)}
    assert [(x[at["Number of Cases"]], x[at["Latitude"]], x[at["Longitude"]]) for x in got] == [("three", "A; B", ""), ("4", "1.5", "2.5")]


def test_posts_without_an_id(spark, tmp_path):
    for k, (head, row) in enumerate([("post_id,url,comment", ",https://x/1,first"), ("id,link,text", "7,https://x/2,second"), ("post_id,url,comment", ",https://x/1,third")]):
        (tmp_path / f"f{k}.csv").write_text(f"{head}\n{row}\n")
    got = {r.post_id: sorted(r.comments) for r in readers.read_posts(spark, str(tmp_path)).collect()}
    assert got == {"https://x/1": ["first", "third"], "7": ["second"]}


def test_training_export(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(200)], "id long, label string")
    manifest = {(r.part, r.label): r.n for r in writers.export_training(df, str(tmp_path / "t")).collect()}
    assert sum(manifest.values()) == 200 and 120 < sum(n for (p, _), n in manifest.items() if p == "train") < 190
    assert spark.read.json(str(tmp_path / "t/rows")).count() == 200


def test_snapshot_replaces_its_key_alone(spark, tmp_path):
    path = str(tmp_path / "k")
    one = spark.createDataFrame([(1,)], "cases int")
    writers.write_kpi_snapshot(one, path, "a|all", date(2024, 1, 1))
    writers.write_kpi_snapshot(one, path, "b|all", date(2024, 1, 1))
    writers.write_kpi_snapshot(one.select((F.col("cases") + 1).alias("cases")), path, "a|all", date(2024, 1, 2))
    assert {(r.filter_key, r.cases) for r in spark.read.parquet(path).collect()} == {("a|all", 2), ("b|all", 1)}
    assert writers.filter_key("Asia", None, 1, 2) == "asia|all|1|2"


def test_formats_of_odd_files(spark, tmp_path):
    import gzip

    datasource.register(spark)
    (tmp_path / "f").mkdir()
    (tmp_path / "f/_SUCCESS").write_text("")
    (tmp_path / "f/empty.xml").write_text("")
    (tmp_path / "f/cut.xml").write_text('<rss><channel><item><title>A</title><link>http://a</link></item><item><title>B')
    (tmp_path / "f/ns.xml").write_text('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:link href="http://b"/><a:content>x <i>y</i></a:content></a:entry><a:entry><a:title>no link</a:title></a:entry></a:feed>')
    rows = {(r.kind, r.title, r.link, r.summary) for r in spark.read.format("feed").load(str(tmp_path / "f")).collect()}
    assert rows == {("rss", "A", "http://a", None), ("atom", None, "http://b", "x y")}
    with pytest.raises(Exception, match="cut.xml|empty.xml"):
        spark.read.format("feed").option("mode", "FAILFAST").load(str(tmp_path / "f")).collect()
    (tmp_path / "s.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc> http://a </loc></url><url/></urlset>"))
    assert [(r.kind, r.loc, r.lastmod) for r in spark.read.format("sitemap").load(str(tmp_path / "s.xml.gz")).collect()] == [("url", "http://a", None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{\n "rows": [1, {"a": null}]\n}')
    (tmp_path / "j/b.json").write_text('[]\n\n{"x": 1}\n')
    got = sorted((r.path[-6:], r.place, r.record) for r in spark.read.format("records").option("partitionBytes", 1).load(str(tmp_path / "j")).collect())
    assert got == [("a.json", 0, "1"), ("a.json", 1, '{"a": null}'), ("b.json", 0, '{"x": 1}')]
    (tmp_path / "p").mkdir()
    assert spark.read.format("points").load(str(tmp_path / "p")).count() == 0


def test_a_feed_as_a_stream(spark, tmp_path):
    """What has come in since is read once; a restart goes on where the last batch ended."""
    import os

    datasource.register(spark)
    (tmp_path / "in").mkdir()
    seen = []

    def run():
        q = spark.readStream.format("feed").load(str(tmp_path / "in")).writeStream.option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).foreachBatch(lambda df, n: seen.append(sorted(r.link for r in df.collect()))).start().awaitTermination()

    for i, names in enumerate((["a", "b"], ["c"])):
        for k, n in enumerate(names):
            f = tmp_path / "in" / f"{n}.xml"
            f.write_text(f"<rss><item><link>http://{n}</link></item></rss>")
            os.utime(f, (1_700_000_000 + 100 * i + k,) * 2)
        run()
    run()
    assert [x for x in seen if x] == [["http://a", "http://b"], ["http://c"]]


def test_sitemaps_that_name_each_other(spark):
    rows = [("a", "sitemap", "b", None), ("b", "sitemap", "a", None), ("b", "url", "http://x", "2024"), ("c", "url", "http://y", None)]
    entries = spark.createDataFrame(rows, "location string, kind string, loc string, lastmod string")
    out = readers.follow_sitemaps(entries, spark.createDataFrame([("a",), ("a",)], "location string"), 4)
    assert [tuple(r) for r in out.collect()] == [("http://x", "2024", 1)]

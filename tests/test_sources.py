import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemason.functions import html as H
from lakemason.sources import files
from lakemason.streaming import upsert

PAGE = """<html><head><title>T &amp; x</title><meta property="og:title" content="Og"><script id="__NEXT_DATA__">{"props": {"a": [{"price": 1, "title": "t", "id": 3}]}}</script>
<script type="application/ld+json">{"@type": "Offer"}</script></head><body><h1>Nice <b>flat</b></h1><dl><dt>Rooms:</dt><dd>3</dd><dt>Rooms</dt><dd>4</dd></dl><table><tr><th>Size</th><td>65 sqm</td></tr></table>
<div class="label">Floor</div><div class="value">12</div><p>short</p><p>This is a long description of the flat. It has two sentences, and it ends here.</p><a href="/x/1">a</a><a href='https://o.y/2'>b</a><a href="/x/1">c</a></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("<p>",)], "h string")
    h = F.col("h")
    got = df.select(H.title_column(h).alias("t"), H.pairs_column(h).alias("p"), H.description_column(h).alias("d"), H.links(h, "https://s.t/").alias("l"), H.records_column(H.embedded_json(h, "__NEXT_DATA__")).alias("r"), H.json_ld(h).alias("j")).collect()
    r = got[0]
    assert r["t"] == "Nice flat" or r["t"].startswith("Nice")
    assert [(p["label"], p["value"]) for p in r["p"]] == [("Rooms", "3"), ("Size", "65 sqm"), ("Floor", "12")]
    assert r["d"].startswith("This is a long") and r["l"] == ["https://s.t/x/1", "https://o.y/2"]
    assert [json.loads(x)["id"] for x in r["r"]] == [3] and len(r["j"]) == 1
    assert got[1]["t"] is None and got[1]["p"] == [] and got[2]["d"] is None
    assert H.flatten_value('{"name": {"en": "x"}}') == "x" and H.flatten_value('[{"label": "y"}]') == "y" and H.flatten_value("plain") == "plain" and H.flatten_value("[]") is None
    assert H.find_records("{broken") == [] and H.plain_text("<p>a</p><script>b</script>") == "a"


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "n": 2}, {"id": "ខ", "x": true}]')
    got = files.read_json_array(spark, str(tmp_path / "a.json"), "id string, n int").orderBy("n").collect()
    assert {tuple(r) for r in got} == {("1", 2), ("ខ", None)}
    (tmp_path / "b.json").write_text('[{"id": ')
    with pytest.raises(Exception):  # noqa: B017
        files.read_json_array(spark, str(tmp_path / "b.json"), "id string").collect()
    (tmp_path / "c.csv").write_text("\ufeffID,\tName \n1,\tx\n\t\n2,\n")
    df = files.read_text_csv(spark, str(tmp_path / "c.csv"), ["id", "name"])
    assert [tuple(r) for r in df.collect()][:1] == [("1", "x")] and df.columns == ["id", "name"]
    with pytest.raises(ValueError, match="lacks"):
        files.read_text_csv(spark, str(tmp_path / "c.csv"), ["nope"])
    assert files.first_existing(spark, [str(tmp_path / "zz"), str(tmp_path / "c.csv")]).endswith("c.csv")
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "zz")])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "accepted"), (2, None, "review")], "id int, options array<int>, record_status string")
    files.write_csv(df, str(tmp_path / "out"), ["record_status", "options", "absent"])
    back = files.read_text_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [("accepted", "[1,2]", ""), ("review", "", "")]
    assert sorted(map(tuple, files.write_by_status(df, str(tmp_path / "parts")).collect())) == [("accepted", 1), ("review", 1)]
    wide = files.conform(df, T.StructType([T.StructField("id", T.StringType()), T.StructField("more", T.DoubleType())]))
    assert wide.dtypes == [("id", "string"), ("more", "double")] and wide.count() == 2
    files.append_log(spark, str(tmp_path / "log"), {"step": "a"})
    files.append_log(spark, str(tmp_path / "log"), {"step": "b"})
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_page_caches(spark, tmp_path):
    (tmp_path / "search_7.html").write_text(PAGE)
    (tmp_path / "my_site.txt").write_text("https://a/1\n\nhttps://a/2\n")
    (tmp_path / "other.txt").write_text("# domain: b.c\nhttps://b/1")
    assert files.read_pages(spark, str(tmp_path)).select("page").first()[0] == 7
    urls = files.read_url_list(spark, str(tmp_path / "*.txt")).collect()
    assert sorted(map(tuple, urls)) == [("b.c", "https://b/1"), ("my.site", "https://a/1"), ("my.site", "https://a/2")]
    xml = spark.createDataFrame([("<urlset><url><loc> https://a/1 </loc></url></urlset>",)], "x string")
    assert xml.select(files.sitemap_urls("x")).first()[0] == ["https://a/1"]


def test_streamed_upsert(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    schema = "id string, seq long, v string"
    for part in ([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z"), (None, 4, "n")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(landing)
        upsert.upsert_stream(upsert.land(spark, landing, schema), store, ["id"], "seq", str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, upsert.latest(spark, store).collect()), key=lambda r: r[1]) == [("b", 2, "y"), ("a", 3, "z"), (None, 4, "n")]
    assert upsert.latest(spark, str(tmp_path / "nothing")) is None


def test_windowed_counts_and_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-01-09 00:00:00", "a")]
    data = spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    data.write.parquet(str(tmp_path / "in"))
    counts = upsert.windowed_counts(upsert.land(spark, str(tmp_path / "in"), data.schema), "t", "k")
    query = counts.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["n"] for r in spark.table("counts").collect()] == [2]


def test_store_by_buckets(spark, tmp_path):
    """Every batch writes the buckets it touches; the newest row of each key stays, whatever the batch."""
    from lakemason.streaming.upsert import latest, upsert_stream

    schema = "k long, at long, v string"
    batches = [[(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], [(1, 2, "d"), (4, 1, "e")], [(1, 1, "old"), (4, 5, "f")], [(1, 9, "g")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "landing"))
        upsert_stream(stream, str(tmp_path / "store"), ["k"], "at", str(tmp_path / "state"), buckets=4).awaitTermination()
        seen = {}
        for k, at, v in (r for batch in batches[: n + 1] for r in batch):
            seen[k] = max(seen.get(k, (0, "")), (at, v))
        assert {r["k"]: (r["at"], r["v"]) for r in latest(spark, str(tmp_path / "store")).collect()} == seen
    kept = [p for p in (tmp_path / "store").glob("v=*/_bucket=*") if any(p.iterdir())]
    assert max(sum(p.name == f"_bucket={b}" for p in kept) for b in range(4)) <= 2

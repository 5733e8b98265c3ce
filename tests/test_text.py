"""Line files."""

from gossamer.sources import text


def test_peers(spark, tmp_path):
    lines = ["127.0.0.1:80", "# note", "", "  [::1]:9000 ", "not an address", "10.0.0.1"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    found = text.parse_peers(df)
    assert sorted(r["address"] for r in found.collect()) == ["127.0.0.1:80", "[::1]:9000"]
    text.write_peers(found, "address", f"{tmp_path}/peers")
    assert text.read_peers(spark, f"{tmp_path}/peers").count() == 2


def test_metrics(spark):
    lines = ["# TYPE a counter", 'a_total{node="n1"} 3', "up 1", 'h_bucket{le="0.5"} 2.5', "broken", "x y z"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r["metric"], r["label"], r["number"], r["kind"]) for r in text.parse_metrics(df).collect()}
    assert got == {("a_total", "n1", 3.0, "counter"), ("up", None, 1.0, "gauge"), ("h_bucket", "0.5", 2.5, "histogram")}

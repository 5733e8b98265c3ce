"""Payloads are compressed a hundred rows at a time, whatever their number."""

from pyspark.sql import functions as F

from gossamer.functions import compression


def test_payloads_come_back_without_arrow_batches(spark):
    payloads = [None, b"", b"x", b"ab" * 5000, bytes(range(256)) * 2]
    rows = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in enumerate(payloads)], "id int, raw binary")
    packed = rows.withColumn("packed", compression.pack("raw")).withColumn("back", compression.unpack("packed"))
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    got = [None if r["back"] is None else bytes(r["back"]) for r in packed.orderBy("id").collect()]
    assert got == payloads
    assert spark.range(1).select(compression.unpack(F.lit(bytearray([3, 9, 9])))).first()[0] is None

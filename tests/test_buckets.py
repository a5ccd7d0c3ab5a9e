"""Tables in buckets of cells: no exchange by cell, one file a bucket and year."""

from pyspark.sql import functions as F

from cellcube.operators import joins as J
from cellcube.operators.series import temporal_lags
from cellcube.session import scratch_path
from cellcube.sources import buckets as B


def _layers(spark):
    cells = spark.range(50 * 24).select((F.col("id") % 50).cast("int").alias("pixel_idx"), (F.col("id") / 50).cast("int").alias("t"),
                                        (2000 + F.floor(F.col("id") / 600)).cast("int").alias("year"), F.col("id").cast("double").alias("ndvi")).repartition(7)
    pop = spark.range(100).select((F.col("id") % 50).cast("int").alias("pixel_idx"), (2000 + F.floor(F.col("id") / 50)).cast("int").alias("year"), F.col("id").cast("double").alias("pop_density"))
    return cells, pop


def test_stored_layers_join_and_window_where_they_lie(spark):
    cells, pop = _layers(spark)
    stored = []
    for name, df in (("cells", cells), ("pop", pop)):
        path = scratch_path(spark, name)
        B.write_bucketed(df, path, 8)
        stored.append(B.scan_bucketed(spark, path))
        assert stored[-1].columns == df.columns and stored[-1].dtypes == df.dtypes
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for (c, p), exchanges in ((stored, 0), ((cells, pop), None)):
            a = c.select("pixel_idx", "t", "year", "ndvi")
            joined = J.join_drivers(a.select("pixel_idx", "t", "ndvi"), a.select("pixel_idx", "t", F.col("ndvi").alias("lst")))
            lagged = temporal_lags(joined.withColumn("year", (2000 + F.floor(F.col("t") / 12)).cast("int")), ["lst"], (1, 2))
            out = J.join_yearly(lagged, p)
            n = out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
            assert n == 0 if exchanges == 0 else n > 0
            rows = sorted(map(str, out.collect()))
            assert len(rows) == 1200 and (exchanges == 0 or rows == kept)
            kept = rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_file_a_bucket_and_year(spark):
    cells, _ = _layers(spark)
    path = scratch_path(spark, "files")
    done = B.write_bucketed(cells, path, 4)
    files = spark.read.parquet(done.path).inputFiles()
    assert len(files) == 2 * len({f.rsplit("_", 1)[1] for f in files}) and len(files) <= 8
    # a second version replaces the first as a whole
    old = B.scan_bucketed(spark, path)
    B.write_bucketed(cells.where("year = 2000"), path, 8)
    assert old.count() == 1200 and B.scan_bucketed(spark, path).count() == 600


def test_bucket_count():
    assert B.bucket_count(0) == B.bucket_count(10 ** 6) == 8 and B.bucket_count(10 ** 9) == 256

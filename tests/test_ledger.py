"""How a micro-batch is written to the ledger."""

import glob

from pyspark.sql import functions as F

from weft.streaming import streams


def test_a_part_of_a_batch_is_one_file(spark, tmp_path):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream with state
    try:
        batch = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
        for number in (0, 0, 1):
            streams.record(batch, number, f"{tmp_path}/ledger")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    files = glob.glob(f"{tmp_path}/ledger/part=*/batch=*/*.parquet")
    assert len(files) == len({f.rpartition("/")[0] for f in files}) == 256
    assert spark.read.schema(streams.LEDGER).parquet(f"{tmp_path}/ledger").select("fingerprint").distinct().count() == 3000

"""What tests of streams share."""

import time


def run_stream(spark, tmp_path, name, batches, schema, build, mode="append"):
    """Feeds each batch as a file of its own, one per trigger; returns the rows that came out."""
    folder = tmp_path / name
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()

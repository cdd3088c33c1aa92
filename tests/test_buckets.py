import random

from karst.streaming import buckets, windows
from pyspark.sql import functions as F

SCHEMA = "event_id long, user string, at long"


def test_streamed_as_a_batch_and_after_a_restart(spark, tmp_path):
    """Files out of order within the watermark's delay, a restart between them, and one event at the end that closes all."""
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 400_000) for _ in range(240))
    rows = [(i, rng.choice(["a", "b", "c"]), t) for i, t in enumerate(times)]
    rows += [(900, "a", times[5]), (901, "a", times[5])]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 40_000))  # up to 40 seconds late
    last = [(999, "z", 4_000_000)]
    table = lambda part: spark.createDataFrame(part, SCHEMA).select("event_id", "user", F.timestamp_millis("at").alias("ts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buckets.PROVIDER)
    try:

        def run(part, name):
            table(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")
            stream = spark.readStream.schema(table([]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
            out = buckets.rate_limited_stream(stream, "user", 3, 0.05)
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

        run(rows[:120], "1")
        run(rows[120:], "2")
        run(last, "3")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = lambda df: sorted((r.event_id, r.user, r.ts, r.allowed, r.retry_after) for r in df.collect() if r.event_id != 999)
    want = told(windows.rate_limited(table([*rows, *last]), "user", 3, 0.05))
    assert told(spark.read.parquet(f"{tmp_path}/out")) == want and len({w[3] for w in want}) == 2

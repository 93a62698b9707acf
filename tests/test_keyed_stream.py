"""Keyed changes of a stream of snapshots against differences of tables, over restarts."""

import datetime

from pyspark.sql import functions as F

from graphloom.streaming import keyed

SNAPSHOTS = [
    {"a": "1", "b": "1", "c": "1", "é": None},
    {"a": "1", "b": "2", "d": "1", "é": None},
    {"b": "2", "c": "9", "é": "x"},
    {},
    {"a": "1"},
]


def at(k):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)


def test_stream_equals_tables(spark, tmp_path):
    keyed.prepared(spark)
    try:
        source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
        schema = "key string, digest string, at timestamp"
        for k, rows in enumerate(SNAPSHOTS):
            # an empty snapshot tells its time by a row without a key
            spark.createDataFrame([*((x, d, at(k)) for x, d in rows.items()), (None, None, at(k))], schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = keyed.watched(stream, out, check, once=True)  # started anew for each snapshot
            query.awaitTermination(120)
            assert query.exception() is None
        got = sorted((r.key, r.change, r.digest) for r in spark.read.parquet(out).collect())
        wanted = []
        for old, new in zip([{}, *SNAPSHOTS], SNAPSHOTS):
            frames = [spark.createDataFrame(list(x.items()), "key string, digest string") for x in (old, new)]
            wanted += [tuple(r) for r in keyed.batch_changes(*frames).collect()]
        assert got == sorted(wanted, key=lambda r: (r[0], r[1], r[2] or "")) or sorted(got, key=repr) == sorted(wanted, key=repr)
        assert spark.read.parquet(out).where(F.col("key").isNull()).isEmpty()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

"""Structured Streaming jobs over the two feeds: request events and newly saved records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.tables import kept, shared_dir

#: Fixed value: the scrape interval. Late rows are taken for LATE.
INTERVAL, LATE = "15 seconds", "10 minutes"


def request_rates(events: DataFrame, interval: str = INTERVAL, late: str = LATE) -> DataFrame:
    """start, bucket, n: requests per interval and latency bucket (tens up to 100)."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), F.expr("width_bucket(value, 0, 100, 10)").alias("bucket"))
    counted = timed.withWatermark("ts", late).groupBy(F.window("ts", interval), "bucket").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("bucket").cast("int").alias("bucket"), "n")


class Upserts:
    """A table of rows that come in numbered batches, of which readers see the latest of each key.

    A batch is written under its number, so one that comes again replaces itself. ``compact`` folds batches into
    a base first and removes them after; readers take the newest whole base and the batches after it, so
    whatever a lost job leaves behind is never read twice. All of it lies under ``path`` on shared storage.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str):
        self.spark, self.path, self.keys, self.version = spark, path.rstrip("/"), keys, version

    def _folder(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that are whole."""
        top, fs = self._folder(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        found = [int(n.removeprefix(f"{kind}-")) for n in names if n.startswith(f"{kind}-")]
        return sorted(n for n in found if fs.exists(self._folder(f"{self.path}/{kind}-{n}/_SUCCESS")[0]))

    def put(self, batch: DataFrame, number: int) -> None:
        if number > max(self._numbers("base"), default=-1):
            batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")

    def _held(self, upto: int | None = None) -> DataFrame | None:
        """All rows that count, several of a key among them."""
        base = max(self._numbers("base"), default=-1)
        paths = [f"{self.path}/base-{base}"] * (base >= 0) + [f"{self.path}/batch-{n}" for n in self._numbers("batch") if n > base and (upto is None or n <= upto)]
        return self.spark.read.parquet(*paths) if paths else None

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        pick = F.max_by(F.struct(*rest), F.struct(self.version, "_batch"))
        return rows.groupBy(*self.keys).agg(pick.alias("r")).select(*self.keys, "r.*")

    def read(self) -> DataFrame:
        return self._latest(self._held()).drop("_batch")

    def compact(self) -> None:
        batches = self._numbers("batch")
        base = max(self._numbers("base"), default=-1)
        if batches and batches[-1] > base:
            self._latest(self._held(batches[-1])).write.mode("overwrite").parquet(f"{self.path}/base-{batches[-1]}")
        base = max(self._numbers("base"), default=-1)
        for kind, number in [("batch", n) for n in self._numbers("batch") if n <= base] + [("base", n) for n in self._numbers("base") if n < base]:
            path, fs = self._folder(f"{self.path}/{kind}-{number}")
            fs.delete(path, True)


def drain(stream: DataFrame, spark: SparkSession, keys: list[str], version: str, shared: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns the table that it upserts."""
    shared = shared or shared_dir(spark)
    top = f"{shared.rstrip('/')}/feed-{uuid.uuid4().hex}"
    table = Upserts(spark, f"{top}/rows", keys, "_batch")
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/log").trigger(availableNow=True)
             .foreachBatch(lambda batch, n: table.put(batch, n)).start())
    query.awaitTermination()
    return table.read()


def scored_feed(stream: DataFrame, table: Upserts, log: str, score, every: int = 8) -> None:
    """Scores the records that have come since the last run, batch by batch, and upserts them.

    ``score`` takes the records of a batch, read back from the shared folder, to rows of ``table``; ``log`` is the
    stream's checkpoint. After ``every`` batches the table is compacted. A batch that is run again after a loss replaces itself."""
    def one(batch: DataFrame, number: int) -> None:
        table.put(score(kept(batch)), number)
        if (number + 1) % every == 0:
            table.compact()

    stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()

"""A cache of the pages of text files on shared storage: only files that changed are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.tables import file_contents, file_list, kept, line_pages


class PageCache:
    """Pages by file, under ``path``: pages-<n> holds those of the files that run n read, manifest-<n> says for every file
    which run has its pages. A manifest counts once it is whole, and the newest does, so a lost run changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _newest(self) -> int:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in fs.listStatus(top)] if fs.exists(top) else []
        whole = [p for p in names if p.getName().startswith("manifest-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(p.getName().removeprefix("manifest-")) for p in whole), default=-1)

    def refresh(self, files: str) -> int:
        """Brings the cache to the state of the files under a folder; returns how many were read."""
        last = self._newest()
        now = kept(file_list(self.spark, files))
        keys = ["path", "length", "modified"]
        old = self.spark.read.parquet(f"{self.path}/manifest-{last}") if last >= 0 else None
        changed = kept(now if old is None else now.join(old, keys, "left_anti"))
        read = changed.count()
        fresh = changed.withColumn("run", F.lit(last + 1))
        if read:
            text = file_contents(self.spark, files, changed).select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"))
            line_pages(text).withColumnRenamed("doc_id", "path").write.mode("overwrite").parquet(f"{self.path}/pages-{last + 1}")
        state = fresh if old is None else now.join(old, keys).select(*keys, "run").unionByName(fresh)
        state.write.mode("overwrite").parquet(f"{self.path}/manifest-{last + 1}")
        return read

    def pages(self) -> DataFrame:
        """path, page_no, text of the files as of the last refresh."""
        state = kept(self.spark.read.parquet(f"{self.path}/manifest-{self._newest()}"))
        runs = sorted(r.run for r in state.select("run").distinct().collect())  # a run is a call of refresh
        out = self.spark.createDataFrame([], "path string, page_no int, text string")
        for n in runs:
            some = self.spark.read.parquet(f"{self.path}/pages-{n}").join(state.where(F.col("run") == n).select("path"), "path", "left_semi")
            out = out.unionByName(some)
        return out

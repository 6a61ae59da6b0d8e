"""Tables that take each batch and each key once, whoever writes and however often: data first, then one commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How often a writer starts anew because another one has committed meanwhile.
TRIES = 20


class Conflict(RuntimeError):
    """Other writers were faster every time."""


class OnceTable:
    """A folder with parquet parts and a log of commits. A part is in the table when the log names it.

    A commit is one file, moved into place under the next number; the move fails where that number is
    taken, so of two writers one wins and the other looks again at what is new. The store must offer such
    a move (HDFS and local folders do). What a writer that died left behind is named by no commit and is
    never read; a batch that was committed before changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._log = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        self._fs = self._log.getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._log.toUri(), conf)

    def commits(self) -> list[dict]:
        """What the log says, in order: batch, part, n, low, high."""
        if not self._fs.exists(self._log):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._log))
        return [json.loads(self._text(n)) for n in names if n.isdigit()]

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._jvm.org.apache.hadoop.fs.Path(self._log, name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, commits: list[dict] | None = None) -> DataFrame | None:
        """All rows that are committed; None while there are no parts."""
        parts = [f"{self.path}/{c['part']}" for c in (self.commits() if commits is None else commits) if c["n"]]
        return self.spark.read.parquet(*parts) if parts else None

    def _commit(self, number: int, entry: dict) -> bool:
        path = self._jvm.org.apache.hadoop.fs.Path
        held = path(self._log, f"_{uuid.uuid4().hex}")
        out = self._fs.create(held, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._files.rename(held, path(self._log, f"{number:012d}"), how)
            return True
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(held, False)
            return False

    def insert(self, df: DataFrame, batch: str, key: str | None = None) -> int:
        """Add the rows of a batch, with a key only those whose key the table lacks, one a key; how many came.

        A batch that the log has adds nothing. Null keys count as one key. The rows are written before the
        commit; if another writer commits first and its range of keys meets ours, keys are compared again.
        """
        part, seen = None, -1
        for _ in range(TRIES):
            log = self.commits()
            if any(c["batch"] == batch for c in log):
                return 0
            fresh = [c for c in log[max(seen, 0) :] if seen < 0 or _meets(c, entry)] if key else []
            if part is None or fresh:
                part = f"part-{uuid.uuid4().hex}"
                entry = {"batch": batch, "part": part, **self._write(df, part, key, log)}
            seen = len(log)
            if self._commit(seen, entry):
                return entry["n"]
        raise Conflict(f"{TRIES} commits to {self.path} were too late")

    def _write(self, df: DataFrame, part: str, key: str | None, log: list[dict]) -> dict:
        rows = df
        if key:
            rows, have = df.dropDuplicates([key]), self.read(log)
            if have is not None:
                have = have.select(F.col(key).alias("_have"))
                rows = rows.join(have, F.col(key).eqNullSafe(F.col("_have")), "left_anti")
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.path}/{part}")
        done = self.spark.read.schema(df.schema).parquet(f"{self.path}/{part}")
        text = F.col(key).cast("string") if key else F.lit(None).cast("string")
        r = done.agg(F.count("*").alias("n"), F.min(text).alias("low"), F.max(text).alias("high"), F.count(F.when(text.isNull(), 1)).alias("nulls")).first()
        return {"n": r.n, "low": r.low, "high": r.high, "nulls": r.nulls if key else 0}


def _meets(a: dict, b: dict) -> bool:
    """Whether two commits may have a key in common."""
    if a["n"] == 0 or b["n"] == 0:
        return False
    if a["nulls"] and b["nulls"]:
        return True
    return a["low"] is not None and b["low"] is not None and a["low"] <= b["high"] and b["low"] <= a["high"]


def once_sink(path: str, name: str, key: str | None = None, keep: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each micro-batch of the stream ``name`` is inserted once, also where a stream
    repeats it after a restart. ``keep`` lists the columns that may be written; others are left out."""

    def put(df: DataFrame, batch: int) -> None:
        OnceTable(df.sparkSession, path).insert(df.select(*[c for c in df.columns if keep is None or c in keep]), f"{name}/{batch}", key)

    return put

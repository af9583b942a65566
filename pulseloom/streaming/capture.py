"""Captures on disk that are whole or not there: batches published through a ledger, metadata written once, resumed or refused.

A batch is written to a folder of its own, then named in the ledger by Spark's own committed write; readers see only what
the ledger names. A batch that is delivered again finds its name there and writes nothing; one that died before it was
named is written over. The identity of a capture is its first entry: another capture at the same path is refused, the
same one goes on only if resuming was asked for. Everything goes through Spark's readers and writers, so that any store
that they reach will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a part of an identity may look like: it becomes a part of a path.
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")
LEDGER = "batch_id long, kind string, n_rows long, content string"


class Refused(ValueError):
    """A capture that would harm another one."""


def folder(root: str, *identity: str) -> str:
    """The path of a capture below root; parts that could leave it are refused."""
    for part in identity:
        if not NAME.fullmatch(part):
            raise Refused(f"no name for a folder: {part!r}")
    return "/".join([root.rstrip("/"), *identity])


class Capture:
    """A capture at a path: add() batches, finish() once, table() what was published."""

    def __init__(self, spark: SparkSession, path: str, identity: dict[str, str], schema: str, resume: bool = False):
        self.spark, self.path, self.schema = spark, path, schema
        content = json.dumps(identity, sort_keys=True)
        begun = self._entries("identity")
        if begun is None:
            self._publish(-1, "identity", 0, content)
        elif begun[0].content != content:
            raise Refused(f"another capture is at {path}: {begun[0].content}")
        elif not resume:
            raise Refused(f"this capture exists at {path}; ask to resume it")
        if self.finished():
            raise Refused(f"the capture at {path} is finished")

    def ledger(self) -> DataFrame | None:
        """The entries so far; None where there is no ledger yet."""
        try:
            return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{self.path}/ledger")
        except AnalysisException:
            return None

    def _entries(self, kind: str) -> list | None:
        d = self.ledger()
        return (d.where(F.col("kind") == kind).collect() or None) if d is not None else None  # a row a batch

    def _publish(self, batch_id: int, kind: str, n_rows: int, content: str) -> None:
        row = self.spark.createDataFrame([(batch_id, kind, n_rows, content)], LEDGER).coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.path}/ledger/{kind}={batch_id}")

    def has(self, batch_id: int) -> bool:
        d = self.ledger()
        return d is not None and not d.where((F.col("kind") == "batch") & (F.col("batch_id") == batch_id)).isEmpty()

    def finished(self) -> bool:
        return self._entries("metadata") is not None

    def add(self, rows: DataFrame, batch_id: int) -> bool:
        """Publish a batch; False, and nothing written, if it has been."""
        if self.has(batch_id):
            return False
        at = f"{self.path}/data/batch={batch_id}"
        rows.write.mode("overwrite").parquet(at)  # what an earlier try left, no reader has seen
        n = self.spark.read.schema(self.schema).parquet(at).count()
        self._publish(batch_id, "batch", n, "")
        return True

    def batches(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return lambda rows, batch_id: self.add(rows, batch_id) and None

    def table(self) -> DataFrame:
        """The rows of the published batches, with batch_id."""
        named = self._entries("batch")
        if not named:
            return self.spark.createDataFrame([], f"{self.schema}, batch_id long")
        paths = [f"{self.path}/data/batch={r.batch_id}" for r in named]
        out = self.spark.read.schema(self.schema).parquet(*paths)
        return out.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long"))

    def finish(self, metadata: dict, annotations: DataFrame | None = None) -> dict:
        """Write the metadata once, with counts of what was published; annotations beside it. Nothing can be added afterwards."""
        if self.finished():
            raise Refused(f"the capture at {self.path} is finished")
        named = self._entries("batch") or []
        if annotations is not None:
            annotations.write.mode("overwrite").option("header", "true").csv(f"{self.path}/annotations")
        content = {**metadata, "batches": len(named), "rows": sum(r.n_rows for r in named), "annotated": annotations is not None}
        self._publish(0, "metadata", content["rows"], json.dumps(content, sort_keys=True))
        return content


def read_capture(spark: SparkSession, path: str) -> dict:
    """The identity and metadata of a finished capture; an unfinished one is refused."""
    rows = {r.kind: r.content for r in spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{path}/ledger").where("kind <> 'batch'").collect()}
    if "metadata" not in rows:
        raise Refused(f"the capture at {path} is not finished")
    return json.loads(rows["identity"]) | json.loads(rows["metadata"])

"""A sink that takes each micro-batch once, whatever is replayed.

Spark gives a batch the same number when it runs it again after a crash. A batch's rows are written to a folder of their own, and a pointer named by the batch's number makes
them visible; the first pointer stays, so a replay leaves an unnamed folder behind and changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import create, exists, line, names


class BatchSink:
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Whether these rows are what counts for the batch."""
        spark, at = rows.sparkSession, f"{self.root}/batches/{batch:012d}"
        if exists(spark, at) and line(spark, at) is not None:
            return False
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{name}")
        # a pointer whose writer died in it is empty: the next attempt has a name of its own
        attempt = 0
        while not create(spark, at + (f".{attempt}" if attempt else ""), name):
            if line(spark, at + (f".{attempt}" if attempt else "")) is not None:
                return False
            attempt += 1
        return True

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows of all batches, each once."""
        first: dict[str, str] = {}
        for n in names(spark, f"{self.root}/batches"):
            if (said := line(spark, f"{self.root}/batches/{n}")) is not None:
                first.setdefault(n.split(".")[0], said)
        return spark.read.schema(schema).parquet(*[f"{self.root}/data/{x}" for x in first.values()]) if first else spark.createDataFrame([], schema)


def run_available(source: DataFrame, make: Callable[[DataFrame], DataFrame], sink: BatchSink, after: Callable[[int], None] | None = None) -> None:
    """Run a stream over what has arrived, and stop: make() gives a batch's rows for the sink. after(batch), if given, is called when a batch is written and before Spark notes it as done."""

    def each(batch: DataFrame, number: int) -> None:
        sink.write(make(batch), number)
        if after is not None:
            after(number)

    query = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{sink.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()

"""The message log as a stream, and stateful strikes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeindex.lake import MESSAGES, Lake
from lakeindex.operators.quality import STRIKES
from lakeindex.ship import ship


def read_log(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A folder of JSON messages as a stream; the number of files a batch bounds its size."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_batch).json(path)


def apply_stream(lake: Lake, log: DataFrame, checkpoint: str):
    """Applies the log batch by batch; the checkpoint says what is applied, and a batch is one commit."""
    return log.writeStream.foreachBatch(lambda batch, _: lake.apply(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def strike_stream(runs: DataFrame) -> DataFrame:
    """Of a stream (host, seq, failed): rows (host, seq, fails) with the strikes after each run, kept as state by site.

    Runs of one batch are taken in the order of seq; batches must come in that order, as the log's do.
    """
    ship(runs.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, failed in zip(rows["seq"], rows["failed"]):
            fails = (fails + 1) % STRIKES if failed else 0
            out.append((key[0], int(seq), fails))
        state.update((fails,))
        yield pd.DataFrame(out, columns=["host", "seq", "fails"])

    return runs.groupBy("host").applyInPandasWithState(step, "host string, seq long, fails int", "fails int", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time; rows later than the watermark are left out."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

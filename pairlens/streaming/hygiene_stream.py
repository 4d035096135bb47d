"""Generation hygiene on a stream of generation files (F1-F6 + W1 with state).

The funnel's row filters are stateless and run unchanged on a streaming DataFrame.
Keep-first dedup (W1) becomes streaming ``dropDuplicates`` on a 64-byte hash of the three
keys: the first arrival of a key is kept, later ones dropped, and the hashes are kept in the
state store (checkpointed, so it survives restarts and executor loss). With an event-time column
the state is bounded: keys are forgotten once the watermark has passed them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairlens.operators import hygiene as H


def clean_stream(stream: DataFrame, treatment_filter: bool = True, event_time: str | None = None,
                 delay: str = "1 day") -> DataFrame:
    s = H.drop_no_change(H.drop_unsuccessful(stream))
    parts = [F.coalesce(F.sha2(F.col(k).cast("string"), 256), F.lit("null")) for k in H.DEDUP_KEYS]
    s = s.withColumn("_key", F.sha2(F.concat_ws("|", *parts), 256))
    if event_time:
        s = s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"])
    else:
        s = s.dropDuplicates(["_key"])
    s = s.drop("_key")
    s = H.drop_fault_endings(H.drop_fault_words(s))
    if treatment_filter:
        s = H.keep_treatment_consistent(H.decode_predictions(s, strict=False))
    return s


def start(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_dir: str,
          fmt: str = "parquet", trigger_once: bool = True):
    """readStream -> clean -> append to a parquet sink (exactly-once via the checkpoint)."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    w = (clean_stream(stream).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()

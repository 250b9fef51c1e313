"""Continuous intake: pages that arrive are scored once, and those already in the state are passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import structure_hints, with_quality
from ..operators.resume import exists, pending


def score_stream(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, keys: list[str], text: str = "text") -> StreamingQuery:
    """Score pages arriving as Parquet under source and append them to the state table, each key once.

    A micro-batch drops repeats within itself and anti-joins the state, so a batch run again after a failure adds nothing.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(keys)
        held = spark.read.parquet(state).select(*keys) if exists(spark, state) else new.select(*keys).limit(0)
        scored = with_quality(pending(new, held, keys), text).withColumn("structure_hints", structure_hints(F.col(text)))
        scored.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(state)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

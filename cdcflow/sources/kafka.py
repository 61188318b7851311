"""Kafka as the change source. Needs Spark's Kafka package on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Offsets of one topic partition that one task looks through for gaps.
BLOCK = 1_000_000


def kafka_options(
    servers: str,
    topic: str,
    *,
    username: str | None = None,
    password: str | None = None,
    protocol: str = "SASL_SSL",
    mechanism: str = "SCRAM-SHA-512",
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Reader options: one topic from its beginning, going on if old offsets are gone.

    ``min_partitions`` lets more tasks parse JSON than the topic has partitions.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    if username is not None:
        login = "org.apache.kafka.common.security.scram.ScramLoginModule"
        options["kafka.security.protocol"] = protocol
        options["kafka.sasl.mechanism"] = mechanism
        options["kafka.sasl.jaas.config"] = f'{login} required username="{username}" password="{password or ""}";'
    return options


def kafka_changes(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Stream of the topic's messages."""
    return messages_of(spark.readStream.format("kafka").options(**options).load())


def messages_of(source: DataFrame) -> DataFrame:
    """What a change needs of a source with Kafka's columns: key and value as text, where and when it stands."""
    return source.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("message_time"),
    )


def next_offsets(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """topic, partition and the offset that comes next, after ``messages`` and those that ``known`` tells of."""
    ends = messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
    if known is None:
        return ends
    return ends.unionByName(known).groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))


def lost_offsets(messages: DataFrame, known: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Offsets that a source passed over: topic, partition, first_lost and last_lost of every gap.

    The reader goes on where old offsets are gone (``failOnDataLoss`` is off), so this is what tells
    of it. ``known`` is ``next_offsets`` of the batches before: a gap at a batch's border counts as
    one inside it, offsets before the border were seen then and are not looked at again. Without it
    a partition begins where its first message is. Compacted topics have gaps by nature.

    Gaps are found within blocks of offsets, however many messages a partition has, and between the
    first and last offset of each block.
    """
    at = F.col("offset")
    seen = messages.select("topic", "partition", "offset")
    if known is not None:
        ends = known.withColumnsRenamed({"topic": "_topic", "partition": "_partition"})
        seen = (
            seen.join(ends, [F.col("topic") == F.col("_topic"), F.col("partition") == F.col("_partition")], "left")
            .filter(F.coalesce(at >= F.col("next_offset"), F.lit(True)))
            .select("topic", "partition", "offset")
        )
    place = ["topic", "partition", "block"]
    blocks = seen.withColumn("block", F.floor(at / block)).dropDuplicates([*place, "offset"])
    before = F.lag("offset").over(Window.partitionBy(*place).orderBy("offset"))
    inside = blocks.withColumn("before", before).select("topic", "partition", "before", "offset")
    borders = blocks.groupBy(*place).agg(F.min("offset").alias("offset"), F.max("offset").alias("last"))
    if known is not None:
        carried = known.select("topic", "partition", F.lit(-1).cast("long").alias("block"), (F.col("next_offset") - 1).alias("last"))
        borders = borders.unionByName(carried, allowMissingColumns=True)
    between = borders.withColumn("before", F.lag("last").over(Window.partitionBy("topic", "partition").orderBy("block")))
    steps = inside.unionByName(between.select("topic", "partition", "before", "offset"))
    return steps.filter(F.col("offset") > F.col("before") + 1).select(
        "topic", "partition", (F.col("before") + 1).alias("first_lost"), (at - 1).alias("last_lost")
    )

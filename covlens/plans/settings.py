"""Session settings for running the library on a large cluster.

The operators leave strategy to Catalyst and AQE; these settings size what
AQE works with. Shuffle partitions are an upper bound that AQE coalesces
down to the advisory size at run time, so it is sized from the input, not
tuned per query. The broadcast thresholds are the size checks behind every
join the library leaves to the planner.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

GIB = 1 << 30
MIB = 1 << 20


def scale_settings(input_bytes: int, total_cores: int, advisory_bytes: int = 256 * MIB,
                   broadcast_bytes: int = 64 * MIB, max_shuffle_partitions: int = 50_000) -> dict[str, str]:
    """Settings for a job reading ``input_bytes`` on ``total_cores`` executor cores.

    About one shuffle partition per GiB of input (partial aggregation and
    column pruning shrink the shuffle well below the input), at least two per
    core, at most ``max_shuffle_partitions``.
    """
    partitions = min(max(2 * total_cores, -(-input_bytes // GIB)), max_shuffle_partitions)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # On a shared cluster, coalesce to the advisory size rather than to the most tasks.
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(advisory_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * advisory_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(advisory_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.parquet.filterPushdown": "true",
        # Keyed stream state on the executors' disks instead of in their memory.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.session.timeZone": "UTC",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> None:
    """Set the settings that can change in a running session."""
    for key, value in settings.items():
        spark.conf.set(key, value)

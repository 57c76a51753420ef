"""First-seen events of a stream (D01 as Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.graph import DEDUP_RULES, _rule_key


def first_seen(events: DataFrame, rules: dict[int, list[str]] = DEDUP_RULES, time: str | None = None, within: str = "1 day") -> DataFrame:
    """Events whose (host, class, key) is new; classes without a rule pass.

    Without a time column the state holds every key for ever, which is the batch operator's meaning. With one, keys older
    than ``within`` are forgotten and let in again: bounded state, another meaning.
    """
    keyed = events.withColumn("_key", F.coalesce(_rule_key(rules), F.concat(F.lit("\u0001"), F.col("seq").cast("string"))))
    columns = ["hostname", "event_id", "_key"]
    if time is None:
        return keyed.dropDuplicates(columns).drop("_key")
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(columns).drop("_key")

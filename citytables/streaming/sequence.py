"""Feature sequences as streams: header overlay, duplicate ids, running summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.sources.document import is_feature, overlay


def read_feature_stream(spark: SparkSession, path: str, header: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Features (feature_id, value map) of the text files in a folder, each with the header's members below its own."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).where(F.trim("value") != "")
    features = lines.where(is_feature(F.col("value")))
    members = overlay(F.lit(header), F.col("value")) if header is not None else F.from_json("value", "map<string,string>")
    return features.select(F.get_json_object("value", "$.id").alias("feature_id"), members.alias("members"))


def summary_stream(features: DataFrame) -> DataFrame:
    """Running number of features and objects, for output mode complete."""
    objects = F.size(F.map_keys(F.from_json(F.col("members")["CityObjects"], "map<string,string>")))
    return features.groupBy().agg(F.count("*").alias("n_features"), F.sum(objects).alias("n_objects"))


def failing_on_duplicates(features: DataFrame) -> DataFrame:
    """feature_id and members of the features; an id that came before, in this or an earlier batch, ends the query with an error.

    The state is one mark for each id, for as long as the query lives: a repeat can come at any time. Ids are
    checked a group of keys at a time, in Arrow batches.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def check(key, frames, state):
        rows = [f for f in frames if len(f)]
        if sum(len(f) for f in rows) > 1 or state.exists:
            raise ValueError(f"duplicate feature: {key[0]}")
        state.update((1,))
        yield from (pd.DataFrame({"feature_id": f["feature_id"], "text": f["text"]}) for f in rows)

    as_text = features.select("feature_id", F.to_json("members").alias("text"))
    checked = as_text.groupBy("feature_id").applyInPandasWithState(check, "feature_id string, text string", "seen int", "append", GroupStateTimeout.NoTimeout)
    return checked.select("feature_id", F.from_json("text", "map<string,string>").alias("members"))


def append_stream(features: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each batch to a Parquet table, once each."""
    return features.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type and time window, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

"""Images as rows: the files of a folder, and raw pixel structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, date, content) of the files of a folder and its subfolders; date is the file's time in milliseconds."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.unix_millis("modificationTime").alias("date"), "content")


def frame_times(videos: DataFrame, frames: int = 10) -> DataFrame:
    """(video_id, frame, time_us) at equal steps over duration_us; none for videos without a duration."""
    if frames < 1:
        raise ValueError("frames must be positive")
    known = videos.where("duration_us > 0").select("video_id", "duration_us", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    return known.select("video_id", "frame", F.expr(f"(frame * duration_us) div {frames}").alias("time_us"))

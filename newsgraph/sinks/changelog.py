"""Day-partitioned CSV log of new journalists, and its retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgraph.functions.rows import reorder
from newsgraph.staging import hadoop_fs

# Column order of the log and the columns it leaves out.
LOG_FIRST = ["email", "name", "state", "country", "association", "media_link", "website", "about_info"]
LOG_REMOVED = ["journalist_id", "designation", "tags"]
KEEP_DAYS = 3


def log_layout(journalists: DataFrame) -> DataFrame:
    return reorder(journalists, LOG_FIRST, LOG_REMOVED)


def log_folder(root: str, day: dt.date, batch: int | str) -> str:
    return f"{root.rstrip('/')}/log_date={day.isoformat()}/batch={batch}"


def log_written(spark: SparkSession, root: str, day: dt.date, batch: int | str) -> bool:
    """Whether the log of a batch was written to its end."""
    fs, done = hadoop_fs(spark, f"{log_folder(root, day, batch)}/_SUCCESS")
    return fs.exists(done)


def write_log(journalists: DataFrame, root: str, day: dt.date, batch: int | str) -> str:
    """Write the rows quoted, with a header, to a folder of their own.

    A batch that is written again replaces its own folder and nothing else.
    """
    path = log_folder(root, day, batch)
    rows = log_layout(journalists)
    text = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))
    (
        text.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(root)
    )


def kept(df: DataFrame, day: str, as_of: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Rows that are not older than ``days`` days."""
    return df.where(F.col(day) >= as_of - F.make_dt_interval(F.lit(days)))


def drop_old_logs(spark: SparkSession, root: str, as_of: dt.date, days: int = KEEP_DAYS) -> list[str]:
    """Remove the day folders older than ``days`` days; returns their dates."""
    oldest = (as_of - dt.timedelta(days=days)).isoformat()
    fs, folder = hadoop_fs(spark, root)
    if not fs.exists(folder):
        return []
    removed = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("log_date=") and name.removeprefix("log_date=") < oldest:
            fs.delete(status.getPath(), True)
            removed.append(name.removeprefix("log_date="))
    return sorted(removed)

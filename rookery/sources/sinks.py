"""Writers: JSON lines, CSV, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = (
    "run", "game", "config", "model", "harness", "level", "color", "result", "score",
    "termination", "plies", "acpl", "cost_usd", "claude_moves", "claude_seconds",
)


def write_jsonl(df: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite"):
    """One JSON object per row, NULL fields kept; compression='gzip' for the raw-call sink."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def write_games_csv(games: DataFrame, path: str, mode: str = "overwrite"):
    """Fixed column order, None for NULL, double quotes inside termination turned into single."""
    text = F.replace(F.col("termination"), F.lit('"'), F.lit("'"))
    flag = F.initcap(F.col("harness").cast("string"))
    rows = games.withColumn("termination", text).withColumn("harness", flag).select(*CSV_COLUMNS)
    rows.write.mode(mode).csv(path, header=True, nullValue="None")


def write_text(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite"):
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)

"""Live measurements: gates, derived features and sums over growing folders (SRC-08).

Gates and most recipes work row by row and run unchanged on streams. Means, deviations, counts and histograms with fixed
edges keep small states; a replay after a failure gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.functions.numeric import finite_or_null
from flowloom.operators.density import histogram


def watch(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """Events that writers commit to a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_statistics(events: DataFrame, features: Sequence[str], gate: Column, by: Sequence[str] = ()) -> DataFrame:
    """Events, %-gated, and mean and deviation of features so far."""
    inside = F.coalesce(gate, F.lit(False))
    cells = [F.count_if(inside).alias("Events"), (F.avg(inside.cast("int")) * 100).alias("%-gated")]
    for f in features:
        x = F.when(inside, finite_or_null(f))
        cells += [F.avg(x).alias(f"Mean {f}"), F.stddev_pop(x).alias(f"SD {f}")]
    return events.groupBy(*by).agg(*cells) if by else events.groupBy().agg(*cells)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, gate: Column, by: Sequence[str] = ()) -> DataFrame:
    """Gated events for each window of time; events later than `late` are left out."""
    return events.withWatermark(time, late).where(gate).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def running_histogram(events: DataFrame, x: str, y: str, bins: tuple[int, int], ranges: Sequence[float]) -> DataFrame:
    return histogram(events, x, y, bins, ranges)

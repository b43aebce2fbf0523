"""Small public series, and a simulator."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Monthly airline passengers in thousands, 1949 to 1960.
AIR_PASSENGERS = (
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140,
    145, 150, 178, 163, 172, 178, 199, 199, 184, 162, 146, 166, 171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194,
    196, 196, 236, 235, 229, 243, 264, 272, 237, 211, 180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229,
    242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317, 313, 318, 374, 413, 405, 355, 306, 271, 306,
    315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336, 340, 318, 362, 348, 363, 435, 491, 505, 404, 359, 310, 337,
    360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432,
)
#: Yearly lynx trappings, 1821 to 1934.
LYNX = (
    269, 321, 585, 871, 1475, 2821, 3928, 5943, 4950, 2577, 523, 98, 184, 279, 409, 2285, 2685, 3409, 1824, 409, 151, 45, 68, 213,
    546, 1033, 2129, 2536, 957, 361, 377, 225, 360, 731, 1638, 2725, 2871, 2119, 684, 299, 236, 245, 552, 1623, 3311, 6721, 4254, 687,
    255, 473, 358, 784, 1594, 1676, 2251, 1426, 756, 299, 201, 229, 469, 736, 2042, 2811, 4431, 2511, 389, 73, 39, 49, 59, 188,
    377, 1292, 4031, 3495, 587, 105, 153, 387, 758, 1307, 3465, 6991, 6313, 3794, 1836, 345, 382, 808, 1388, 2713, 3800, 3091, 2985, 3790,
    374, 81, 80, 108, 229, 399, 1132, 2432, 3574, 2935, 1537, 529, 485, 662, 1000, 1590, 2657, 3396,
)


def _table(spark: SparkSession, start: str, step: str, values) -> DataFrame:
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, value double")
    return rows.select(F.expr(f"cast(date'{start}' + make_interval({step}) as date)").alias("date"), "value")


def air_passengers(spark: SparkSession) -> DataFrame:
    return _table(spark, "1949-01-01", "0, i", AIR_PASSENGERS)


def lynx(spark: SparkSession) -> DataFrame:
    return _table(spark, "1821-01-01", "i", LYNX)


def series_file(spark: SparkSession, path: str, date: str = "date", value: str = "value") -> DataFrame:
    """A longer public series from a CSV file with a date and a value column."""
    return spark.read.csv(path, header=True, schema=f"`{date}` date, `{value}` double").select(F.col(date).alias("date"), F.col(value).alias("value"))


def simulate_seasonal(spark: SparkSession, n: int, m: int, *, level: float = 100.0, trend: float = 0.5, amplitude: float = 10.0, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """(t, value): trend, a sine of period m, and normal noise."""
    t = F.col("id") + 1
    value = F.lit(level) + trend * t + amplitude * F.sin(t * (2 * math.pi / m)) + noise * F.randn(seed)
    return spark.range(n).select(t.alias("t"), value.alias("value"))

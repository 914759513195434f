"""Time and memory that a tree method is expected to take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (n^2, n^2 loci / processes, constant) of seconds and (n^2, constant) of bytes, by platform and matrix; n^3 of neighbour joining.
SQUARES = {
    ("windows", "asymmetric"): ((5.600754e-6, 6.22306e-9, 22.71), (182.16, 282674000)),
    ("other", "asymmetric"): ((2.431284e-6, 2.701426667e-9, 33.753), (103.77, 516625000)),
    ("windows", "symmetric"): ((3.362214e-6, 3.735793333e-9, 20), (70.140, 292156000)),
    ("other", "symmetric"): ((2.272428e-6, 2.52492e-9, 32.625), (66.297, 429570000)),
}
CUBES = {"windows": 1.149e-8, "other": 1.1042e-8}
CUBE_BYTES = (0.058292, 1.39e6, -9.86e8)
LEAST_SECONDS, LEAST_BYTES = 5, 50 * 1024 * 1024


def estimate(n: Column, loci: Column, method: str, matrix: str, processes: int = 5, platform: str = "other") -> tuple[Column, Column]:
    """Seconds and bytes for n distinct profiles. Methods without an estimate (distance, fastme, goeBurst) give nulls."""
    if method in ("MSTree", "MSTreeV2", "RapidNJ", "ninja"):
        (a, b, c), (d, e) = SQUARES[platform, "asymmetric" if matrix == "asymmetric" or method == "MSTreeV2" else "symmetric"]
        seconds, size = a * n * n + b * loci * n * n / processes + c, d * n * n + e
    elif method == "NJ":
        seconds, size = CUBES[platform] * n * n * n, F.greatest(CUBE_BYTES[0] * n * n * n, CUBE_BYTES[1] * n + CUBE_BYTES[2])
    else:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    return F.greatest(seconds, F.lit(LEAST_SECONDS)), F.greatest(size, F.lit(LEAST_BYTES))

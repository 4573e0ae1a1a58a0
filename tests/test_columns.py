from __future__ import annotations

import random

from pyspark.sql import functions as F

from auditweave.functions.columns import fixed_bytes, readable_bytes


def test_bytes_are_rounded_as_printf_does(spark):
    """Halves go to even, and the largest unit is the caller's."""
    rng = random.Random(5)
    values = [0, 1, 1023, 1024, 1280, 1152, 1408, 1 << 20, (1 << 20) - 1, (1 << 20) + (1 << 18), (1 << 30) - 1, 1 << 30, 7 << 30, (1 << 41) + 5, *[rng.randrange(1 << 42) for _ in range(50)]]
    rows = spark.createDataFrame([(v,) for v in values], "n long")
    for r in rows.select("n", readable_bytes(F.col("n"), "MB").alias("mb"), readable_bytes(F.col("n")).alias("all"), fixed_bytes(F.col("n"), "KB").alias("kb")).collect():
        assert r.kb == f"{r.n / 1024:.2f} KB"
        assert r.mb == (f"{r.n / (1 << 20):.1f} MB" if r.n >= 1 << 20 else f"{r.n / 1024:.1f} KB" if r.n >= 1024 else f"{r.n} B")
        size, unit = next(((s, u) for s, u in ((1 << 40, "TB"), (1 << 30, "GB")) if r.n >= s), (0, ""))
        assert r["all"] == (f"{r.n / size:.1f} {unit}" if size else r.mb)

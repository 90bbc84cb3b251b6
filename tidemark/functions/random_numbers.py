"""Reproducible random series per key (Mersenne twister)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniform_series(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` numbers in [0, 1], both ends included, for each key's integer seed: ``key, step, value``.

    A key's numbers depend on its seed only, not on partitions.
    """

    def run(frames):
        for f in frames:
            rows = []
            for k, s in zip(f["__key"], f["__seed"]):
                generator = np.random.RandomState(int(s) & 0xFFFFFFFF)
                x = generator.randint(0, 1 << 32, n, dtype=np.uint32).astype(float) / ((1 << 32) - 1)
                rows.append(pd.DataFrame({key: k, "step": np.arange(n, dtype=np.int64), "value": x}))
            if rows:
                yield pd.concat(rows)

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("__key"), F.col(seed).alias("__seed")).mapInPandas(run, f"{key} {kind}, step long, value double")

"""Table functions for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from epochlens.operators.scan import ScanConfig, scan_delta, seed_chi2

STRETCH = [T.StructField("start", T.LongType()), T.StructField("end_exclusive", T.LongType()), T.StructField("chi2_final", T.DoubleType())]
CONTENT = "content"


class FixedWindows:
    """``fixed_windows(content, width, threshold)``: ciphertext-like stretches of one value, for lateral use.
    ``fixed_windows(TABLE(t) [PARTITION BY (...)], width, threshold)``: those of every row of a table with a ``content``
    column, with the row's other columns in front. A null content has none."""

    @staticmethod
    def analyze(content: AnalyzeArgument, width: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        carried = []
        if content.isTable:
            if CONTENT not in content.dataType.names:
                raise ValueError(f"the table has no column {CONTENT!r}")
            carried = [f for f in content.dataType.fields if f.name != CONTENT]
        return AnalyzeResult(T.StructType([*carried, *STRETCH]))

    def eval(self, content, width, threshold):
        front = ()
        if isinstance(content, Row):
            front = tuple(v for k, v in zip(content.__fields__, content) if k != CONTENT)
            content = content[CONTENT]
        cfg = ScanConfig(width=width, chi2_threshold=float(threshold), expand=False)
        data = np.frombuffer(content or b"", np.uint8)
        seeds = seed_chi2(data, cfg.width)[: max(0, data.size - cfg.width + 1)]
        for start, end, _, _, _, chi2 in scan_delta(data, seeds, cfg):
            yield (*front, start, end, chi2)


fixed_windows = udtf(FixedWindows)


def register(spark: SparkSession) -> None:
    spark.udtf.register("fixed_windows", fixed_windows)

"""A table that several branches of a plan read is worked out once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder (spark.checkpoint.dir; a local one only in local mode where none is set)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='khata-')}"
        context.setCheckpointDir(folder)
    return df.checkpoint()

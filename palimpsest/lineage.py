"""Lineage cuts of the text-reuse stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``, which survives lost executors; plans start anew from it.

    Only where the session names none (tests on one machine) is a temporary folder made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
    return df.checkpoint(eager=True)

"""Cutting the lineage of iterative plans, and the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def own_folder() -> str:
    """One temporary folder a process, for sessions that run in it alone."""
    return tempfile.mkdtemp(prefix="narrata-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and all runs in one local process (tests) is a temporary folder taken; on a
    cluster such a folder would be lost with its machine, so there its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or own_folder()


def settle(frame: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder, so that a lost executor loses nothing."""
    sc = frame.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)

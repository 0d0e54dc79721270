"""Tables that a job writes on its way, so that what follows reads files and a lost executor costs a re-read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the folder that ``spark.checkpoint.dir`` names and read from there, in the same partitions each time.

    Where the setting is missing, a local run gets a folder of its own; a cluster gets an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="tidewave-")
        sc.setCheckpointDir(path)
    return df.checkpoint(eager=True)

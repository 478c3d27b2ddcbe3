"""What all modules share: the folder for checkpoints and cutting of lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local master (tests) may do without: it gets a fresh local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that checkpoints go to, which all executors see."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: iterations re-read their state after a lost executor instead of redoing all rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()

"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings every faresight job expects; applied only where the session
# does not already carry a value, so a cluster's own config wins.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "faresight",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with faresight's defaults."""
    b = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (a shared file system): a
    folder of the driver's own would be another one on each executor, and
    reads would miss rows, so its absence is an error there. Only a local
    session -- tests -- gets a private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="faresight-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that have not
    been written or collected still read them, so call it after that."""
    folder = os.path.join(ensure_checkpoint_dir(spark), "faresight", spark.sparkContext.applicationId or "app")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back.

    Used for intermediates read more than once (deduped fares, feature
    frames, encoders, counts): the upstream shuffle runs once, lineage is
    cut (a lost executor re-reads files instead of recomputing), and the
    reader gets exact sizes for broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)       # no job to infer it


def materialize_counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """``materialize`` that also returns the row count, observed during
    the same write job (no second pass)."""
    out, rows, _ = materialize_sized(df, name, sized=False)
    return out, rows


def materialize_sized(df: DataFrame, name: str = "table", sized: bool = True
                      ) -> tuple[DataFrame, int, int]:
    """``materialize`` with the row count and the bytes of all values as
    text, both observed during the write."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    width = F.octet_length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    bytes_ = F.sum(width.cast("bigint")) if sized else F.max(F.lit(0))
    df.observe(obs, F.count(F.lit(1)).alias("rows"), bytes_.alias("bytes")).write.mode("overwrite").parquet(path)
    got = obs.get
    return spark.read.schema(df.schema).parquet(path), int(got["rows"]), int(got["bytes"] or 0)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder,
    grouped per application (``<dir>/faresight/<application id>/<name>``)
    so a finished job's scratch can be expired as one folder."""
    app = spark.sparkContext.applicationId or "app"
    return os.path.join(ensure_checkpoint_dir(spark), "faresight", app, name)

"""Session helpers: table access, and cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session that this library starts itself; a session given by the caller is never changed.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def session(name: str = "citeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SESSION_CONF; conf overrides, with '__' for '.' in the keys."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SESSION_CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table `name` of the Parquet dataset folder `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local master gets a temporary one; on a cluster that is an error,
    as a machine-local folder isn't seen by the other machines."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return str(kept.get()).rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="citeloom-")
    sc.setCheckpointDir(made)
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def _remove_all() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended
            pass


atexit.register(_remove_all)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: one computation for several uses, with a lineage that starts
    at files all executors see, so a lost executor costs no earlier stage. The files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)

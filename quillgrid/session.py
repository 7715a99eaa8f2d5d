"""Engine settings and the Spark session."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Config:
    """Settings of the engine; everything else is left to Spark's own configuration.

    block_dim_size: rows and columns of a block of the blocked encoding.
    broadcast_rows: an operand of a block product is replicated to all tasks only if
        it is counted and has at most so many cells.
    number_of_partitions: shuffle partitions of the block kernels; None: the session's.
    use_map_join: send an operand of at most ``broadcast_rows`` cells to all tasks.
    group_by_join: multiply blocked operands on a grid of tasks (one shuffle of each
        operand, replicated along the grid's side) instead of a join and an aggregation.
    checkpoint_every: arrays that a while loop assigns are written to the shared folder
        after every so many rounds, so that plans stay small and survive lost executors.
    plan_scans: an assigned array whose plan has grown past so many scans is written to
        the shared folder as well.
    trace: print the rewritten comprehensions and the plans.
    """

    block_dim_size: int = 1000
    broadcast_rows: int = 1_000_000
    number_of_partitions: int | None = None
    use_map_join: bool = True
    group_by_join: bool = False
    checkpoint_every: int = 1
    plan_scans: int = 24
    trace: bool = False


config = Config()


def parami(name: str, value: int) -> None:
    """Set an integer setting."""
    names = {"block_dim_size": "block_dim_size", "number_of_partitions": "number_of_partitions", "broadcast_limit": "broadcast_rows"}
    if name not in names:
        raise KeyError(f"no integer setting {name}")
    setattr(config, names[name], int(value))


def param(name: str, value: bool) -> None:
    """Set a switch; those that name another engine's strategies are accepted and without effect, as Catalyst decides them."""
    if name == "trace":
        config.trace = bool(value)
    elif name == "groupByJoin":
        config.group_by_join = bool(value)
    elif name == "use_map_join":
        config.use_map_join = bool(value)
    elif name not in ("parallel", "mapPreserve", "data_frames"):
        raise KeyError(f"no switch {name}")


def session(**settings) -> SparkSession:
    b = SparkSession.builder.appName("quillgrid").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillgrid-"))
    return "file://" + _own[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read back: lineage ends there.  The files go when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillgrid/array-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete files that no later plan reads."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass

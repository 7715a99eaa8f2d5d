"""Helpers shared by the corpus operators: staging tables, word hashing, ranks.

Text rule used by every word-level operator: bytes A-Z are lower-cased, and words
are maximal runs of bytes other than space, tab, LF, VT, FF and CR.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- staging

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach: ``spark.checkpoint.dir``.

    A local temporary folder is used only where the session names none and runs in
    one process (tests); on a cluster the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quillgrid-"))
    return "file://" + _own_dir[0]


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> Iterator[None]:
    """Inside: Arrow batches of at most ``rows`` rows and about ``size`` bytes, where the session allows more (texts are
    long, and a batch is held by the JVM and by Python); the session's settings are put back at the end.  What is to run
    so must be written inside."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {n: spark.conf.get(n) for n in names}
    for n, most in names.items():
        now = before[n].lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(n, str(most))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillgrid/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends here, so a lost executor costs a re-read and not a recomputation,
    and non-deterministic columns (partition ids) are frozen.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)


def stage_alone(df: DataFrame, name: str) -> DataFrame:
    """As ``stage``; what was shuffled for it leaves the disks when it is written, not when the driver happens to collect its garbage."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        return stage(df, name)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


# ---------------------------------------------------------------- hashing

SPACES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_TABLE[65:91] = _TABLE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """Words of a run of texts: hashes, byte spans and the texts' word offsets."""

    __slots__ = ("bounds", "data", "ends", "hashes", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: bytes of all texts; offsets: where each begins, and the last ends."""
        self.data = data
        word = np.zeros(len(data) + 1, bool)
        np.logical_not(_IS_SPACE[data], out=word[:-1])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (edge | ~before))
        self.ends = np.flatnonzero(before & (edge | ~word))
        up, down = _powers_to(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + size)
        self.bounds = np.searchsorted(self.starts, offsets)


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of about ``limit`` bytes: first row,
    row after the last, bytes, offsets within them.  A null counts as empty.  A longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring words (runs may cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _SHINGLE[0]
    for j in range(1, k):
        total += hashes[j : j + n] * _SHINGLE[j]
    return mix(total)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """As ``window_hashes``, by running sums: the cost does not grow with ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def shingle_set(word: np.ndarray, windows: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the words a to b; fewer than k: one shingle."""
    if b - a >= k:
        return np.unique(windows[a : b - k + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    total = np.uint64(b - a)
    with np.errstate(over="ignore"):
        for j, h in enumerate(word[a:b]):
            total = total + h * _SHINGLE[j + 32]
    return mix(np.array([total], np.uint64))


# ---------------------------------------------------------------- ranks


def gapless_rank(df: DataFrame, group: str, order: list[str], bins: int, out: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 without gaps and without one task per group.

    ``df`` must be staged (it is read twice) and hold a long ``bin`` in [0, bins);
    rows are counted by (group, bin), the counts' running sums are joined back and
    each bin is numbered by itself.  ``group`` must have few values: the counts
    (groups x bins rows) are broadcast.
    """
    counts = df.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        group,
        "bin",
        (F.sum("_n").over(Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    inner = Window.partitionBy(group, "bin").orderBy(*order)
    return (
        df.withColumn("_at", F.row_number().over(inner))
        .join(F.broadcast(before), [group, "bin"])
        .withColumn(out, F.col("_before") + F.col("_at") - 1)
        .drop("_before", "_at", "bin")
    )

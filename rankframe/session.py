"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "rankframe",
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own session."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``rankframe`` importable in Python workers (what ``--py-files`` does for a submit).

    The package is zipped next to its source (``build/rankframe.zip``) and added once per context
    with ``addPyFile``; Spark distributes it to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_rankframe_shipped", False):
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = os.path.join(root, "build")
    os.makedirs(out_dir, exist_ok=True)
    zpath = os.path.join(out_dir, f"rankframe-{os.getpid()}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dp, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dp, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._rankframe_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always honoured; without it a cluster
    session is refused, since a folder of one machine would lose what the others write.  Only a
    ``local`` master (tests) gets a scratch folder of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="rankframe-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if getattr(sc, "_rankframe_ckpt", None) != d:
        sc.setCheckpointDir(d)
        sc._rankframe_ckpt = d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    for scope in _SCOPES:
        scope.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Removes the scratch tables made inside it when it ends; for jobs whose result is written by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Survives executor loss (shared storage, never a local checkpoint), cuts the lineage, and the
    re-read gets column pruning and filter pushdown.  Unlike an RDD checkpoint it carries no stale
    partitioning claim from an adaptive plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int, materialize: bool = False) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows.

    The check is one job on the (expected small) side.  When that side is the end of an expensive
    plan, ``materialize=True`` writes it once (shared checkpoint folder) so the check and the join
    read the same table instead of computing it twice.  Beyond the bound the frame is returned
    unchanged and Spark plans a shuffle join (AQE may still demote it at runtime).
    """
    if materialize:
        df = cut_lineage(df, "small-side")
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def join_unbroadcast(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, a table that grows with the input, without broadcasting ``right``.

    Spark takes the size of a table from its files, and vectors, texts and derived columns may hold many
    times what their compressed, pruned files let it expect: all of it would pass through the driver.
    """
    return left.join(right.hint("merge"), on, how)


#: Rows of an Arrow slice at most (shingle keys have room for 2**14 texts).
SLICE_ROWS = 8192


def arrow_slices(batch, columns, slice_bytes: int):
    """Slices of an Arrow batch or table with about ``slice_bytes`` of text in ``columns``, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False) for c in columns)
    ends, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        stop = min(max(begin + 1, int(np.searchsorted(ends, done + slice_bytes, "right"))), begin + SLICE_ROWS)
        yield batch.slice(begin, stop - begin)
        begin = stop

"""Session defaults and the written-table cut used between passes."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Keeps the compiled code of a whole set of tables, so reruns do not compile again.
    "spark.sql.codegen.cache.maxEntries": "1000",
    # Call-site capture costs more than planning for tables with many columns.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# One fallback folder per application, used only in local mode.
_local_dirs: dict[str, str] = {}


def get_spark(app: str = "driftpanel", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, may fall back to a
    temporary folder. Elsewhere a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="driftpanel-")
    return _local_dirs[context.applicationId]


_FOLDER = "driftpanel"
#: Renewed with every written table; a folder without a fresh one belongs to a run that has ended.
_LEASE = "_LEASE"

# Per application, the open scopes, innermost last, each with the paths written in it.
_scopes: dict[str, list[list[str]]] = {}
_owned: set[str] = set()


def _place(spark: SparkSession, path: str):
    """File system and path object of a path, as Spark's own writers see it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _own_folder(spark: SparkSession) -> str:
    """This application's folder. The file system removes it when the application ends, however
    its code ends; only a killed process leaves it, for ``sweep``."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/{_FOLDER}/{app}"
    fs, place = _place(spark, folder)
    if app not in _owned:
        _owned.add(app)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    fs.create(_place(spark, f"{folder}/{_LEASE}")[1], True).close()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, unique to this application and call, owned by the
    innermost open ``scope``."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    open_scopes = _scopes.get(spark.sparkContext.applicationId)
    if open_scopes:
        open_scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes every table written inside it at its end, also after an error.

    Frames that read such tables must be collected or written before the scope ends. A scope in a
    scope removes only its own tables.
    """
    app = spark.sparkContext.applicationId
    stack = _scopes.setdefault(app, [])
    mine: list[str] = []
    stack.append(mine)
    try:
        yield
    finally:
        stack.remove(mine)
        for path in mine:
            remove(spark, path)


def sweep(spark: SparkSession, hours: float = 72) -> list[str]:
    """Remove the folders of applications that have written nothing for ``hours``, such as killed
    runs, and return them. Never this application's own."""
    base = f"{shared_dir(spark)}/{_FOLDER}"
    fs, place = _place(spark, base)
    if not fs.exists(place):
        return []
    gone = []
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if not status.isDirectory() or name == spark.sparkContext.applicationId:
            continue
        lease = _place(spark, f"{base}/{name}/{_LEASE}")[1]
        touched = fs.getFileStatus(lease) if fs.exists(lease) else status
        if time.time() - touched.getModificationTime() / 1000 > hours * 3600:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Used where several passes read the same shuffled result: the heavy lineage runs once, later
    passes are column-pruned scans, and a lost executor re-reads files instead of re-shuffling.
    A failed write leaves nothing behind.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        df.write.parquet(path)
    except Exception:
        remove(spark, path)
        raise
    return spark.read.schema(df.schema).parquet(path)


def commit(spark: SparkSession, folder: str, write: Callable[[str], Sequence[str]]) -> None:
    """Publish a set of tables in ``folder`` as one.

    ``write`` stores them under the staging folder that it is given and names them. Only when all
    are there do they take their places, and the marker ``_COMPLETE`` lists them last; it is removed
    first, so a reader that waits for it never sees tables of two runs. After an error the staging
    folder is gone and what was published before stays.
    """
    staging = f"{folder}/_staging-{uuid.uuid4().hex[:12]}"
    marker = f"{folder}/_COMPLETE"
    fs, place = _place(spark, staging)
    try:
        names = list(write(staging))
        fs.delete(_place(spark, marker)[1], False)
        for name in names:
            target = _place(spark, f"{folder}/{name}")[1]
            fs.delete(target, True)
            if not fs.rename(_place(spark, f"{staging}/{name}")[1], target):
                raise OSError(f"could not publish {name} in {folder}")
        out = fs.create(_place(spark, marker)[1], True)
        out.write(bytearray("\n".join(sorted(names)).encode()))
        out.close()
    finally:
        fs.delete(place, True)


def settled(df: DataFrame) -> DataFrame:
    """Mark a frame as a plain read of a written table, whose files tell Spark its size."""
    df._settled = True
    return df


def is_settled(df: DataFrame) -> bool:
    return getattr(df, "_settled", False)

"""Session helpers: settings the library relies on and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# A key with more rows than this is laid out over several tasks.
BLOCK_ROWS = 2_000_000
# A lookup table is broadcast only when it has been counted and is no longer than this.
BROADCAST_ROWS = 200_000


#: Bytes of a batch that goes to Python, unless the session has its own setting. Spark's row limit alone lets a task's
#: texts pass as one batch, which both the executor and its Python workers then hold outside the heap.
ARROW_BYTES = "2m"

#: What the open ``scratch`` blocks, outermost first, have to release.
_SCOPES: ContextVar[tuple[list[Callable[[], object]], ...]] = ContextVar("scopes", default=())


def build_session(cores: int | str = "*", partitions: int | None = None, app: str = "lapcast") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"lapcast.{name}", str(default)))


def block_rows(spark: SparkSession) -> int:
    return setting(spark, "blockRows", BLOCK_ROWS)


def broadcast_rows(spark: SparkSession) -> int:
    return setting(spark, "broadcastRows", BROADCAST_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without a setting."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured is None:
        configured = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lapcast-")
        context.setCheckpointDir(configured)
        configured = context.getCheckpointDir()
    return configured


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes, at its end, the tables that ``written`` makes inside and drops what ``held`` keeps in memory.

    For work whose result is stored, with ``keep`` or elsewhere, before the block ends. After an error all stay.
    """
    mine: list[Callable[[], object]] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
    for release in mine:
        release()


def _released_later(release: Callable[[], object], outer: int = 0) -> None:
    scopes = _SCOPES.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(release)


def held(df: DataFrame) -> DataFrame:
    """Persisted until the innermost ``scratch`` block ends, if there is one."""
    df = df.persist()
    _released_later(df.unpersist)
    return df


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside send batches of about ``ARROW_BYTES`` to Python; a setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None) is not None
    if not own:
        spark.conf.set(name, ARROW_BYTES)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(name)


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Compute once into a Parquet table in the shared folder: later scans prune columns.

    The innermost ``scratch`` block removes the table at its end; with ``keep`` only the block around that one does.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)

    def remove() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    _released_later(remove, int(keep))
    df.write.parquet(path)
    return spark.read.parquet(path)

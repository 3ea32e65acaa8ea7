"""Session, tables and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quaverlake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="quaverlake-code-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "quaverlake_code.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(folder / "quaverlake_code.zip"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is unset and the session is local, a temporary folder is made; on a
    cluster without it this raises, for a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quaverlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, True)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted at the end of the driver at the latest."""
    path = f"{shared_folder(spark).rstrip('/')}/quaverlake/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written[path] = spark
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """:func:`cut_counted` without the count."""
    return cut_counted(df, False)[0]


def cut_counted(df: DataFrame, count: bool = True) -> tuple[DataFrame, int]:
    """``df`` written as a table in the shared folder and read again: lineage ends there.

    Unlike after ``checkpoint()`` the planner knows the true size of what it reads, which keeps
    the estimates of iterative plans from growing with every round. Written tables live until
    :func:`release` or the end of the driver. Its rows are counted as they are written.
    """
    spark = df.sparkSession
    path = scratch(spark)
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("n")) if count else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"] if count else -1


_written: dict[str, SparkSession] = {}


def release(*dfs: DataFrame) -> None:
    """Deletes the tables that :func:`cut` wrote for ``dfs``, once nothing reads them any more."""
    for df in dfs:
        for f in df.inputFiles()[:1]:
            path = f.rpartition("/")[0]
            for known in [k for k in _written if path.endswith(k.partition("://")[2].rstrip("/") or k)]:
                _delete(known)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    try:
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder goes with it
        pass


def _sweep() -> None:
    for path in list(_written):
        _delete(path)


#: A side of a join is broadcast only up to so many rows and bytes of text; beyond, Catalyst shuffles it.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of ``size`` bytes together, else as it is.

    Bytes are those of the rows as JSON. The count stops at the bound of rows, so a large side is not
    read whole to find out. Give it a table or a result of :func:`cut`, which is cheap to read again.
    """
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def current(tracks: DataFrame, *cols: str) -> DataFrame:
    """The present state of every id: ``cols`` of its row with the newest ``updated_at``.

    Rows of one id that tie on ``updated_at`` (repeats) give one row, that with the largest
    values; rows without id are dropped. One shuffle, with partial aggregation before it.
    """
    cols = cols or tuple(c for c in tracks.columns if c != "id")
    s = F.max(F.struct(F.coalesce(F.col("updated_at"), F.lit(-(2**62))).alias("__u"), *[F.col(c).alias(c) for c in cols]))
    return (
        tracks.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(s.alias("__s"))
        .select("id", *[F.col("__s")[c].alias(c) for c in cols])
    )

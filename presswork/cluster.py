"""What a cluster shares: the package on the Python workers, and tables between jobs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The setting that frees the shuffle files of a finished query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application.

    They need not have it on their path: Spark's own file server hands it out.
    """
    sc = spark.sparkContext
    if getattr(sc, "_presswork_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="presswork-")) / "presswork_modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((top / "presswork").rglob("*.py")):
            z.write(source, source.relative_to(top))
    sc.addPyFile(str(archive))
    sc._presswork_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop) a local one is set once;
    on a cluster executors would not see each other's files there, so that is an
    error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="presswork-"))
    return shared_dir(spark)


@contextmanager
def free_shuffles(spark: SparkSession):
    """Queries run inside free their shuffle files as soon as they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The copy outlives lost executors. Shuffle files of the write are freed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/presswork/{name}-{uuid.uuid4().hex}"
    with free_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._presswork_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is; none there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``; later reads fail."""
    path = getattr(df, "_presswork_path", None)
    if path:
        delete(df.sparkSession, path)

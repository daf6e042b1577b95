"""Helpers shared by the corpus operators: table access, durable cut points and row keys."""

from __future__ import annotations

import contextlib
import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: from the driver's folder on one machine, else from an archive that Spark hands out."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    elif getattr(context, "_corpus_archive", None) is None:
        context._corpus_archive = archived(spark)
        context.addPyFile(context._corpus_archive)


def archived(spark: SparkSession) -> str:
    """This package as an archive in the shared folder, from where executors can import it."""
    top = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, path.relative_to(top.parent))
    name = f"{shared_dir(spark)}/{top.name}-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    files.deleteOnExit(path)
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where the session names none (tests on one machine) a temporary folder is set for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more; it acts on the driver's garbage."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Computes `df` once, into the shared folder, and goes on from those files.

    Survives the loss of executors; Spark's cleaner may remove the files once nothing refers to them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """As `cut`, but as a Parquet table: columnar and compressed, for wider or larger intermediates.

    The table stays until the application ends, since results may be read from it at any time before.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(folder)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with its columns of these names, which an operator needs for itself, under other names; and what gives them theirs back."""
    new = {c: f"{c}{'+' * (i + 1)}{uuid.uuid4().hex[:6]}" for i, c in enumerate(c for c in df.columns if c in names)}
    return df.withColumnsRenamed(new), lambda out: out.withColumnsRenamed({v: k for k, v in new.items()})


def give_back() -> None:
    """Returns memory that this worker's allocators hold for later to the machine: it may idle while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))

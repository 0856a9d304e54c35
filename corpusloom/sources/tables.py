"""Parquet tables of a data directory, and the folder for intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they need no path of the driver's."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="corpusloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(f"{folder}/{root.name}.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Catalyst prunes its columns and pushes filters into the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIR: list[str] = []
#: Folders of stored steps that were not released yet.
_STEPS: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`. Where the session names none a private one is made, but only if all tasks
    run on this machine (tests); on a cluster every worker would write to a disk of its own, so that is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share; intermediate results are stored there")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="corpusloom-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return f"file://{_OWN_DIR[0]}"


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again.

    Cuts the lineage like checkpoint(): the files outlive lost executors, hold only the columns asked for, compressed,
    and later plans see their exact size. They are deleted by `release`, or when the driver ends, on any file system.
    """
    spark = df.sparkSession
    ship(spark)
    folder = f"{scratch_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    _STEPS.append(folder)
    try:
        df.write.parquet(folder)
    finally:
        path, fs = _path(spark, folder)
        fs.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def stream_folder(spark: SparkSession, label: str) -> str:
    """A new folder beside the stored steps for a stream's files and state; it is deleted with them."""
    ship(spark)
    folder = f"{scratch_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    path, fs = _path(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    _STEPS.append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Delete all stored steps so far and give their number; call it when the results of earlier queries have been read.
    What `kept` stored remains."""
    n = len(_STEPS)
    for folder in _STEPS:
        path, fs = _path(spark, folder)
        with contextlib.suppress(Exception):  # gone already
            fs.delete(path, True)
            fs.cancelDeleteOnExit(path)
    _STEPS.clear()
    return n


#: By application, table and label: the table's fingerprint, the folder and what is stored there.
_KEPT: dict[tuple, tuple[str, str, DataFrame]] = {}


def is_folder(spark: SparkSession, folder: str) -> bool:
    path, fs = _path(spark, folder)
    return fs.getFileStatus(path).isDirectory()


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of a table's files."""
    path, fs = _path(spark, folder)
    files = [path] if not is_folder(spark, folder) else [x.getPath() for x in fs.listStatus(path)]
    said = [(f.getName(), s.getLen(), s.getModificationTime()) for f in files for s in [fs.getFileStatus(f)]]
    return str(sorted(said))


def kept(spark: SparkSession, sf_dir: str, name: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` stored last from table `name`, made once in an application, and again when the table's files change or the
    stored ones are gone. `release` leaves it."""
    key = (spark.sparkContext.applicationId, sf_dir, name, label)
    now = fingerprint(spark, f"{sf_dir}/{name}.parquet")
    if key in _KEPT:
        path, fs = _path(spark, _KEPT[key][1])
        if _KEPT[key][0] == now and fs.exists(path):
            return _KEPT[key][2]
    before = len(_STEPS)
    made = make()
    _KEPT[key] = (now, _STEPS[-1], made)
    del _STEPS[before:]
    return made

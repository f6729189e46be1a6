"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, adaptive execution, ANSI left on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on a local master, as in tests, a folder of our own is set where the session names none; on a
    cluster that is an error, as executors would not share it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    now = sc.getCheckpointDir()
    if named:
        if now is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if now is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tesserae-"))
        now = sc.getCheckpointDir()
    return now.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application, through the shared folder.

    Workers import it by name; they need not have it installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    at = f"{shared_root(spark)}/{here.name}-{uuid.uuid4().hex}.zip"
    write_bytes(spark, at, packed.getvalue())
    sc.addPyFile(at)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def local_file(path: str) -> str | None:
    """The plain path of a ``file:`` URI or path without scheme; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """Write one small file through Hadoop's file system; without overwrite an existing file is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    inp = p.getFileSystem(conf).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(inp))
    finally:
        inp.close()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder. Also ships the package, as whatever follows may need it on the executors."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))

"""Folders that driver and executors share, and small files in any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where a local session sets none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/pagewright-{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change in ms) of what a folder holds; none where it is not there."""
    where, fs = _path(spark, folder)
    return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where)] if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _path(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a whole file under a name that is free, or nothing: of several writers one gets True.

    The text goes to a name of its own first. On a local disk a hard link then takes the name, which fails if it is taken;
    elsewhere a rename that does not overwrite does (one atomic step in HDFS; an object store needs a client with conditional
    writes).
    """
    where, fs = _path(spark, path)
    own, _ = _path(spark, f"{path[: path.rindex('/')]}/.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    from py4j.protocol import Py4JJavaError

    try:
        if fs.getScheme() == "file":
            files, local = spark._jvm.java.nio.file.Files, lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            files.createLink(local(where), local(own))
        else:
            options = spark._jvm.org.apache.hadoop.fs.Options
            rename = spark.sparkContext._gateway.new_array(options.Rename, 1)
            rename[0] = options.Rename.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(own, where, rename)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(own, False)

"""The few directory operations that need no Spark job, through the Hadoop file system of the path."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; empty if it does not exist."""
    fs, target = _resolve(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []


def touch(spark: SparkSession, path: str) -> None:
    fs, target = _resolve(spark, path)
    fs.create(target, True).close()


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.delete(target, True)


def bytes_below(spark: SparkSession, path: str) -> int:
    """Total length of the files below ``path``; 0 if it does not exist."""
    fs, target = _resolve(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file as a whole; ``None`` if it does not exist."""
    fs, target = _resolve(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with this content in one step; ``False``, and no change, if it is there already.

    The content is written beside it and renamed without overwriting, so that no reader sees half a file and only one
    of several writers succeeds.
    """
    fs, target = _resolve(spark, path)
    if fs.exists(target):
        return False
    jvm = spark._jvm
    parent = target.getParent()
    fs.mkdirs(parent)
    draft = jvm.org.apache.hadoop.fs.Path(parent, f".{target.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    without_overwriting = spark._sc._gateway.new_array(rename, 1)
    without_overwriting[0] = rename.NONE
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), without_overwriting)
    except Py4JJavaError as failed:
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise failed
    return True

"""Small files of a shared store, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    files, place = _at(spark, folder)
    return sorted(entry.getPath().getName() for entry in files.listStatus(place)) if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    files, place = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Make a small file appear whole or not at all: written beside its place, then renamed.

    A file that is there already is not replaced, and an error is raised.
    """
    files, place = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}.new")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(place) or not files.rename(beside, place):
        raise FileExistsError(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, place = _at(spark, folder)
    files.delete(place, True)

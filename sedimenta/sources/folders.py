"""Where a job may put files that all executors must see."""

from __future__ import annotations

import re
import tempfile
import urllib.parse

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only on a single machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None and re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sedimenta-"))
        named = sc.getCheckpointDir()
    return named


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there; works on drivers and executors alike."""
    if re.match(r"[a-z][a-z0-9+]*:", uri):
        return pafs.FileSystem.from_uri("file://" + urllib.parse.urlparse(uri).path if uri.startswith("file:") else uri)
    return pafs.LocalFileSystem(), uri

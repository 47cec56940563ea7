"""Binary files in the shared folder, written and read by tasks.

A task writes a file under a name no other attempt uses and returns the name with its rows; those rows become a Parquet table
through Spark's own commit. A file of an attempt that was lost or repeated is therefore never named by any table. The folder may
be in any store that pyarrow.fs opens by address."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from trackguard.session import app_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """An address below the shared folder; made here, so that tasks only add files."""
    uri = f"{app_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    return uri


def new_file(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def writer(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_output_stream(path, compression=None)


def reader(uri: str):
    """A file with seek and read."""
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)

"""Where a project's files lie, which of several there is, and what environment runs."""

from __future__ import annotations

import json
import os
import platform
from dataclasses import dataclass
from importlib import metadata

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ProjectPaths:
    """The folders below a project's root, on any file system that Spark reads."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def documents(self) -> str:
        return f"{self.root}/documents"

    @property
    def chunks(self) -> str:
        return f"{self.root}/chunks"

    @property
    def vectors(self) -> str:
        return f"{self.root}/vectors"

    @property
    def manifests(self) -> str:
        return f"{self.root}/manifests"

    @property
    def tables(self) -> str:
        return f"{self.root}/tables"

    def every(self) -> dict[str, str]:
        return {n: getattr(self, n) for n in ("raw", "documents", "chunks", "vectors", "manifests", "tables")}

    def create(self, spark: SparkSession) -> None:
        """Make the folders that are not there."""
        for path in self.every().values():
            _file_system(spark, path).mkdirs(_path(spark, path))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the paths that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def first_match(spark: SparkSession, pattern: str) -> str | None:
    """The path that matches a pattern and comes first by name."""
    found = _file_system(spark, pattern).globStatus(_path(spark, pattern)) or []
    return min((str(f.getPath().toString()) for f in found), default=None)


def project_root(spark: SparkSession, *candidates: str, marker: str = "manifests") -> str:
    """The first of the folders that holds the marker; an error if none does."""
    found = next((c for c in candidates if exists(spark, f"{c}/{marker}")), None)
    if found is None:
        raise FileNotFoundError(f"no project in {', '.join(candidates)}")
    return found


def environment_report(spark: SparkSession, packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> DataFrame:
    """name, version of the platform, the language, the engine and the packages; null for one that is not installed."""

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    rows = [("platform", platform.platform()), ("python", platform.python_version()), ("spark", spark.version), *((p, version(p)) for p in packages)]
    return spark.createDataFrame(rows, "name string, version string")


def write_bodies(items: DataFrame, root: str) -> DataFrame:
    """Writes each item's body and metadata below root/source_id/snapshot_id/item_id and returns their paths.

    items: what sources.raw.raw_items gives. Every task writes its own rows; a file
    that is written again by a retried task is the same. Returned: snapshot_id,
    source_id, item_id, local_body_path (relative to root), byte_size; reading it writes.
    """

    def write(batches):
        system, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        for batch in batches:
            paths = []
            for row in batch.to_pylist():
                folder = f"{row['source_id']}/{row['snapshot_id']}/{row['item_id']}"
                system.create_dir(f"{base}/{folder}", recursive=True)
                body = f"{folder}/body{row['extension']}"
                with system.open_output_stream(f"{base}/{body}") as f:
                    f.write(row["content"] or b"")
                about = {k: row[k] for k in ("snapshot_id", "source_id", "item_id", "url", "fetched_at", "status_code", "content_type", "encoding", "sha256", "byte_size")} | {"local_body_path": body}
                with system.open_output_stream(f"{base}/{folder}/metadata.json") as f:
                    f.write(json.dumps(about, ensure_ascii=False).encode())
                paths.append(body)
            yield pyarrow.RecordBatch.from_arrays([*(batch.column(c) for c in ("snapshot_id", "source_id", "item_id")), pyarrow.array(paths, pyarrow.string()), batch.column("byte_size")], names=["snapshot_id", "source_id", "item_id", "local_body_path", "byte_size"])

    fields = ("snapshot_id", "source_id", "item_id", "url", "fetched_at", "status_code", "content_type", "encoding", "sha256", "byte_size", "extension", "content")
    return items.select(*(F.col(c) for c in fields)).mapInArrow(write, "snapshot_id string, source_id string, item_id string, local_body_path string, byte_size bigint")

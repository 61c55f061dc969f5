"""Verified snapshots of tables: content-addressed folders on the shared file system, each with a manifest of digests.

A snapshot is written under a name of its own and becomes visible by one rename of its manifest, so readers see the whole of
it or the one before. Reading checks every file's size and the rows' digest against the manifest first.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from factorloom.reports import fingerprint


class SnapshotError(ValueError):
    """A snapshot that is missing or isn't what its manifest says."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, agent: str):
        if not agent.strip():
            raise ValueError("agent says who keeps the snapshots")
        self.spark, self.folder, self.agent = spark, folder.rstrip("/"), agent
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    @staticmethod
    def _checked(name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
            raise ValueError("a name has letters, digits, dots, dashes and underscores")
        return name

    def _files(self, data: str) -> dict[str, int]:
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(data)) if s.getPath().getName().endswith(".parquet")}

    def _holds(self, data: str, digest: str) -> bool:
        try:
            return fingerprint(self.spark.read.parquet(f"{self.folder}/{data}")) == digest
        except Exception:  # files that can't be read
            return False

    def save(self, name: str, df: DataFrame, source: str) -> dict:
        """Writes df and publishes it under the name; the manifest that now holds is returned."""
        name = self._checked(name)
        draft = f"data/draft-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{draft}")
        written = self.spark.read.parquet(f"{self.folder}/{draft}")
        digest = fingerprint(written)
        data = f"data/{digest}"
        if self._fs.exists(self._path(data)) and not self._holds(data, digest):
            data = f"data/{digest}-{uuid.uuid4().hex}"  # what is there isn't what it says
        if self._fs.exists(self._path(data)):
            self._fs.delete(self._path(draft), True)
        elif not self._fs.rename(self._path(draft), self._path(data)):
            raise SnapshotError(f"the snapshot of {name} can't be put in place")
        manifest = {"name": name, "source": source, "agent": self.agent, "saved_at": datetime.now(timezone.utc).isoformat(), "data": data, "digest": digest, "schema": written.schema.json(), "files": self._files(data)}
        self._publish(f"{name}.manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
        return manifest

    def _publish(self, name: str, text: str) -> None:
        draft = self._path(f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, self._path(name), how)

    def manifest(self, name: str) -> dict:
        path = self._path(f"{self._checked(name)}.manifest.json")
        if not self._fs.exists(path):
            raise SnapshotError(f"no verified snapshot {name}")
        try:
            found = json.loads("\n".join(r["value"] for r in self.spark.read.text(path.toString(), wholetext=True).collect()))
        except Exception:  # no JSON, or a file that can't be read
            found = None
        if not isinstance(found, dict) or not {"data", "digest", "files", "schema"} <= found.keys():
            raise SnapshotError(f"the manifest of {name} can't be read")
        return found

    def load(self, name: str) -> DataFrame:
        """The table, after its files and its rows' digest were found to be those of the manifest."""
        from pyspark.sql.types import StructType

        m = self.manifest(name)
        if not self._fs.exists(self._path(m["data"])) or self._files(m["data"]) != m["files"]:
            raise SnapshotError(f"the files of {name} aren't those of its manifest")
        df = self.spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{self.folder}/{m['data']}")
        try:
            digest = fingerprint(df)
        except Exception as e:  # files that can't be read
            raise SnapshotError(f"the files of {name} can't be read") from e
        if digest != m["digest"]:
            raise SnapshotError(f"the content of {name} isn't that of its manifest")
        return df

    def refresh(self, name: str, fetch, source: str) -> DataFrame:
        """The table that ``fetch()`` gives, saved; if fetching fails, the verified snapshot of before. Failing to save is an error."""
        try:
            fresh = fetch()
        except Exception:
            return self.load(name)
        self.save(name, fresh, source)
        return self.load(name)

"""A local artifact store: opaque keys, checked media types and sizes, atomic puts."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siftline.operators.dataset import Dataset
from siftline.sinks.writers import MEDIA, render

CHUNK = 64 * 1024
MAX_BYTES = 100 * 1024 * 1024
ALLOWED_MEDIA = {m for m, _ in MEDIA.values()} | {"image/png", "image/jpeg", "application/octet-stream", "application/xml", "text/xml"}
_KEY = re.compile(r"[a-z0-9_]{1,40}/[0-9a-f]{32}")


class ArtifactError(ValueError):
    pass


@dataclass(frozen=True)
class Artifact:
    storage_key: str
    media_type: str
    byte_size: int
    checksum: str
    expires_at: datetime | None = None


class LocalArtifacts:
    def __init__(self, root: str | Path, max_bytes: int = MAX_BYTES):
        self.root, self.max_bytes = Path(root), max_bytes
        self.root.mkdir(parents=True, exist_ok=True)

    def _path(self, key: str) -> Path:
        if not _KEY.fullmatch(key):
            raise ArtifactError("unsafe key")
        return self.root / key

    def put(self, kind: str, chunks: Iterable[bytes], media_type: str, expires_at: datetime | None = None) -> Artifact:
        """Store the chunks under a new key; a file is visible only once it is whole and on disk."""
        if media_type not in ALLOWED_MEDIA:
            raise ArtifactError(f"media type {media_type} isn't allowed")
        key = f"{kind}/{uuid.uuid4().hex}"
        target = self._path(key)
        target.parent.mkdir(parents=True, exist_ok=True)
        digest, size = hashlib.sha256(), 0
        fd, temporary = tempfile.mkstemp(dir=target.parent)
        try:
            with os.fdopen(fd, "wb") as f:
                for chunk in chunks:
                    size += len(chunk)
                    if size > self.max_bytes:
                        raise ArtifactError(f"more than {self.max_bytes} bytes")
                    digest.update(chunk)
                    f.write(chunk)
                f.flush()
                os.fsync(f.fileno())
            os.replace(temporary, target)
        except BaseException:
            Path(temporary).unlink(missing_ok=True)
            raise
        return Artifact(key, media_type, size, f"sha256:{digest.hexdigest()}", expires_at)

    def open(self, artifact: Artifact) -> Iterator[bytes]:
        with self._path(artifact.storage_key).open("rb") as f:
            while chunk := f.read(CHUNK):
                yield chunk

    def head(self, artifact: Artifact) -> Artifact:
        path = self._path(artifact.storage_key)
        if not path.is_file():
            raise ArtifactError("no such artifact")
        return Artifact(artifact.storage_key, artifact.media_type, path.stat().st_size, artifact.checksum, artifact.expires_at)

    def delete(self, artifact: Artifact) -> None:
        """Gone afterwards, whether it was there or not."""
        self._path(artifact.storage_key).unlink(missing_ok=True)

    def read_all(self, spark: SparkSession) -> DataFrame:
        """The stored files as a DataFrame (path, modificationTime, length, content)."""
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(self.root))


def store_export(store: LocalArtifacts, dataset: Dataset, name: str) -> Artifact:
    return store.put("export", [render(dataset, name)], MEDIA[name][0])

"""Output stores: a folder, a mounted drive, a bucket, or several at once."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path


class LocalStore:
    """Files below a folder; a file appears under its name only when it is whole."""

    def __init__(self, root: str):
        self.root = Path(root)

    def uri(self, name: str) -> str:
        return str(self.root / name)

    def put(self, path: str, name: str) -> str:
        target = self.root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        shutil.copyfile(path, part)
        os.replace(part, target)
        return str(target)

    def exists(self, name: str) -> bool:
        return (self.root / name).exists()

    def list(self, prefix: str = "") -> list[str]:
        found = (p.relative_to(self.root).as_posix() for p in self.root.rglob("*") if p.is_file() and not p.name.startswith("."))
        return sorted(n for n in found if n.startswith(prefix))

    def read_text(self, name: str) -> str:
        return (self.root / name).read_text()

    def get(self, name: str, path: str) -> str:
        return shutil.copyfile(self.root / name, path)

    def refresh(self, prefix: str = "") -> None:
        """A folder needs no listing cache."""

    def describe(self) -> str:
        return f"folder {self.root}"


class DriveStore(LocalStore):
    """A mounted drive: its mount point must be there."""

    def __init__(self, root: str, mount: str | None = None):
        if mount and not os.path.isdir(mount):
            raise RuntimeError(f"{mount} is not mounted")
        super().__init__(root)

    def describe(self) -> str:
        return f"drive folder {self.root}"


class BucketStore:
    """Objects of a bucket through a client with put, get, list and exists; listings are kept by prefix."""

    def __init__(self, bucket: str, prefix: str, client):
        self.bucket, self.prefix, self.client = bucket, prefix.strip("/"), client
        self.known: set[str] = set()
        self.listed: set[str] = set()

    def _key(self, name: str) -> str:
        return f"{self.prefix}/{name}" if self.prefix else name

    def uri(self, name: str) -> str:
        return f"gs://{self.bucket}/{self._key(name)}"

    def put(self, path: str, name: str) -> str:
        self.client.put(self.bucket, self._key(name), Path(path).read_bytes())
        self.known.add(name)
        return self.uri(name)

    def refresh(self, prefix: str = "") -> None:
        """Replaces what is known below the prefix by a fresh listing."""
        cut = len(self.prefix) + 1 if self.prefix else 0
        fresh = {k[cut:] for k in self.client.list(self.bucket, self._key(prefix))}
        self.known = {n for n in self.known if not n.startswith(prefix)} | fresh
        self.listed.add(prefix)

    def _folder(self, name: str) -> str:
        return name.rpartition("/")[0]

    def exists(self, name: str) -> bool:
        if not any(name.startswith(p) for p in self.listed):
            self.refresh(self._folder(name))
        return name in self.known

    def list(self, prefix: str = "") -> list[str]:
        self.refresh(prefix)
        return sorted(n for n in self.known if n.startswith(prefix))

    def read_text(self, name: str) -> str:
        return self.client.get(self.bucket, self._key(name)).decode()

    def get(self, name: str, path: str) -> str:
        Path(path).write_bytes(self.client.get(self.bucket, self._key(name)))
        return path

    def describe(self) -> str:
        return f"bucket {self.bucket}/{self.prefix}"


class MultiStore:
    """Writes to all stores; a file exists where all have it; reads come from a local store, else the first."""

    def __init__(self, *stores):
        if not stores:
            raise ValueError("no stores")
        self.stores = stores
        self.first = next((s for s in stores if isinstance(s, LocalStore)), stores[0])

    def uri(self, name: str) -> str:
        return self.first.uri(name)

    def uris(self, name: str) -> list[str]:
        return [s.uri(name) for s in self.stores]

    def put(self, path: str, name: str) -> str:
        for s in self.stores:
            s.put(path, name)
        return self.uri(name)

    def exists(self, name: str) -> bool:
        return all(s.exists(name) for s in self.stores)

    def list(self, prefix: str = "") -> list[str]:
        return self.first.list(prefix)

    def read_text(self, name: str) -> str:
        return self.first.read_text(name)

    def get(self, name: str, path: str) -> str:
        return self.first.get(name, path)

    def refresh(self, prefix: str = "") -> None:
        for s in self.stores:
            s.refresh(prefix)

    def describe(self) -> str:
        return " and ".join(s.describe() for s in self.stores)


def make_store(target: str, folder: str = "outputs", bucket: str | None = None, prefix: str = "", client=None, mount: str | None = None):
    """local, gdrive, gcs, or both (local and bucket)."""
    if target in ("gcs", "both") and (not bucket or client is None):
        raise ValueError(f"target {target} needs a bucket and a client")
    if target == "local":
        return LocalStore(folder)
    if target == "gdrive":
        return DriveStore(folder, mount)
    if target == "gcs":
        return BucketStore(bucket, prefix, client)
    if target == "both":
        return MultiStore(LocalStore(folder), BucketStore(bucket, prefix, client))
    raise ValueError(f"unknown target {target}; use local, gdrive, gcs or both")

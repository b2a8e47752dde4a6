"""Stores of immutable artifacts by digest."""

from __future__ import annotations

import hashlib
import os
import re
import threading
import time
import uuid
from contextlib import contextmanager

from .errors import ArtifactStoreError, ArtifactStoreKeyError, ArtifactStoreLockError

_DIGEST = re.compile(r"[0-9a-f]{64}")


class ArtifactStore:
    """put(content) -> digest, get(digest), named bindings; a name once bound stays bound to its digest."""

    def put(self, content: bytes) -> str:
        digest = hashlib.sha256(content).hexdigest()
        self._write(f"blob-{digest}", content)
        return digest

    def get(self, digest: str) -> bytes:
        if not _DIGEST.fullmatch(digest):
            raise ArtifactStoreKeyError(digest)
        content = self._read(f"blob-{digest}")
        if hashlib.sha256(content).hexdigest() != digest:
            raise ArtifactStoreError(f"{digest} is damaged")
        return content

    def bind(self, name: str, content: bytes) -> str:
        digest = self.put(content)
        with self._locked():
            try:
                held = self._read(f"name-{hashlib.sha256(name.encode()).hexdigest()}").decode()
            except ArtifactStoreKeyError:
                self._write(f"name-{hashlib.sha256(name.encode()).hexdigest()}", digest.encode())
                return digest
        if held != digest:
            raise ValueError(f"{name} is bound to {held}")
        return digest

    def lookup(self, name: str) -> bytes:
        return self.get(self._read(f"name-{hashlib.sha256(name.encode()).hexdigest()}").decode())

    def _read(self, key: str) -> bytes:
        raise NotImplementedError

    def _write(self, key: str, content: bytes) -> None:
        raise NotImplementedError

    @contextmanager
    def _locked(self):
        yield


class InMemoryArtifactStore(ArtifactStore):
    def __init__(self):
        self._held: dict[str, bytes] = {}
        self._lock = threading.Lock()

    def _read(self, key: str) -> bytes:
        try:
            return self._held[key]
        except KeyError:
            raise ArtifactStoreKeyError(key) from None

    def _write(self, key: str, content: bytes) -> None:
        self._held.setdefault(key, content)

    @contextmanager
    def _locked(self):
        with self._lock:
            yield


class FileLock:
    """A lock file: held by who created it; one older than `stale` seconds is taken over."""

    def __init__(self, path: str, timeout: float = 30.0, stale: float = 600.0, error: type[Exception] = ArtifactStoreLockError):
        self.path, self.timeout, self.stale, self.error = path, timeout, stale, error

    def __enter__(self):
        end = time.monotonic() + self.timeout
        while True:
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return self
            except FileExistsError:
                try:
                    if time.time() - os.path.getmtime(self.path) > self.stale:
                        os.unlink(self.path)
                        continue
                except FileNotFoundError:
                    continue
            if time.monotonic() > end:
                raise self.error(self.path)
            time.sleep(0.02)

    def __exit__(self, *_):
        try:
            os.unlink(self.path)
        except FileNotFoundError:
            pass


def replace_file(path: str, content: bytes) -> None:
    """Write a file whole or not at all: a new name beside it, synced, then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(temporary, "xb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


class FileSystemArtifactStore(ArtifactStore):
    def __init__(self, root: str, timeout: float = 30.0):
        self.root, self.timeout = root, timeout
        os.makedirs(root, exist_ok=True)

    def _path(self, key: str) -> str:
        kind, _, digest = key.partition("-")
        return os.path.join(self.root, kind, digest[:2], digest)

    def _read(self, key: str) -> bytes:
        try:
            with open(self._path(key), "rb") as f:
                return f.read()
        except FileNotFoundError:
            raise ArtifactStoreKeyError(key) from None

    def _write(self, key: str, content: bytes) -> None:
        if not os.path.exists(self._path(key)):
            replace_file(self._path(key), content)

    @contextmanager
    def _locked(self):
        with FileLock(os.path.join(self.root, ".lock"), self.timeout):
            yield

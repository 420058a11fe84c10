"""Small files that writers agree by: numbered commits and locks, on any file system that Hadoop knows.

Everything rests on one step: a file is created whole and only where there is none. On a local or mounted file system that
is a hard link, on others Hadoop's rename without overwriting, which HDFS does atomically. An object store whose rename is
a copy does not give this and needs another commit service.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from tidemark.errors import ConflictError, LockHeldError


class Folder:
    """Small text files of one folder."""

    def __init__(self, spark: SparkSession, path: str, hadoop: bool | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(self._conf)
        self.local = self._fs.getUri().getScheme() == "file" if hadoop is None else not hadoop
        if self.local:
            self._root = unquote(urlparse(self.path).path) if self.path.startswith("file:") else self.path
            os.makedirs(self._root, exist_ok=True)
        else:
            self._fs.mkdirs(self._jpath(self.path))

    def __truediv__(self, name: str) -> str:
        return f"{self.path}/{name}"

    def sub(self, name: str) -> Folder:
        return Folder(self.spark, self / name, None if self.local else True)

    def names(self) -> list[str]:
        if self.local:
            return sorted(os.listdir(self._root))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._jpath(self.path)))

    def read(self, name: str) -> str | None:
        if self.local:
            try:
                with open(os.path.join(self._root, name), encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        p = self._jpath(self / name)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes the file with all its text; False, without effect, where there is one."""
        tmp = f".{uuid.uuid4().hex}"
        if self.local:
            tmp = os.path.join(self._root, tmp)
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(tmp, os.path.join(self._root, name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(tmp)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        stream = self._fs.create(self._jpath(self / tmp), False)
        stream.write(text.encode())
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._jpath(self / tmp), self._jpath(self / name), none)
            return True
        except Exception as e:  # py4j wraps what Hadoop throws
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self._fs.delete(self._jpath(self / tmp), False)

    def delete(self, name: str) -> None:
        """Removes a file or a folder with all it holds; nothing there is no error."""
        self._fs.delete(self._jpath(self / name), True)


class CommitLog:
    """Documents numbered from 0. Of two writers of one number one wins and the other gets a ConflictError."""

    def __init__(self, folder: Folder, name: str = "commits") -> None:
        self.folder = folder.sub(name)

    def _numbers(self) -> list[int]:
        return [int(n[:12]) for n in self.folder.names() if n.endswith(".json") and not n.startswith(".")]

    def latest(self) -> tuple[int, dict]:
        """The last number and its document; -1 and an empty one when there is none."""
        for n in reversed(self._numbers()):
            text = self.folder.read(f"{n:012d}.json")
            if text is not None:  # else it was pruned meanwhile
                return n, json.loads(text)
        return -1, {}

    def all(self) -> list[dict]:
        return [json.loads(t) for n in self._numbers() if (t := self.folder.read(f"{n:012d}.json")) is not None]

    def append(self, n: int, doc: dict) -> None:
        if not self.folder.create(f"{n:012d}.json", json.dumps(doc)):
            raise ConflictError(f"{self.folder.path}: number {n} has been committed by another writer")

    def prune(self, keep: int = 16) -> None:
        """Removes all but the last documents, for logs of which only the last one counts."""
        for n in self._numbers()[:-keep]:
            self.folder.delete(f"{n:012d}.json")


class Lock:
    """A lock that ends by itself when its holder stops renewing it.

    Taking, renewing and releasing are commits, so of two processes that find a lock expired one gets it. Clocks of the
    machines may differ by less than the time to live.
    """

    def __init__(self, folder: Folder, name: str, ttl_s: float) -> None:
        self.log, self.ttl_s, self.token = CommitLog(folder, name), ttl_s, uuid.uuid4().hex

    def holder(self) -> str | None:
        _, doc = self.log.latest()
        return doc.get("token") if doc.get("until", 0) > time.time() else None

    def take(self) -> None:
        n, doc = self.log.latest()
        if doc.get("token") not in (None, self.token) and doc["until"] > time.time():
            raise LockHeldError(f"{self.log.folder.path} is held")
        self._put(n)

    def _put(self, n: int) -> None:
        try:
            self.log.append(n + 1, {"token": self.token, "until": time.time() + self.ttl_s})
        except ConflictError:
            raise LockHeldError(f"{self.log.folder.path} was taken by another") from None
        self.log.prune()

    def renew(self) -> None:
        """Prolongs a lock that is still one's own; LockHeldError when another has taken it."""
        n, doc = self.log.latest()
        if doc.get("token") != self.token:
            raise LockHeldError(f"{self.log.folder.path} is no longer held")
        self._put(n)

    def release(self) -> None:
        n, doc = self.log.latest()
        if doc.get("token") == self.token:
            try:
                self.log.append(n + 1, {"token": None, "until": 0})
            except ConflictError:
                pass

    @contextmanager
    def held(self) -> Iterator[Lock]:
        self.take()
        try:
            yield self
        finally:
            self.release()

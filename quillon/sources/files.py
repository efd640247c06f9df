"""Bytes of files for Python data sources, and small files through Hadoop's file systems."""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def open_bytes(path: str):
    """A seekable binary file on a local path or any URI that Arrow knows."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return open(urlparse(path).path if scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def local_path(path: str) -> str | None:
    """The path on this machine's file systems, or None for another URI."""
    parts = urlparse(path)
    return path if not parts.scheme else parts.path if parts.scheme == "file" else None


def create_bytes(path: str):
    """A binary file to be written from its beginning, on a local path or any URI that Arrow knows; folders are made."""
    local = local_path(path)
    if local is not None:
        os.makedirs(os.path.dirname(local) or ".", exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner)


def append_file(out, path: str, piece: int = 8 << 20) -> None:
    """Copy a file's bytes to an open one, a piece at a time."""
    with open_bytes(path) as f:
        while raw := f.read(piece):
            out.write(raw)


def remove_folder(path: str) -> None:
    local = local_path(path)
    if local is not None:
        shutil.rmtree(local, ignore_errors=True)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.delete_dir(inner)


def read_range(path: str, begin: int, size: int) -> bytes:
    with open_bytes(path) as f:
        f.seek(begin)
        return f.read(size)


def size_of(path: str) -> int:
    with open_bytes(path) as f:
        return f.seek(0, 2)


def exists(path: str) -> bool:
    try:
        with open_bytes(path):
            return True
    except OSError:
        return False


class Files:
    """Small files and folders on whatever file system a path names; used on the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _of(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._of(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._of(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = True) -> bool:
        """Write through a temporary name and rename; false if the name is taken and may not be replaced."""
        fs, p = self._of(path)
        if not replace and fs.exists(p):
            return False
        temporary = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if replace and fs.exists(p):
            fs.delete(p, False)
        return fs.rename(temporary, p)

    def create(self, path: str, text: str) -> bool:
        """Write a file that isn't there yet, whole or not at all; false if another writer was first."""
        fs, p = self._of(path)
        fs.mkdirs(p.getParent())
        temporary = f"{path}.{uuid.uuid4().hex}"
        if fs.getUri().getScheme() == "file":
            local = [urlparse(x).path if "://" in x or x.startswith("file:") else x for x in (temporary, path)]
            with open(local[0], "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(*local)  # fails where the name is taken
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(local[0])
        stream = fs.create(self.jvm.org.apache.hadoop.fs.Path(temporary), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.jvm.org.apache.hadoop.fs.Path(temporary), p, options)
            return True
        except Exception:
            fs.delete(self.jvm.org.apache.hadoop.fs.Path(temporary), False)
            if fs.exists(p):
                return False
            raise

    def move(self, old: str, new: str) -> bool:
        """Rename a folder; false if it isn't there."""
        fs, p = self._of(old)
        target = self.jvm.org.apache.hadoop.fs.Path(new)
        fs.mkdirs(target.getParent())
        return fs.exists(p) and not fs.exists(target) and fs.rename(p, target)

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)

"""Where a catalog's files lie. All that a catalog asks of a store is that of several writers of a new file just one succeeds."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from importlib import import_module
from urllib.parse import urlsplit

from lakeloom.errors import InvalidArgument, ReadFailure, SealFailure


class URI:
    """A literal URI: scheme, authority and path as written; a query or fragment is dropped."""

    def __init__(self, text: str) -> None:
        if not text:
            raise InvalidArgument("empty URI")
        parts = urlsplit(text if "://" in text else f"file://{os.path.abspath(text)}")
        self.scheme, self.authority, self.path = parts.scheme, parts.netloc, parts.path.rstrip("/") or "/"

    def __str__(self) -> str:
        return f"{self.scheme}://{self.authority}{self.path}"

    def child(self, relative: str) -> str:
        return f"{str(self).rstrip('/')}/{relative.lstrip('/')}"


class Storage:
    """Files under one root, named by paths relative to it."""

    def __init__(self, root: str, **options: str) -> None:
        self.root, self.options = URI(root), options
        self.delete_batch = int(options.get("delete-batch-size", 1000))

    def url(self, path: str) -> str:
        return self.root.child(path)

    def read(self, path: str) -> bytes:
        raise NotImplementedError

    def create(self, path: str, data: bytes) -> None:
        """Writes a new file as a whole, or raises SealFailure if it exists."""
        raise NotImplementedError

    def create_all(self, files: list[tuple[str, bytes]]) -> None:
        """Creates files in this order."""
        for path, data in files:
            self.create(path, data)

    def overwrite(self, path: str, data: bytes) -> None:
        raise NotImplementedError

    def exists(self, path: str) -> bool:
        raise NotImplementedError

    def delete(self, paths: Iterable[str]) -> None:
        raise NotImplementedError

    def modified(self, path: str) -> float | None:
        """When a file was last written, in milliseconds; None if it is gone."""
        raise NotImplementedError

    def list(self, prefix: str = "") -> list[str]:
        """Paths of all files under a folder, sorted."""
        raise NotImplementedError

    def local(self, path: str) -> str:
        """A file on this machine with the content of path."""
        at = os.path.join(tempfile.mkdtemp(prefix="lakeloom-"), os.path.basename(path))
        with open(at, "wb") as f:
            f.write(self.read(path))
        return at

    def copy_to(self, other: "Storage", paths: Iterable[str]) -> None:
        for p in paths:
            if not other.exists(p):
                other.create(p, self.read(p))


#: Files that are synchronized together rather than one by one, at least.
BULK = 64


class LocalStorage(Storage):
    """A local or mounted file system. A file is written aside and then linked to its name, which fails if the name is taken."""

    def _at(self, path: str) -> str:
        return os.path.join(self.root.path, path)

    def _staged(self, path: str, data: bytes, settled: bool = True) -> str:
        at = self._at(path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        staged = os.path.join(os.path.dirname(at), f".{uuid.uuid4().hex}.tmp")
        with open(staged, "wb") as f:
            f.write(data)
            if settled:
                f.flush()
                os.fsync(f.fileno())
        return staged

    def read(self, path: str) -> bytes:
        try:
            with open(self._at(path), "rb") as f:
                return f.read()
        except OSError as e:
            raise ReadFailure(f"{path}: {e.strerror}") from e

    def local(self, path: str) -> str:
        return self._at(path)

    def create(self, path: str, data: bytes) -> None:
        self._sealed(self._staged(path, data), path)

    def _sealed(self, staged: str, path: str) -> None:
        try:
            os.link(staged, self._at(path))
        except FileExistsError as e:
            raise SealFailure(path) from e
        finally:
            os.unlink(staged)

    def create_all(self, files: list[tuple[str, bytes]]) -> None:
        if len(files) < BULK:
            return super().create_all(files)
        staged = [self._staged(path, data, settled=False) for path, data in files]
        os.sync()  # writes them together, so that each one's own sync below, which tells of errors, has little left to do
        for at in staged:
            with open(at, "rb") as f:
                os.fsync(f.fileno())
        for at, (path, _) in zip(staged, files, strict=True):
            self._sealed(at, path)

    def overwrite(self, path: str, data: bytes) -> None:
        os.replace(self._staged(path, data), self._at(path))

    def exists(self, path: str) -> bool:
        return os.path.exists(self._at(path))

    def modified(self, path: str) -> float | None:
        try:
            return os.path.getmtime(self._at(path)) * 1000
        except OSError:
            return None

    def delete(self, paths: Iterable[str]) -> None:
        for p in paths:
            at = self._at(p)
            if os.path.isdir(at):
                shutil.rmtree(at)
            elif os.path.exists(at):
                os.unlink(at)

    def list(self, prefix: str = "") -> list[str]:
        out = []
        for d, _, names in os.walk(self._at(prefix)):
            out += [os.path.relpath(os.path.join(d, n), self.root.path) for n in names if not n.startswith(".")]
        return sorted(out)


#: Fixed value: the name of Hadoop's option for conditional creation.
CONDITIONAL = "fs.option.create.conditional.overwrite"


class HadoopStorage(Storage):
    """Any file system that the session's Hadoop client knows, through the JVM. Creation without overwriting is as exclusive as that file
    system's; of object stores conditional writes are asked for, which their client must know."""

    def __init__(self, root: str, **options: str) -> None:
        super().__init__(root, **options)
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if spark is None:
            raise InvalidArgument("this store needs an active Spark session")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(self.url(path))
        return p, p.getFileSystem(self._conf)

    def _write(self, path: str, data: bytes, overwrite: bool) -> None:
        p, fs = self._path(path)
        try:
            # stores that can write on condition that a name is free do so at close; others ignore the option
            out = fs.create(p, True) if overwrite else fs.createFile(p).recursive().overwrite(False).opt(CONDITIONAL, True).build()
            try:
                out.write(bytearray(data))
            finally:
                out.close()
        except Exception as e:
            if not overwrite and any(x in str(e) for x in ("AlreadyExists", "PreconditionFailed", "412")):
                raise SealFailure(path) from e
            raise

    def read(self, path: str) -> bytes:
        p, fs = self._path(path)
        try:
            stream = fs.open(p)
        except Exception as e:
            raise ReadFailure(path) from e
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        self._write(path, data, False)

    def overwrite(self, path: str, data: bytes) -> None:
        self._write(path, data, True)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def modified(self, path: str) -> float | None:
        p, fs = self._path(path)
        return float(fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else None

    def delete(self, paths: Iterable[str]) -> None:
        for path in paths:
            p, fs = self._path(path)
            fs.delete(p, True)

    def list(self, prefix: str = "") -> list[str]:
        p, fs = self._path(prefix)
        if not fs.exists(p):
            return []
        found, it, base = [], fs.listFiles(p, True), fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(str(self.root))).toUri().getPath().rstrip("/") + "/"
        while it.hasNext():
            found.append(it.next().getPath().toUri().getPath().removeprefix(base))
        return sorted(found)


class ArrowStorage(Storage):
    """Reading only, without a JVM: for executors, on any file system that Arrow knows by its URI."""

    def __init__(self, root: str, **options: str) -> None:
        super().__init__(root, **options)
        from pyarrow import fs

        self._fs, self._base = fs.FileSystem.from_uri(str(self.root))
        self._missing = fs.FileType.NotFound

    def read(self, path: str) -> bytes:
        try:
            with self._fs.open_input_file(f"{self._base}/{path}") as f:
                return f.read()
        except OSError as e:
            raise ReadFailure(f"{path}: {e}") from e

    def exists(self, path: str) -> bool:
        return self._fs.get_file_info(f"{self._base}/{path}").type != self._missing

    def list(self, prefix: str = "") -> list[str]:
        from pyarrow import fs

        found = self._fs.get_file_info(fs.FileSelector(f"{self._base}/{prefix}".rstrip("/"), recursive=True, allow_not_found=True))
        return sorted(f.path.removeprefix(f"{self._base}/") for f in found if f.is_file and not f.base_name.startswith("."))


def copy_files(spark, source: Storage, target: Storage, paths: list[str]) -> None:
    """Copies files from store to store: on executors where both can be reached without a session, in pieces of bounded size."""
    known = (LocalStorage, ArrowStorage)
    if not paths:
        return
    if not isinstance(source, known) or not isinstance(target, known):
        source.copy_to(target, paths)
        return
    roots = str(source.root), str(target.root)

    def copy(batches):
        from pyarrow import fs

        (a, base_a), (b, base_b) = (fs.FileSystem.from_uri(r) for r in roots)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                b.create_dir(os.path.dirname(f"{base_b}/{p}"), recursive=True)
                fs.copy_files(f"{base_a}/{p}", f"{base_b}/{p}", source_filesystem=a, destination_filesystem=b, chunk_size=1 << 22)
            yield batch

    spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 256)).mapInArrow(copy, "path string").count()


def reading(root: str) -> Storage:
    """A store to read from where there may be no session, as on executors."""
    return LocalStorage(root) if URI(root).scheme == "file" else ArrowStorage(root)


_STORES: dict[str, Callable[..., Storage]] = {"file": LocalStorage, "local": LocalStorage, "arrow": ArrowStorage, "hadoop": HadoopStorage, "hdfs": HadoopStorage, "s3": HadoopStorage, "s3a": HadoopStorage, "abfs": HadoopStorage, "gs": HadoopStorage, "viewfs": HadoopStorage}


def open_storage(root: str, kind: str | None = None, **options: str) -> Storage:
    """The store of a root: by kind, a known name or `module.Class`, else by the root's scheme."""
    kind = kind or URI(root).scheme
    if kind in _STORES:
        return _STORES[kind](root, **options)
    module, _, name = kind.rpartition(".")
    if not module:
        raise InvalidArgument(f"no store for {kind}")
    try:
        return getattr(import_module(module), name)(root, **options)
    except (ImportError, AttributeError) as e:
        raise InvalidArgument(f"no store {kind}: {e}") from e

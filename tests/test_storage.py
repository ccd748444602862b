from concurrent.futures import ThreadPoolExecutor

import pytest

from lakeloom.errors import InvalidArgument, ReadFailure, SealFailure
from lakeloom.sources.storage import URI, HadoopStorage, LocalStorage, open_storage


@pytest.fixture(params=["local", "hadoop"])
def store(request, tmp_path, spark):
    return open_storage(f"file://{tmp_path}", request.param)


def test_files(store):
    assert not store.exists("a/x.txt") and store.list() == []
    with pytest.raises(ReadFailure):
        store.read("a/x.txt")
    store.create("a/x.txt", b"test data")
    assert store.exists("a/x.txt") and store.read("a/x.txt") == b"test data"
    with pytest.raises(SealFailure):
        store.create("a/x.txt", b"other")
    assert store.read("a/x.txt") == b"test data"
    store.overwrite("a/x.txt", b"test data 1")
    store.overwrite("a/x.txt", b"test data 2")
    assert store.read("a/x.txt") == b"test data 2"
    with open(store.local("a/x.txt"), "rb") as f:
        assert f.read() == b"test data 2"
    for i in range(10):
        store.create(f"b/c/{i}.txt", b"")
    assert store.list("b") == [f"b/c/{i}.txt" for i in range(10)] and len(store.list()) == 11
    store.delete([f"b/c/{i}.txt" for i in range(9)])
    assert store.list() == ["a/x.txt", "b/c/9.txt"]


def test_of_many_writers_one_wins(tmp_path):
    store = LocalStorage(str(tmp_path))

    def attempt(i):
        try:
            store.create("f", str(i).encode())
            return i
        except SealFailure:
            return None

    with ThreadPoolExecutor(128) as pool:
        won = [x for x in pool.map(attempt, range(128)) if x is not None]
    assert len(won) == 1 and store.read("f") == str(won[0]).encode() and store.list() == ["f"]


def test_uris():
    u = URI("s3://bucket/a/b/?q=1#f")
    assert (u.scheme, u.authority, u.path, str(u)) == ("s3", "bucket", "/a/b", "s3://bucket/a/b") and u.child("/c") == "s3://bucket/a/b/c"
    assert URI("/tmp/x").scheme == "file"
    with pytest.raises(InvalidArgument):
        URI("")


def test_factory(tmp_path, spark):
    assert isinstance(open_storage(str(tmp_path)), LocalStorage)
    assert isinstance(open_storage(str(tmp_path), "lakeloom.sources.storage.HadoopStorage"), HadoopStorage)
    for bad in ("ftp", "no.such.Store"):
        with pytest.raises(InvalidArgument):
            open_storage(str(tmp_path), bad)


def test_reading_without_a_session(tmp_path):
    made = LocalStorage(str(tmp_path))
    for i in range(3):
        made.create(f"a/{i}", str(i).encode())
    store = open_storage(f"file://{tmp_path}", "arrow")
    assert store.list() == made.list() and store.list("none") == [] and store.read("a/2") == b"2" and store.exists("a/1") and not store.exists("a/9")
    with pytest.raises(ReadFailure):
        store.read("a/9")
    with pytest.raises(NotImplementedError):
        store.create("a/9", b"")

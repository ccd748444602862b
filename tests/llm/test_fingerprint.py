import base64
import collections
import hashlib

import numpy as np
import pytest

from lakeloom.llm import fingerprint as fp


def brute_fingerprint(text):
    """The fingerprint by plain loops, and the bag of its marks."""
    data, sections, now, bag = (text or "").encode(), [], [], collections.Counter()
    end, hashed = fp.chunks(np.frombuffer(data, np.uint8)) if data else ([], [])
    short = lambda d: base64.urlsafe_b64encode(d[:9]).decode()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    at = 0
    parts = data.split(b"\n")
    for line in [x + b"\n" for x in parts[:-1]] + [x for x in parts[-1:] if x]:
        marks = ""
        for e, h in zip(end, hashed, strict=True):
            if at < e <= at + len(line):
                mark = "".join(letters[(int(h) >> 34 >> 6 * k) & 63] for k in range(5))
                bag[mark] += 1
                marks += mark
        at += len(line)
        digest = hashlib.sha256(line).digest()
        now.append((short(digest), marks))
        if digest[0] < 32 or at == len(data):
            sections.append((short(hashlib.sha256("".join(d for d, _ in now).encode()).digest()), now))
            now = []
    root = hashlib.sha256("".join(d for d, _ in sections).encode()).hexdigest()
    return root + ":" + ";".join(d + ":" + ",".join(p + m for p, m in ps) for d, ps in sections), bag


def brute_likeness(a, b):
    (fa, x), (fb, y) = a, b
    if fa[:64] == fb[:64]:
        return 1.0
    total = x.total() + y.total()
    return min(2 * (x & y).total() / total, 1 - 1e-9) if total else 0.0


def brute(rows):
    rows = sorted(rows)
    out, seen = {}, {}
    look = lambda t: seen.setdefault(t, None) or seen.update({t: brute_fingerprint(t)}) or seen[t]
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, nxt = look(t), look(edited), look(after)
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), own[0], other[0], brute_likeness(own, other), brute_likeness(own, nxt))
    return out


TEXTS = [None, "", "é", "same text\nhere", "same text\nhere", "a b c d e f g h " * 300, "one\n\ntwo\n", "\n\n", "x" * 4001, "last ünï"]


def test_against_next(spark):
    rows = [(7 * i - 20, t) for i, t in enumerate(TEXTS * 6)]
    docs = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in fp.against_next(docs).collect()}
    assert got == brute(rows)
    assert fp.against_next(docs.limit(0)).count() == 0
    one = fp.against_next(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_null_and_repeated_ids_keep_their_order(spark, kind):
    """Half of all ids are null and many others repeat: rows are ordered by id (null first) and text hash all the same."""
    from pyspark.sql import functions as F

    rows = [(None if i % 2 else (5 if i % 3 else i), f"text {i % 20}\nof {i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text").repartition(4)
    order = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    want = collections.Counter()
    for i, r in enumerate(order):
        own, nxt = brute_fingerprint(r.text), brute_fingerprint(order[(i + 1) % len(order)].text)
        want[r.doc_id, own[0], round(brute_likeness(own, nxt), 9)] += 1
    got = collections.Counter((r.doc_id, r.fingerprint, round(r.near_next, 9)) for r in fp.against_next(docs).collect())
    assert got == want


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r[0]: tuple(r)[1:] for r in fp.against_next(docs).collect()}
    short = {k for k, v in got.items() if v[0] < 6000}
    want = brute(rows)
    assert all(got[k] == want[k] for k in short) and {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    long = [v for v in got.values() if v[0] > 1000]
    assert sum(v[4] > v[5] for v in long) > 0.9 * len(long)


LINES = [f"line {i} has a few words and more {i * i}\n" for i in range(200)]


def edits(change):
    lines = list(LINES)
    change(lines)
    a, b = fp.Tree.of("".join(LINES).encode()), fp.Tree.of("".join(lines).encode())
    assert a.root != b.root and 0.9 < fp.likeness(a, b) < 1 and a.holds() and b.holds()
    found = fp.differing(a.text, b.text)
    # the edits found turn one text into the other
    out, at = [], 0
    for _, i, j, k, l in found:
        out += LINES[at:i] + lines[k:l]
        at = j
    assert out + LINES[at:] == lines
    return found


def test_edits_are_located_by_position():
    def swap(x):
        x[30], x[90] = x[90], x[30]

    assert [e[1:3] for e in edits(swap)] in ([(30, 31), (90, 91)], [(30, 31), (90, 90), (90, 91)])
    assert edits(lambda x: x.__setitem__(30, "line 30 had\n")) == [("replace", 30, 31, 30, 31)]
    assert edits(lambda x: x.insert(77, "new line\n")) == [("insert", 77, 77, 77, 78)]
    assert edits(lambda x: x.pop(150)) == [("delete", 150, 151, 150, 150)]
    assert edits(lambda x: x.insert(0, x.pop(5)))[0][0] in ("insert", "delete", "replace")


def test_tree_reads_back_and_shows_tampering():
    a = fp.Tree.of("".join(LINES).encode())
    assert fp.Tree.read(a.text).text == a.text and fp.Tree.read(fp.Tree.of(b"").text).sections == [] and not fp.differing(a.text, a.text)
    digest = a.sections[1][1][0][0]
    assert not fp.Tree.read(a.text.replace(digest, "A" * len(digest), 1)).holds()


def test_fingerprints_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "doc_id long, text string, fingerprint string")
    got = fp.fingerprints(docs)
    assert got.columns == ["doc_id", "text", "fingerprint", "fingerprint"] and got.count() == 2

"""The registered queries over a whole table, each against what its contract says, computed plainly."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lakeloom.llm.queries import QUERIES
from tests.llm.test_jaccard import grams
from tests.llm.test_mixing import fair
from tests.llm.test_substring import brute, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own, full = collections.defaultdict(dict), collections.defaultdict(list)
    for r in QUERIES["op1_best_fit_packing"](spark, SF).collect():
        own[r.doc_id][r.piece] = r
        full[r.sequence_id].append((r.offset, r.length))
    for k, (t, _) in docs.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = [own[k][i] for i in range(len(own[k]))]
        assert sum(p.length for p in parts) == len(ids) and (len(parts) == 1) == (len(ids) <= 2048) and all(p.length == 2048 for p in parts[1:])
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts)
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(full) <= 1.02 * sum(n for v in full.values() for _, n in v) / 2048 + 1


def test_op1_special_tokens(spark):
    from lakeloom.llm import packing
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b<|endoftext|><|endoftext|>  c"
    got = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True, special=packing.special_tokens(P.path("byte_bpe_50k.json")))
    assert got.first().ids == [*Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0]


def test_op2(spark, docs):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (t, _) in docs.items()}
    sources = collections.Counter()
    for k, (_, s) in docs.items():
        sources[s] += size[k]
    names = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    want = dict(zip(names, fair([sources[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    rows, taken = QUERIES["op2_mixing_sources"](spark, SF).collect(), collections.Counter()
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r.doc_id][1]
        assert (r.size, r.source_size) == (size[r.doc_id], sources[s]) and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)


def test_op5(spark, docs):
    rows = QUERIES["op5_quality_classifier"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_op6(spark, docs):
    order = sorted(docs)
    want = {k: digest(b, m) for k, (b, m) in zip(order, brute([docs[k][0] for k in order]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_suffix_array_dedup"](spark, SF).collect()} == want


def test_op7(spark, docs):
    order = sorted(docs)
    sets = [grams(docs[k][0]) for k in order]
    near = [[i != j and (a == b or (bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b))) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(order)))
    for _ in range(20):
        root = [min([root[i]] + [root[j] for j in range(len(order)) if near[i][j]]) for i in range(len(order))]
    want = {k: (order[root[i]], sum(near[i])) for i, k in enumerate(order)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op7_ngram_jaccard_join"](spark, SF).collect()} == want


def test_op8(spark, docs):
    rows = QUERIES["op8_media_columns"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_text = collections.defaultdict(set)
    for r in rows:
        data = (docs[r.doc_id][0] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 + len(payload) % 2 and re.fullmatch("[0-9a-f]{64}", r.media_sha256) and r.tensors_bytes > 96 * 32 * 4
        by_text[data].add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_text.values())


def test_op9(spark, docs):
    rows = QUERIES["op9_sharding"](spark, SF).collect()
    shards = collections.defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id][0] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(40)) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(rows) == len(docs)

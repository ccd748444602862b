import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lakeloom.llm import packing


def best(items, cap):
    """Fewest bins, by search."""
    items = sorted(items, reverse=True)
    top = [len(items)]

    def go(i, bins):
        if len(bins) >= top[0]:
            return
        if i == len(items):
            top[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= items[i]:
                rest = list(bins)
                rest.remove(b)
                go(i + 1, [*rest, b - items[i]])
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return top[0]


def counted(items, cap):
    return np.bincount(np.array(items, np.int64), minlength=cap + 1)


@pytest.mark.parametrize("seed", range(25))
def test_reduction_loses_no_optimum(seed):
    rng = np.random.default_rng(seed)
    cap = 20
    items = rng.integers(3, 21, 9).tolist()
    fixed, rest = packing.reduce_instance(counted(items, cap))
    assert all(sum(held) <= cap for _, held in fixed)
    left = np.repeat(np.arange(cap + 1), rest).tolist()
    assert sum(n for n, _ in fixed) + best(left, cap) == best(items, cap)
    back = counted([x for n, held in fixed for x in held for _ in range(n)] + left, cap)
    assert (back == counted(items, cap)).all()


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_that_of_single_items(seed):
    rng = np.random.default_rng(seed)
    cap = 50
    items = rng.integers(1, 51, 300).tolist()
    bins = []
    for x in sorted(items, reverse=True):
        fit = [b for b in bins if b >= x]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - x)
        else:
            bins.append(cap - x)
    got = packing.best_fit(counted(items, cap))
    assert sum(n for n, _ in got) == len(bins)
    assert all(sum(x * t for x, t in held) <= cap for _, held in got)


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = {1: None, 2: "", 3: "one two three", 4: "word " * 5000, 5: "one two three", 6: "é <|endoftext|> 漢字", 7: "x" * 3000, 8: "a b\n\n\nc" * 700, None: "id"}
    rows = [(k, v, "en") for k, v in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).toPandas()
    for k, v in texts.items():
        own = got[got.doc_id.isna() if k is None else got.doc_id == k].sort_values("piece")
        ids = [*tok.encode(v or "", add_special_tokens=False).ids, 0]
        assert [x for p in own.ids for x in p] == ids
        assert own.start.tolist() == np.r_[0, np.cumsum(own.length)[:-1]].tolist()
        assert (own.length.iloc[1:] == 2048).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own.ids]
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == np.r_[0, np.cumsum(seq.length)[:-1]].tolist()
        assert seq.length.sum() <= 2048
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0

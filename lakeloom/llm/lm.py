"""Language-model scores from a log-frequency Bloom filter.

All words of the training documents and all runs of 2 to ORDER tokens (a row's start is a token before its first) are counted exactly,
as hashes, on executors; there is no vocabulary and no cut-off. A run of count c is quantised to level 1 + floor(log_BASE c) and
enters the filter once for each level up to its own; a lookup probes level after level until one is missing, and the last one found
stands for the count. Hashes are dealt to shards, whose number grows with the text; a shard holds the exact counts of its words
and a filter for each length of run that is as large as its runs need, so nothing is left out, and no machine holds it all.

Probabilities are smoothed from the shortest run to the longest: p_n(w | h) = (c(hw) + K_n p_(n-1)(w | h')) / (c(h) + K_n), p_1 being
the smoothed share of the word, which also gives the base score. K_n is such that the mean weight of the shorter run over
all training tokens is the share of runs that occur once, Good and Turing's estimate of what is new; it comes from the shards' counts
of counts, so it rests on all the data, too. Counts of runs are the filter's. A run counts as not seen if its context isn't.

Documents are cut in blocks. A block asks every shard for its distinct words and runs (sorted, as differences of some 3 bytes), the
shards answer in the order of the asking, and the block is scored with the answers. It is one way for all sizes.

Keys of runs have KEY_SPARE bits more than the number of training bytes needs, so that one that isn't there is taken for another with
a chance below 2**-KEY_SPARE; the filter's own errors are larger. Words have 64 bits.

Null text: empty, one end token. Null doc_id: held out of neither fold by the caller's condition, hence not trained on. Empty
table: no rows. No training rows: every count is 0 and score is base_score. Repeated rows: each is counted and scored. Very long
texts: a block of their own. Names that clash with the new columns: both are returned, the caller's first.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens in the longest runs.
ORDER = 3
#: The filter: hash functions, bits for an entry, base of the levels (1.5 keeps counts up to 4 apart).
PROBES, ENTRY_BITS, BASE = 5, 8, 1.5
KEY_SPARE = 9
#: Training bytes to a shard, shards at least, and bytes to a block of documents.
SHARD, SHARDS, BLOCK = 1 << 23, 12, 1 << 23
END, START = np.uint64(0x27D4EB2F165667C5), np.uint64(0x5851F42D4C957F2D)
#: Distinct keys that one task holds of each length before it merges or sends what it has.
HELD = 1 << 20


def stream(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each row, its end token last, and their rows."""
    _, _, row, hashed = common.words(raw, off, lower=True)
    n = len(off) - 1
    ends = np.searchsorted(row, np.arange(n), "right")
    return np.insert(hashed, ends, END), np.insert(row, ends, np.arange(n))


def runs(tokens: np.ndarray, row: np.ndarray, order: int, bits: int):
    """(n, keys, whether there is such a run) of the runs of 2 to `order` tokens that end at each token. The start of a row stands
    before its first token; longer runs lie within the row."""
    size = len(tokens)
    begin = np.r_[True, row[1:] != row[:-1]][:size]
    place = np.arange(size) - np.maximum.accumulate(np.where(begin, np.arange(size), 0)) if size else np.zeros(0, int)
    now = tokens
    for n in range(2, order + 1):
        before = np.r_[START, now[:-1]][:size]
        if n == 2:
            before[begin] = START
        now = common.mix(before * np.uint64(3) + tokens + np.uint64(n))
        yield n, now >> np.uint64(64 - bits), place >= n - 2


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Tally:
    """Distinct keys with counts."""

    def __init__(self) -> None:
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to take what is held."""
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > HELD:
            self.held = [self._merged()]
            self.size = len(self.held[0][0])
        return self.size > HELD // 2 and len(self.held) == 1

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*self.held, strict=True))) if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self._merged()
        self.held, self.size = [], 0
        return out


# ---- sorted keys as messages to shards


def _cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells: the rows of data up to each end."""
    width = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    offsets = np.r_[0, ends].astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def _lows(bits: int, shards: int) -> np.ndarray:
    """The least key of each shard: shards are ranges of keys."""
    return (-(-(np.arange(shards + 1, dtype=np.int64) << 24) // shards)).astype(np.uint64) << np.uint64(bits - 24)


def packed(keys: np.ndarray, bits: int, shards: int) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """Sorted distinct keys to (shards that get any, ends of their parts, parts as differences, bytes of a difference)."""
    lows = _lows(bits, shards)
    cuts = np.r_[np.searchsorted(keys, lows[:-1]), len(keys)]
    has = np.flatnonzero(np.diff(cuts))
    step = np.diff(keys, prepend=np.uint64(0))
    step[cuts[has]] = keys[cuts[has]] - lows[has]
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    data = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return has, cuts[has + 1], _cells(data, cuts[has + 1]), width


def unpacked(parts: list[bytes], widths: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all parts of one shard, one part after another, and how many each has."""
    n = np.array([len(x) for x in parts], np.int64) // widths if parts else np.zeros(0, np.int64)
    begin = np.r_[0, np.cumsum(n)][: len(n)]
    out = np.empty(int(n.sum()), np.uint64)
    for width in set(widths.tolist()):
        which = np.flatnonzero(widths == width)
        data = np.frombuffer(b"".join(parts[i] for i in which), np.uint8).reshape(-1, width)
        wide = np.zeros((len(data), 8), np.uint8)
        wide[:, :width] = data
        total = np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)
        first = np.r_[0, np.cumsum(n[which])[:-1]]
        before = np.where(first > 0, total[np.maximum(first, 1) - 1], np.uint64(0)) if len(total) else first.astype(np.uint64)
        out[np.repeat(begin[which] - first, n[which]) + np.arange(len(total))] = total - np.repeat(before, n[which]) + np.uint64(low)
    return out, n


def _joined(column, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


# ---- the filter


def levels(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(c) / np.log(BASE) + 1e-9).astype(np.int64)


def decoded(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of the whole numbers that it may have been."""
    least, most = np.ceil(BASE ** (level - 1.0) - 1e-9), np.ceil(BASE**level * 1.0 - 1e-9) - 1
    return np.where(level > 0, (least + np.maximum(least, most)) / 2, 0.0)


def _places(keys: np.ndarray, level: int, size: int):
    """The bits of a key's level among `size`, one hash function after another."""
    base = common.mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xC2B2AE3D27D4EB4F % 2**64))
    step = common.mix(base)
    return lambda which, i: (((base[which] + np.uint64(i) * step[which]) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray, level: np.ndarray) -> tuple[int, bytes]:
    """Bits and bitmap of a filter of keys at their levels."""
    size = max(64, -(-int(level.sum()) * ENTRY_BITS // 8) * 8)
    bitmap = np.zeros(size, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= at]
        place = _places(own, at, size)
        for i in range(PROBES):
            bitmap[place(slice(None), i)] = True
    return size, np.packbits(bitmap, bitorder="little").tobytes()


def lookup(bitmap: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """The level of each key by repeated probes: the last before one that is missing."""
    found = np.zeros(len(keys), np.uint8)
    if not size:
        return found
    live, at = np.arange(len(keys)), 1
    while len(live):
        place, hit = _places(keys[live], at, size), np.arange(len(live))
        for i in range(PROBES):
            bit = place(hit, i)
            hit = hit[bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
        live = live[hit]
        found[live] = at
        at += 1
    return found


# ---- training


class Shards:
    """The stored shards of a training set: (shard, n, keys and counts or size and bitmap, tokens, distinct, counts of counts)."""

    def __init__(self, train: DataFrame, order: int = ORDER) -> None:
        n_bytes = train.agg(F.sum(F.octet_length(F.col("text").cast("string")) + F.lit(1))).first()[0] or 0
        self.order, self.number = order, max(SHARDS, -(-n_bytes // SHARD))
        self.bits = {1: 64, **{n: min(64, max(24, int(n_bytes + 1).bit_length() + KEY_SPARE)) for n in range(2, order + 1)}}
        self.rows = _tallied(train, order, self.bits, self.number)


def _tallied(train: DataFrame, order: int, bits: dict[int, int], number: int) -> DataFrame:
    @common.trimmed
    def count(batches):
        held = {n: Tally() for n in range(1, order + 1)}

        def out(n):
            keys, counts = held[n].take()
            has, ends, parts, width = packed(keys, bits[n], number)
            return pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(np.full(len(has), n, np.int32)), pa.array(np.full(len(has), width, np.int32)), parts, _cells(counts.astype("<u4"), ends)], ["shard", "n", "width", "keys", "counts"])

        for batch in batches:
            for _, raw, off in common.slices(batch.column(0)):
                tokens, row = stream(raw, off)
                for n, keys in [(1, tokens), *((n, k[ok]) for n, k, ok in runs(tokens, row, order, bits[order]))]:
                    if held[n].add(keys):
                        yield out(n)
        for n, tally in held.items():
            if tally.size:
                yield out(n)

    def built(table):
        common.release()
        shard, found = table.column("shard")[0].as_py(), []
        for n in range(1, order + 1):
            part = table.filter(pa.array(table.column("n").to_numpy() == n))
            keys, _ = unpacked(part.column("keys").to_pylist(), part.column("width").to_numpy(), int(_lows(bits[n], number)[shard]))
            keys, c = _summed(keys, _joined(part.column("counts"), "<u4").astype(np.int64))
            level = levels(c)
            many, total = np.bincount(level, minlength=1), np.bincount(level, c, 1).astype(np.int64)
            size, bitmap = build(keys, level) if n > 1 else (0, b"")
            words = (keys.astype("<u8").tobytes(), c.astype("<i8").tobytes()) if n == 1 else (b"", b"")
            found.append((shard, n, *words, size, bitmap, int(c.sum()), len(c), many.tolist(), total.tolist()))
        return pa.table({name: pa.array(x) for name, x in zip(("shard", "n", "words", "counts", "size", "bitmap", "tokens", "distinct", "many", "total"), zip(*found, strict=True), strict=True)}).cast(kinds)

    kinds = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("size", pa.int64()), ("bitmap", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("many", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))])
    tallies = common.batched(train.select(F.col("text").cast("string").alias("text"))).mapInArrow(count, "shard int, n int, width int, keys binary, counts binary")
    return common.stored(tallies.groupBy("shard").applyInArrow(built, "shard int, n int, words binary, counts binary, size long, bitmap binary, tokens long, distinct long, many array<long>, total array<long>"), release=True)


class Model:
    """Totals, and the strength of the shorter run for each length."""

    def __init__(self, shards: Shards) -> None:
        cells = F.arrays_zip("many", "total")
        rows = shards.rows.select("n", F.posexplode(cells)).groupBy("n", "pos").agg(F.sum("col.many").alias("many"), F.sum("col.total").alias("total")).collect()  # as many as levels
        of = {n: [(r.many, r.total) for r in rows if r.n == n and r.many] for n in range(1, shards.order + 1)}
        self.total, self.distinct = sum(t for _, t in of[1]), sum(m for m, _ in of[1])
        once = {r.n: r.many for r in rows if r.pos == 1}
        self.strength = {n: strength(of[n - 1], once.get(n, 0)) for n in range(2, shards.order + 1)}

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 0.5) - np.log10(self.total + 0.5 * (self.distinct + 1))


def strength(contexts: list[tuple[int, int]], once: int) -> float:
    """K such that K / (c + K), over the tokens that follow contexts of (number, sum of counts c), sums to `once`."""
    lo, hi = 1e-6, 1e9
    if not contexts:
        return lo
    number, total = np.array(contexts, float).T
    mean = total / number
    for _ in range(100):
        mid = (lo * hi) ** 0.5
        lo, hi = (mid, hi) if (total * mid / (mean + mid)).sum() < once else (lo, mid)
    return lo


# ---- asking


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    found = [(t, row + first) for first, raw, off in common.slices(column) for t, row in [stream(raw, off)]]
    return np.concatenate([t for t, _ in found]), np.concatenate([row for _, row in found])


def _table(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as f:
        return f.read_all()


def blocks(docs: DataFrame) -> DataFrame:
    """docs (..., text last) as (block, blob): runs of rows of about BLOCK bytes of text, as compressed Arrow streams. docs must come in the
    same order whenever it is read, as files do, so that a lost task makes the same blocks again; if not, scoring fails."""

    @common.trimmed
    def cut(batches):
        held, size, number, pid = [], 0, 0, TaskContext.get().partitionId()

        def out():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                for b in held:
                    f.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([(pid << 32) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_block", "_blob"])

        for batch in batches:
            at = 0
            for first, raw, off in common.slices(batch.column(batch.num_columns - 1), max(1, BLOCK // 4)):
                n = len(off) - 1
                held.append(batch.slice(first, n))
                size, at = size + len(raw), first + n
                if size >= BLOCK:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    return common.batched(docs).mapInArrow(cut, "_block long, _blob binary")


def answered(docs: DataFrame, shards: Shards, use, schema: str) -> DataFrame:
    """use(rows, row of each token, its count, {n: level of the run of n tokens that ends there}), over all blocks of docs (..., text
    last). Its table has the given schema."""
    order, number, bits = shards.order, shards.number, shards.bits
    dealt = blocks(docs)

    def distinct(column):
        tokens, row = _tokens(column)
        return tokens, row, [(1, tokens, np.ones(len(tokens), bool)), *runs(tokens, row, order, bits[order])]

    def ask(block):
        common.release()
        found = []
        for n, keys, ok in distinct(_table(block.column("_blob")[0].as_py()).column(-1))[2]:
            has, _, parts, width = packed(common.distinct(keys[ok]), bits[n], number)
            found.append(pa.table({"_block": pa.array(np.full(len(has), block.column("_block")[0].as_py())), "_shard": pa.array(has.astype(np.int32)), "_n": pa.array(np.full(len(has), n, np.int32)), "_width": pa.array(np.full(len(has), width, np.int32)), "_keys": parts}))
        return pa.concat_tables(found)

    kinds = pa.schema([("_block", pa.int64()), ("_shard", pa.int32()), ("_n", pa.int32()), ("_a", pa.binary())])

    def answer(asked, shard):
        common.release()
        out = [kinds.empty_table()]
        for n in range(1, order + 1) if asked.num_rows else ():
            part = asked.filter(pa.array(asked.column("_n").to_numpy() == n))
            keys, many = unpacked(part.column("_keys").to_pylist(), part.column("_width").to_numpy(), int(_lows(bits[n], number)[asked.column("_shard")[0].as_py()]))
            flat, back = np.unique(keys, return_inverse=True)
            held = shard.filter(pa.array(shard.column("n").to_numpy() == n))
            if n == 1:
                got = np.zeros(len(flat), "<i8")
                if held.num_rows and len(words := _joined(held.column("words"), "<u8")):
                    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
                    got = np.where(words[at] == flat, _joined(held.column("counts"), "<i8")[at], 0).astype("<i8")
            else:
                got = lookup(_joined(held.column("bitmap"), "u1"), held.column("size")[0].as_py(), flat) if held.num_rows else np.zeros(len(flat), np.uint8)
            out.append(pa.Table.from_arrays([*(part.column(c) for c in ("_block", "_shard", "_n")), _cells(got[back], np.cumsum(many))], schema=kinds))
        return pa.concat_tables(out)

    def used(block, answers):
        common.release()
        rows = _table(block.column("_blob")[0].as_py())
        answers = answers.sort_by([("_n", "ascending"), ("_shard", "ascending")])  # shards are ranges: the order of the sorted keys
        of = answers.column("_n").to_numpy()
        _, row, every = distinct(rows.column(-1))
        got = {}
        for n, keys, ok in every:
            value = _joined(answers.column("_a").filter(pa.array(of == n)), "<i8" if n == 1 else "u1")
            flat, back = np.unique(keys[ok], return_inverse=True)
            if len(flat) != len(value):
                raise RuntimeError("a block is not the one that asked: its rows come in another order when they are read again")
            got[n] = np.zeros(len(keys), value.dtype)
            got[n][ok] = value[back]
        return use(rows, row, got.pop(1), got)

    asks = dealt.groupBy("_block").applyInArrow(ask, "_block long, _shard int, _n int, _width int, _keys binary")
    answers = asks.groupBy("_shard").cogroup(shards.rows.withColumnRenamed("shard", "_shard").groupBy("_shard")).applyInArrow(answer, "_block long, _shard int, _n int, _a binary")
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(used, schema)  # one exchange of the blocks serves both


def probabilities(model: Model, row: np.ndarray, c: np.ndarray, level: dict[int, np.ndarray]) -> np.ndarray:
    """Log10 of the smoothed probability of each token."""
    p = 10.0 ** model.base(c)
    begin = np.r_[True, row[1:] != row[:-1]][: len(row)]
    # what the runs' contexts count: the word before (a row's start as often as its end), then the filter's count of the run before
    ends = c[np.r_[begin[1:], True]] if len(row) else c
    context = np.r_[0, c[:-1]][: len(c)].astype(float)
    context[begin] = ends
    for n in sorted(level):
        k = model.strength[n]
        seen = np.minimum(decoded(level[n]), context)
        p = np.where(context > 0, (seen + k * p) / (context + k), p)
        context = np.r_[0.0, seen[:-1]][: len(seen)]
        context[begin] = 0
    return np.log10(p)


def _forget(spark) -> None:
    """Has Spark drop the shuffle files of what nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, train: DataFrame, order: int = ORDER) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, by the counts and the model of train (text)."""
    held = Shards(train, order)
    m = Model(held)
    _forget(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != "text"]
    names = [*(f"_k{i}" for i in range(len(keep))), "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(rows, row, c, level):
        n, word = rows.num_rows, m.base(c)
        full = probabilities(m, row, c, level)
        cells = [np.bincount(row, minlength=n), np.bincount(row, c > 0, n).astype(np.int64), np.full(n, m.total), np.bincount(row, word, n), np.bincount(row, full, n)]
        return pa.table([*(rows.column(i) for i in range(len(keep))), *(pa.array(x) for x in cells)], names=names)

    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    at = [i for i, f in enumerate(docs.schema.fields) if f.name != "text"]
    plain = plain.select(*(F.col(f"_c{i}").alias(f"_k{k}") for k, i in enumerate(at)), F.col(f"_c{docs.columns.index('text')}").cast("string").alias("_text"))
    kinds = [*(f.dataType.simpleString() for f in keep), "long", "long", "long", "double", "double"]
    return answered(plain, held, scored, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).toDF(*(f.name for f in keep), *names[len(keep) :])

"""Best-fit packing after dominance reduction.

Documents become token ids, an end id is added, and pieces of at most `capacity` tokens are packed whole into sequences. Which
document goes where depends on lengths alone, so the bin-packing instance is the histogram of piece lengths (at most `capacity`
numbers, however large the corpus). The driver reduces it by Martello and Toth's dominance criterion - a set of up to three items
whose bin provably can stand in some best packing is fixed and taken out, with its whole multiplicity - and packs what remains
by best fit, longest first, again by whole multiplicities. The result is a list of patterns with counts. Executors turn it
into places by each piece's exact rank among the pieces of its length.

Texts that name special tokens get those tokens' ids, as the tokenizer's own file says, if they are passed; else they are ordinary text.

Null text: empty, one end id. Null ids: packed as any. Very long texts: cut in pieces, the first one shorter. Empty table: no rows.
Repeated rows: packed each for itself. Other columns: not read, whatever their names. Ties between pieces of a length: by
input partition and order in it.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048


def reduce_instance(count: np.ndarray) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """Fixes dominating sets. count[L]: items of length L, up to the capacity, len(count) - 1. Gives fixed (bins, lengths) and
    the counts that remain.

    For each longest item j with room r: the set {j}, if no other item fits; {j, k} with k the largest that fits, if k fills r
    or no two others fit; {j, a, b}, if no three others fit and the pair (a, b) is at least any feasible pair, item by item."""
    count = count.copy()
    cap = len(count) - 1
    have = [int(x) for x in np.flatnonzero(count)]
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def take(*items: int) -> None:
        need = {x: items.count(x) for x in items}
        times = min(int(count[x]) // n for x, n in need.items())
        fixed.append((times, items))
        for x, n in need.items():
            count[x] -= n * times
            if not count[x]:
                have.remove(x)

    def largest(limit: int, used: tuple[int, ...]) -> int:
        at = bisect_right(have, limit) - 1
        while at >= 0 and count[have[at]] <= used.count(have[at]):
            at -= 1
        return have[at] if at >= 0 else 0

    def smallest(n: int, used: tuple[int, ...]) -> int:
        """The sum of the n smallest items besides those used; over the capacity if there are fewer."""
        total = 0
        for x in have:
            free = min(n, int(count[x]) - used.count(x))
            if free > 0:
                total, n = total + x * free, n - free
            if not n:
                return total
        return cap + 1

    for j in sorted(have, reverse=True):
        while count[j]:
            r = cap - j
            if smallest(1, (j,)) > r:
                take(j)
                continue
            k = largest(r, (j,))
            if k == r or smallest(2, (j,)) > r:
                take(j, k)
                continue
            b = largest(r - k, (j, k))
            if b and smallest(3, (j,)) > r and b >= largest(r // 2, (j,)):
                take(j, k, b)
                continue
            break
    return fixed, count


def best_fit(count: np.ndarray) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit of the counted lengths, longest first: (bins, ((length, times), ...)). Equal bins are kept as one with a count."""
    cap = len(count) - 1
    by: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: int, held: tuple) -> None:
        if room not in by:
            by[room] = []
            insort(rooms, room)
        by[room].append((bins, held))

    def fill(room: int, bins: int, held: tuple, size: int, left: int) -> tuple[int, int]:
        """Fills bins of one kind with items as best fit does, one bin after another. Gives items left and bins untouched."""
        each = room // size
        full = min(bins, left // each)
        if full:
            put(room - each * size, full, (*held, (size, each)))
        left -= full * each
        bins -= full
        if bins and left:
            put(room - left * size, 1, (*held, (size, left)))
            bins, left = bins - 1, 0
        return left, bins

    for size in range(cap, 0, -1):
        left = int(count[size])
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                left, _ = fill(cap, left, (), size, left)
                continue
            room = rooms[at]
            bins, held = by[room].pop()
            if not by[room]:
                del by[room]
                rooms.remove(room)
            left, rest = fill(room, bins, held, size, left)
            if rest:
                put(room, rest, held)
    return [(bins, held) for kinds in by.values() for bins, held in kinds]


def solve(count: np.ndarray) -> dict[str, np.ndarray]:
    """Places for every rank of every length, as runs sorted by (length, rank): a run's `times` pieces a bin lie one after another."""
    fixed, rest = reduce_instance(count)
    patterns = [(bins, tuple((x, 1) for x in items)) for bins, items in fixed] + best_fit(rest)
    rank = np.zeros(len(count), np.int64)
    runs, base = [], 0
    for bins, held in patterns:
        at = 0
        for size, times in held:
            runs.append((size, rank[size], times, base, at))
            rank[size] += bins * times
            at += size * times
        base += bins
    runs.sort()
    return {k: np.array([x[i] for x in runs], np.int64) for i, k in enumerate(("length", "rank", "times", "base", "at"))}


def special_tokens(json_path: str) -> dict[str, int]:
    """The special tokens of a tokenizer's JSON file: strings that are one id wherever a text has them."""
    with open(json_path) as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, pid, local (rank among the task's pieces of that length), ids."""

    @common.trimmed
    def pieces(batches):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        encode = functools.partial(held.encode, allowed_special="all", disallowed_special=()) if special else held.encode_ordinary
        local, pid = common.LocalRanks(), TaskContext.get().partitionId()
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                a, b = 0, (len(ids) - 1) % capacity + 1
                for k in range(-(-len(ids) // capacity)):
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
                    a, b = b, b + capacity
            n = np.array(length, np.int64)
            cols = [pa.array(doc, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), pid, np.int32)), pa.array(local.of(n))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "local"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, pid int, local long" + ", ids array<int>" * with_ids
    return common.batched(docs.select("doc_id", "text")).mapInArrow(pieces, schema)


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, if asked for, the ids of the piece."""
    spark = docs.sparkSession
    found = common.stored(tokenised(docs, ranks_path, pattern, capacity, end_id, with_ids, special))
    counts = found.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    places = spark.sparkContext.broadcast(solve(histogram))

    @common.trimmed
    def place(batches):
        p = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # runs are sorted by (length, rank); one number holds both
            at = np.searchsorted(p["length"] * (1 << 48) + p["rank"], length * (1 << 48) + rank, "right") - 1
            inside, times = rank - p["rank"][at], p["times"][at]
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p["base"][at] + inside // times), pa.array(p["at"][at] + inside % times * length)], [*names, "sequence_id", "offset"])

    before = common.starts(counts, "length").select("pid", "length", "before")
    ranked = found.join(before, ["pid", "length"]).withColumn("rank", F.col("local") + F.col("before")).drop("pid", "local", "before")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")

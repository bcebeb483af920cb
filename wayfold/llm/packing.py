"""Best-fit packing of documents into sequences by exact-complement hashing.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the
driver. There the sums of one, two and three lengths that are available are
indexed (an entry goes when its lengths have run out, and none comes back), the
longest piece's gap is looked up, and every combination that fills it exactly is
used as often as the counts allow; what is left is packed by best
fit, longest first. The plan is a short list of patterns with multiplicities,
so its size does not depend on the number of documents. Pieces are then numbered
among those of equal length, salted so that a very common length does not meet
in one task, and each number is looked up in the plan.

Null texts count as empty: such a document is its end id alone. Very long texts
are cut as above. Repeated rows, also those with a null doc_id, are packed each
for itself; which of several pieces with equal doc_id, number and length takes
which of their places is open, and changes no length. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import slices, stored, texts
from wayfold.llm.library import library_encoder

CAPACITY = 2048
END_ID = 0
#: Rows of one length that are numbered in one task, about.
SALT_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A longer document is cut into
    pieces of `capacity`; what is over is its first piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(tokenizer)
        for batch in batches:
            for at, n in slices(batch):
                part, out = batch.slice(at, n), []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), e.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    total, start, k = len(ids) // 4, 0, 0
                    while start < total:
                        size = (total - start) % capacity or capacity
                        out.append((doc_id, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                        start, k = start + size, k + 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


class SumIndex:
    """Sums of one, two and three available lengths. For each sum, the shorter
    lengths of its pairs, and the shortest ones of its triples, that have not run
    out, in ascending order. have: how many pieces of each length there are; it
    only goes down."""

    def __init__(self, have: np.ndarray):
        self.have = have
        single, top = have > 0, len(have) - 1
        lengths = np.flatnonzero(single)
        self.pairs: list[list[int]] = [[], []]
        for s in range(2, top + 1):
            low = lengths[: np.searchsorted(lengths, s // 2, "right")]
            self.pairs.append(low[single[s - low]][::-1].tolist())  # the next one is last
        self.triples: list[list[int] | None] = [None] * (top + 1)
        self.lengths = lengths.tolist()

    def _free(self, taken: tuple[int, ...], length: int, n: int = 1) -> bool:
        return self.have[length] - taken.count(length) >= n

    def pair(self, s: int, taken: tuple[int, ...], least: int = 1) -> tuple[int, int] | None:
        """The longer and the shorter of two lengths that sum to s, beside those
        taken; the shorter as short as can be, `least` or more."""
        low = self.pairs[s] if s > 1 else []
        while low and not (self.have[low[-1]] and self.have[s - low[-1]] and (2 * low[-1] != s or self.have[low[-1]] > 1)):
            low.pop()
        for c in reversed(low):
            if c >= least and self._free(taken, c, 2 if 2 * c == s else 1) and self._free(taken, s - c):
                return s - c, c
        return None

    def triple(self, s: int, taken: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Three lengths that sum to s, the longest first."""
        if self.triples[s] is None:
            self.triples[s] = [c for c in reversed(self.lengths) if 3 * c <= s and self.pairs[s - c]]
        low = self.triples[s]
        while low and not (self.have[low[-1]] and self.pairs[s - low[-1]]):
            low.pop()
        for c in reversed(low):
            if self._free(taken, c) and (found := self.pair(s - c, (*taken, c), c)):
                return *found, c
        return None

    def complement(self, size: int, capacity: int) -> tuple[int, ...] | None:
        """A pattern of size and up to three more lengths that fills capacity."""
        gap = capacity - size
        if gap == 0:
            return (size,)
        if self._free((size,), gap):
            return size, gap
        found = self.pair(gap, (size,)) or self.triple(gap, (size,))
        return (size, *found) if found else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; all of `counts`
    is used up."""
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size}")
        have[size] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need = {s: pattern.count(s) for s in pattern}
        times = int(min(have[s] // n for s, n in need.items()))
        for s, n in need.items():
            have[s] -= times * n
        out.append((pattern, times))

    index = SumIndex(have)
    for size in range(capacity, 0, -1):
        while have[size] and (found := index.complement(size, capacity)):
            use(found)
    rest = [(s, int(have[s])) for s in range(capacity, 0, -1) if have[s]]
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [pattern, times]
    gaps = np.zeros(capacity + 1, bool)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        open_[gap].append([pattern, times])
        gaps[gap] = True

    for size, n in rest:
        while n:
            fit = np.flatnonzero(gaps[size:])
            if not len(fit):
                each = min(capacity // size, n)
                put((size,) * each, n // each)
                n %= each
                continue
            gap = size + int(fit[0])
            pattern, times = open_[gap].pop()
            gaps[gap] = bool(open_[gap])
            took = min(times, n)
            if took < times:
                put(pattern, times - took)
            put((*pattern, size), took)
            n -= took
    return out + [(tuple(p), t) for g in open_.values() for p, t in g]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, beyond last rank, first sequence, offset): pieces of
    a length take the ranks 0, 1, ...; rank r of a row lies in sequence
    first + r - first rank."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            out.append((size, used[size], used[size] + times, sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: a stored table of pieces (doc_id, piece, length, more columns).
    Adds sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = slots(plan(counts, capacity))
    salts = max(16, max(counts.values(), default=0) // SALT_ROWS)
    own = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # Pieces with a smaller salt come before: a table of lengths x salts rows.
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = own.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = own.withColumn("_rank", rank).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    # The plan is as long as the patterns are many: a few times `capacity` rows, whatever the input.
    by_length = defaultdict(list)
    for size, *row in rows:
        by_length[size].append(row)
    shared = spark.sparkContext.broadcast({k: np.array(sorted(v), np.int64) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine, table = np.flatnonzero(size == s), shared.value[int(s)]
                k = np.searchsorted(table[:, 0], at[mine], "right") - 1
                sequence[mine], offset[mine] = table[k, 2] + at[mine] - table[k, 0], table[k, 3]
            keep = [c for c in batch.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if not f.name.startswith("_")]
    return ranked.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    packed = pack(stored(pieces(docs, tokenizer, capacity, end_id)), capacity)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id, n_tokens and the parts (offset, doc_id, piece, start, length)
    of each sequence, in order: at most `capacity` parts."""
    part = F.struct("offset", "doc_id", "piece", "start", "length")
    return pack_documents(docs, tokenizer, capacity, end_id).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("parts"))

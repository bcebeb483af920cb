"""Token-id files: canonical length-limited Huffman coding in blocks.

One pass encodes the texts and stores the raw ids in the shared folder. From the
counts of all ids (one row for each id of the vocabulary) code lengths of at
most 16 bits are found by package-merge; the canonical code follows from the
lengths alone, so the header of a file set is one row. Documents are coded where
they are, each from a byte boundary on, and only codes are shuffled: they are
range partitioned by doc_id, and each partition writes blocks: whole documents
whose ids reach BLOCK_IDS together, or one longer document. A block is decoded
without any other. It holds the bit length of every run of RUN ids of a document
(the checkpoints), so all its runs are decoded side by side with a table of 2^16
entries, and where it starts in its partition, so that readers need one number
for each partition and none for each block.

A file set is a folder with `header` (code lengths, id width) and `blocks`
(part, start, ids, doc_ids, sizes, payload, runs) in Parquet, which every store
that Spark writes to can hold.

Null texts count as empty: such a document is its end id alone. Very long texts
are one block each. Rows with the same doc_id, repeated rows among them, are
written one after another, in the order of their codes' crc32. A null doc_id
comes first and is read back as null. An empty table gives an empty file set.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import shared_folder, slices, stored, texts
from wayfold.llm.library import library_encoder

MAX_BITS = 16
BLOCK_IDS = 1 << 17
RUN = 64
END_ID = 0
#: Ids in one range partition, about, where there are more than the session's
#: number of shuffle partitions holds: some 90 MB of codes.
PARTITION_IDS = 64_000_000
#: Words that the encoder remembers.
MEMO_WORDS = 1_000_000


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids
    that do not occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    leaves = [(w, i) for i, w in enumerate(weights.tolist())]
    level, taken = leaves, []
    for _ in range(limit - 1):
        pairs = [(level[k][0] + level[k + 1][0], -1) for k in range(0, len(level) - 1, 2)]
        taken.append(level)
        level = list(heapq.merge(leaves, pairs, key=lambda x: x[0]))
    taken.append(level)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for level in reversed(taken):  # the first `take` items of each level; packages open two below
        chosen = level[:take]
        single = sum(1 for _, i in chosen if i >= 0)
        lengths[:single] += 1  # leaves come in order of weight
        take = 2 * (len(chosen) - single)
    out[order] = lengths
    return out


def canonical_order(lengths: np.ndarray) -> np.ndarray:
    """Ids with a code, in order of (length, id)."""
    used = np.flatnonzero(lengths)
    return used[np.lexsort((used, lengths[used]))]


class Code:
    """In canonical order, each code follows the one before; aligned to MAX_BITS,
    it is the sum of what the codes before it take up."""

    def __init__(self, lengths: np.ndarray, decoder: bool = True):
        self.lengths = lengths.astype(np.int64)
        order = canonical_order(lengths)
        free = MAX_BITS - self.lengths[order]
        room = np.left_shift(1, free)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (np.cumsum(room) - room) >> free
        if decoder:
            self.symbol, self.bits = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
            filled = int(room.sum())
            self.symbol[:filled], self.bits[:filled] = np.repeat(order, room), np.repeat(self.lengths[order], room)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """ids: of documents of these sizes, one after another. For each document
        its codes, whole bytes, and the bits of each run of RUN ids as 16-bit numbers."""
        size = self.lengths[ids]
        bits = np.concatenate([[0], np.cumsum(size)])  # before each id, and in all
        last = np.cumsum(sizes)
        first = last - sizes
        room = (bits[last] - bits[first] + 7) >> 3
        at = np.cumsum(room) - room  # first byte of each document
        start = bits[:-1] + np.repeat(8 * at - bits[first], sizes)
        # codes have 16 bits at most, so each lies in two neighbouring 32-bit words
        word, free = start >> 5, 64 - (start & 31) - size
        held = self.codes[ids] << free.astype(np.uint64)
        out = np.zeros((int(room.sum()) >> 2) + 2, np.uint64)
        if len(ids):
            head = np.flatnonzero(np.diff(word, prepend=-1))  # every word up to the last has a code that starts in it
            both = np.bitwise_or.reduceat(held, head)
            place = word[head]
            out[place] |= both >> np.uint64(32)
            out[place + 1] |= both & np.uint64(0xFFFFFFFF)
        payload = out.astype(">u4").tobytes()
        lanes = -(-sizes // RUN)
        low = np.repeat(first, lanes) + RUN * (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        runs = (bits[np.minimum(low + RUN, np.repeat(last, lanes))] - bits[low]).astype("<u2").tobytes()
        cut = lambda raw, n: [raw[b - k : b] for b, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
        return cut(payload, room), cut(runs, 2 * lanes)

    def decode(self, payload: bytes, runs: bytes, sizes: np.ndarray) -> np.ndarray:
        """The ids of documents of these sizes, from their joined codes and runs."""
        bits, lanes = np.frombuffer(runs, "<u2").astype(np.int64), -(-sizes // RUN)
        before = np.concatenate([[0], np.cumsum(bits)])
        last = np.cumsum(lanes)
        own = before[last] - before[last - lanes]  # bits of each document
        room = 8 * ((own + 7) >> 3)
        at = before[:-1] + np.repeat(np.cumsum(room) - room - before[last - lanes], lanes)
        raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]  # 24 bits from each byte
        out = np.empty((RUN, len(at)), np.uint32)
        limit = len(window) - 1
        for step in range(RUN):
            key = (window[np.minimum(at >> 3, limit)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[step] = self.symbol[key]
            at = at + self.bits[key]
        held = np.full(len(bits), RUN)  # a document's last run reads on beyond its end
        some = lanes > 0
        held[last[some] - 1] = sizes[some] - RUN * (lanes[some] - 1)
        return out.T[np.arange(RUN)[None, :] < held[:, None]]


def raw_ids(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids; 16 bits an id where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(tokenizer, narrow=True, words=MEMO_WORDS)
        end = b"" if end_id is None else int(end_id).to_bytes(e.width, "little")
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                ids = [x + end for x in e.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // e.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(raw: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often each id occurs in all documents; one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                total += np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(at, 512).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


BLOCKS = "part int, start long, ids long, doc_ids array<long>, sizes array<long>, payload binary, runs binary"
_CODED = "doc_id long, n long, crc long, payload binary, runs binary"


def coded(raw: DataFrame, lengths, kind: str) -> DataFrame:
    """raw_ids() by document as codes: doc_id, n (ids), crc (of the codes),
    payload, runs. lengths: the broadcast code lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, width = Code(lengths.value, decoder=False), np.dtype(kind).itemsize
        for batch in batches:
            for at, n in slices(batch, "ids"):
                part = batch.slice(at, n)
                held = part.column("ids").to_pylist()
                sizes = np.array([len(x) // width for x in held], np.int64)
                payload, runs = code.encode(np.frombuffer(b"".join(held), kind), sizes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array([zlib.crc32(x) for x in payload], pa.int64()), pa.array(payload, pa.binary()), pa.array(runs, pa.binary())], ["doc_id", "n", "crc", "payload", "runs"])

    return raw.select("doc_id", "ids").mapInArrow(run, _CODED)


def blocked(codes: DataFrame) -> DataFrame:
    """coded() in order, within partitions, as rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            doc_ids, sizes, payload, runs = zip(*rows, strict=True)
            values = [part], [start], [held], [list(doc_ids)], [list(sizes)], [b"".join(payload)], [b"".join(runs)]
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for row in zip(*(some.column(c).to_pylist() for c in ("doc_id", "n", "payload", "runs")), strict=True):
                    rows.append(row)
                    held += row[1]
                    if held >= BLOCK_IDS:
                        yield out()
                        rows, start, held = [], start + held, 0
        if rows:
            yield out()

    return codes.mapInArrow(run, BLOCKS)


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID) -> None:
    """Write the file set of all documents, in ascending doc_id order, to path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    raw = stored(raw_ids(docs, tokenizer, end_id), "zstd")
    counts = id_counts(raw, kind, size)
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary
    parts = max(1, int(counts.sum()) // PARTITION_IDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = coded(raw, shared, kind).repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "n")
    blocked(ordered).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()), kind)], "lengths binary, kind string").coalesce(1).write.parquet(f"{path}/header")


def read_files(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32, and ids
    (binary, little-endian unsigned 32-bit) unless digests_only."""
    header = spark.read.parquet(f"{path}/header").first()
    lengths = np.frombuffer(bytes(header["lengths"]), np.uint8)
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row for each range partition, 16 bytes: as many as the session's shuffle
    # partitions, or one for PARTITION_IDS ids. So it may be broadcast.
    sums = table.groupBy("part").agg(F.sum("ids").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = table.join(F.broadcast(base), "part").select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "sizes", "payload", "runs")
    shared = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                sizes = row["sizes"].values.to_numpy()
                ids = code.decode(row["payload"].as_py(), row["runs"].as_py(), sizes).astype("<u4")
                ends = np.cumsum(sizes)
                raw = [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                cols = [row["doc_ids"].values, pa.array(row["start"].as_py() + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([] if digests_only else [pa.array(raw, pa.binary())]), ["doc_id", "start", "n_tokens", "ids_crc32"] + ([] if digests_only else ["ids"]))

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digests_only else ", ids binary"))


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_folder(docs.sparkSession)
    write_files(docs, tokenizer, path)
    return read_files(docs.sparkSession, path, digests_only=True)

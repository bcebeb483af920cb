"""N-gram Jaccard join: documents whose word-shingle sets are alike.

A document's set holds its distinct shingles of `words` words, as 64-bit hashes
in one global order. Two documents link when their sets' Jaccard similarity is
at least `percent` / 100. The join is exact (up to collisions of 64-bit hashes):

1. Equal sets become one class, whose smallest doc_id stands for it.
2. Two linked sets of n and m shingles differ in at most (n + m) * (100 -
   percent) / (100 + percent) of them. Each set is cut into more ranges of the
   order than that, a quarter more at least, so linked sets have many ranges in
   common, and so many that of a set's ranges more hold shingles than may differ
   (but for one set in 10 million, see range_count()). Ranges that hold the same
   shingles give the same signature. Signatures are
   ordered, those that no other set has first, then rare ones, and of each set
   as many are looked at, in that order, as a linked set may lack, and one more
   (prefix filtering): linked sets have one of these in common, and most sets,
   whose signatures are mostly their own, are done with. Sets that share such
   signatures, directly or through others, form a family.
   Signatures that several sets have are told by a bitmap, up to 32 MB; beyond
   some 100 million of them it only lets more rows through, which the joins
   behind it drop. They are counted by 40 of their bits, which travel as sorted
   runs of differences, some 3 bytes each; two that are equal in these bits only
   let rows through as well.
3. The sets of a family meet in blocks: a family of many sets is cut into g
   blocks, and every pair of blocks is one group of rows, so no task holds more
   than two blocks. In a group the sets of one block are stored in a trie. Each
   set of the other is taken down the trie: children of a node share the overlap
   found so far, and a subtree is left, with all sets below it that are not long
   enough, as soon as the shingles that remain can't reach the needed overlap.
   Every pair is decided for link counts, which tasks
   add up by set before they leave, and for `links`. For components alone, a set
   that already belongs to another's component is not compared with it again.
4. Links are contracted to components of sets, labelled with the smallest doc_id.

Null texts count as empty; texts without words have empty sets, which link with
nothing. Texts with fewer than `words` words have the whole sequence as their
one shingle. Letters A-Z count as a-z. Very long texts are read whole; a text is
what a task holds at least. Repeated rows are copies. A doc_id that stands with
several texts has a row for each, and what any of them links with reaches it. A
null doc_id is nobody's label: a component of such rows alone has none. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import WORD, release, removed, slices, sole_memo, stored, texts
from wayfold.operators.components import connected, join_hot

#: Ratio of neighbouring bounds of set sizes.
RATIO = 1.35
#: Identical ranges that two linked sets have at least (and a quarter of those
#: that may differ); sets with fewer empty ranges than this give no signature
#: for empty ones.
SPARE = 4
#: Share of sets, at most, of which no more ranges hold shingles than may differ.
SPARSE = 1e-7
#: A signature is rare in fewer classes than this.
RARE = 17
#: Sets, and shingles in all, of a block, about.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Bits of the filters that tasks hold, as a power of two: by how much they hold,
#: 2 MB at least and 32 MB at most. A filter that is full only lets more rows
#: through, which the joins behind it drop.
FILTER_BITS, FILTER_MOST = 24, 28
#: Signatures are counted by COUNT_BITS of their bits, in buckets by the first of
#: these; in a bucket, VALUE_BITS are left. A task holds so many before it sends them.
COUNT_BITS, VALUE_BITS, SENT = 40, 28, 1 << 20
MEMO_WORDS = 300_000
#: Rows, of 4 KB, of the filter of documents that go.
FILTER_ROWS = 2048
#: Stands for a null doc_id while rows are looked up.
NOBODY = -(1 << 63)

_GOLD, _M1, _M2, _S32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(32)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_memo: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    h = _memo.get(word)
    if h is None:
        if len(_memo) >= MEMO_WORDS:
            _memo.clear()
        h = _memo[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return h


def shingle_set(text: str, words: int = 3) -> np.ndarray:
    """Distinct shingles as ascending 64-bit hashes."""
    found = WORD.findall(text.translate(_LOWER) if not text.islower() else text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)  # a short sequence is no shingle's hash
    for k in range(min(words, len(h))):
        out = _mix(out * _GOLD + h[k : k + n])
    return np.unique(out)


def size_bounds(limit: int = 1 << 40) -> np.ndarray:
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out)


_BOUNDS = size_bounds()


@lru_cache(maxsize=1024)
def range_count(least: int, differ: int) -> int:
    """Ranges for sets of `least` shingles or more, `differ` of which may lack:
    so many that at most a share of SPARSE of them leave all but `differ` ranges
    empty. Shingles are hashes, so the share is under C(ranges, differ) * (differ
    / ranges) ^ least."""
    ranges = differ + max(SPARE, differ // 4)
    beyond = lambda r: math.lgamma(r + 1) - math.lgamma(differ + 1) - math.lgamma(r - differ + 1) + least * math.log(differ / r) > math.log(SPARSE)
    while beyond(ranges):
        ranges += max(1, ranges // 16)
    return ranges


def signatures(shingles: np.ndarray, percent: int = 90) -> list[tuple[int, np.ndarray]]:
    """Signatures of one set, for its own class of sizes and, where a smaller
    set of the class below may link with it, for that; with each the number that
    is to be looked at. Where no more ranges hold shingles than may differ, the
    ranges in common with a linked set may be empty ones: one signature stands
    for those, by itself."""
    n, out = len(shingles), []
    if not n:
        return out
    own = int(np.searchsorted(_BOUNDS, n, "right")) - 1
    for c in (own, own - 1):
        if c < 0 or (c < own and percent * n > 100 * (int(_BOUNDS[own]) - 1)):
            continue
        largest = int(_BOUNDS[c + 1]) - 1  # of the smaller set; the other has 100 / percent of it at most
        differ = largest * (100 - percent) // percent
        if differ == 0:
            continue  # linked sets are equal
        ranges = range_count(int(_BOUNDS[c]), differ)
        at = ((shingles >> _S32) * np.uint64(ranges)) >> _S32
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        held = np.add.reduceat(_mix(shingles + np.uint64(c)), first)
        # of these, at most `differ` are missing in a linked set, or stand against its empty ranges
        out.append((differ + 1, _mix(held + at[first] * _GOLD + np.uint64(c))))
        if len(first) <= differ:
            out.append((1, _mix(np.array([c], np.uint64))))
    return out


def needed(n: int, m: int, percent: int) -> int:
    """Smallest overlap with which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


class Trie:
    """Ascending sets in lexicographic order with the length of the prefix that
    each shares with the one before: the nodes of their trie in depth-first
    order. `after` is the next set that shares less, so the sets from one up to
    there hang below its branch; `longest` is the largest size among them. Long
    edges are walked in steps of STEP shingles."""

    STEP = 48

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            k = min(len(a), len(b))
            differs = np.flatnonzero(a[:k] != b[:k])
            self.shared.append(int(differs[0]) if len(differs) else k)
        n = len(self.sets)
        self.after, self.longest = [n] * n, [len(x) for x in self.sets]
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n and self.shared[j] >= self.shared[i]:
                self.longest[i] = max(self.longest[i], self.longest[j])
                j = self.after[j]
            self.after[i] = j

    def links(self, probe: np.ndarray, percent: int, skip=lambda i: False) -> list[tuple[int, int]]:
        """(position, overlap) of the stored sets that link with the probe."""
        out, n = [], len(probe)
        if not n:
            return out
        shared, after, longest, sets = self.shared, self.after, self.longest, self.sets
        # overlap of the current path at the depths that were reached
        depths, found = [0], [0]
        i, dead, missed = 0, -1, 0  # dead: depth of the subtree that was left, missed: its shingles that the probe lacks
        while i < len(sets):
            while depths[-1] > shared[i]:
                depths.pop()
                found.pop()
            if dead > shared[i]:
                dead = -1
            if dead >= 0:
                # below it, only sets that are longer than those tried may afford so many
                if longest[i] - missed < needed(n, longest[i], percent):
                    i = after[i]
                    continue
            held = sets[i]
            m, need = len(held), needed(n, len(held), percent)
            if dead >= 0 and m - missed < need or min(n, m) < need or skip(i):
                i += 1
                continue
            depth, overlap = depths[-1], found[-1]
            while depth < m:
                step = held[depth : depth + self.STEP]
                at = np.searchsorted(probe, step)
                at[at == n] = n - 1
                overlap += int((probe[at] == step).sum())
                depth += len(step)
                depths.append(depth)
                found.append(overlap)
                if overlap + min(m - depth, n - overlap) < need:
                    break
            if depth >= m and overlap >= need:
                out.append((i, overlap))
            elif depth < m:
                dead, missed = depth, depth - overlap
            i += 1
        return out


def block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links that join the components of the two blocks' sets (right None: of
    left with itself): enough of them to connect what is linked, or every one."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    stored_ = left if right is None else right
    trie, out = Trie([i for i, _ in stored_], [s for _, s in stored_]), []
    place = {i: k for k, i in enumerate(trie.ids)}
    for i, probe in left:
        own = place.get(i, -1) if right is None else -1
        for k, _ in trie.links(probe, percent, lambda k: k <= own or not every and top(trie.ids[k]) == top(i)):
            j = trie.ids[k]
            if every:
                out.append((i, j))
            elif top(i) != top(j):
                parent[top(i)] = top(j)
                out.append((i, j))
    return out


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """hashes: (h), longs of a stored table. A set of them, of four bits or more
    for each, as far as FILTER_MOST allows; in words of 64 bits."""
    bits = min(FILTER_MOST, max(FILTER_BITS, (4 * hashes.count()).bit_length()))
    place = hashes.select((F.col("h").bitwiseAND((1 << bits) - 1)).alias("p"))
    rows = place.groupBy(F.expr("shiftright(p, 6) AS w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT))) AS b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def fingerprints(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_id (64-bit hash of the set), signatures, and
    groups: how many signatures each group has and how many are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("ngram_join", _memo.clear)
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                ids = [_set_id(s) for s in sets]
                found = [signatures(s, percent) for s in sets]
                held = [b"".join(h.tobytes() for _, h in g) for g in found]
                groups = [np.array([(len(h), k) for k, h in g], "<i4").tobytes() for g in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(held, pa.binary()), pa.array(groups, pa.binary())], ["doc_id", "n_shingles", "set_id", "signatures", "groups"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id long, signatures binary, groups binary")


def _exploded(prints: DataFrame, bitmaps) -> DataFrame:
    """(h, set_id) for the signatures to be looked at that several sets have, by
    bitmaps (of those that several sets have, and of those that many have). The
    order is by bitmaps, then by value, for all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("ngram_join, signatures", lambda: None)
        for batch in batches:
            for at, rows in slices(batch, "signatures"):
                part = batch.slice(at, rows)
                raw = part.column("signatures").to_pylist()
                h = np.frombuffer(b"".join(raw), np.int64)
                own = np.repeat(part.column("set_id").to_numpy(), [len(x) // 8 for x in raw])
                if len(h):
                    several, many = (_held(b, h) for b in bitmaps.value)
                    size, look = np.frombuffer(b"".join(part.column("groups").to_pylist()), "<i4").reshape(-1, 2).T
                    group = np.repeat(np.arange(len(size)), size)
                    order = np.lexsort((h, several.astype(np.int8) + (several & many), group))
                    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                    keep = order[(place < np.repeat(look, size)) & several[order]]
                    h, own = h[keep], own[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(own)], ["h", "set_id"])

    return prints.select("set_id", "signatures", "groups").mapInArrow(run, "h long, set_id long")


def packed(hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, run): the COUNT_BITS low bits of hashes, sorted, as differences of
    32 bits, of which all lowest bytes come first, then all second ones and so on,
    so that the zeros among the high ones lie together."""
    low = hashes.view(np.uint64) & np.uint64((1 << COUNT_BITS) - 1)
    low.sort()
    bucket, value = (low >> np.uint64(VALUE_BITS)).astype(np.int64), (low & np.uint64((1 << VALUE_BITS) - 1)).astype("<u4")
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(low)])
    last = np.append(first, len(low))[1:]
    step = np.diff(value, prepend=value[:1])
    step[first] = value[first]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        yield int(bucket[a]), step[a:b].view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(run: bytes) -> np.ndarray:
    """The values of a run of packed(), ascending."""
    steps = np.ascontiguousarray(np.frombuffer(run, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64)


def _counted_signatures(prints: DataFrame) -> DataFrame:
    """(h, n): the COUNT_BITS low bits of the signatures that several sets have, and
    how many have them. Copies of a set count once: rows whose set has copies, by a
    bitmap, are made one for each set before; the signatures of others stay where
    they are until they are packed."""
    spark = prints.sparkSession
    again = stored(prints.groupBy(F.col("set_id").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"))
    bitmap = spark.sparkContext.broadcast(_bitmap(again))

    def told(batch: pa.RecordBatch, copies: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(_held(bitmap.value, batch.column("set_id").to_numpy()) == copies))

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("ngram_join, signatures", lambda: None)
        for batch in batches:
            yield told(batch, True)

    def pack(chosen: Callable[[pa.RecordBatch], pa.RecordBatch]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole_memo("ngram_join, signatures", lambda: None)
            held, n = [], 0

            def out() -> pa.RecordBatch:
                runs = list(packed(np.concatenate([np.zeros(0, np.int64), *held])))
                return pa.RecordBatch.from_arrays([pa.array([b for b, _ in runs], pa.int64()), pa.array([r for _, r in runs], pa.binary())], ["bucket", "run"])

            for batch in map(chosen, batches):
                for at, rows in slices(batch, "signatures"):
                    for raw in batch.column("signatures").slice(at, rows).to_pylist():
                        held.append(np.frombuffer(raw, np.int64))
                        n += len(held[-1])
                        if n >= SENT:
                            yield out()
                            held, n = [], 0
            yield out()
            held = []
            release()  # the worker waits for its next task with no more than it began with

        return run

    def count(table: pa.Table) -> pa.Table:
        value, n = np.unique(np.concatenate([unpacked(r) for r in table.column("run").to_pylist()]), return_counts=True)
        h = value[n > 1] + (table.column("bucket")[0].as_py() << VALUE_BITS)
        return pa.table({"h": pa.array(h, pa.int64()), "n": pa.array(n[n > 1], pa.int64())})

    signed, sent = prints.select("set_id", "signatures"), "bucket long, run binary"
    once = signed.mapInArrow(copied, "set_id long, signatures binary").dropDuplicates(["set_id"])
    # one Python worker a task: those of each Python step in a stage run beside one another
    runs = signed.mapInArrow(pack(lambda batch: told(batch, False)), sent).unionByName(once.mapInArrow(pack(lambda batch: batch), sent))
    return runs.groupBy("bucket").applyInArrow(count, "h long, n long")


def families(prints: DataFrame) -> DataFrame:
    """(set_id, family) of the sets that share a looked-at signature with another."""
    spark = prints.sparkSession
    shared = stored(_counted_signatures(prints))
    bitmaps = spark.sparkContext.broadcast((_bitmap(shared), _bitmap(shared.where(F.col("n") >= RARE))))
    members = stored(_exploded(prints, bitmaps).distinct())  # copies of a set go before the join
    stars = members.groupBy("h").agg(F.min("set_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = join_hot(members, stars, "h", members.count()).select(F.col("set_id").alias("a"), F.col("first").alias("b"))
    return connected(edges).select(F.col("node").alias("set_id"), F.col("component").alias("family"))


def _set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_of(docs: DataFrame, bitmap, words: int) -> DataFrame:
    """(doc_id, set_id, shingles) of the documents whose id the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("ngram_join", _memo.clear)
        for batch in batches:
            keep = np.flatnonzero(_held(bitmap.value, batch.column("h").to_numpy()))
            if len(keep):
                chosen = batch.take(pa.array(keep))
                for at, n in slices(chosen):
                    part = chosen.slice(at, n)
                    sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(_set_id, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set_id", "shingles"])

    return texts(docs).withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, set_id long, shingles binary")


def _counted(links: list[tuple[int, int]], copies: dict[int, int]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Of all links of a group, enough to connect what is linked; and how many
    documents each set links with."""
    parent: dict[int, int] = {}
    count: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in links:
        count[a], count[b] = count.get(a, 0) + copies[b], count.get(b, 0) + copies[a]
        if top(a) != top(b):
            parent[top(a)] = top(b)
            out.append((a, b))
    return out, count


def _links(rows: DataFrame, percent: int, kind: str = "joining") -> DataFrame:
    """rows: (family, i, j, side, set_id, copies, shingles), side 0 for block i
    and 1 for block j. Groups come one after another, sorted; a task holds one
    group. Links (a, b): enough to connect what is linked ("joining"), or "every"
    one; "counted" adds rows of a set a and the number n of documents that it
    links with in the group, without b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, copies = None, ([], []), {}

        def out() -> Iterator[pa.RecordBatch]:
            if key is not None:
                found, count = block_links(blocks[0], None if key[1] == key[2] else blocks[1], percent, kind != "joining"), {}
                if kind == "counted":
                    found, count = _counted(found, copies)
                if found:
                    a, b = [a for a, _ in found] + list(count), [b for _, b in found] + [None] * len(count)
                    n = [None] * len(found) + list(count.values())
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])

        for batch in batches:
            for r in range(batch.num_rows):
                at = (batch.column("family")[r].as_py(), batch.column("i")[r].as_py(), batch.column("j")[r].as_py())
                if at != key:
                    yield from out()
                    key, blocks, copies = at, ([], []), {}
                copies[batch.column("set_id")[r].as_py()] = batch.column("copies")[r].as_py()
                blocks[batch.column("side")[r].as_py()].append((batch.column("set_id")[r].as_py(), np.frombuffer(batch.column("shingles")[r].as_py(), np.uint64)))
        yield from out()

    dealt = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, n long")


def _met(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents' doc_id, n_shingles and set_id; those with shingles; their classes of equal
    sets (set_id, rep: the smallest doc_id, n, size); and the classes' sets as
    rows for _links()."""
    spark = docs.sparkSession
    signed = stored(fingerprints(docs, words, percent))
    prints = stored(signed.select("doc_id", "n_shingles", "set_id"))
    sound = prints.where("n_shingles > 0")
    classes = stored(sound.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("size")))
    own = classes.join(families(signed), "set_id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    own = stored(own.select("set_id", F.coalesce("rep", F.lit(NOBODY)).alias("rep"), "family", "size", F.col("n").alias("copies")))
    removed(signed)  # 8 bytes for each signature, which nothing reads from here on
    sizes = own.groupBy("family").agg(blocks.alias("g"), F.count("*").alias("members"))
    bitmap = spark.sparkContext.broadcast(_bitmap(own.select(F.xxhash64("rep").alias("h"))))
    dealt = join_hot(own, sizes, "family", own.count(), "members").where("members > 1").withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("g")).cast("int"))
    named = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)))
    found = _sets_of(named, bitmap, words).withColumnsRenamed({"doc_id": "rep"}).dropDuplicates(["rep", "set_id"])  # of repeated rows, one
    sets = dealt.join(found, ["rep", "set_id"])
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    placed = sets.select("family", "own", other.alias("other"), "set_id", "copies", "shingles")
    rows = placed.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "set_id", "copies", "shingles")
    return prints, sound, classes, rows


def ngram_join(docs: DataFrame, words: int = 3, percent: int = 90, counts: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that a document
    reaches by links, itself included; and, with counts, n_links: the other
    documents that it links with, copies included."""
    prints, sound, classes, rows = _met(docs, words, percent)
    found = stored(_links(rows, percent, "counted" if counts else "joining"))
    joined = connected(found.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "set_id"})
    least = joined.join(classes, "set_id").groupBy("component").agg(F.min("rep").alias("_label"), F.count("*").alias("_sets"))
    labels = join_hot(joined, stored(least), "component", joined.count(), "_sets").select("set_id", "_label")
    others = found.where("b IS NULL").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("_others"))
    named = classes.join(labels, "set_id", "left").join(others, "set_id", "left").select("set_id", "n", F.coalesce("_label", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"))
    names = ["doc_id", "n_shingles", "component_id", *(["n_links"] if counts else [])]
    linked = join_hot(sound.select("doc_id", "n_shingles", "set_id"), named, "set_id", sound.count()).select(names)
    return linked.unionByName(prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")).select(names))


def links(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(a, b), a < b: every link between different texts, each of which its
    smallest doc_id stands for (texts that have none are left out)."""
    _, _, classes, rows = _met(docs, words, percent)
    rep = lambda c: classes.select(F.col("set_id").alias(c), F.col("rep").alias(f"{c}_rep"))
    found = _links(rows, percent, "every").select("a", "b").join(rep("a"), "a").join(rep("b"), "b").where("a_rep IS NOT NULL AND b_rep IS NOT NULL")
    return found.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all their columns, without the rows that reach a document with
    a smaller doc_id. Rows without a doc_id stay. Only rows that a filter of those
    that go lets through are shuffled."""
    gone = stored(ngram_join(docs, words, percent, counts=False).where("component_id <> doc_id").select("doc_id").distinct())
    free = "_" * (1 + max(map(len, docs.columns)))  # a prefix that no column has
    key, at, bucket, bits = (free + c for c in ("doc_id", "at", "bucket", "bits"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_ROWS * 32768))
    doubt = gone.select(place("doc_id").alias("at")).groupBy(F.expr("at DIV 32768").alias(bucket)).agg(F.expr("bitmap_construct_agg(at % 32768)").alias(bits))
    own = docs.withColumn(key, F.col("doc_id").cast("long"))
    own = own.withColumn(at, place(key)).withColumn(bucket, F.expr(f"{at} DIV 32768")).join(F.broadcast(doubt), bucket, "left")  # 8 MB at most
    byte = F.conv(F.hex(F.expr(f"substring({bits}, CAST({at} % 32768 DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    may_go = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, CAST({at} % 8 AS INT))")) != 0, F.lit(False))
    stay = own.where(may_go).join(gone.withColumnRenamed("doc_id", key).hint("merge"), key, "left_anti")
    return own.where(~may_go).select(docs.columns).unionAll(stay.select(docs.columns))

"""Secret scans: fixed patterns, and sliding-window entropy over candidates.

Base kinds are found by pattern. The method adds spans: every run of 20 or more
characters of the base64 and token alphabet is a candidate; a window of 20
characters slides over it, and its Shannon entropy, over all characters and for
each character class (upper case, lower case, digits), follows from counts of
which two change at each step. Windows whose entropy reaches that of random keys
and that mix classes are joined into spans, which are widened to the whole runs
of letters and digits that they touch. Candidates on the allow-list (words,
paths and hosts, dates, uuids, repeated characters) are suppressed; so are spans
of which a run with a digit begins or ends with a word for examples. An added span whose
windows a base span covers is not added.

Null texts count as empty. Empty texts have no spans. Very long texts are
scanned whole. Spans that begin together stand in the order of the kinds.
Repeated rows give repeated results, a null doc_id is a row like any other, an
empty table gives no rows. Other columns are ignored by scanning and kept as
they are by masking, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.common import slices, sole_memo, texts

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character in a window of 20; random base64 keys have about 4.0.
LEAST_ENTROPY = 3.5
#: Bits a character that the class with most characters of the window has at least.
LEAST_CLASS_ENTROPY = 1.5
#: Characters of the window that each of two classes has at least, one of them digits.
LEAST_OF_CLASS = 2
ALLOWED = (
    re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/=]*\Z"),  # words, joined or not
    re.compile(r"[0-9_=+/-]+\Z"),  # numbers, dates, rules
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),  # uuids
    re.compile(r"(?:[A-Za-z]+[0-9]{0,4}[-_/+=]+)+[A-Za-z]*[0-9]{0,4}\Z"),  # words with numbers, joined
)

#: Runs of letters and digits that are meant as examples.
EXAMPLE = re.compile(r"(?i)(?:example|sample|placeholder|changeme|dummy|xxxx)|.*(?:example|sample|placeholder|changeme|dummy|xxxx)\Z")
RUN = re.compile(r"[A-Za-z0-9]+")

_N_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def char_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def entropy_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Joined windows of text[start:end] that look random. The entropy of n
    characters with counts k is log n - sum(k log k) / n, for all characters and
    for those of each class; one step changes two counts."""
    counts: dict[str, int] = {}
    size, sums, total = [0] * 4, [0.0] * 4, 0.0
    full, out = math.log2(WINDOW), []
    for i in range(start, end):
        for c, step in ((text[i], 1), *(((text[i - WINDOW], -1),) if i - start >= WINDOW else ())):
            k, kind = counts.get(c, 0), char_class(c)
            counts[c] = k + step
            change = _N_LOG[k + step] - _N_LOG[k] if k + step <= WINDOW else 0.0
            total, sums[kind], size[kind] = total + change, sums[kind] + change, size[kind] + step
        if i - start >= WINDOW - 1 and full - total / WINDOW >= LEAST_ENTROPY and size[0] >= LEAST_OF_CLASS and size[1] + size[2] >= LEAST_OF_CLASS:
            most = max(range(3), key=size.__getitem__)
            if math.log2(size[most]) - sums[most] / size[most] >= LEAST_CLASS_ENTROPY:
                a, b = i - WINDOW + 1, i + 1
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in code points, by start and kind."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    added, covers, reach, k = [], sorted(base), -1, 0
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not any(c.isdigit() for c in s) or any(p.match(s) for p in ALLOWED):
            continue
        for a, b in entropy_spans(text, m.start(), m.end()):
            while k < len(covers) and covers[k][0] <= a:
                reach, k = max(reach, covers[k][1]), k + 1
            if b > reach:  # else a base span that begins no later ends no sooner
                runs = [r for r in RUN.finditer(text, m.start(), m.end()) if r.start() < b and a < r.end()]
                if not any(EXAMPLE.match(r[0]) for r in runs if any(c.isdigit() for c in r[0])):
                    a, b = min(a, runs[0].start()), max(b, runs[-1].end())
                    if added and a <= added[-1][1]:
                        added[-1] = (added[-1][0], max(b, added[-1][1]), "entropy")
                    else:
                        added.append((a, b, "entropy"))
    return sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                found = [scan(t) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(k == kind for _, _, k in s) for s in found], pa.int64()) for kind in KINDS]
                base = [hashlib.sha256(joined([x for x in s if x[2] != "entropy"]).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(base), pa.array([joined(s) for s in found])], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


MASK = "[SECRET]"


def mask(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, done = [], 0
    merged: list[list[int]] = []
    for a, b, _ in scan(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[done:a], MASK]
        done = b
    return "".join([*out, text[done:]])


def masked_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets masked and n_chars, where there is such a column, as
    the new text has it. No row goes; a null text stays null."""
    names, at = docs.columns, docs.columns.index("text")
    ids = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("secrets", lambda: None)
        for batch in batches:
            for start, n in slices(batch):
                part = batch.slice(start, n)
                columns, old = list(part.columns), part.column("text").to_pylist()
                new = [None if t is None else mask(t) for t in old]
                columns[at] = pa.array(new, part.schema.field(at).type)
                if ids is not None:
                    sizes = [c if t is None or t == o else len(t) for c, t, o in zip(part.column(ids).to_pylist(), new, old, strict=True)]
                    columns[ids] = pa.array(sizes, part.schema.field(ids).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)

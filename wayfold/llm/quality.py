"""Quality rules with robust multivariate outliers.

Plain rules come first: a text of fewer than 50 words, or of which more than
half of the words stand in repeated 3-word windows, fails. For the others a
vector of transformed statistics is held against a minimum-covariance-determinant
estimate of its language and source: the mean and scatter of those `SHARE` of
the group's rows that lie closest together. The estimate is found by
concentration steps over all rows, for all groups at once: from a robust start
(medians and quartiles by component), each step computes distances, takes the
rows up to the group's quantile, and re-estimates from their sums, until nothing
changes or STEPS steps are done. A row whose squared Mahalanobis distance is
beyond CUT is rejected.

Every language and source has an estimate of its own, whatever its size: its
mean and scatter count as many rows as it has, those of its language PRIOR rows
more, and a language's lean on those of all rows in the same way. So a group of
one row is judged by its language and a large one by itself, without a step
between. No row that passes the plain rules is left unjudged.

Statistics are rounded to 1 / GRAIN and summed as whole numbers, and quantiles
come from counts, so results don't depend on how rows are partitioned.

Null texts count as empty (and fail the plain rules). Very long texts are read
whole. A null language or source is a group of its own, as is a missing column.
Repeated rows count as often as they occur; equal distances are ranked alike. An
empty table gives no rows. Other columns are ignored, whatever their names. A
null doc_id is a row like any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import WORD, slices, stored, texts
from wayfold.operators.components import join_hot

LEAST_WORDS = 50
SHARE = 0.75
STEPS = 8
#: Rows for which the estimate above a group counts in the group's own.
PRIOR = 50
#: Statistics are whole multiples of 1 / GRAIN.
GRAIN = 4096
#: Squared distance at which a row is rejected, after scaling so that the median
#: is that of a chi-square variable; far beyond its tail, since texts of a source
#: are no Gaussian sample and clean texts have to stay.
CUT = 60.0
#: Spread that every component is given beside its own: differences below it
#: don't count as odd. Where the group repeats nothing, repeated words alone are
#: beyond CUT from 40 % on (the base rule ends at 50 %), repeated lines from 75 %.
FLOORS = (0.15, 0.03, math.sqrt(0.40 / CUT), math.sqrt(0.75 / CUT))
SYMBOL = re.compile(r"[#*$%&|<>]")
CHI2_MEDIAN = 3.357  # of 4 degrees of freedom
VECTOR = ("v0", "v1", "v2", "v3")


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, covered)
                    covered = i + 3
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeat


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                found = part.column("text").to_pylist()
                cols = list(zip(*map(text_statistics, found), strict=True))
                lines = [t.count("\n") + 1 for t in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), *(pa.array(c, pa.int64()) for c in (*cols, lines))], [f.split()[0] for f in STATS.split(", ")])

    own = docs.withColumns({c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")})
    return texts(own, "lang", "source").mapInArrow(run, STATS)


def vectors(stats: DataFrame) -> DataFrame:
    """Rates rather than counts, so that long texts are no outliers for being
    long: log word length, roots of symbols a character, repeated words a word
    and repeated lines a line. In units of 1 / GRAIN."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    rates = F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / F.col("n_lines"))
    return stats.withColumns({v: F.round(r * GRAIN).cast("long") for v, r in zip(VECTOR, rates, strict=True)})


OVERALL = "all"
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_SUMS = ["inside", *(f"s{i}" for i in range(4)), *(f"p{i}{j}" for i, j in _PAIRS)]
PARAMETERS = [*(f"m{i}" for i in range(4)), *(f"i{i}{j}" for i, j in _PAIRS)]
_ESTIMATE = "g string, n long, " + ", ".join(f"{c} double" for c in PARAMETERS)


def _distance():
    """Squared distance from inverse scatter entries i00.. and means m0.."""
    d = [F.col(v) / GRAIN - F.col(f"m{i}") for i, v in enumerate(VECTOR)]
    terms = [d[i] * d[j] * F.col(f"i{i}{j}") * F.lit(1.0 if i == j else 2.0) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _level(distance):
    """A distance in 1 / 65536, of which the first seven binary digits are kept."""
    whole = F.floor(F.least(distance, F.lit(2.0**40)) * 65536)
    free = F.greatest(F.length(F.bin(whole)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", whole, free), free)


def _quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n (rows), and for each share the smallest value that so many of the
    rows don't exceed. A row for each value is what a task sees of a group."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(value)
    summed = counts.withColumns({"_below": F.sum("_c").over(order), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    return summed.groupBy(*keys).agg(F.first("_n").alias("n"), *(F.min(F.when(F.col("_below") >= share * F.col("_n"), F.col(value))).alias(name) for name, share in shares.items()))


def estimate(chain: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse scatter from the sums of a group's inner rows and those
    of what stands above it, from all rows down."""
    mean = scatter = None
    for sums in chain:
        n = float(sums["inside"])
        own = np.array([float(sums[f"s{i}"]) / GRAIN / n for i in range(4)])
        spread = np.array([[float(sums[f"p{min(i, j)}{max(i, j)}"]) / GRAIN**2 / n - own[i] * own[j] for j in range(4)] for i in range(4)])
        if mean is None:
            mean, scatter = own, spread
        else:
            mean, scatter = (n * own + PRIOR * mean) / (n + PRIOR), (n * spread + PRIOR * scatter) / (n + PRIOR)
    return mean, np.linalg.inv(scatter + np.diag(np.square(FLOORS)))


def keyed(rows: DataFrame) -> DataFrame:
    """rows with k0, its language and source, and k1, its language, as text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.regexp_replace(c, "/", "//")), F.lit("null"))
    return rows.withColumns({"k0": F.concat(part("lang"), F.lit("/."), part("source")), "k1": part("lang")})


def estimates(rows: DataFrame, total: int, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """rows: a stored table with k0, k1 and the vector. The estimate of every
    language and source: g (its k0), n (rows), means, inverse scatter, and scale:
    the factor that brings the median squared distance, which leans on the
    language's as means do, down to that of a chi-square variable."""
    own = rows.select(F.explode(F.array("k0", "k1", F.lit(OVERALL))).alias("g"), *VECTOR)
    parts = own.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(v).alias("value")) for i, v in enumerate(VECTOR)))).alias("c")).select("g", "c.*")
    quartiles = _quantiles(parts, ["g", "i"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = quartiles.groupBy("g").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col(q))).alias(f"{q}{i}") for i in range(4) for q in ("q1", "q2", "q3")))
    start = {f"m{i}": F.col(f"q2{i}") / GRAIN for i in range(4)}
    for i in range(4):
        spread = (F.col(f"q3{i}") - F.col(f"q1{i}")) / GRAIN / 1.349
        start |= {f"i{i}{j}": (1 / (spread * spread + F.lit(FLOORS[i] ** 2)) if i == j else F.lit(0.0)) for j in range(i, 4)}
    now = stored(wide.select("g", "n", *(start[c].cast("double").alias(c) for c in PARAMETERS)))
    above = stored(rows.groupBy("k0", "k1").agg(F.count("*").alias("c")).select(F.col("k0").alias("g"), F.col("k1").alias("up")))
    at = lambda table: join_hot(own, table, "g", 3 * total).withColumn("d", _level(_distance())).select("g", "n", *VECTOR, "d")
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    for _ in range(steps):
        # sums for each level of distance, of which a group has a few thousand at most; the inner rows are those of the levels up to the quantile
        levels = at(now).groupBy("g", "d").agg(F.first("n").alias("n"), F.count("*").alias("inside"), *(whole(F.col(v)).alias(f"s{i}") for i, v in enumerate(VECTOR)), *(whole(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}{j}") for i, j in _PAIRS))
        group = Window.partitionBy("g")
        inner = levels.withColumns({"_below": F.sum("inside").over(group.orderBy("d")), "_rows": F.sum("inside").over(group)}).where(F.col("_below") - F.col("inside") < share * F.col("_rows"))
        sums = stored(inner.groupBy("g").agg(F.first("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS)))
        top = sums.where(F.col("g") == OVERALL).first()  # one row
        if top is None:
            break
        new = stored(_above(sums, above).mapInPandas(_estimates(top.asDict()), _ESTIMATE))
        same = now.join(new.withColumnsRenamed({c: f"new_{c}" for c in PARAMETERS}), "g").where(" OR ".join(f"abs({c} - new_{c}) > 1e-12 * abs({c})" for c in PARAMETERS)).isEmpty()
        now = new
        if same:
            break
    median = stored(_quantiles(at(now), ["g"], "d", {"median": 0.5}).select("g", (F.col("median") / 65536).alias("median"), F.col("n").alias("rows")))
    top = median.where(F.col("g") == OVERALL).first()
    lean = lambda own, up: (F.col("rows") * own + PRIOR * up) / (F.col("rows") + PRIOR)
    language = median.select(F.col("g").alias("up"), lean(F.col("median"), F.lit(top["median"] if top else None).cast("double")).alias("up_median"))
    scaled = median.join(above, "g").join(language, "up").select("g", F.greatest(lean(F.col("median"), F.col("up_median")), F.lit(CHI2_MEDIAN)).alias("median"))
    return now.join(scaled, "g").select("g", "n", *PARAMETERS, (F.lit(CHI2_MEDIAN) / F.col("median")).alias("scale"))


def _above(sums: DataFrame, above: DataFrame) -> DataFrame:
    """sums with those of the language above, as up_..., null for a language
    and for all rows."""
    up = sums.select(F.col("g").alias("up"), *(F.col(c).alias(f"up_{c}") for c in _SUMS))
    return sums.join(above, "g", "left").join(up, "up", "left")


def _estimates(top: dict):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                chain = [top] if r["g"] == OVERALL else [top, r]
                if not pd.isna(r["up_inside"]):
                    chain.insert(1, {c: r[f"up_{c}"] for c in _SUMS})
                mean, inverse = estimate(chain)
                out.append({"g": r["g"], "n": r["n"]} | {f"m{i}": mean[i] for i in range(4)} | {f"i{i}{j}": inverse[i, j] for i, j in _PAIRS})
            if out:
                yield pd.DataFrame(out)

    return run


def quality(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where base_failed)
    and kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(keyed(vectors(statistics(docs))).withColumn("base_failed", base))
    sound = rows.where("not base_failed")
    found = stored(estimates(sound, sound.count()).withColumnRenamed("g", "k0"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = join_hot(sound, found, "k0", rows.count()).withColumn("distance", _distance() * F.col("scale"))
    out = judged.select(*names, (F.col("distance") <= cut).alias("kept"), "distance")
    return out.unionByName(rows.where("base_failed").select(*names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))

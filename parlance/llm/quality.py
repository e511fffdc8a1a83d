"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Cyclic boosting visits the features in turn; at each visit a shallow tree over the
feature's bins is fitted to the gradient and added, shrunken, to the feature's lookup table. Then the pairs whose joint
histogram explains most of what is left get two-way tables in the same manner. A score is one addition for each table: the
bins of a whole Arrow batch are looked up at once.

Features are taken from whole texts in one pass and kept; labels join them, not the texts. The fit uses at most
``sample`` labelled rows, chosen by a hash of the id.

Defined cases: null and empty texts have the features of an empty text and a score as any other; labels that are null count
as none, and those that disagree are averaged; ids that repeat are scored each; an empty table gives an empty result; without
labels of both kinds every score is the share of label 1 (0.5 without labels); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, map_arrow, text_of

THRESHOLD = 0.3
SAMPLE = 20_000
FEATURES = ("chars", "words", "word_length", "distinct_words", "distinct_pairs", "top_word", "same_as_before", "upper", "digits", "symbols", "top_symbol", "symbol_words", "blanks", "non_ascii", "lines", "repeated_lines", "line_length", "sentences")

UPPER, DIGIT, SYMBOL, BLANK, HIGH = range(1, 6)
CLASSES = np.array([UPPER if 65 <= i <= 90 else DIGIT if 48 <= i <= 57 else BLANK if i in (9, 10, 11, 12, 13, 32) else HIGH if i >= 128 else 0 if 97 <= i <= 122 or i < 32 else SYMBOL for i in range(256)], np.uint8)
STOPS = [46, 63, 33]
ODD = np.array([CLASSES[i] == SYMBOL and chr(i) not in ".,;:'\"()-!?" for i in range(256)])


def features(text: str) -> list[float]:
    """The features of one whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    kinds, n = np.bincount(CLASSES, bytes_, 6), max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    counts, w = Counter(words), max(1, len(words))
    full = [x for x in lines if x]
    symbols = np.where(CLASSES == SYMBOL, bytes_, 0)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, words)) / w,
        len(counts) / w,
        len(set(zip(words, words[1:], strict=False))) / w,
        counts.most_common(1)[0][1] / w if words else 0.0,
        sum(map(str.__eq__, words, words[1:])) / w,
        kinds[UPPER] / n,
        kinds[DIGIT] / n,
        kinds[SYMBOL] / n,
        symbols.max() / n,
        bytes_[ODD].sum() / w,
        kinds[BLANK] / n,
        kinds[HIGH] / n,
        np.log1p(len(full)),
        1 - len(set(full)) / max(1, len(full)),
        np.log1p(len(text) / max(1, len(full))),
        bytes_[STOPS].sum() / w,
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array ``x`` of each document's features."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])

    return map_arrow(docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")), rows, "doc_id long, x array<double>")


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


@dataclass
class Gam:
    """Lookup tables of bins; ``pairs`` are tables of two features' coarse bins."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """The values of a tree of at most ``leaves`` leaves over ordered bins: the best cut is taken first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, -1, -1)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gs, hs = g[a:b].sum(), h[a:b].sum()
            got = np.where((hl >= least) & (hs - hl >= least), gain(gl, hl, ridge) + gain(gs - gl, hs - hl, ridge) - gain(gs, hs, ridge), 0)
            c = int(got.argmax())
            if got[c] > best[0]:
                best = (got[c], k, a + c + 1)
        if best[1] < 0:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def crossed(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts rows once and then columns once in each half."""
    top, out = 0.0, np.zeros(g.shape)
    for r in range(1, len(g)):
        halves = [(slice(0, r), g[:r].sum(0), h[:r].sum(0)), (slice(r, None), g[r:].sum(0), h[r:].sum(0))]
        got, value = 0.0, np.zeros(g.shape)
        for rows, gg, hh in halves:
            v = shallow(gg, hh, 2, ridge, least)
            value[rows] = v
            got += float((v * gg).sum() - 0.5 * (v * v * hh).sum())
        if got > top:
            top, out = got, value
    return top, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.1, leaves: int = 3, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 1.0, least: float = 0.5) -> Gam:
    """The model of features and 0/1 labels."""
    model = Gam()
    if len(y) == 0:
        return model
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    d = x.shape[1]
    model.cuts = [quantiles(x[:, j], bins) for j in range(d)]
    model.coarse = [quantiles(x[:, j], pair_bins) for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(model.cuts[j], x[:, j], side="right") for j in range(d)]
    wide = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(d)]
    f = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slope()
            m = len(model.tables[j])
            step = rate * shallow(np.bincount(at[j], g, m), np.bincount(at[j], h, m), leaves, ridge, least)
            model.tables[j] += step
            f += step[at[j]]

    def joint(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(wide[i] * b + wide[j], v, a * b).reshape(a, b)

    g, h = slope()
    ranked = sorted(((crossed(joint(i, j, g), joint(i, j, h), ridge, least)[0], (i, j)) for i, j in combinations(range(d), 2)), reverse=True)
    model.pairs = {k: np.zeros((len(model.coarse[k[0]]) + 1, len(model.coarse[k[1]]) + 1)) for got, k in ranked[:n_pairs] if got > 0}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slope()
            step = rate * crossed(joint(i, j, g), joint(i, j, h), ridge, least)[1]
            table += step
            f += step[wide[i], wide[j]]
    return model


def labelled(labels: DataFrame, label: str, folds: int, held: int, sample: int) -> DataFrame:
    """doc_id and y of at most ``sample`` rows outside the held-out fold, those of the least hash."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(remainder(F.col("doc_id"), folds) != held)
    return known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def trained(kept: DataFrame, known: DataFrame) -> Gam:
    """The model of the known rows of a feature table; rows and features are bounded."""
    rows = kept.join(F.broadcast(known), "doc_id").select("doc_id", "x", "y").toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    kept = cut(feature_table(docs))
    model = trained(kept, labelled(labels, "quality", 5, 0, sample))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    out = map_arrow(kept.select("doc_id", "x"), rows, "doc_id long, score double", 10_000)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score at least ``threshold``. No shuffle: a batch is scored and filtered where it is."""
    known = labelled(labels, "quality", 5, 0, sample)
    some = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id")
    model = trained(cut(feature_table(some)), known)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t or "") for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return map_arrow(docs, rows, docs.schema)


def op6_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_additive_quality": op6_additive_quality}

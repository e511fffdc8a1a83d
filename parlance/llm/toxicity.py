"""Toxicity: a noisy-channel decoder restores disguised words, then the restored text is scored.

A character trigram model is counted over all documents. A chunk of text that may be disguised (a digit or sign beside a letter,
a letter twice in a row, letters set apart by blanks) becomes a lattice: each sign may stand for itself, for a letter it
resembles, for nothing, or for the end of a word, and a repeated letter may be one. An exact Viterbi search over the whole chunk
(a state is the last two letters and the last sign) finds the readings that the channel and the model make likeliest: the best
path of each last state, if it is not MARGIN less likely than the best of all. Readings are split into words. Words and their
beginnings are weighed by the labelled rows in which they occur; a logistic function of a document's weightiest words is its
score.

Chunks that come again are not decoded again. What is learnt from labels comes from at most ``SAMPLE`` rows of each label,
those of the least hash, and the words found in them; the character model comes from every document.

Defined cases: null and empty texts get the score of a text without words; null labels count as none, and those that
disagree count as 1 if any is; repeated rows are scored each; an empty table gives an empty result; without labels of both
kinds every score is the share of label 1 (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, map_arrow, text_of
from parlance.llm.quality import remainder

THRESHOLD = 0.3
SAMPLE = 6_000
#: Words kept in a worker's cache; a full cache starts again.
CACHE = 1_000_000
#: Letters of the character model, by code point: a-z and the letters of the Latin-1 and Latin Extended-A blocks.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c == c.lower())
#: The letters that a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "[": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s"}
#: Signs that may be set between letters.
APART = set(".-_*~'`^,:;#%&/\\=\" ")
#: Costs in natural logarithms: a sign read as a letter, left out, kept; a repeated letter left out, kept.
AS_LETTER, LEFT_OUT, KEPT, REPEAT_OUT, REPEAT_IN = -0.5, -0.7, -14.0, -0.5, -1.0
#: Natural logarithms by which a reading may be less likely than the best one.
MARGIN = 6.0

SIGNS = re.escape("".join(LOOKS)) + re.escape("".join(sorted(APART - {" "})))
DISGUISED = re.compile(rf"[^\W\d_][{SIGNS}]|[{SIGNS}][^\W\d_]|([^\W\d_])\1").search
REPEATED, DOUBLED = re.compile(r"(.)\1+").sub, re.compile(r"(.)\1").search
NOTHING: list = []
SPACED = re.compile(r"(?<![^\s])(?:[^\s\w]?\w[^\s\w]? ){2,}[^\s\w]?\w[^\s\w]?(?![^\s])").finditer
EDGES = "".join(sorted(APART)) + "!?.,;:()[]{}<>|+$@\"'«»"


class Characters:
    """log P(c | a, b) with additive smoothing over letters and the word edge (index 0)."""

    def __init__(self, counts: np.ndarray):
        k = len(LETTERS) + 1
        c = counts.reshape(k, k, k).astype(float) + 0.05
        self.logp = np.log(c / c.sum(2, keepdims=True)).tolist()
        self.index = {c: i + 1 for i, c in enumerate(LETTERS)}

    def readings(self, chunk: str, margin: float = MARGIN) -> list[str]:
        """The likeliest letters behind a chunk, words parted by blanks. Each state keeps its best path, as a chain of letters."""
        logp, index = self.logp, self.index
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for ch in chunk:
            nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def put(key: tuple, score: float, path: tuple | None, nxt: dict = nxt) -> None:
                if key not in nxt or nxt[key][0] < score:
                    nxt[key] = (score, path)

            low = ch if ch in index else ch.lower()
            for (a, b, seen), (score, path) in states.items():
                last = path[1] if path else ""
                if low in index:
                    i = index[low]
                    again = last == low
                    put((b, i, low), score + logp[a][b][i] + (REPEAT_IN if again else 0.0), (path, low))
                    if again:
                        put((a, b, seen), score + REPEAT_OUT, path)
                    continue
                for c in LOOKS.get(ch, ""):
                    if last == c and seen == ch:
                        put((a, b, seen), score + REPEAT_OUT, path)
                    put((b, index[c], ch), score + logp[a][b][index[c]] + AS_LETTER, (path, c))
                if ch in APART or ch in "!|+":
                    put((a, b, seen), score + LEFT_OUT, path)
                    if b:  # the end of a word
                        put((0, 0, ""), score + logp[a][b][0], (path, " "))
                elif ch not in LOOKS or ch.isdigit():
                    put((a, b, seen), score + KEPT, path)
            states = nxt
            if not states:
                return []
        done: dict[str, float] = {}
        for (a, b, _), (score, path) in states.items():
            letters = []
            while path:
                path, c = path
                letters.append(c)
            if text := "".join(reversed(letters)).strip():
                done[text] = max(done.get(text, -1e18), score + (logp[a][b][0] if b else 0.0))
        best = max(done.values(), default=0.0)
        return [t for t, x in sorted(done.items(), key=lambda x: (-x[1], x[0])) if x >= best - margin]


ORDER = np.zeros(0x180, np.int64)
for _i, _c in enumerate(LETTERS):
    ORDER[ord(_c)] = _i + 1
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x180:
        ORDER[ord(_c.upper())] = _i + 1


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents, word edges as index 0; added up by batch, task and key."""
    k = len(LETTERS) + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k**3, np.int64)
        for b in batches:
            points = np.frombuffer("  ".join(b.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            at = ORDER[np.where(points < len(ORDER), points, 0)]
            key = (at[:-2] * k + at[1:-1]) * k + at[2:]
            # the pair (edge, first letter) has no third letter before it, so each word starts after two edges
            first = np.flatnonzero((at[:-1] == 0) & (at[1:] > 0))
            total += np.bincount(key[(at[1:-1] > 0)], minlength=k**3) + np.bincount(at[first + 1], minlength=k**3)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["gram", "n"])

    out = np.zeros(k**3, np.int64)
    # at most as many rows as there are trigrams of the fixed alphabet, most of which never occur
    for r in map_arrow(docs.select(text_of(docs)), rows, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["gram"]] = r["n"]
    return out


def restored(chunk: str, lm: Characters) -> list[str]:
    """The words that a chunk of text may stand for: itself in lower case, and its readings where it looks disguised."""
    plain = chunk.strip(EDGES).lower()
    if chunk.isalpha() and not DISGUISED(chunk):
        return [plain]
    out = [w for w in re.split(r"[\W\d_]+", plain) if w]
    if any(map(str.isalpha, chunk)) and (core := chunk.strip(".,;:?\"'()*#%&~-_")) and (" " in chunk or DISGUISED(core)):
        out += [w for r in lm.readings(core) for w in r.split()]
    return out


@lru_cache(maxsize=2)
def cache_of(run: str) -> dict:
    """One for each worker process and pass, so that it serves all tasks that run there."""
    return {}


def marks(word: str) -> list[str]:
    """What is weighed of a word: all of it, its beginnings of 4 to 8 letters, and its letters without their repetitions."""
    return [word, *(f"{word[:n]}~" for n in range(4, 9) if n <= len(word)), "=" + REPEATED("\\1", word)]


def words_of(text: str, cache: dict[str, list[str]], lm: Characters) -> set[str]:
    """The words of a text, restored."""
    out: set[str] = set()
    chunks = set(text.split())
    chunks.update(m[0] for m in SPACED(text))
    if len(cache) + len(chunks) > CACHE:
        cache.clear()
    for c in chunks:
        if (got := cache.get(c)) is None:
            got = cache[c] = restored(c, lm)
        out.update(got)
    return out


@dataclass
class Model:
    lm: Characters
    weights: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.zeros(6))
    prior: float = 0.0

    def evidence(self, hits: dict[str, float], n_words: int) -> list[float]:
        """Of the words with weights: the first three, how many, and their share; a mark that several words share counts once."""
        w = sorted(hits.values(), reverse=True)[:3]
        w += [0.0] * (3 - len(w))
        return [w[0], w[1], w[2], np.log1p(len(hits)), len(hits) / max(20, n_words), 1.0]

    @cached_property
    def heads(self) -> set[str]:
        """The first four letters of the beginnings that weigh something: few words have them."""
        return {m[:4] for m in self.weights if m.endswith("~")}

    def best(self, word: str) -> tuple[str, float]:
        """The weightiest of a word's marks."""
        get = self.weights.get
        own = "=" + (REPEATED("\\1", word) if DOUBLED(word) else word)
        if word[:4] not in self.heads:
            w, x = get(word, 0.0), get(own, 0.0)
            return (word, w) if w >= x else (own, x)
        return max(((m, get(m, 0.0)) for m in marks(word)), key=itemgetter(1))

    def look(self, text: str, cache: dict[str, list[tuple[str, float]]]) -> list[float]:
        chunks = set(text.split())
        n = len(chunks)
        chunks.update(m[0] for m in SPACED(text))
        if len(cache) + n > CACHE:
            cache.clear()
        hits: dict[str, float] = {}
        fresh = chunks.difference(cache)
        for c in fresh:
            cache[c] = [x for x in map(self.best, restored(c, self.lm)) if x[1] > 0] or NOTHING
        for got in filter(None, map(cache.__getitem__, chunks)):
            hits.update(got)
        return self.evidence(hits, n)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant and is not shrunk."""
    w, r = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + r, x.T @ (y - p) - r @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int) -> DataFrame:
    """doc_id, text, y and half of at most ``sample`` labelled rows of each kind outside the held-out fold."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(remainder(F.col("doc_id"), folds) != held)
    known = known.groupBy("doc_id").agg((F.max(label) >= 1).cast("int").alias("y"))
    some = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = part if some is None else some.unionByName(part)
    # two bounded groups, so the small side of the join is bounded
    base = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(some), "doc_id")
    # of rows that share an id, the one of the least text hash
    return base.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) == 0)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """Weights from two thirds of the sample, the logistic function from the rest."""
    lm = Characters(trigrams(docs))
    kept = cut(training_texts(docs, labels, label, folds, held, sample))
    n = {(r["half"], r["y"]): r["n"] for r in kept.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sum(v for (_, y), v in n.items() if y), sum(v for (_, y), v in n.items() if not y)
    model = Model(lm, prior=ones / max(1, ones + zeros))
    n1, n0 = n.get((False, 1), 0), n.get((False, 0), 0)
    if not (ones and zeros and n1):
        return model

    run = uuid.uuid4().hex

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[str]] = cache_of(f"count {run}")
        with_label, without = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (with_label if y else without).update({m for w in words_of(text, cache, lm) for m in marks(w)})
        keys = list(with_label)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([with_label[k] for k in keys], pa.int64()), pa.array([without[k] for k in keys], pa.int64())], names=["mark", "n1", "n0"])
        keys = [k for k in without if k not in with_label]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([0] * len(keys), pa.int64()), pa.array([without[k] for k in keys], pa.int64())], names=["mark", "n1", "n0"])

    seen = map_arrow(kept.filter(~F.col("half")).select("text", "y"), counted, "mark string, n1 long, n0 long").groupBy("mark").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # words that a few labelled rows share are chance; the bound rises slowly with the rows
    least = max(2, round(np.log10(max(10, n1))))
    odds = F.log((F.col("n1") + 0.1) / (n1 + 0.2)) - F.log((F.col("n0") + 0.1) / (n0 + 0.2))
    # what the counts leave certain: a mark seen twice says less than one seen fifty times
    sure = odds - 1.0 / F.sqrt(F.col("n1") + 0.1)
    top = seen.filter(F.col("n1") >= least).select("mark", sure.alias("w")).filter("w > 1")
    model.weights = {r["mark"]: r["w"] for r in top.collect()}

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[tuple[str, float]]] = cache_of(f"look {run}")
        for b in batches:
            x = [model.look(t, cache) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "y"])

    rest = map_arrow(kept.filter("half").select("doc_id", "text", "y"), looked, "doc_id long, x array<double>, y int").toPandas().sort_values("doc_id")
    if rest["y"].nunique() < 2:
        model.coef = np.array([1.0, 0, 0, 0, 0, np.log(model.prior / (1 - model.prior)) - 2])
    else:
        x, y = np.array(rest["x"].tolist()), rest["y"].to_numpy(float)
        model.coef = logistic(x, y)
        # the sample may hold more of one kind than the corpus does
        everyone = labels.filter(F.col(label).isNotNull()).filter(remainder(F.col("doc_id"), folds) != held).agg(F.avg((F.col(label) >= 1).cast("int"))).first()[0]
        everyone = min(max(everyone or model.prior, 1e-6), 1 - 1e-6)
        own = y.mean()
        model.coef[-1] += np.log(everyone / (1 - everyone)) - np.log(own / (1 - own))
        model.prior = everyone
    return model


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = learn(docs, labels, sample=sample)
    run = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed alphabet's table and words of the bounded sample

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[tuple[str, float]]] = cache_of(f"score {run}")
        for b in batches:
            x = np.array([held.value.look(t, cache) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(x))], names=["doc_id", "score"])

    out = map_arrow(docs.select("doc_id", text_of(docs).alias("text")), rows, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_channel_toxicity": op4_channel_toxicity}

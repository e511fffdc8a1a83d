"""Exact Jaccard join of documents as sets of word shingles, in the metric space of the Jaccard distance.

1. Texts become sets of 64-bit shingle hashes; equal sets are one point, named by a digest of the set.
2. Blocks. Two sets that link differ in at most D elements, D by their sizes. If the elements are dealt by hash into classes,
   a set's filled classes but D are the same in both. So of the digests of its filled classes, in an order that is the
   same for all sets, each set puts down the first D + 1, and the points that put down one digest stand in one block; no
   link leaves the blocks. A set that does not fill so many classes puts them all down and also those of further, finer
   dealings, up to one in which each element is a class. In the order, classes of nothing but elements that very many
   documents have come last, and else large classes come first, so that passages that documents share, or single elements,
   bring few points together. What is so frequent is told by counts over all documents, in a table of fixed size; the order
   changes the work, not the result. (Random pivots alone would not do: unrelated texts are all at distance 1 from each
   other, where no triangle inequality tells them apart.)
3. Connected blocks are a region. A region is joined by pivots: each point belongs to the Voronoi region of its nearest
   pivot and is copied to that of each other pivot within a window of twice the threshold, which the triangle inequality
   makes wide enough for every link; regions are joined the same way again. Where pivots cannot part the points any more,
   pairs are compared whose distances to all pivots differ by no more than the threshold and that are not yet connected.
   Regions with many points are parted by a distributed pass first, so that a task gets a bounded region where pivots can.
4. The least document id of each connected set of links goes to all its documents.

Every comparison is exact in the counts: ``100 * intersection >= 90 * union``.

Defined cases: a null text is empty; sets without elements link with nothing; repeated rows are each kept, and equal texts
share a component; a null id is below all others (its component is the least id that is not null, if there is one); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, in_bitmap, map_arrow, marked, salted, text_of
from parlance.llm.graphs import components

WORDS, PERCENT = 3, 90
NO_ID = -(2**63)
CACHE = 300_000
#: Cells of the table of counts that tells frequent elements; a cell is frequent beyond what chance makes of the mean.
CELLS = 1 << 17
#: Dealings, in turn: the classes for each element that can differ (None: every element by itself).
DEALINGS = (1.6, 4.0, None)
#: Sizes of one level go up to half as many again.
LEVEL = 1.5
#: Elements of a region that a task joins; larger regions are parted by a distributed pass, so many at a time.
REGION, AT_ONCE, PIVOTS = 6_000_000, 16, 16
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits."""
    h = (h ^ (h >> np.uint64(31))) * M2
    h = (h ^ (h >> np.uint64(29))) * M3
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Sets of hashes of the shingles of whole texts."""

    def __init__(self, words: int = WORDS):
        self.n, self.cache = words, {}

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes. Bytes, so that only A-Z change case and only ASCII blanks part words."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = self.n
        if len(h) < n:
            out = np.full(1, len(h), np.uint64)
            for x in h:
                out = mix(out * M1 + x)
            return out
        out = h[: len(h) - n + 1]
        for i in range(1, n):
            out = mix(out * M1) + h[i : len(h) - n + 1 + i]
        return np.unique(mix(out * M1))


def differences(size: int, percent: int = PERCENT) -> int:
    """The most elements in which two sets of at most this size can differ and link."""
    return 2 * size * (100 - percent) // (100 + percent)


def levels(most: int, percent: int = PERCENT) -> list[int]:
    """The largest size of each level; what links with a set is at its level or next to it. At level 0 nothing but equal sets link."""
    first = 1
    while differences(first + 1, percent) == 0:
        first += 1
    out = [first]
    while out[-1] < most:
        out.append(max(out[-1] * 100 // percent, int(out[-1] * LEVEL), out[-1] + 1))
    return out


@lru_cache(maxsize=8)
def tops(percent: int) -> np.ndarray:
    return np.array(levels(1 << 40, percent))


def digest(h: np.ndarray) -> int:
    """A name of the set, signed."""
    return int(np.bitwise_xor.reduce(mix(h + M2)) ^ mix(h.sum(keepdims=True) * M3 + np.uint64(len(h)))[0]) - (1 << 63) if len(h) else 0


def frequent_cells(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Which cells of the table hold elements of very many documents: a mark for each of CELLS cells.

    Tasks count their own documents; at most CELLS numbers leave a task and come to the driver.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(words), np.zeros(CELLS, np.int64)
        for b in batches:
            for h in map(shingles.of, set(b.column(0).to_pylist())):
                total[cell(h)] += 1
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["cell", "n"])

    found = map_arrow(docs.select(text_of(docs)), rows, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(CELLS)
    total[found["cell"].to_numpy(int)] = found["n"].to_numpy(float)
    return total > total.mean() + 6 * np.sqrt(total.mean()) + 16


def cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def blocks(h: np.ndarray, percent: int = PERCENT, frequent: np.ndarray | None = None) -> np.ndarray:
    """The class digests of a set: at its own level, and at the next if a larger set that links can be there."""
    n, top = len(h), tops(percent)
    own = int(np.searchsorted(top, n))
    common = np.zeros(n, bool) if frequent is None else frequent[cell(h)]
    out = []
    for level in (own, own + 1) if n * 100 // percent > top[own] else (own,):
        if level == 0 or not n:
            continue
        # in so many elements the set can differ from one of the level that links with it
        most = (n + min(int(top[level]), n * 100 // percent)) * (100 - percent) // (100 + percent)
        for turn, factor in enumerate(DEALINGS):
            seed = np.uint64(len(DEALINGS) * level + turn)
            if factor is None:
                sig, size, rare = mix(mix(h * M1) + seed), np.ones(n, np.int64), ~common
            else:
                k = int(differences(int(top[level]), percent) * factor) + 2
                at = ((h >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
                low = np.bincount(at, (h & np.uint64(0xFFFFFFFF)).astype(float), k).astype(np.uint64)
                high = np.bincount(at, (h >> np.uint64(32)).astype(float), k).astype(np.uint64)
                size = np.bincount(at, minlength=k)
                sig = mix((low * M1 + high) * M3 + np.arange(k, dtype=np.uint64) * M2 + seed)
                rare = np.bincount(at[~common], minlength=k) > 0
                sig, size, rare = sig[size > 0], size[size > 0], rare[size > 0]
            if len(sig) > most:
                out.append(sig[np.lexsort((sig, -size, ~rare))[: most + 1]])
                break
            out.append(sig)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64))


def points(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, doc_id, a hash of the text, the size and name of each document's set, and its block digests."""
    frequent = frequent_cells(docs, words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            sets = [shingles.of(t) for t in b.column(2).to_pylist()]
            held: dict[int, np.ndarray] = {}
            names = [digest(h) for h in sets]
            sigs = []
            for name, h in zip(names, sets, strict=True):
                # copies in one batch put their digests down once
                sigs.append(np.zeros(0, np.uint64) if name in held else blocks(h, percent, frequent))
                held[name] = h
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([len(h) for h in sets], pa.int64()), pa.array(names, pa.int64()), lists(sigs)], names=["key", "doc_id", "kt", "n", "sid", "sigs"])

    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "doc_id", text_of(docs).alias("text"), F.xxhash64(text_of(docs)).alias("kt"))
    return map_arrow(base, rows, "key long, doc_id long, kt long, n long, sid long, sigs array<long>")


class Region:
    """Sets of one region, held as one array of elements; links join points to classes."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        self.end = np.cumsum(self.size)
        self.values, flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        self.flat, self.label = flat.astype(np.int64), np.arange(len(sets))
        self.mark = np.zeros(len(self.values), bool)

    def own(self, i: int) -> np.ndarray:
        return self.flat[self.end[i] - self.size[i] : self.end[i]]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others."""
        mine = self.own(i)
        self.mark[mine] = True
        size = self.size[others]
        start = np.cumsum(size) - size
        at = np.repeat(self.end[others] - size - start, size) + np.arange(int(size.sum()))
        hits = self.mark[self.flat[at]]
        self.mark[mine] = False
        return np.add.reduceat(hits, start, dtype=np.int64) if len(others) else np.zeros(0, np.int64)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Distances to one set; links found on the way are kept."""
        both = self.common(i, others)
        union = self.size[i] + self.size[others] - both
        self.join(i, others[100 * both >= self.percent * union])
        return 1 - both / np.maximum(union, 1)

    def join(self, i: int, others: np.ndarray) -> None:
        for c in np.unique(self.label[others]):
            if c != self.label[i]:
                low, high = min(c, self.label[i]), max(c, self.label[i])
                self.label[self.label == high] = low

    def solve(self, members: np.ndarray | None = None) -> np.ndarray:
        """Labels of all points, by recursion over Voronoi regions with windows."""
        work = [np.arange(len(self.size)) if members is None else members]
        r = 1 - self.percent / 100
        while work:
            at = work.pop()
            if len(at) < 2 or (self.label[at] == self.label[at[0]]).all():
                continue
            pivots, far = [], np.full(len(at), np.inf)
            d: list[np.ndarray] = []
            nxt = int(np.argsort(self.size[at])[len(at) // 2])
            while len(pivots) < min(8, 1 + len(at) // 8) and far[nxt] > 0:
                pivots.append(nxt)
                d.append(self.near(int(at[nxt]), at))
                far = np.minimum(far, d[-1])
                nxt = int(far.argmax())
            dist = np.array(d)
            home = dist.argmin(0)
            least = dist.min(0)
            parts = [at[(home == k) | (dist[k] <= least + 2 * r + 1e-9)] for k in range(len(pivots))]
            if len(at) > 32 and len(pivots) > 1 and max(map(len, parts)) <= 0.8 * len(at) and sum(map(len, parts)) <= 3 * len(at):
                work += [p for k, p in enumerate(parts) if (home == k).any()]
            else:
                self.compare(at, dist, r)
        return self.label

    def compare(self, at: np.ndarray, dist: np.ndarray, r: float) -> None:
        """Pairs that may link and that no chain of links connects yet.

        Of two sets that link, each has one of the other's elements among its rarest few, rare in this region; so what many
        of its points share brings no pairs up. Then the sizes and the distances to every pivot must allow a link.
        """
        size = self.size[at]
        owner = np.repeat(np.arange(len(at)), size)
        flat = np.concatenate([self.own(int(i)) for i in at])
        seen = np.bincount(flat, minlength=len(self.values))
        order = np.lexsort((flat, seen[flat], owner))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        rare = place < np.repeat(size + (-self.percent * size) // 100 + 1, size)
        element, who = flat[order][rare], owner[rare]
        several = seen[element] > 1
        element, who = element[several], who[several]
        by = np.argsort(element, kind="stable")
        starts = np.searchsorted(element[by], np.arange(len(self.values) + 1))
        listed = who[by]
        cuts = np.searchsorted(who, np.arange(len(at) + 1))
        for i in range(len(at) - 1):
            mine = element[cuts[i] : cuts[i + 1]]
            if not len(mine):
                continue
            rest = np.unique(np.concatenate([listed[starts[e] : starts[e + 1]] for e in mine]))
            rest = rest[rest > i]
            rest = rest[self.label[at[rest]] != self.label[at[i]]]
            small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
            rest = rest[100 * small >= self.percent * large]
            for row in dist:
                rest = rest[np.abs(row[rest] - row[i]) <= r + 1e-9]
            if len(rest):
                self.near(int(at[i]), at[rest])


def region_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) from each point of a region to the least point it is connected with there."""
    def solve(t: pa.Table) -> pa.Table:
        sid = t.column("sid").to_numpy()
        sid, first = np.unique(sid, return_index=True)
        column = t.column("h").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        label = Region([values[offsets[i] : offsets[i + 1]] for i in first], percent).solve()
        return pa.table({"a": sid, "b": sid[label]})

    return sets.groupBy("region").applyInArrow(solve, "a long, b long")


def part_large(sets: DataFrame, percent: int, limit: int = REGION) -> tuple[DataFrame, DataFrame | None]:
    """Regions whose sets have more than ``limit`` elements are parted by pivots in distributed passes; also the links to pivots found there.

    At most AT_ONCE regions are parted in a pass, so the pivots that travel are bounded. A region that its pivots do not part
    (all its points lie within the window of one another) is left whole.
    """
    links, whole, r = None, set(), 1 - percent / 100
    while True:
        sizes = sets.groupBy("region").agg(F.sum(F.size("h")).alias("n")).filter(F.col("n") > limit)
        large = [x for x in sizes.orderBy(F.col("n").desc(), "region").limit(AT_ONCE + len(whole)).collect() if x["region"] not in whole][:AT_ONCE]
        if not large:
            return sets, links
        ids = [x["region"] for x in large]
        pivots: dict[int, list[tuple[int, np.ndarray]]] = {}
        for region in ids:
            rows = sets.filter(F.col("region") == region).orderBy(F.xxhash64("sid")).limit(PIVOTS).collect()
            pivots[region] = [(x["sid"], np.array(x["h"], np.int64).view(np.uint64)) for x in rows]
        own = sets.filter(F.col("region").isin(ids))

        def dealt(batches: Iterator[pa.RecordBatch], pivots: dict = pivots) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for region, sid, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    mine = h.values.to_numpy().view(np.uint64)
                    both = [len(np.intersect1d(mine, p, assume_unique=True)) for _, p in pivots[region]]
                    union = [len(mine) + len(p) - c for c, (_, p) in zip(both, pivots[region], strict=True)]
                    d = np.array([1 - c / max(1, u) for c, u in zip(both, union, strict=True)])
                    linked = [p for (p, _), c, u in zip(pivots[region], both, union, strict=True) if 100 * c >= percent * u]
                    to = np.flatnonzero(d <= d.min() + 2 * r + 1e-9)
                    out += [(xxhash.xxh64_intdigest(f"{region} {k}") - (1 << 63), region, sid, mine.view(np.int64).tolist(), linked if i == 0 else []) for i, k in enumerate(to)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64()))], names=["region", "was", "sid", "h", "linked"])

        parted = cut(map_arrow(own.select("region", "sid", "h"), dealt, "region long, was long, sid long, h array<long>, linked array<long>"))
        found = parted.select(F.col("sid").alias("a"), F.explode("linked").alias("b"))
        links = found if links is None else links.unionByName(found)
        before = {x["region"]: x["n"] for x in large}
        most = {x["was"]: (x["most"], x["total"]) for x in parted.groupBy("was", "region").agg(F.sum(F.size("h")).alias("n")).groupBy("was").agg(F.max("n").alias("most"), F.sum("n").alias("total")).collect()}
        good = [i for i in ids if most[i][0] <= 0.8 * before[i] and most[i][1] <= 4 * before[i]]
        whole |= set(ids) - set(good)
        if good:
            sets = cut(sets.filter(~F.col("region").isin(good)).select("region", "sid", "h").unionByName(parted.filter(F.col("was").isin(good)).select("region", "sid", "h")))


def linked_sets(docs: DataFrame, held: DataFrame, words: int = WORDS, percent: int = PERCENT, limit: int = REGION) -> DataFrame:
    """(node, root) of the set names that some link connects with another set."""
    spread = held.filter("n > 0").select("sid", F.explode("sigs").alias("sig"))
    # every point of a block points to the block's least; the minimum is combined before the shuffle, so copies of a set and
    # hot digests travel once a task, and only what stands in a block is shuffled again
    several = cut(spread.groupBy("sig").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).filter("least != most").select("sig", "least"))
    some = in_bitmap(spread, several, "sig")
    edges = salted(some, several, ["sig"], F.col("sid")).filter("sid != least").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    regions = components(edges)
    if regions.isEmpty():
        return regions
    reps = held.filter("n > 0").groupBy("sid").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    reps = cut(reps.join(regions.select(F.col("node").alias("sid"), F.col("root").alias("region")), "sid"))
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), text_of(docs).alias("text"))
    # the bitmap keeps the other texts from being shuffled
    some = in_bitmap(base.withColumn("name", F.xxhash64("key")), reps.select(F.xxhash64("key").alias("name")), "name")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            sets = [shingles.of(t) for t in b.column(2).to_pylist()]
            keep = pa.array([digest(h) == s for h, s in zip(sets, b.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(sets)], names=["region", "sid", "h"]).filter(keep)

    sets = map_arrow(some.select("key", "text").join(reps.drop("n"), "key").select("region", "sid", "text"), rows, "region long, sid long, h array<long>")
    largest = reps.groupBy("region").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    links = None
    if largest > limit:
        sets, links = part_large(cut(sets), percent, limit)
    solved = region_links(sets, percent)
    if links is None:
        return solved.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return components(solved.unionByName(links))


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, limit: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, and copies: the documents with an equal set."""
    return rooted_rows(docs, words, percent, limit).drop("kt", "root")


def rooted_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, limit: int = REGION) -> DataFrame:
    """What ``joined`` returns, the hash of the text, and the set that names the component (null for one document alone)."""
    held = cut(points(docs, words, percent))
    by_set = held.filter("n > 0").groupBy("sid").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    roots = cut(linked_sets(docs, held, words, percent, limit))
    rooted = by_set.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = cut(rooted.select("sid", "root", "least", "copies"))
    # a component of a few sets at a time: sets, not documents, meet here, and the minimum is combined before the shuffle
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    several = salted(rooted, least, ["root"], F.col("sid")).filter("sets > 1 OR copies > 1").select("sid", "root", "component_id", "copies", "sets")
    mine = held.select("key", "doc_id", "kt", "n", "sid")
    out = salted(mine, several, ["sid"], F.col("key"), how="left")
    found = (F.col("n") > 0) & F.col("copies").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(found, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(found, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("copies"), F.when(found, F.col("sets")).otherwise(F.lit(1)).cast("long").alias("component_sets"), "kt", F.when(found, F.col("root")).alias("root"))


def first_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, one of each component: that of the least id (null above all), and of texts that share it
    that of the least hash; of rows that repeat with the same id and text, one.

    Only ids and hashes of texts travel, and the documents that a bitmap of those lets through: the others stay where they are.
    Texts without a word are in no component and all stay; an empty table gives an empty result.
    """
    found = rooted_rows(docs.select("doc_id", "text"), words, percent).filter("root IS NOT NULL")
    found = cut(found.groupBy("root", "doc_id", "kt").agg(F.count("*").alias("rows")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kt")
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    both = salted(found, first, ["root"], F.col("doc_id"), F.col("kt")).withColumn("stays", order.eqNullSafe(F.col("first")))
    name = lambda i, t: F.xxhash64(F.coalesce(i, F.lit(NO_ID)), t).alias("name")
    named = cut(both.filter("NOT stays OR rows > 1").select("doc_id", "kt", "stays", name(F.col("doc_id"), F.col("kt"))))
    kt = F.xxhash64(text_of(docs))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), kt.alias("t"), name(docs["doc_id"], kt))
    rows = marked(rows, named, "name")
    some, keys = rows.filter("__may"), named.drop("name")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("kt"))
    alone = some.join(keys, same, "left_anti")
    # the first of its component, but in several rows
    again = some.join(keys.filter("stays"), same, "left_semi").dropDuplicates(["id", "t"])
    return rows.filter("NOT __may").select("row.*").unionByName(alone.select("row.*")).unionByName(again.select("row.*"))


def op7_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.9 over shingles of three words."""
    return joined(documents(spark, sf_dir))


def brute(texts: dict[int, str | None], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id) by comparing all pairs, for tests."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    root = {i: i for i in texts}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    return {i: (len(sets[i]), root[i]) for i in ids}


QUERIES = {"op7_metric_join": op7_metric_join}

#: The whole result by all pairs of different sets that share a shingle, and the closure of their links.
JOIN_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= {WORDS} THEN list_distinct(list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w),
d AS (SELECT doc_id, sh, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS k FROM s),
u AS (SELECT k, any_value(n) AS n, any_value(sh) AS sh, min(doc_id) AS least, count(*) AS copies FROM d WHERE n > 0 GROUP BY k),
e AS (SELECT k, n, unnest(sh) AS x FROM u),
p AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (na + nb - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k, k AS other FROM u UNION SELECT r.k, g.b FROM r JOIN g ON g.a = r.other),
c AS (SELECT r.k, min(o.least) AS component_id, count(*) AS component_sets FROM r JOIN u o ON o.k = r.other GROUP BY r.k)
SELECT doc_id, d.n AS n_shingles, coalesce(c.component_id, doc_id) AS component_id, coalesce(u.copies, 1) AS copies, coalesce(c.component_sets, 1) AS component_sets
FROM d LEFT JOIN u ON u.k = d.k AND d.n > 0 LEFT JOIN c ON c.k = d.k AND d.n > 0
"""
ORACLES = {"op7_metric_join": JOIN_SQL}

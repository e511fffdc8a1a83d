"""Packing documents into sequences of a fixed number of tokens by bin completion.

Texts are tokenized in Arrow batches; documents longer than a sequence are cut, and each piece keeps only its place, length
and checksum. What is packed is the histogram of lengths, which has at most as many entries as a sequence has tokens, so
the search runs on the driver whatever the corpus holds. It is a branch and bound over the histogram: a node takes the largest
length left, enumerates the undominated fillings of the gap around it, least waste first, and uses one for as many sequences as
the counts allow; when few pieces are left, it is used once. A branch whose waste cannot lead to fewer sequences than the
incumbent has is pruned. The first incumbent is best fit; the search ends when the incumbent is proved to be optimal
(it meets a lower bound, or no branch is left of a search that used no filling several times) or at a number of nodes that is a
parameter. The plan says, for each length, which ranks go to which sequence and offset; ranks come from counts of each
partition and length.

Defined cases: null and empty texts are one token (the end id); repeated rows are packed each; null ids are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import logging
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import cut, documents, map_arrow, text_of

log = logging.getLogger(__name__)
CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Entries of each cache of a worker; a full cache starts again, results don't depend on it.
CACHE = 200_000
#: Steps of the enumeration of fillings of one gap and of all, and nodes of the search, after which the best so far is taken.
FILLINGS, STEPS, NODES = 10_000, 4_000_000, 20_000
#: With so many pieces left a filling is used for one sequence at a time.
SINGLY = 48


def byte_letters() -> dict[int, int]:
    """How the vocabulary writes bytes: printable ones as themselves, the others as the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LETTERS = byte_letters()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Token ids of whole texts as little-endian bytes, by a tokenizer that never looks across white space.

    Words that come again are not tokenized again. Where Python and the tokenizer might disagree about white space, case or
    Unicode forms, the tokenizer gets the whole chunk or text.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # fixed value: the vocabulary's own pre-token pattern
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ids(self, word: str) -> bytes:
        """Ids of one pre-token, straight from the merges; its bytes are written as the vocabulary writes them."""
        plain = word.isascii() and word.isprintable()
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word if plain else word.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, c: str) -> bytes:
        """Ids of what stands between blanks."""
        if "<|" in c or not (c.isascii() or max(c) < "ɐ"):
            return self.whole(c)
        if c.isalpha():
            parts = (c.lower(),) if "İ" not in c else self.pieces(c.lower())
        elif c[:-1].isalpha() and "İ" not in c:
            parts = (c[:-1].lower(), c[-1])
        else:
            parts = self.pieces(c.lower())
        words, out = self.words, []
        for p in parts:
            if (got := words.get(p)) is None:
                if len(words) >= CACHE:
                    words.clear()
                got = words[p] = self.ids(p)
            out.append(got)
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if self.odd(t):
                yield self.whole(t)
                continue
            split = t.split()
            held = self.chunks
            if len(held) >= CACHE:
                held.clear()
            for c in set(split).difference(held):
                held[c] = self.chunk(c)
            yield b"".join(map(held.__getitem__, split))


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each worker process, so that its caches serve all tasks that run there."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; also the partition and the rank of the piece among those of its length there."""
    path = path or vocabulary_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pid, ranks = tokenizer_of(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = array("I", [END_ID]).tobytes()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row, ids in enumerate(tokenizer.encode(b.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for held, x in zip(out, (row, k, at // 4, n, zlib.crc32(own), ranks[n]), strict=True):
                        held.append(x)
                    ranks[n] += 1
            row, k, start, n, crc, rank = out
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([pid] * len(k), pa.int32()), pa.array(rank, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "rank"])

    return map_arrow(docs.select("doc_id", text_of(docs).alias("text")), rows, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long")


def fillings(gap: int, counts: dict[int, int], sizes: list[int], steps: int = FILLINGS, spent: Counter | None = None) -> Iterator[list[int]]:
    """The undominated multisets of available lengths (``sizes``, ascending) that fit ``gap``, least waste first.

    A filling is dominated if another length fits in the room it leaves, or if one or two of its lengths can be exchanged for
    one available length that is larger and fits. The one that leaves nothing and has the fewest lengths is looked up at once; the
    rest are enumerated, largest lengths first, ``steps`` steps at most; ``spent`` counts them.
    """
    first: list[int] | None = None
    if counts.get(gap):
        first = [gap]
    else:
        for i in range(bisect_right(sizes, gap) - 1, -1, -1):
            a = sizes[i]
            if 2 * a < gap:
                break
            if counts.get(gap - a, 0) >= 1 + (gap - a == a):
                first = [a, gap - a]
                break
    if first is not None:
        yield first
    found: list[tuple[int, list[int]]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(gap, len(sizes), ())]
    seen = 0
    while stack and seen < steps:
        room, below, chosen = stack.pop()
        seen += 1
        if spent is not None:
            spent["steps"] += 1
        i = min(below, bisect_right(sizes, room)) - 1
        if i < 0:
            if undominated(chosen, room, counts, sizes) and list(chosen) != first:
                found.append((room, list(chosen)))
                if not room and first is None:  # nothing can be better
                    first = list(chosen)
                    yield first
                    found.pop()
            continue
        a = sizes[i]
        stack.append((room, i, chosen))  # no (further) a: the rest comes from smaller lengths
        if chosen.count(a) < counts[a]:
            stack.append((room - a, i + 1, (*chosen, a)))
    if not found and first is None:
        found = [(gap, [])]
    yield from (own for _, own in sorted(found, key=lambda x: x[0]))


def undominated(chosen: tuple[int, ...], room: int, counts: dict[int, int], sizes: list[int]) -> bool:
    """Whether no available length fits in the room or can take the place of one or two of the chosen and fill more."""
    left = lambda s: counts[s] - chosen.count(s) > 0
    if any(left(s) for s in sizes[: bisect_right(sizes, room)]):
        return False
    distinct = sorted(set(chosen))
    pairs = {a + b for i, a in enumerate(distinct) for b in distinct[i:] if a != b or chosen.count(a) > 1}
    for have, least in [*((a, a + 1) for a in distinct), *((p, p) for p in pairs)]:
        if any(left(s) for s in sizes[bisect_right(sizes, least - 1) : bisect_right(sizes, have + room)]):
            return False
    return True


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram: open sequences of the same content are one group."""
    groups: dict[int, list[tuple[list[int], int]]] = {}
    free: list[int] = []
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_right(free, size - 1)
            if at == len(free):
                held, k = [], n * 0 + n if size * 2 > capacity else max(1, -(-n // (capacity // size)))
                room = capacity
            else:
                room = free[at]
                held, k = groups[room].pop()
                if not groups[room]:
                    del groups[room], free[at]
            use = min(k, n)
            if k > use and held:
                put(groups, free, room, held, k - use)
            put(groups, free, room - size, [*held, size], use)
            n -= use
    return [x for own in groups.values() for x in own]


def put(groups: dict[int, list], free: list[int], room: int, held: list[int], k: int) -> None:
    if room not in groups:
        groups[room] = []
        free.insert(bisect_right(free, room), room)
    groups[room].append((held, k))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the tokens, or the pieces over half a sequence and what does not fit beside them."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for least in [s for s in counts if 2 * s <= capacity] or [0]:
        alone = sum(n for s, n in counts.items() if s > capacity - least)
        half = sum(n for s, n in counts.items() if 2 * s > capacity and s <= capacity - least)
        room = sum(n * (capacity - s) for s, n in counts.items() if 2 * s > capacity and s <= capacity - least)
        small = sum(n * s for s, n in counts.items() if least <= s and 2 * s <= capacity)
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return best


class Search:
    """Branch and bound over a histogram of lengths; ``best`` is the plan, ``proved`` tells whether no plan can have fewer sequences."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = NODES, steps: int = FILLINGS, singly: int = SINGLY):
        self.left = {s: n for s, n in counts.items() if n}
        self.capacity, self.nodes, self.steps, self.singly = capacity, nodes, steps, singly
        self.total, self.pieces, self.sizes = sum(s * n for s, n in self.left.items()), sum(self.left.values()), sorted(self.left)
        self.bound = lower_bound(self.left, capacity)
        self.best = best_fit(dict(self.left), capacity)
        self.bins, self.several, self.spent = sum(k for _, k in self.best), False, Counter()
        self.proved = self.bins == self.bound or self.run()

    def take(self, own: list[int], k: int) -> None:
        """Removes ``k`` sequences from what is left, or puts them back if ``k`` is negative."""
        self.pieces -= k * len(own)
        for s in set(own):
            before = self.left.get(s, 0)
            after = before - k * own.count(s)
            if after:
                self.left[s] = after
                if not before:
                    self.sizes.insert(bisect_right(self.sizes, s), s)
            else:
                del self.left[s]
                self.sizes.remove(s)

    def branches(self) -> Iterator[list[int]]:
        """The sequences around the largest piece left."""
        top = self.sizes[-1]
        rest = dict(self.left)
        rest[top] -= 1
        for own in fillings(self.capacity - top, rest, [s for s in self.sizes if rest[s]], self.steps, self.spent):
            yield [top, *own]

    def run(self) -> bool:
        path: list[tuple[list[int], int, int]] = []
        open_: list[Iterator[list[int]]] = [self.branches()]
        wasted = used = nodes = 0
        while open_ and nodes < self.nodes and self.spent["steps"] < STEPS:
            own = next(open_[-1], None)
            allowed = (self.bins - 1) * self.capacity - self.total
            # fillings come by rising waste, so what follows one too many is too many as well
            waste = self.capacity - sum(own) if own else 0
            if own is None or wasted + waste > allowed:
                open_.pop()
                if path:
                    own, k, waste = path.pop()
                    self.take(own, -k)
                    wasted, used = wasted - k * waste, used - k
                continue
            nodes += 1
            k = min(self.left[s] // own.count(s) for s in set(own)) if self.pieces > self.singly else 1
            k = min(k, (allowed - wasted) // waste) if waste else k
            self.several |= k > 1
            self.take(own, k)
            path.append((own, k, waste))
            wasted, used = wasted + k * waste, used + k
            if self.pieces:
                open_.append(self.branches())
                continue
            if used < self.bins:
                self.best, self.bins = [(list(own), k) for own, k, _ in path], used
                if used == self.bound:
                    return True
            own, k, waste = path.pop()
            self.take(own, -k)
            wasted, used = wasted - k * waste, used - k
        return not open_ and not self.several


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences), for all pieces of a histogram of lengths."""
    search = Search(counts, capacity, nodes)
    log.info("%d sequences, at least %d are needed, %s", search.bins, search.bound, "proved optimal" if search.proved else "not proved optimal")
    return search.best


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row for each piece with its sequence and offset."""
    cut_up = cut(pieces(docs, capacity, path))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spans, given, bins = [], dict.fromkeys(counts, 0), 0
    for own, k in plan(counts, capacity):
        at = 0
        for s in own:
            spans.append((s, given[s], bins, at))
            given[s], at = given[s] + k, at + s
        bins += k
    spans.sort()
    size, first, seq, off = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else [np.zeros(0, np.int64)] * 4
    keys = size << 44 | first

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            i = np.searchsorted(keys, n << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq[i] + rank - first[i]), pa.array(off[i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    by = cut_up.groupBy("pid", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = by.select("pid", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = cut_up.join(before, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return map_arrow(ranked, placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", 10_000)


def op8_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed(documents(spark, sf_dir))


QUERIES = {"op8_bin_completion": op8_bin_completion}

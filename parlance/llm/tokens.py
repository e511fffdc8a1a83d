"""Token counts under a unigram vocabulary, by one dynamic program over a trie of pre-tokens.

A pre-token is a run without white space with the blank before it, or a run of other white space. Distinct pre-tokens are put
into a trie of bytes. A node holds the best log score of its prefix (the maximum over the last piece) and how many pieces
that takes; it is computed once, when the node is made, from the nodes above it, however many pre-tokens share the prefix.
The count of a pre-token is that of its last node. A document's count is the sum of its pre-tokens' counts.

The vocabulary is a file of byte pieces with ranks; a piece of rank r has the probability of Zipf's law, log P = -log(r + SHIFT), and
all 256 bytes are pieces, so every text has a segmentation. Of equally good segmentations the one with fewer pieces, then
with the longer last piece, is taken.

Each worker process has a trie of its own, made anew when it has NODES nodes; results don't depend on that. No shuffle.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parlance.llm.common import documents, map_arrow, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
SHIFT = 10.0
NODES = 1_000_000
MISSING = object()
PRE_TOKEN = re.compile(r" ?[^\s]+|\s(?![^\s])|\s+?(?= ?[^\s])|\s+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def scores(path: str) -> dict[bytes, float]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): -log(int(b) + SHIFT) for a, b in (line.split() for line in f if line.strip())}


class Trie:
    """Nodes are numbers; ``best`` and ``pieces`` hold the forward score and piece count of each node's prefix."""

    def __init__(self, vocabulary: dict[bytes, float]):
        # pieces with their scores, and all that pieces end with: looking back from a byte stops where no piece can go on
        self.endings: dict[bytes, float | None] = dict.fromkeys(p[i:] for p in vocabulary for i in range(1, len(p)))
        self.endings |= vocabulary
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]
        self.terminal: dict[str, tuple[int, float, int]] = {}
        self.after_blank: dict[str, tuple[int, float, int]] = {}

    def insert(self, token: bytes) -> int:
        """The node of a pre-token; only the part that no pre-token before shares makes nodes."""
        children, best, pieces, get = self.children, self.best, self.pieces, self.endings.get
        node, path = 0, [0]
        for d, byte in enumerate(token):
            nxt = children.get(node << 8 | byte)
            if nxt is None:
                top, n, end = -1e300, 0, d + 1
                for a in range(d, -1, -1):
                    s = get(token[a:end], MISSING)
                    if s is None:
                        continue
                    if s is MISSING:  # no piece ends like this
                        break
                    at = path[a]
                    s += best[at]
                    if s > top + 1e-9 or (s > top - 1e-9 and pieces[at] < n):
                        top, n = s, pieces[at] + 1
                nxt = children[node << 8 | byte] = len(best)
                best.append(top)
                pieces.append(n)
            node = nxt
            path.append(node)
        return node

    def add(self, part: str) -> tuple[int, float, int]:
        """Tokens, score and pre-tokens of what stands between two blanks, kept as the terminal counts of its pre-tokens."""
        nodes = [self.insert(p.encode("utf-8", "surrogatepass")) for p in PRE_TOKEN.findall(part)]
        if len(nodes) == 1:
            got = (self.pieces[nodes[0]], self.best[nodes[0]], 1)
        else:
            got = (sum(self.pieces[n] for n in nodes), sum(self.best[n] for n in nodes), len(nodes))
        if not part.startswith(" "):
            self.terminal[part] = got
        return got

    def count(self, text: str) -> tuple[int, float, int]:
        """Tokens, log score and pre-tokens of a text."""
        if len(self.best) > NODES or len(self.terminal) + len(self.after_blank) > NODES:
            self.clear()
        if not text:
            return 0, 0.0, 0
        if "  " in text or text[-1] == " ":  # runs of blanks belong together
            found = [self.terminal.get(p) or self.add(p) for p in PRE_TOKEN.findall(text)]
        else:
            first, *rest = text.split(" ")
            held = self.after_blank
            for p in set(rest).difference(held):
                held[p] = self.add(" " + p)
            found = list(map(held.__getitem__, rest))
            if first:
                found.append(self.terminal.get(first) or self.add(first))
        n, score, parts = map(sum, zip(*found, strict=True)) if found else (0, 0.0, 0)
        return n, score, parts


@lru_cache(maxsize=1)
def trie_of(path: str) -> Trie:
    """One for each worker process, so that its nodes serve all tasks that run there."""
    return Trie(scores(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, log_score and n_pretokens of each document."""
    path = path or vocabulary_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path)
        for b in batches:
            found = [trie.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int64()))]], names=["doc_id", "n_tokens", "log_score", "n_pretokens"])

    return map_arrow(docs.select("doc_id", text_of(docs).alias("text")), rows, "doc_id long, n_tokens long, log_score double, n_pretokens long")


def brute(text: str, vocabulary: dict[bytes, float]) -> tuple[int, float]:
    """Tokens and score of one text by a Viterbi pass over each pre-token alone, for tests."""
    total, score = 0, 0.0
    for p in PRE_TOKEN.findall(text):
        b = p.encode()
        best: list[tuple[float, int]] = [(0.0, 0)]
        for d in range(1, len(b) + 1):
            top = (-1e300, 0)
            for a in range(d):
                if b[a:d] in vocabulary:
                    s, n = best[a][0] + vocabulary[b[a:d]], best[a][1] + 1
                    if s > top[0] + 1e-9 or (s > top[0] - 1e-9 and n < top[1]):
                        top = (s, n)
            best.append(top)
        total, score = total + best[-1][1], score + best[-1][0]
    return total, score


def op5_trie_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op5_trie_unigram": op5_trie_unigram}

"""Digests, shards, token counts and packing against plain Python."""

import hashlib
import random
import unicodedata
import zlib
from array import array
from collections import Counter

import duckdb
import pytest
import xxhash

from parlance.llm import digests, packing, sharding, templates, tokens
from parlance.llm.common import documents

TEXTS = [(5, "Ａ b  C"), (3, "a B c"), (1, None), (9, ""), (7, "  "), (2, "Straße é"), (4, "STRASSE é"), (8, "x" * 4000), (6, "日本 " * 50), (10, "a B c")]


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(t.split())


def test_canonical_forms(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    h1, h2 = digests.wide_hash(digests.F.col("c"))
    rows = df.select("doc_id", "text", digests.canonical(df.text).alias("c")).select("*", digests.hexed(h1, h2).alias("f")).collect()
    for r in rows:
        assert r.c == canonical(r.text)
        assert r.f[:16] == f"{xxhash.xxh64_intdigest(r.c.encode(), 42):016x}"
    by = {r.doc_id: r.f for r in rows}
    assert by[5] == by[3] == by[10] and by[1] == by[9] == by[7] and by[2] == by[4]


def test_op3_on_documents(spark, sf, monkeypatch):
    for docs in (spark.createDataFrame(TEXTS, "doc_id long, text string"), documents(spark, sf)):
        monkeypatch.setattr(digests, "documents", lambda *_, d=docs: d)
        rows = {r.doc_id: r for r in digests.op3_canonical_digest(spark, sf).collect()}
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        ids = sorted(texts, reverse=True)
        groups = Counter(canonical(t) for t in texts.values())
        for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
            t, k, r = texts[i], len(texts[i]) // 3, rows[i]
            e = t[: len(t) - k] + texts[j][:k]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert (r.near_edited == 1.0) == (canonical(e) == canonical(t)) and (r.near_next == 1.0) == (canonical(texts[j]) == canonical(t))
            assert r.class_size == groups[canonical(t)] and canonical(texts[r.class_id]) == canonical(t)
        assert len(rows) == len(texts)


def test_op3_edge_tables(spark, sf, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(digests, "documents", lambda *_: empty)
    assert digests.op3_canonical_digest(spark, sf).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, "A")], "doc_id long, text string")
    monkeypatch.setattr(digests, "documents", lambda *_: odd)
    rows = digests.op3_canonical_digest(spark, sf).collect()
    assert len(rows) == 4 and sorted(r.class_size for r in rows) == [2, 2, 2, 2]


@pytest.mark.parametrize("rows", [[(i, "x" * (i * 37 % 400)) for i in range(300)], [(1, None), (1, "a"), (1, "a"), (None, "é")], [(5, "y")]])
def test_shards(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text_crc32, r["size"], r["shard"], r.slot) for r in sharding.prefix_shards(sharding.measured(df)).collect())
    want = sorted((i, crc, size, k, slot) for i, size, crc, k, slot in sharding.brute([(i if i is not None else -1, t) for i, t in rows]))
    assert got == want
    assert sharding.prefix_shards(sharding.measured(df.filter("false"))).count() == 0


def test_shards_of_documents(spark, sf):
    rows = sharding.op10_prefix_shards(spark, sf).collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted((r.doc_id, r["size"], r["shard"], r.slot) for r in rows) == sorted(c.sql(sharding.PLACES_SQL).fetchall())
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    assert all(zlib.crc32((texts[r.doc_id] or "").encode()) == r.text_crc32 for r in rows)


def test_tries_agree_with_viterbi():
    v = tokens.scores(tokens.vocabulary_path())
    trie, r = tokens.Trie(v), random.Random(3)
    for t in ["", " ", "a  b ", "\n\n x\ty ", "word.\nNext  one", "日本 語\r\n"] + ["".join(r.choice("abcdeé \n") for _ in range(200)) for _ in range(30)]:
        n, s, _ = trie.count(t)
        bn, bs = tokens.brute(t, v)
        assert n == bn and abs(s - bs) < 1e-6
        assert "".join(tokens.PRE_TOKEN.findall(t)) == t


def test_trie_shares_prefixes():
    trie = tokens.Trie(tokens.scores(tokens.vocabulary_path()))
    trie.count("international")
    nodes = len(trie.best)
    trie.count("internationally")
    assert len(trie.best) == nodes + 2


def test_op5_rows(spark, sf):
    rows = {r.doc_id: r for r in tokens.op5_trie_unigram(spark, sf).collect()}
    v = tokens.scores(tokens.vocabulary_path())
    some = [r for r in documents(spark, sf).collect() if len(r.text) < 2000][:40]
    assert all(rows[r.doc_id].n_tokens == tokens.brute(r.text, v)[0] for r in some)


def test_word_tokenizer_is_the_tokenizer():
    w = packing.WordTokenizer(packing.vocabulary_path())
    texts = ["", "a\x1cb c", "<|endoftext|> x<|endoftext|>y", "Σας ΟΔΟΣ’s don't I'LL", "é é café İ ﬁ 日本 ok’ll 12'34", "x" * 3000, "the&&& ### a1b2 c d"]
    assert list(w.encode(texts)) == [array("I", w.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 101) for _ in range(r.choice([0, 1, 7, 30, 400, 3000]))]
    plan = packing.plan(Counter(sizes), 100)
    used = Counter(s for own, k in plan for s in own for _ in range(k))
    assert used == Counter(sizes) and all(sum(own) <= 100 for own, _ in plan)
    bins = sum(k for _, k in plan)
    assert bins <= sum(k for _, k in packing.best_fit(dict(Counter(sizes)), 100)) and bins >= -(-sum(sizes) // 100)


def optimum(sizes, capacity):
    """The least number of sequences, by trying every placement."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j, held in enumerate(bins):
            if held + sizes[i] <= capacity and held not in bins[:j]:
                go(i + 1, [*bins[:j], held + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_beats_best_fit():
    sizes = [60, 50, 30, 20, 20, 20]
    assert sum(k for _, k in packing.best_fit(dict(Counter(sizes)), 100)) == 3
    search = packing.Search(Counter(sizes), 100)
    assert search.bins == 2 and search.proved


@pytest.mark.parametrize("seed", range(60))
def test_plans_are_optimal(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 50, 100])
    sizes = [r.randrange(r.choice([1, capacity // 5 + 1]), capacity * 2 // 3 + 2) for _ in range(r.randrange(12))]
    search = packing.Search(Counter(sizes), capacity)
    assert search.bins == optimum(sizes, capacity) >= packing.lower_bound(dict(Counter(sizes)), capacity)
    assert search.proved and all(sum(own) <= capacity for own, _ in search.best)


def test_fillings_are_not_dominated():
    counts = {3: 1, 4: 2, 7: 1, 9: 1}
    found = list(packing.fillings(12, counts, sorted(counts)))
    assert found[0] == [9, 3] and all(sum(f) <= 12 for f in found) and [sum(f) for f in found] == sorted(map(sum, found), reverse=True)
    assert [4, 4] not in found  # the 3 fits too, and the 9 takes the place of both


def test_word_tokenizer_on_any_signs():
    w, r = packing.WordTokenizer(packing.vocabulary_path()), random.Random(5)
    texts = ["a\x10b", "\x10", *("".join(f"{a}{c}x {c}" for a in "z1") for c in map(chr, [*range(0x80), *range(0x80, 0x3000, 7)]))]
    texts += ["".join(chr(r.choice([r.randrange(0x20), r.randrange(0x80), r.randrange(0x3000), 0x7F])) for _ in range(r.randrange(1, 12))) for _ in range(3000)]
    assert list(w.encode(texts)) == [array("I", w.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_packing_long_text_and_clashing_columns(spark):
    rows = [(1, "word \x10 " * 30_000, 5, 6), (1, "word \x10 " * 30_000, 5, 6), (2, None, 5, 6)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, length int, pid int")).collect()
    n = len(next(iter(packing.WordTokenizer(packing.vocabulary_path()).encode([rows[0][1]])))) // 4 + 1
    assert sum(r.length for r in out) == 2 * n + 1 and all(r.length <= 2048 for r in out)


def test_packed_rows(spark, sf):
    extra = spark.createDataFrame([(None, None), (7, ""), (7, "")], "doc_id long, text string")
    docs = documents(spark, sf).select("doc_id", "text").unionByName(extra)
    rows = packing.packed(docs).collect()
    w = packing.WordTokenizer(packing.vocabulary_path())
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by[None]) == 1 and by[None][0].length == 1 and len([r for r in by[7] if r.length == 1]) >= 2
    for i, t in texts.items():
        if i == 7:
            continue
        ids = next(iter(w.encode([t]))) + b"\0\0\0\0"
        own = sorted(by[i], key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids) // 4
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in own)
    total = sum(r.length for r in rows)
    assert len(seq) <= -(-total // 2048) + 2
    assert packing.packed(docs.filter("false")).count() == 0


def test_template_lines(spark):
    noise = lambda i, k: f"line {'abcdefghij'[i % 10]}{'qrstuvwxyz'[k]} of doc {chr(97 + i)}{chr(110 + k)} alone"
    rows = [(i, f"{noise(i, 0)}\nrequest {i * 17} took {i} ms on host{i}\n{noise(i, 1)}\n{noise(i, 2)}") for i in range(12)]
    rows += [(100 + i, "\n".join(f"copied text number {chr(97 + k)} stays as it is" for k in range(6))) for i in range(5)]
    rows += [(200, None), (201, ""), (202, "short"), (203, "request 5 took 9 ms on host1")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, __no int, kt string")
    both = {r.row.doc_id: r for r in templates.deduped(df).collect()}
    out = {i: r.row for i, r in both.items()}
    assert len(out) == len(rows) and all(r["__no"] == 1 and r.kt == "x" for r in out.values())
    for i in range(12):
        assert both[i].dropped == [1] and "request" not in out[i].text and out[i].text.count("\n") == 2
    assert all(out[100 + i].text.count("copied") == 6 for i in range(5))  # whole copies are for document dedup
    assert out[200].text is None and out[201].text == "" and out[202].text == "short" and out[203].text.startswith("request")
    assert templates.deduped(df.filter("false")).count() == 0


def test_templates_generalise_words(spark):
    names = "anna bert carl dora emil fritz gerd hans".split()
    rows = [(i, f"own words {chr(97 + i)} here {chr(110 + i)}\nthe user named {n} has signed in from the west side gate today") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.dropped == [1] for r in templates.deduped(df).collect())


def test_a_line_recurs_whatever_it_hashes_to(spark):
    rows = [(100 * k + i, f"shared passage number {chr(97 + k)} has its place here\nown {chr(97 + k)} words {chr(97 + i)} stand here and so do some more of them") for k in range(16) for i in range(5)]
    rows += [(10_000 + i, rows[0][1]) for i in range(30)]  # copies take nothing from the count
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.dropped[:1] == [0] for r in templates.deduped(df).collect())


def test_several_templates_of_a_leaf(spark):
    names = "anna bert carl dora emil fritz gerd hans".split()
    kinds = ["the user named {} has signed in from the west side gate today", "the user named {} could not open any room with his old key"]
    rows = [(10 * k + i, f"own words {chr(97 + i)} here {chr(110 + i)} {chr(97 + k)}\n{kind.format(n)}") for k, kind in enumerate(kinds) for i, n in enumerate(names)]
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows += [(100 + i, f"{word()} {word()} {word()}\nthe user named " + " ".join(word() for _ in range(10))) for i in range(60)]
    out = {x.row.doc_id: x.dropped for x in templates.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == ([1] if i < 100 else []) for i in out)


def test_a_passage_goes_from_documents_that_are_mostly_it(spark):
    word = lambda i, k: "".join(chr(97 + (i * 7 + k * 11 + j * (i + 3)) % 26) for j in range(7))
    passage = " ".join(word(k, k) for k in range(100))
    rows = [(i, f"{passage}\n" + " ".join(word(i + 40, k + 9 * i) for k in range(24))) for i in range(2)]  # 81% passage, two documents
    other = "this program is free software and comes without any warranty at all so please read on"
    rows += [(10 + i, f"{other}\n" + " ".join(word(i + 60, k + 5 * i) for k in range(30))) for i in range(3)]
    rows += [(20 + i, f"{other}\nx{chr(97 + i)}") for i in range(2)]  # nearly nothing else
    base = [" ".join(word(i + 100, k + 3 * i) for k in range(12)) for i in range(20)]
    rows += [(30 + i, "\n".join([*base[:i], f"another {word(i, 5)} line {word(i, 6)}", *base[i + 1 :]])) for i in range(4)]  # near copies
    pair = [" ".join(word(i + 300, k + 3 * i) for k in range(60 if i == 1 else 12)) for i in range(9)]
    rows += [(40 + i, "\n".join([*pair, f"another {word(i, 7)} line {word(i, 9)}"])) for i in range(2)]  # a pair of near copies
    out = {x.row.doc_id: x.dropped for x in templates.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == ([0] if i < 30 else []) for i in out)


def test_lines_between_the_ends_of_bands_are_compared(spark):
    """A family of one leaf whose common bands end, by hash, in lines unlike it; all groups against brute force."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    family = [f"alpha beta gamma same kept {word()}" for _ in range(4)]
    others = [f"alpha beta gamma same {word()} {word()}" for _ in range(60)]
    others += [f"delta beta gamma {r.choice('pqrs')} {r.choice('pqrstuv')} {r.choice('pqrstuv')} {r.choice('pqrstuv')} {r.choice('pq')}" for _ in range(60)]
    lines = sorted({*family, *others})
    F = templates.F
    base = spark.createDataFrame([(x, " ".join(x.split()[:3])) for x in lines], "line string, lead string")
    rest = base.select(F.xxhash64("lead").alias("leaf"), F.xxhash64("line").alias("th"), "line", F.lit(1).cast("long").alias("n"), F.lit(len(lines)).cast("long").alias("all"), templates.placed(F.col("line")).alias("tokens")).cache()
    counts = rest.select("leaf", "th", F.col("th").alias("m"))
    sketches = counts.withColumn("sketch", F.array(F.lit(1).cast("long"))).filter("false")
    got = {x.line for x in templates.similar(rest, counts, sketches, 3).join(rest, ["leaf", "th"]).collect()}
    like = lambda x, y: x.split()[:3] == y.split()[:3] and len(x.split()) == len(y.split()) and sum(a == b for a, b in zip(x.split(), y.split())) >= templates.SIMILAR * len(x.split())
    near = {x: [y for y in lines if like(x, y)] for x in lines}
    want = {y for x in lines if len(near[x]) >= 3 for y in near[x]}
    assert set(family) <= want and not want >= set(others)
    assert got >= want
    # beside these, only lines of the majority's template go
    assert {x for x in got if x.startswith("alpha")} == set(family)


def test_a_family_between_the_ends_goes(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(i, f"own {word()} {word()} {word()}\nalpha beta gamma same kept {word()}") for i in range(4)]
    rows += [(100 + i, f"own {word()} {word()} {word()}\nalpha beta gamma same {word()} {word()}") for i in range(60)]
    out = {x.row.doc_id: x.dropped for x in templates.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == ([1] if i < 100 else []) for i in out)


def leaf_lines(spark, lines):
    """The lines as ``similar`` gets them, of one leaf for each length and first three words."""
    F = templates.F
    base = spark.createDataFrame([(x, " ".join(x.split()[:3]), len(x.split())) for x in lines], "line string, lead string, size int")
    return base.select(F.xxhash64("size", "lead").alias("leaf"), F.xxhash64("line").alias("th"), "line", F.lit(1).cast("long").alias("n"), F.lit(len(lines)).cast("long").alias("all"), templates.placed(F.col("line")).alias("tokens")).cache()


@pytest.mark.parametrize("kind", ["unlike", "copies"])
def test_comparisons_grow_with_the_lines(spark, monkeypatch, kind):
    """Lines that share a band but nothing else, and near copies of one document that differ in the line only."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    n = 300
    lines = [f"alpha beta gamma same {word()} {word()}" if kind == "unlike" else f"alpha beta gamma {'same ' * 12}{word()}" for _ in range(n)]
    F, calls, plain = templates.F, spark.sparkContext.accumulator(0), templates.agreement

    @F.udf("int")
    def counted(x):
        calls.add(1)
        return x

    monkeypatch.setattr(templates, "agreement", lambda a, b: counted(plain(a, b)))
    monkeypatch.setattr(templates, "CROWD", 100, raising=False)
    rest = leaf_lines(spark, lines)
    counts = rest.select("leaf", "th", (F.col("th") if kind == "unlike" else F.lit(1).cast("long")).alias("m"))
    sketches = counts.withColumn("sketch", F.array(F.lit(1).cast("long"))).filter("false")
    assert templates.similar(rest, counts, sketches, 3).count() == 0
    assert n <= calls.value < 40 * n  # all pairs of one band are n * n


@pytest.mark.parametrize("seed", range(2))
def test_rarest_tokens_miss_no_line(spark, monkeypatch, seed):
    """With the rarest tokens in place of bands, and the lines of a key in parts: all that brute force finds."""
    r = random.Random(seed)
    base = ["alpha beta gamma " + " ".join(r.choice("abc") for _ in range(k)) for k in (4, 7, 12)]
    vary = lambda x: " ".join([*x.split()[:3], *[r.choice("abcdefgh") if r.random() < 0.3 else w for w in x.split()[3:]]])
    lines = sorted({vary(r.choice(base)) for _ in range(150)})
    monkeypatch.setattr(templates, "CROWD", 0)
    monkeypatch.setattr(templates, "PART", 4)
    # the rest of the way without what the ends of bands tell
    monkeypatch.setattr(templates, "voted", lambda rest, min_docs: rest.select("leaf", "th", templates.F.col("th").alias("group")).limit(0))
    F = templates.F
    rest = leaf_lines(spark, lines)
    counts = rest.select("leaf", "th", F.pmod("th", F.lit(40)).alias("m"))
    sketches = counts.withColumn("sketch", F.array(F.lit(1).cast("long"))).filter("false")
    m = {x.line: x.m for x in rest.join(counts, ["leaf", "th"]).collect()}
    like = lambda x, y: len(x.split()) == len(y.split()) and sum(a == b for a, b in zip(x.split(), y.split())) >= templates.SIMILAR * len(x.split())
    near = {x: [y for y in lines if like(x, y)] for x in lines}
    want = {y for x in lines if len({m[z] for z in near[x]}) >= 3 for y in near[x]}
    got = {x.line for x in templates.similar(rest, counts, sketches, 3).join(rest, ["leaf", "th"]).collect()}
    assert got == want and 0 < len(want) < len(lines)

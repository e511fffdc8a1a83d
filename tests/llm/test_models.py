"""Classifiers and the mixture on held-out rows; the join and the pipeline against plain Python."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import jaccard, mixing, quality, toxicity
from parlance.llm.graphs import components

SF = "/root/testdata/sf0.01"


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, rows, label):
    d = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    return d[label].to_numpy(), d["score"].to_numpy(), d["predicted"].to_numpy()


def test_quality_held_out(spark):
    rows = quality.op6_additive_quality(spark, SF)
    assert rows.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0
    y, p, q = held_out(spark, rows, "quality")
    assert auc(y, p) > 0.97 and q[y == 1].mean() > 0.98


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 30000), (3, "x"), (None, "y")], "doc_id long, text string")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(docs, labels.filter("false")).count() == 5
    assert quality.scored(docs.filter("false"), labels).count() == 0
    clash = docs.withColumns({"x": F.lit("keep"), "score": F.lit(1)})
    assert {r.x for r in quality.good(clash, labels.filter("quality = 1")).collect()} == {"keep"}


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_toxicity_held_out(spark):
    rows = toxicity.op4_channel_toxicity(spark, SF)
    assert rows.count() == 1000 and rows.filter("score < 0 OR score > 1").count() == 0
    y, p, q = held_out(spark, rows, "toxic")
    assert auc(y, p) > 0.8


def test_disguised_words_are_restored(spark):
    docs = spark.createDataFrame([(i, "the idiot is a stupid moron and a loser trash clown pathetic scum worthless") for i in range(50)], "doc_id long, text string")
    lm = toxicity.Characters(toxicity.trigrams(docs))
    for said, meant in {"1d10t": "idiot", "m o r o n": "moron", "tr@sh": "trash", "s.t.u.p.i.d": "stupid", "looooser": "loser", "5cum": "scum", "cl0wn": "clown", "p-a-t-h-e-t-i-c": "pathetic"}.items():
        assert meant in toxicity.restored(said, lm), said
    for said, word in (("a s t u p i d", "stupid"), ("stuupid", "stupid"), ("5tup1d", "stupid"), ("id!ot", "idot"), ("x55", "xs")):
        assert word in toxicity.restored(said, lm) or word in "".join(toxicity.restored(said, lm)), said
    assert "=fol" in toxicity.marks("fool") and "=fol" in toxicity.marks("fol")
    assert toxicity.restored("plain", lm) == ["plain"] and toxicity.restored("###", lm) == []


def test_readings_are_the_likeliest_of_all(spark):
    """Every path through the lattice, scored by itself: the best reading is the best path's."""
    lm, r = toxicity.Characters(toxicity.trigrams(spark.read.parquet(f"{SF}/documents.parquet"))), random.Random(7)

    def paths(chunk, a=0, b=0, seen="", last="", score=0.0, text=""):
        if not chunk:
            if text.strip():
                yield score + (lm.logp[a][b][0] if b else 0.0), text.strip()
            return
        ch, rest = chunk[0], chunk[1:]
        if ch in lm.index:
            i, again = lm.index[ch], last == ch
            yield from paths(rest, b, i, ch, ch, score + lm.logp[a][b][i] + (toxicity.REPEAT_IN if again else 0.0), text + ch)
            if again:
                yield from paths(rest, a, b, seen, last, score + toxicity.REPEAT_OUT, text)
            return
        for c in toxicity.LOOKS.get(ch, ""):
            if last == c and seen == ch:
                yield from paths(rest, a, b, seen, last, score + toxicity.REPEAT_OUT, text)
            yield from paths(rest, b, lm.index[c], ch, c, score + lm.logp[a][b][lm.index[c]] + toxicity.AS_LETTER, text + c)
        if ch in toxicity.APART or ch in "!|+":
            yield from paths(rest, a, b, seen, last, score + toxicity.LEFT_OUT, text)
            if b:
                yield from paths(rest, 0, 0, "", " ", score + lm.logp[a][b][0], text + " ")
        elif ch not in toxicity.LOOKS or ch.isdigit():
            yield from paths(rest, a, b, seen, last, score + toxicity.KEPT, text)

    for _ in range(150):
        chunk = "".join(r.choice("aest01!. -") for _ in range(r.randrange(1, 7)))
        found, every = lm.readings(chunk), list(paths(chunk))
        if not every:
            assert found == []
        else:
            top = max(every)[0]
            assert found[0] in {t for x, t in every if x > top - 1e-9}, (chunk, found[0])


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "bad w0rd " * 3000), (3, "x"), (None, "y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(docs.filter("false"), none).count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    assert toxicity.scored(docs, some).count() == 5


@pytest.mark.parametrize("limit", [20_000, 4])
def test_join_of_documents(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = jaccard.brute({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs, limit=limit).collect()}
    assert got == want


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_join_of_near_copies(spark, words, percent):
    r = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, common = {}, [r.choice(vocabulary) for _ in range(50)]
    for i in range(80):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 12, 40, 130]))] if i % 4 == 0 else list(base)
        own = list(base)
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        if i % 3 == 0:
            own += common
        texts[i] = " ".join(own).upper() if i % 5 == 0 else "\t".join(own)
    texts |= {500: None, 501: "", 502: " \n", 503: "one", 504: "ONE"}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, sid string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(df, words, percent).collect()}
    assert got == jaccard.brute(texts, words, percent)
    kept = {x.doc_id for x in jaccard.first_of_each(df, words, percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}
    assert jaccard.joined(df.filter("false")).count() == 0


def test_regions_are_exact():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(12)]
    sets = []
    for i in range(300):
        s = base[i % 12].copy()
        s[r.integers(0, len(s), r.integers(0, 4))] = r.integers(0, 1 << 60)
        sets.append(np.unique(s))
    label = jaccard.Region(sets).solve()
    want = np.arange(300)
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                want[want == want[i]] = want[j]
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == nodes
    assert len({(got[n], find(n)) for n in nodes}) == len({find(n) for n in nodes}) == len(set(got.values()))


def test_mixture_meets_its_targets(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for least in (0.0, 1.0):
        rows, domains = mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet"), mixing.domain_of_labels(labels), least=least)
        d = rows.select("tokens", "p", "rate", "copies", "row.doc_id", "row.text").toPandas()
        p, t, r = np.array(d["p"].tolist()), d["tokens"].to_numpy(), d["rate"].to_numpy()
        assert np.allclose(p.sum(1), 1) and (r >= 0).all()
        assert (t == [len([w for w in x.translate(str.maketrans("\n\t\r", "   ")).split(" ") if w]) for x in d["text"]]).all()
        share = (p * (t * r)[:, None]).sum(0)
        assert (np.abs(d["copies"] - r) < 1).all()
        if least:  # nearer to the targets than before, as far as the documents that stay allow
            assert (r[p.argmax(1) == domains.index("clean")] >= 1).all()
            goal, before = np.array([mixing.TARGETS[k] for k in domains]), (p * t[:, None]).sum(0)
            assert np.abs(share / share.sum() - goal).max() < np.abs(before / before.sum() - goal).max()
        else:
            assert np.allclose(share / share.sum(), [mixing.TARGETS[k] for k in domains], atol=1e-3)


def test_mixture_edges(spark):
    docs = spark.createDataFrame([(1, None, 0, 1.0), (2, "", 0, 1.0), (3, "a b", 0, 1.0), (3, "a b", 0, 1.0)], "doc_id long, text string, __p int, rate double")
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows, domains = mixing.mixed(docs, none)
    assert domains == [] and rows.count() == 4 and rows.select("row.*").columns == docs.columns
    one = spark.createDataFrame([(3, "clean")], "doc_id long, domain string")
    rows, domains = mixing.mixed(docs, one)
    assert domains == ["clean"] and {r["rate"] for r in rows.collect()} == {1.0}
    assert mixing.mixed(docs.filter("false"), one)[0].count() == 0


@pytest.mark.parametrize("most", [None, 1.5])
def test_rates_against_plain_projected_gradient(spark, most):
    r = np.random.default_rng(4)
    p, t, floor = r.dirichlet([0.5, 0.3, 0.2], 200), r.integers(1, 200, 200), (r.random(200) < 0.3) * 1.0
    members = spark.createDataFrame([(i, p[i].tolist(), int(t[i]), float(floor[i])) for i in range(200)], "doc_id long, p array<double>, tokens long, floor double")
    targets = {"a": 0.5, "b": 0.3, "c": 0.2} if most is None else {"a": 0.3, "b": 0.1, "c": 0.6}
    steps = mixing.fit_rates(members, ["a", "b", "c"], targets, most=most)
    rate = np.array([x["r"] for x in members.withColumn("r", mixing.rate_of(steps, most)).orderBy("doc_id").collect()])
    assert (rate >= floor).all() and (most is None or (rate <= most).all())
    has = (p * t[:, None]).sum(0)
    want = np.array(list(targets.values()))
    goal = want * (has / want)[want.argmax()]
    plain, a = np.ones(200), p * t[:, None]
    for _ in range(20_000):
        plain = np.clip(plain - (a @ (plain @ a - goal)) / np.linalg.norm(a, 2) ** 2, floor, most)
    loss = lambda x: float(((x @ a - goal) ** 2).sum()) ** 0.5 / goal.sum()
    assert loss(rate) <= loss(plain) + 2e-3


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == cols, name
            out = spark.createDataFrame(out.collect(), docs.schema)
            assert 0 < out.count() and (name == "mixture" or out.count() <= n)
            if name == "near_copies":
                want = jaccard.brute({r.doc_id: r.text for r in docs.collect()}, 5, 80)
                assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
            docs, n = out, out.count()
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_copies_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (None, text(1) + " end"), (None, text(2)), (5, text(1)), (5, text(3)), (6, text(4)), (6, text(4)), (None, text(5)), (None, text(5)), (7, None), (7, None), (8, text(6)), (8, text(7)), (9, text(7))]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = sorted((x.doc_id or -1, x.text or "") for x in jaccard.first_of_each(df, 5, 80).collect())
    assert kept == sorted([(1, text(1)), (-1, text(2)), (5, text(3)), (6, text(4)), (-1, text(5)), (7, ""), (7, ""), (8, text(6)), (8, text(7))])


@pytest.mark.parametrize("toxic", [10, 40])
def test_mixture_keeps_clean_documents_at_any_supply(spark, toxic, caplog):
    rows = [(i, [0.0, 1.0] if i < toxic else [1.0, 0.0], 10, 0.0) for i in range(1000)]
    members = spark.createDataFrame(rows, "doc_id long, p array<double>, tokens long, floor double")
    for most in (None, 4.0):
        caplog.clear()
        steps = mixing.fit_rates(members, ["clean", "toxic"], {"clean": 0.95, "toxic": 0.05}, most=most)
        rate = {r.doc_id: r["rate"] for r in members.withColumn("rate", mixing.rate_of(steps, most)).collect()}
        assert all(abs(rate[i] - 1) < 0.02 for i in range(toxic, 1000))
        assert ("targets missed" in caplog.text) == (toxic == 10 and most is not None)


def test_unrelated_sets_share_no_block():
    r = np.random.default_rng(1)
    for percent in (80, 90):
        for n in (20, 50, 200, 400, 2_000, 12_200, 20_000):
            sets = [set(jaccard.blocks(np.unique(r.integers(0, 2**63, n).astype(np.uint64)), percent).tolist()) for _ in range(8)]
            assert not any(a & b for i, a in enumerate(sets) for b in sets[:i])


def test_sets_that_link_share_a_block():
    r = np.random.default_rng(2)
    frequent = r.random(jaccard.CELLS) < 0.3
    for percent in (50, 80, 90):
        for n in (2, 3, 4, 5, 6, 9, 10, 14, 30, 31, 100, 1000):
            h = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            own = set(jaccard.blocks(h, percent, frequent).tolist())
            for _ in range(60):
                gone, new = r.integers(0, jaccard.differences(n, percent) + 2, 2)
                g = np.unique(np.concatenate([r.permutation(h)[gone:], r.integers(0, 2**63, new).astype(np.uint64)]))
                both = len(np.intersect1d(g, h))
                if len(g) and 100 * both >= percent * (len(g) + n - both) and not np.array_equal(g, h):
                    assert own & set(jaccard.blocks(g, percent, frequent).tolist()), (percent, n, gone, new)


def test_join_of_all_documents_is_the_brute_force_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for words, percent in ((3, 90), (5, 80)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs, words, percent).collect()} == jaccard.brute(texts, words, percent)


def test_join_is_its_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = c.sql(jaccard.JOIN_SQL)
    rows = jaccard.op7_metric_join(spark, SF).select(*found.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())

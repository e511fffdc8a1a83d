"""Line dedup by a log-template tree.

Lines are parsed in a tree of fixed depth: the number of tokens, then the first LEAD tokens, in which tokens with digits count as
one variable. Under a leaf, a line whose tokens with digits are taken as variable is a template itself if it recurs;
the other lines of the leaf share a template that has, at each place, the token most of them have, or else a variable, and
belong to it if they agree with it in at least SIMILAR of the places. A leaf may hold several templates: each line is one, for
all lines of the leaf that agree with it as far. Templates that recur across documents are dropped from the texts.

A template recurs if at least ``min_docs`` different documents have it: documents count by what they hold besides the line, so
copies count once however many they are. Two are enough for templates of LONG tokens if they have little else in common (by a sketch
of their lines). A document all of which would go is left as it is. A document of which more than WHOLE would go is a
near copy if it shares its longest or its least-hashed line of those with another such document; of it, only lines go that
documents unlike it have too, and the rest is left for document dedup to settle.

All in DataFrame operations. Nothing is gathered but the line numbers of one document and the tokens of one template.

Defined cases: a null text stays null; an empty one stays empty; lines of fewer than ``min_tokens`` tokens stay; rows that repeat are
treated alike and each kept; an empty table gives an empty result; the documents' columns travel in a struct, so any names
are possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, held, in_bitmap, marked, salted

MIN_DOCS, MIN_TOKENS = 3, 3
LEAD = 3
SIMILAR = 0.7
#: Two texts that share this part of both have a Jaccard similarity of 0.8, at which the pipeline joins near copies.
WHOLE = 8 / 9
#: Tokens of templates for which two documents are enough; different texts in which the lines of a near copy must stand.
LONG, HOSTS, SKETCH = 50, 2, 8
VARIABLE = "<*>"
#: Lines beyond which a line's bands give way to its rarest tokens, if they have fewer; lines of one key that are compared in one task.
CROWD, PART = 1000, 1024


def masked(line: Column) -> Column:
    """Tokens with digits as the variable."""
    return F.regexp_replace(line, r"(?<![^ ])[^ \d]*+\d[^ ]*", VARIABLE)


def n_tokens(line: Column) -> Column:
    return F.size(F.split(line, " "))


def leaf_of(line: Column, n: Column) -> Column:
    """The place in the tree: the token count and the first tokens."""
    return F.xxhash64(n, masked(F.substring_index(line, " ", LEAD)))


def trimmed(line: Column) -> Column:
    return F.rtrim(F.rtrim(line), F.lit("\r"))


def weight(line: Column) -> Column:
    """40 bits of a line's hash, so that the sum over a text has room; 0 for a blank line."""
    return F.when(line == "", F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(line, F.lit(1)), 24))


def lines_of(docs: DataFrame, text_col: str, min_tokens: int) -> DataFrame:
    """kd, kt (which name the text), m (which names the text's lines that are not blank, in any order), sketch (the least hashes of those), chars (of the text), no, size, line, tokens."""
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = F.split(text, "\n", -1)
    base = docs.select(F.xxhash64(text).alias("kt"), F.xxhash64(F.lit(7).cast("long"), text).alias("kd"), parts.alias("parts"), (F.char_length(text) + 1).alias("chars"))
    base = base.withColumn("w", F.transform("parts", lambda x: weight(trimmed(x))))
    sketch = F.slice(F.array_sort(F.array_distinct(F.filter("w", lambda x: x > 0))), 1, SKETCH)
    base = base.withColumns({"m": F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x), "sketch": sketch})
    rows = base.select("kt", "kd", "m", "sketch", "chars", F.posexplode("parts").alias("no", "line")).withColumn("size", F.char_length("line") + 1)
    rows = rows.withColumn("line", trimmed(F.col("line"))).withColumn("tokens", held(n_tokens(F.col("line")))).filter(F.col("tokens") >= min_tokens)
    return rows


def recurring(counts: DataFrame, sketches: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """The keys that recur across different documents, of distinct rows (by..., m) with long, and the sketches of the long ones."""
    often = counts.groupBy(*by).agg(F.count("*").alias("kinds")).filter(F.col("kinds") >= min_docs).select(*by)
    found = sketches.groupBy(*by).agg(F.count("*").alias("kinds"), F.min_by("sketch", "m").alias("a"), F.max_by("sketch", "m").alias("b")).filter("kinds >= 2")
    both = F.size(F.array_intersect("a", "b"))
    unlike = (both == 0) | (2 * both < F.least(F.size("a"), F.size("b")))
    return often.unionByName(found.filter(unlike).select(*by)).distinct()


def placed(line: Column) -> Column:
    """A name of each token and its place, so that lines agree in as many places as they have names in common."""
    return F.transform(F.split(line, " "), lambda x, i: F.xxhash64(i, x))


def agreement(a: Column, b: Column) -> Column:
    """The number of places in which two lines agree."""
    return F.size(F.array_intersect(a, b))


def voted(rest: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, th, group): the lines of each leaf that agree with its majority template."""
    tokens = rest.filter(F.col("all") >= min_docs).select("leaf", "n", F.posexplode("tokens").alias("at", "token"))
    votes = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("most"), F.sum("n").alias("n"))
    votes = votes.withColumn("token", F.when(2 * F.col("most.n") > F.col("n"), F.col("most.token")).otherwise(F.xxhash64("at", F.lit(VARIABLE))))
    trees = votes.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"))
    near = rest.join(trees, "leaf").filter(agreement(F.col("tokens"), F.col("template")) >= SIMILAR * F.size("template"))
    return near.select("leaf", "th", F.lit(0).cast("long").alias("group"))


def may_differ(tokens: Column) -> Column:
    """The most places in which two lines that agree may differ."""
    return F.floor((1 - SIMILAR) * F.size(tokens) + 1e-9).cast("int")


def banded(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaf, th, group): the lines of each leaf that agree with another line, which names the group, as far as the ends of bands tell;
    (leaf, band, th, low, high, lines): the lines of each band, its ends and their number; ``crowded`` compares those between the ends.

    The places after the first tokens are cut into one band more than places may differ, so lines that differ in the same
    few places have a band in common; each line is compared with the least and the greatest line that have it.
    """
    keyed = rest.withColumn("k", may_differ(F.col("tokens")) + 1).filter(F.size("tokens") > LEAD)
    at = lambda b: F.floor(b * (F.size("tokens") - LEAD) / F.col("k")).cast("int")
    bands = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda b: F.xxhash64(b, F.slice("tokens", LEAD + 1 + at(b), at(b + 1) - at(b))))
    keyed = cut(keyed.select("leaf", "th", F.explode(bands).alias("band")))
    ends = keyed.groupBy("leaf", "band").agg(F.min("th").alias("low"), F.max("th").alias("high"), F.count("*").alias("lines")).filter("low < high")
    keyed = cut(keyed.join(ends, ["leaf", "band"]))
    pairs = keyed.select("leaf", "th", F.explode(F.array("low", "high")).alias("end")).filter("th != end")
    pairs = pairs.select("leaf", F.least("th", "end").alias("th"), F.greatest("th", "end").alias("group")).distinct()
    both = pairs.join(rest.select("leaf", "th", "tokens"), ["leaf", "th"]).join(rest.select("leaf", F.col("th").alias("group"), F.col("tokens").alias("others")), ["leaf", "group"])
    near = cut(both.filter(agree()).select("leaf", "th", "group"))
    return mutual(near), keyed


def agree() -> Column:
    return agreement(F.col("tokens"), F.col("others")) >= SIMILAR * F.size("tokens")


def mutual(near: DataFrame) -> DataFrame:
    """Each of two lines that agree is in the other's group, and in its own."""
    return near.select("leaf", F.explode(F.array(*[F.struct(F.col(a).alias("th"), F.col(b).alias("group")) for a in ("th", "group") for b in ("th", "group")])).alias("p")).select("leaf", "p.th", "p.group")


def asking(met: DataFrame, open_: DataFrame, counts: DataFrame, gone: DataFrame, long: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, th): the lines of ``open_`` whose group may recur, and hold a line that has not gone, by what all lines of their bands tell.

    Near copies that differ in this line only have the same rest of a document; their bands have one, however many lines.
    """
    kinds = met.join(counts, ["leaf", "th"]).select("leaf", "band", "m").distinct().groupBy("leaf", "band").agg(F.count("*").alias("kinds"), F.min("m").alias("a"), F.max("m").alias("b"))
    left = met.join(gone, ["leaf", "th"], "left_anti").select("leaf", "band").distinct().withColumn("left", F.lit(True))
    own = met.select("leaf", "band", "th").join(open_, ["leaf", "th"], "left_semi").join(kinds, ["leaf", "band"]).join(left, ["leaf", "band"], "left")
    own = own.groupBy("leaf", "th").agg(F.max("kinds").alias("kinds"), F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))).alias("ms"), F.max("left").alias("left"))
    # where no band has more than two kinds, its least and greatest are all it has
    few = F.when(F.col("long"), min(2, min_docs)).otherwise(min_docs)
    return own.join(long, ["leaf", "th"]).filter(F.col("left") & ((F.col("kinds") > 2) | (F.size("ms") >= few))).select("leaf", "th")


def rarest(rest: DataFrame) -> DataFrame:
    """(leaf, th, key, lines): of each line the tokens that are rarest in its leaf, one more than places may differ, if other lines have them.

    Two lines that agree have one of these in common, as of any order of the tokens that is the same for all lines of a leaf.
    """
    tokens = rest.select("leaf", "th", F.size("tokens").alias("size"), (may_differ(F.col("tokens")) + 1).alias("k"), F.explode("tokens").alias("key"))
    often = tokens.groupBy("leaf", "key").agg(F.count("*").alias("lines")).filter("lines > 1")
    shared = tokens.join(often, ["leaf", "key"]).groupBy("leaf", "th", "size", "k").agg(F.array_sort(F.collect_list(F.struct("lines", "key"))).alias("keys"))
    # the tokens that no other line has come first
    first = F.slice("keys", 1, F.greatest(F.lit(0), F.col("k") - (F.col("size") - F.size("keys"))))
    return shared.select("leaf", "th", F.explode(first).alias("key")).select("leaf", "th", "key.key", "key.lines")


def crowded(rest: DataFrame, keyed: DataFrame, counts: DataFrame, found: DataFrame, gone: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, th, group): the pairs that agree of the lines between the ends of bands, if one of them names a group that may
    recur, is not found to, and may hold a line that is not in ``gone``.

    The other pairs decide nothing. A line is compared with the lines of its bands, or with those that have one of its
    rarest tokens, whichever are fewer.
    """
    # two lines between the ends of a band have not been compared
    inner = F.expr("lines > 3 AND th != low AND th != high")
    open_ = cut(keyed.filter(inner).select("leaf", "th").distinct().join(found.select("leaf", F.col("group").alias("th")), ["leaf", "th"], "left_anti"))
    met = cut(keyed.join(keyed.join(open_, ["leaf", "th"], "left_semi").select("leaf", "band").distinct(), ["leaf", "band"], "left_semi"))
    long = rest.select("leaf", "th", (F.size("tokens") >= LONG).alias("long"))
    asked = cut(asking(met, open_, counts, gone, long, min_docs))
    bands = met.filter(inner).select("leaf", "th", F.col("band").alias("key"), "lines")
    costs = cut(bands.join(asked, ["leaf", "th"], "left_semi").groupBy("leaf", "th").agg(F.sum("lines").alias("lines")))
    rare = cut(rarest(rest.join(costs.filter(F.col("lines") > CROWD).select("leaf").distinct(), "leaf", "left_semi")))
    # a line without any such token has no line to be compared with
    fewer = costs.filter(F.col("lines") > CROWD).join(rare.groupBy("leaf", "th").agg(F.sum("lines").alias("other")), ["leaf", "th"], "left").filter(F.coalesce("other", F.lit(0)) < F.col("lines")).select("leaf", "th")
    asks = bands.join(asked.join(fewer, ["leaf", "th"], "left_anti"), ["leaf", "th"], "left_semi").unionByName(rare.join(fewer, ["leaf", "th"], "left_semi"))
    asks = cut(asks.select("leaf", "th", "key"))
    parts = asks.groupBy("leaf", "key").agg(F.floor(F.count("*") / PART).alias("parts"))
    tokens = rest.select("leaf", "th", "tokens")
    ours = asks.join(parts, ["leaf", "key"]).withColumn("part", F.pmod(F.xxhash64("th"), F.col("parts") + 1)).select("leaf", "th", "key", "part").join(tokens, ["leaf", "th"])
    theirs = bands.unionByName(rare).select("leaf", "th", "key").join(parts, ["leaf", "key"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts")))).join(tokens, ["leaf", "th"])
    theirs = theirs.select("leaf", "key", "part", F.col("th").alias("group"), F.col("tokens").alias("others"))
    # compared where they meet, so that only pairs that agree are written
    both = ours.join(theirs, ["leaf", "key", "part"]).filter("th != `group`").filter(agree())
    return mutual(both.select("leaf", "th", "group").distinct())


def recurring_groups(matched: DataFrame, counts: DataFrame, sketches: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, group) of the groups whose lines recur across different documents."""
    # a leaf has one token count, so its lines are all long or none is
    shared = counts.join(matched, ["leaf", "th"]).select("leaf", "group", "m").distinct()
    alike = sketches.join(matched, ["leaf", "th"]).groupBy("leaf", "group", "m").agg(F.min("sketch").alias("sketch"))
    return recurring(shared, alike, ["leaf", "group"], min_docs)


def similar(rest: DataFrame, counts: DataFrame, sketches: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, th): the lines in a group that recurs, of the majority's template or of a line.

    Every line that agrees with a line that recurs so is found: what the ends of bands leave open is compared in full.
    """
    near, keyed = banded(rest)
    matched = cut(voted(rest, min_docs).unionByName(near).distinct())
    found = cut(recurring_groups(matched, counts, sketches, min_docs))
    gone = cut(salted(matched, found, ["leaf", "group"], F.col("th")).select("leaf", "th").distinct())
    more = cut(crowded(rest, keyed, counts, found, gone, min_docs).distinct())
    again = matched.unionByName(more).join(more.select("leaf", "group").distinct(), ["leaf", "group"], "left_semi").distinct()
    found = found.unionByName(recurring_groups(again, counts, sketches, min_docs)).distinct()
    return salted(matched.unionByName(more), found, ["leaf", "group"], F.col("th")).select("leaf", "th").distinct()


def dropped_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(kt, kd, no) of each line that has a recurring template."""
    lines = lines_of(docs, text_col, min_tokens).withColumn("leaf", held(leaf_of(F.col("line"), F.col("tokens"))))
    is_long = F.col("tokens") >= LONG
    # texts count once for each row that has them; the copies differ in no key, so rows are counted before the shuffle
    leaves = cut(lines.groupBy("leaf").agg(F.count("*").alias("n"), F.max(is_long).alias("long")).filter((F.col("n") >= min_docs) | F.col("long") & (F.col("n") >= 2)).select("leaf"))
    # m and the sketch without the line itself
    own = weight(F.col("line"))
    some = in_bitmap(lines, leaves, "leaf").withColumn("long", is_long).withColumns({"m": F.col("m") - own, "sketch": F.when(F.col("long"), F.array_remove("sketch", own)), "line": masked(F.col("line"))}).withColumn("th", F.xxhash64("line"))
    some = cut(some.select("kt", "kd", "m", "sketch", "chars", "no", "size", "leaf", "long", "th", "line"))
    # a text with several lines of a template counts once
    counts = some.groupBy("leaf", "th", "kt", "kd").agg(F.min("m").alias("m"))
    counts = cut(counts.select("leaf", "th", "m").distinct())
    once = some.filter("long").groupBy("leaf", "th", "kt", "kd").agg(F.min("m").alias("m"), F.min_by("sketch", "m").alias("sketch"))
    sketches = cut(once.groupBy("leaf", "th", "m").agg(F.min("sketch").alias("sketch")))
    own = cut(recurring(counts, sketches, ["leaf", "th"], min_docs))
    # the lines of a leaf that are no template themselves, if there are several
    rest = some.groupBy("leaf", "th", "line").agg(F.count("*").alias("n")).join(own, ["leaf", "th"], "left_anti")
    several = rest.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n").alias("all")).filter("lines > 1").select("leaf", "all")
    rest = cut(rest.join(several, "leaf").select("leaf", "th", "n", "all", placed(F.col("line")).alias("tokens")))
    general = similar(rest, counts, sketches, min_docs)
    gone = cut(own.unionByName(general))
    rows = salted(some.select("kt", "kd", "no", "leaf", "th", "size", "chars"), gone, ["leaf", "th"], F.col("kt"), F.col("no"))
    return without_near_copies(cut(rows.groupBy("kt", "kd", "no", "leaf", "th", "size", "chars").agg(F.count("*").alias("docs"))))


def without_near_copies(rows: DataFrame) -> DataFrame:
    """(kt, kd, no) of the rows, but of near copies only the lines that stand in HOSTS texts unlike them as well."""
    texts = rows.groupBy("kt", "kd").agg(F.sum("size").alias("gone"), F.max("chars").alias("chars"), F.max("docs").alias("docs"), F.max_by("th", F.struct("size", "th")).alias("longest"), F.min("th").alias("least"))
    whole = cut(texts.filter(F.col("gone") > WHOLE * F.col("chars")))
    keyed = whole.select("kt", "kd", "docs", F.explode(F.array(F.xxhash64(F.lit(1), "longest"), F.xxhash64(F.lit(2), "least"))).alias("key"))
    several = keyed.groupBy("key").agg(F.sum("docs").alias("docs")).filter("docs > 1").select("key")
    copies = cut(keyed.join(several, "key", "left_semi").select("kt", "kd").distinct())
    own = rows.join(copies, ["kt", "kd"], "left_semi")
    # two texts tell; no need to count more
    unlike = rows.join(whole, ["kt", "kd"], "left_anti").groupBy("leaf", "th").agg(F.min("kt").alias("low"), F.max("kt").alias("high"))
    hosts = unlike.filter("low < high").select("leaf", "th")
    kept = own.join(hosts, ["leaf", "th"], "left_anti").select("kt", "kd", "no")
    return rows.select("kt", "kd", "no").join(kept, ["kt", "kd", "no"], "left_anti")


def deduped(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``row`` (the documents' columns, the text shortened), ``lines`` (of the text) and ``dropped`` (numbers of the lines that went).

    Only texts that a bitmap of those with such lines lets through are shuffled.
    """
    gone = dropped_lines(docs, text_col, min_docs, min_tokens).groupBy("kt", "kd").agg(F.sort_array(F.collect_list("no")).alias("nos"))
    gone = cut(gone)
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    # the input columns travel as one, so that no name can clash
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(text).alias("kt"), F.xxhash64(F.lit(7).cast("long"), text).alias("kd"), F.monotonically_increasing_id().alias("at"))
    rows = marked(rows, gone.select("kt"), "kt")
    joined = salted(rows.filter("__may"), gone, ["kt", "kd"], F.col("at"), how="left").select("row", "nos")
    both = joined.unionByName(rows.filter("NOT __may").select("row", F.lit(None).cast("array<int>").alias("nos")))
    old = F.col("row").getField(text_col)
    parts = F.split(old, "\n", -1)
    both = both.withColumn("kept", F.when(F.col("nos").isNotNull(), F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("nos", i)), "\n")))
    drop = F.col("nos").isNotNull() & (F.trim("kept") != "")
    own = [F.when(drop, F.col("kept")).otherwise(old).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    dropped = F.when(drop, F.col("nos")).otherwise(F.array().cast("array<int>"))
    return both.select(F.struct(*own).alias("row"), F.when(old.isNull(), 0).otherwise(F.size(parts)).alias("lines"), dropped.alias("dropped"))


def op9_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates."""
    out = deduped(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "row.text", "lines", "dropped")
    return out.select("doc_id", F.col("lines").alias("n_lines"), F.size("dropped").alias("n_dropped"), F.col("dropped").alias("dropped_lines"), F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_template_lines": op9_template_lines}

"""Scores of predictions against labelled samples; one row for each sample, then the average of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import columns as C


def keys(names: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(names, F.array().cast("array<string>")), C.normalize_key))


def set_scores(expected: Column, predicted: Column) -> dict[str, Column]:
    """precision, recall and the rates of false ones, over distinct normalised keys; 0 where a set is empty."""
    e, p = keys(expected), keys(predicted)
    both, n_e, n_p = F.size(F.array_intersect(e, p)), F.size(e), F.size(p)
    return {"precision_": C.safe_divide(both.cast("double"), n_p), "recall_": C.safe_divide(both.cast("double"), n_e), "false_positive_rate": C.safe_divide((n_p - both).cast("double"), F.greatest(n_p, F.lit(1))), "false_negative_rate": C.safe_divide((n_e - both).cast("double"), F.greatest(n_e, F.lit(1)))}


def top_k_hit(primary: Column, predicted: Column, k: int) -> Column:
    """Whether the primary key is among the first k predictions (structs of ord, key, confidence) by confidence, ties in their order."""
    ranked = F.transform(F.array_sort(F.transform(predicted, lambda x: F.struct((-F.coalesce(x["confidence"], F.lit(0.0))).alias("c"), x["ord"].alias("o"), C.normalize_key(x["key"]).alias("k")))), lambda x: x["k"])
    at = F.array_position(ranked, C.normalize_key(primary))
    return F.when((C.normalize_key(primary) != "") & (at > 0) & (at <= k), 1).otherwise(0)


def title_hit(expected: Column, predicted: Column, should: Column, said: Column) -> Column:
    a, b = C.normalize_key(expected), C.normalize_key(predicted)
    return F.when(~should & ~said, 1).when((a != "") & (b != "") & (C.jaccard(C.words(a), C.words(b)) >= 0.6), 1).otherwise(0)


def issue_scores(expected: Column, said: Column) -> dict[str, Column]:
    """Of structs of should_issue, title, type and actionability; a missing prediction says that there is no issue."""
    should, claims = F.coalesce(expected["should_issue"], F.lit(False)), F.coalesce(said["should_issue"], F.lit(False))
    neither, acts = ~should & ~claims, F.coalesce(C.clamp01(said["actionability"].cast("double")), F.lit(0.0))
    same_type = F.when(neither | said["type"].eqNullSafe(expected["type"]), 1).otherwise(0)
    return {"should_issue_accuracy": F.when(should == claims, 1).otherwise(0), "title_hit_rate": title_hit(expected["title"], said["title"], should, claims), "type_accuracy": same_type, "actionability_gap": F.abs(acts - expected["actionability"]), "average_actionability": acts}


def knowledge_scores(expected: Column, said: Column) -> dict[str, Column]:
    """Of structs of should_distill and kind; the kind counts only where something is to be kept, and nothing kept on both sides is right."""
    should, claims = expected["should_distill"], F.coalesce(said["should_distill"], F.lit(False))
    right = (expected["kind"].eqNullSafe(said["kind"]) & should) | (~should & ~claims)
    return {"should_distill_accuracy": F.when(should == claims, 1).otherwise(0), "type_accuracy": F.when(right, 1).otherwise(0)}


def redaction_scores(must: Column, redacted: Column, allowed: Column) -> dict[str, Column]:
    """Leaked of what must go; redacted that neither must go nor is allowed."""
    m, r, a = keys(must), keys(redacted), keys(allowed)
    leaked = F.size(F.array_except(m, r)).cast("double")
    over = F.size(F.array_except(F.array_except(r, m), a)).cast("double")
    return {"leak_rate": C.safe_divide(leaked, F.greatest(F.size(m), F.lit(1))), "over_redaction_rate": C.safe_divide(over, F.greatest(F.size(r), F.lit(1)))}


def last_predictions(predictions: DataFrame, order: str = "ord") -> DataFrame:
    """Of predictions for one sample the last counts."""
    rest = [c for c in predictions.columns if c != "id"]
    return predictions.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("p")).select("id", "p.*")


def paired(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every sample, with its prediction if there is one."""
    return samples.join(last_predictions(predictions), "id", "left")


def averages(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.agg(F.count("*").alias("samples"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def sensitive_tokens(text: Column) -> Column:
    """E-mails, keys and numbered ids, each once."""
    rules = [r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?i)sk[-_][a-z0-9-]+", r"(?i)(?<![A-Za-z0-9_])(?:user|order|session)[-_]?\d{3,}(?![A-Za-z0-9_])"]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(r), F.lit(0)) for r in rules]))


SIGNAL = "struct<key:string,summary:string,category:string,severity:string,weight:double>"
ACTION = "struct<key:string,label:string,priority:string>"
SAMPLE = f"id string, intent string, rawInput string, expected struct<primarySignal:string,signals:array<{SIGNAL}>,issue:struct<shouldIssue:boolean,title:string,type:string,priority:string,actionability:double>,actions:array<{ACTION}>,knowledge:struct<shouldDistill:boolean,kind:string,scope:string>,redaction:struct<mustRedact:array<string>,shouldKeep:array<string>>>"
PREDICTION = "id string, signals array<struct<key:string,confidence:double>>, issueDraft struct<shouldIssue:boolean,title:string,type:string,priority:string,actionability:double>, actions array<struct<key:string,label:string,priority:string,confidence:double>>, knowledge struct<shouldDistill:boolean,kind:string,scope:string>, redaction struct<redacted:array<string>,allowed:array<string>>"
#: Rates of the noisy baseline.
NOISE = {"drop_signal": 0.12, "drop_action": 0.18, "flip_issue": 0.08, "noise_signal": 0.1, "drop_redaction": 0.15}


def load(spark: SparkSession, path: str, kind: str = SAMPLE) -> DataFrame:
    """Samples or predictions (``PREDICTION``) from files that hold a JSON array, with ``ord`` by place."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_fields(kind)}>>")).alias("ord", "s"))
    return rows.select("ord", "s.*")


def _fields(kind: str) -> str:
    """``a t, b u`` as ``a:t,b:u``, commas inside brackets left alone."""
    depth, out = 0, [""]
    for c in kind:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return ",".join(":".join(x.strip().split(" ", 1)) for x in out)


def seed_hash(seed: Column) -> Column:
    """The 31-hash of a string in 32 signed bits, 42 for 0 (characters beyond the basic plane count as one)."""
    low = F.lit(0xFFFFFFFF).cast("long")
    h = F.aggregate(F.filter(F.split(seed, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(low))
    return F.when(h == 0, 42).otherwise(F.when(h >= 2**31, h - 2**32).otherwise(h)).cast("int")


def randoms(seed: Column, n: Column | int) -> Column:
    """The first ``n`` numbers from 0 to 1 of the xorshift generator (13, 7, 17) that a string seeds."""
    shifted = lambda f, x, k: F.call_function(f, x, F.lit(k))

    def step(x: Column) -> Column:
        x = x.bitwiseXOR(shifted("shiftleft", x, 13))
        x = x.bitwiseXOR(shifted("shiftright", x, 7))
        return x.bitwiseXOR(shifted("shiftleft", x, 17))

    start = F.struct(seed_hash(seed).alias("x"), F.array().cast("array<int>").alias("out"))
    times = F.lit(n) if isinstance(n, int) else n

    def go(s: Column, _: Column) -> Column:
        x = step(s["x"])
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x)).alias("out"))

    states = F.aggregate(F.sequence(F.lit(1), times), start, go, lambda s: s["out"])
    return F.transform(states, lambda x: F.when(x < 0, x.cast("long") + 2**32).otherwise(x.cast("long")) / float(0xFFFFFFFF))


def baseline(samples: DataFrame, variant: str, noise: dict[str, float] | None = None) -> DataFrame:
    """Predictions made of the samples' labels with seeded noise: signals and actions dropped, issues flipped, tokens missed.

    The numbers of a sample are drawn in a fixed order: keep signals, keep actions, noise signal, flip, two for the actionability,
    then one for each token.
    """
    rate = NOISE | (noise or {})
    e = F.col("expected")
    merged = F.array_union(F.coalesce(e["redaction"]["mustRedact"], F.array().cast("array<string>")), sensitive_tokens(F.col("rawInput")))
    out = samples.withColumn("tokens", merged).withColumn("r", randoms(F.concat(F.lit(f"{variant}:"), F.col("id")), 6 + F.size("tokens")))
    r = [F.get("r", F.lit(k)) for k in range(6)]
    kept = F.when(r[0] > rate["drop_signal"], e["signals"]).otherwise(F.slice(e["signals"], 1, 1))
    said = F.transform(kept, lambda s: F.struct(s["key"].alias("key"), F.coalesce(s["weight"], F.lit(0.75)).alias("confidence")))
    noisy = F.array(F.struct(F.concat(F.lit("noise-"), F.col("intent")).alias("key"), F.lit(0.75).alias("confidence")))
    issue = e["issue"]
    should = F.when(r[3] < rate["flip_issue"], ~issue["shouldIssue"]).otherwise(issue["shouldIssue"])
    title = F.substring(issue["title"], F.lit(1), F.greatest(F.lit(12), F.floor(F.char_length(issue["title"]) * 0.65).cast("int")))
    acts = F.greatest(F.lit(0.0), F.least(F.lit(1.0), issue["actionability"] - r[4] * 0.25 + r[5] * 0.1))
    actions = F.when(r[1] > rate["drop_action"], e["actions"]).otherwise(F.slice(e["actions"], 1, 1))
    return out.select(
        "id",
        F.when(r[2] < rate["noise_signal"], F.concat(said, noisy)).otherwise(said).alias("signals"),
        F.struct(should.alias("shouldIssue"), F.when(should, title).alias("title"), issue["type"].alias("type"), issue["priority"].alias("priority"), F.when(should, acts).otherwise(0.0).alias("actionability")).alias("issueDraft"),
        F.transform(actions, lambda a: F.struct(a["key"].alias("key"), a["label"].alias("label"), a["priority"].alias("priority"), F.lit(0.7).alias("confidence"))).alias("actions"),
        e["knowledge"].alias("knowledge"),
        F.struct(F.filter("tokens", lambda _, i: F.get("r", i + 6) > rate["drop_redaction"]).alias("redacted"), e["redaction"]["shouldKeep"].alias("allowed")).alias("redaction"),
    )


def evaluated(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """id and structs of the signal, issue, action, knowledge and redaction scores; of predictions for one id the last (by ``ord``, if there) counts."""
    last = last_predictions(predictions) if "ord" in predictions.columns else predictions
    p = last.select("id", F.struct(*[c for c in ("signals", "issueDraft", "actions", "knowledge", "redaction")]).alias("p"))
    both = samples.drop("ord").join(p, "id", "left")
    e, p = F.col("expected"), F.col("p")
    pack = lambda scores: F.struct(*[c.alias(n) for n, c in scores.items()])
    named = lambda x: F.struct(x["shouldIssue"].alias("should_issue"), x["title"].alias("title"), x["type"].alias("type"), x["actionability"].alias("actionability"))
    kept = lambda x: F.struct(x["shouldDistill"].alias("should_distill"), x["kind"].alias("kind"))
    ranked = F.transform(F.coalesce(p["signals"], F.array().cast("array<struct<key:string,confidence:double>>")), lambda x, i: F.struct(i.alias("ord"), x["key"].alias("key"), x["confidence"].alias("confidence")))
    signal = set_scores(F.transform(e["signals"], lambda x: x["key"]), F.transform(p["signals"], lambda x: x["key"])) | {f"top{k}_hit_rate": top_k_hit(e["primarySignal"], ranked, k) for k in (1, 3)}
    action = set_scores(F.transform(e["actions"], lambda x: x["key"]), F.transform(p["actions"], lambda x: F.coalesce(x["key"], x["label"])))
    redaction = redaction_scores(e["redaction"]["mustRedact"], p["redaction"]["redacted"], F.coalesce(p["redaction"]["allowed"], e["redaction"]["shouldKeep"]))
    return both.select("id", pack(signal).alias("signal"), pack(issue_scores(named(e["issue"]), named(p["issueDraft"]))).alias("issue"), pack(action).alias("action"), pack(knowledge_scores(kept(e["knowledge"]), kept(p["knowledge"]))).alias("knowledge"), pack(redaction).alias("redaction"))


def report(scores: DataFrame, variant: str, dataset: str) -> DataFrame:
    """One row: the average of each score over all samples (null without samples)."""
    groups = ("signal", "issue", "action", "knowledge", "redaction")
    averaged = [F.struct(*[F.avg(F.col(f"{g}.{n}")).alias(n) for n in scores.schema[g].dataType.names]).alias(g) for g in groups]
    return scores.agg(F.count("*").alias("sample_count"), *averaged).select(F.lit(variant).alias("variant"), F.lit(dataset).alias("dataset_name"), "sample_count", F.struct(*groups).alias("metrics"))


def write_report(found: DataFrame, path: str) -> None:
    """The one-row report as JSON."""
    found.coalesce(1).write.mode("overwrite").json(path)

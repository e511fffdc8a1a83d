"""Command line: ``python -m parlance capture | distill | evaluate``. Each verb is a Spark job over folders."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from parlance import config
from parlance.operators import archive, distill, evaluation
from parlance.session import local_session
from parlance.sources import transcripts


def capture(args: argparse.Namespace) -> None:
    """Transcripts into the archive."""
    spark = local_session()
    found = transcripts.payloads(transcripts.rows(spark, args.transcripts))
    rows = found.select("session.session_id", F.coalesce("context.repo", F.lit(archive.GLOBAL)).alias("repo"), F.lit(transcripts.SOURCE).alias("provider"), F.col("time_range.end").alias("captured_at"), "messages")
    archive.write(archive.sanitize_messages(rows), args.archive)


def run_distill(args: argparse.Namespace) -> None:
    """Replies (JSON lines of session_id and reply) over the archive's sessions, as results."""
    spark = local_session()
    sessions = archive.scan(archive.read(spark, args.archive), repo=args.repo, since=args.since, until=args.until)
    messages = sessions.select("session_id", F.posexplode("messages").alias("turn", "m")).select("session_id", "turn", F.col("m.id").alias("message_id"), F.col("m.content").alias("text"))
    replies = spark.read.schema("session_id string, reply string, error string").json(args.replies).join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    for name in args.distillers or config.load()["distillers"]:
        results, _, report = distill.distilled(replies, messages, name)
        results.write.mode("append").json(f"{args.out}/{name}")
        print(report.first().asDict())


def evaluate(args: argparse.Namespace) -> None:
    """Scores of predictions, or of the noisy baseline, as a report."""
    spark = local_session()
    samples = evaluation.load(spark, args.samples)
    said = evaluation.load(spark, args.predictions, evaluation.PREDICTION) if args.predictions else evaluation.baseline(samples, args.variant)
    found = evaluation.report(evaluation.evaluated(samples, said), args.variant, args.samples.rsplit("/", 1)[-1])
    evaluation.write_report(found, args.out)
    print(found.first().asDict(recursive=True))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="parlance")
    verbs = parser.add_subparsers(required=True)
    for name, run, needs, may in (("capture", capture, ("transcripts", "archive"), ()), ("distill", run_distill, ("archive", "replies", "out"), ("repo", "since", "until")), ("evaluate", evaluate, ("samples", "out"), ("predictions",))):
        verb = verbs.add_parser(name)
        verb.set_defaults(run=run)
        for n in needs:
            verb.add_argument(f"--{n}", required=True)
        for n in may:
            verb.add_argument(f"--{n}")
        if name == "distill":
            verb.add_argument("--distillers", nargs="*")
        if name == "evaluate":
            verb.add_argument("--variant", default="baseline")
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()

"""Command line: build or check a mirror, classify a sample, flag and unflag."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("source")
    build.add_argument("mirror")
    build.add_argument("--runs", help="folder for the snapshots and the summary of each run")
    check = sub.add_parser("check")
    check.add_argument("source")
    sample = sub.add_parser("classify")
    sample.add_argument("source")
    sample.add_argument("mirror")
    sample.add_argument("--seed", type=int, default=0)
    sample.add_argument("--contrast-n", type=int, default=10)
    sample.add_argument("--cache")
    sample.add_argument("--out")
    for name in ("flag", "unflag"):
        one = sub.add_parser(name)
        one.add_argument("ledger")
        one.add_argument("content_hash")
        one.add_argument("reason", nargs="?" if name == "unflag" else None, default="unflagged")
    a = p.parse_args(argv)

    from tidemark.operators import classify, mirror, state

    if a.command in ("flag", "unflag"):
        print(json.dumps(getattr(state, a.command)(a.ledger, a.content_hash, a.reason)))
        return 0
    from tidemark.session import local_session
    from tidemark.sources.corpus import read_corpus

    spark = local_session()
    if a.command == "build":
        _, summary, failed = mirror.build_mirror(spark, a.source, a.mirror, runs=a.runs)
        print(summary.toJSON().first())
        return int(failed)
    if a.command == "check":
        results = mirror.check_files(read_corpus(spark, a.source, most_text=mirror.MOST_TEXT_BYTES)).persist()
        for r in results.where("error is not null").orderBy("relpath").toLocalIterator():
            print(f"skipped\t{r.relpath}\t{r.error}")
        by_file = mirror.counts_by_file(results)
        for r in by_file.orderBy("relpath", "entity_type").toLocalIterator():
            print(f"{r.n}\t{r.entity_type}\t{r.relpath}")
        print(f"files_with_findings\t{by_file.select('relpath').distinct().count()}")
        for r in mirror.corpus_totals(results).toLocalIterator():
            print(f"{r.n}\t{r.entity_type}")
        return 0
    metrics, picked, run = classify.classify_sample(spark, a.source, a.mirror, a.cache, a.contrast_n, a.seed)
    text = metrics.toJSON().first()
    if a.out:
        classify.write_metrics(a.out, metrics, picked, run)
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())

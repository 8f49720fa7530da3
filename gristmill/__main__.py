"""python -m gristmill COMMAND ...

score -jd job.txt -resume resume.md [-o score.json] [-q]
extract [-o result.json] [-debug trace.json] [-q] job.txt
check -requirements result.json -resume resume.md [-o coverage.json] [-debug trace.json] [-q]
query NAME TABLES OUT      runs a registered query over a folder of tables and writes Parquet
serve                      answers a client's tool calls, JSON-RPC by lines on standard input and output

Answers come from a recording, from a classifier's address, or by words (see gristmill.settings.config); without -q a summary goes to
standard error. Exit 0: done; 1: the run failed; 2: wrong arguments or inputs.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import ask, check, extract
from gristmill.plans import catalog
from gristmill.runtime import Metrics, deadline, logger, stage
from gristmill.server import Server
from gristmill.settings import config, tuning
from gristmill.sinks.files import emit_json, write_json
from gristmill.sources import loaders

OK, FAILED, USAGE = 0, 1, 2


class InputError(ValueError):
    """Wrong arguments or inputs."""


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise InputError(message)


def _parser() -> _Parser:
    p = _Parser(prog="gristmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, needs in (("score", ("-jd", "-resume")), ("extract", ()), ("check", ("-requirements", "-resume"))):
        s = sub.add_parser(name)
        for n in needs:
            s.add_argument(n, required=True)
        if name == "extract":
            s.add_argument("posting")
        s.add_argument("-o", default="")
        s.add_argument("-q", action="store_true")
        if name != "score":
            s.add_argument("-debug", default="")
    sub.add_parser("serve")
    q = sub.add_parser("query")
    for n in ("name", "tables", "out"):
        q.add_argument(n)
    return p


def _one(read: Callable[[], DataFrame], path: str, kinds: tuple[str, ...]) -> DataFrame:
    """The one row of a file that was read; its error is the user's."""
    if Path(path).suffix.lower() not in kinds:
        raise InputError(f"{path}: expected {', '.join(kinds)}")
    if not Path(path).is_file():
        raise InputError(f"{path}: no such file")
    rows = read()
    found = rows.collect()
    if not found or found[0].error:
        raise InputError(f"{path}: {found[0].error if found else 'unreadable'}")
    return rows


def _run(spark: SparkSession, a: argparse.Namespace, settings: config.Settings, words: tuning.Tuning, metrics: Metrics) -> None:
    log = logger(settings)
    provider = ask.provider(spark, settings)
    uri = lambda p: Path(p).absolute().as_uri() if Path(p).exists() else p
    if a.command in ("score", "check"):
        people = _one(lambda: loaders.read_resumes(spark, uri(a.resume)), a.resume, (".md", ".txt", ".pdf"))
    if a.command in ("score", "extract"):
        path = a.jd if a.command == "score" else a.posting
        jobs = _one(lambda: loaders.read_postings(spark, uri(path)), path, (".txt", ".md"))
    if a.command == "check":
        results = _one(lambda: loaders.read_results(spark, uri(a.requirements)), a.requirements, (".json",))
        reqs, groups, context = loaders.result_tables(results)
        if wrong := [r.problem for r in loaders.result_violations(reqs, groups, context).collect()]:
            raise InputError(f"{a.requirements}: invalid result: " + "; ".join(sorted(wrong)))
    with deadline(spark, settings.deadline):
        if a.command == "score":
            with stage("holistic", metrics, log):
                docs = extract.prepared(jobs.select("posting_id", "text"))
                pair = docs.select("posting_id", F.col("text").alias("posting"), F.lit(1).alias("n")).join(people.select("resume_id", F.col("text").alias("resume"), F.lit(1).alias("n")), "n").drop("n")
                out = json.loads(check.match_json(check.holistic(pair, provider, words), words, settings.model).first().match)
        elif a.command == "extract":
            with stage("extract", metrics, log):
                e = extract.extract(jobs.select("posting_id", "text"), provider, words, settings)
                if a.debug:
                    write_json(a.debug, {n: [json.loads(x) for x in df.toJSON().collect()] for n, df in (("sentences", e.labelled.orderBy("ord")), ("chunks", e.validated.orderBy("ord", "chunk_no")), ("refinement", e.refined.values.orderBy("i")), ("title_drops", e.title_drops))})
                found = extract.result_json(e, settings.model, settings.skip_importance).first()
                if found is None:
                    raise RuntimeError("job description has no sentences")
                out = json.loads(found.result)
                metrics.add("requirements.total", len(out["requirements"]))
        else:
            with stage("check", metrics, log):
                pairs = results.select("posting_id", F.lit(1).alias("n")).join(people.select("resume_id", F.lit(1).alias("n")), "n").drop("n")
                if check.evidence_units(people.select("resume_id", "text")).isEmpty():
                    raise RuntimeError("resume has no evidence units")
                if not reqs.head(1):
                    raise RuntimeError("no requirements to check")
                c = check.check(pairs, reqs, groups, context, people.select("resume_id", "text"), provider, words, settings)
                if a.debug:
                    write_json(a.debug, [json.loads(x) for x in c.judged.orderBy("unit.ord", "k").toJSON().collect()])
                out = json.loads(check.coverage_json(c, settings.model).first().coverage)
    emit_json(out, a.o)


def main(args: list[str]) -> int:
    try:
        a = _parser().parse_args(args)
        if a.command == "query" and a.name not in catalog.queries():
            raise InputError("no such query; known are:\n" + "\n".join(sorted(catalog.queries())))
    except InputError as e:
        print(f"gristmill: {e}\n\n{__doc__}", file=sys.stderr)
        return USAGE
    metrics = Metrics()
    try:
        settings = config.load()
        words = tuning.load(settings.tuning_file or None)
    except (ValueError, OSError) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return USAGE
    spark = SparkSession.builder.appName(f"gristmill {a.command}").getOrCreate()
    try:
        if a.command == "query":
            catalog.queries()[a.name](spark, a.tables).write.mode("errorifexists").parquet(a.out)
        elif a.command == "serve":
            Server(spark, settings, words).serve(sys.stdin, sys.stdout)
        else:
            _run(spark, a, settings, words, metrics)
    except InputError as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return USAGE
    except Exception as e:  # the whole run is one unit: report and exit
        print(f"{a.command}: {e}", file=sys.stderr)
        return FAILED
    finally:
        if a.command not in ("query", "serve") and not a.q:
            print("--- run summary ---", file=sys.stderr)
            metrics.write(sys.stderr)
    return OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Command line: python -m loomline.cli COMMAND ... (answer, evaluate, filter, clean, worklist, second, export)."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.rules import RELATIONS, SiteRules
from loomline.operators import annotate, corpus, evaluate, knowledge, reader, retrieve
from loomline.session import local_session
from loomline.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        for path in paths:
            own.add_argument(path)
        return own

    own = command("answer", "corpus", "questions", "predictions")
    own.add_argument("--supplement", action="append", default=[])
    own.add_argument("--known", action="append", default=[])
    own.add_argument("--use-known-answers", action="store_true", help="also look questions up word for word")
    own.add_argument("--top-k", type=int, default=8)
    own.add_argument("--chunk-size", type=int, default=140)
    own.add_argument("--chunk-overlap", type=int, default=30)
    own.add_argument("--site", help="a JSON file of site rules: deny_urls, navigation_markers, inline_noise, relations, hosts")
    own.add_argument("--reader", help="module:function that takes a system prompt and a prompt; without one, answers are extracted")
    own = command("evaluate", "references", "predictions")
    own.add_argument("--questions", help="the questions that the predictions answer, in their order")
    own.add_argument("--details-out")
    own.add_argument("--allow-prefix", action="store_true")
    own.add_argument("--first", type=int, help="score only so many references, the first")
    own = command("filter", "crawl", "out")
    own.add_argument("--deny", action="append", default=[])
    own = command("clean", "crawl", "documents", "chunks")
    own.add_argument("--site")
    own = command("worklist", "documents", "out")
    own.add_argument("--exclude")
    own.add_argument("--limit", type=int, default=45)
    command("second", "metadata", "questions", "out", "blind")
    command("export", "rows", "out")
    return top


def _show(frame: DataFrame) -> None:
    print(frame.select(F.to_json(F.struct("*"))).first()[0])


def site_rules(path: str | None) -> SiteRules:
    """Site rules of a JSON file; what it doesn't name is empty."""
    if not path:
        return SiteRules()
    fixed = lambda x: tuple(map(fixed, x)) if isinstance(x, list) else x
    return SiteRules(**{k: fixed(v) for k, v in json.loads(Path(path).read_text()).items()})


def named_function(name: str | None):
    """The function of module:function."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def answer(spark: SparkSession, args: argparse.Namespace) -> None:
    chunks = files.read_corpora(spark, [args.corpus], args.supplement, size=args.chunk_size, overlap=args.chunk_overlap)
    chunks = corpus.chunk_dedup(chunks.withColumn("ord", F.monotonically_increasing_id()).persist())
    questions = files.read_questions(spark, args.questions).select(F.col("pos").alias("q"), F.col("question").alias("text"))
    site, known = site_rules(args.site), files.read_knowledge(spark, args.known) if args.known else None
    hints = knowledge.hint_urls(questions, known.where("url <> ''")).select("q", "url") if known is not None else None
    hosts = {"legacy_label": site.legacy_host_label, "legacy_host": site.legacy_host, "people_host": site.people_host, "help_host": site.help_host}
    found = retrieve.retrieve(chunks, questions, args.top_k, hints, **hosts)
    # what was retrieved is written beside the predictions, so that reading starts from a short plan
    found.write.mode("overwrite").parquet(f"{args.predictions}-retrieved")
    found = spark.read.parquet(f"{args.predictions}-retrieved")
    told = reader.answers(questions, found, known, args.use_known_answers, named_function(args.reader), RELATIONS + site.relations)
    files.write_lines(told, args.predictions, "answer", "q")


def evaluate_(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.references.endswith(".json"):
        scored = evaluate.squad(files.read_squad(spark, args.references), files.read_squad_predictions(spark, args.predictions))
    elif args.questions:
        scored = evaluate.details(evaluate.by_question(files.read_qa(spark, args.references).drop("pos"), files.read_questions(spark, args.questions, skip_blank=True), files.read_predictions(spark, args.predictions)))
    else:
        # lists of questions are small; blank lines between them don't count
        references = files.read_qa(spark, args.references).withColumn("pos", F.row_number().over(Window.orderBy("pos")) - 1)
        scored = evaluate.details(evaluate.by_position(references, files.read_predictions(spark, args.predictions), args.allow_prefix))
    if args.first is not None:
        scored = scored.orderBy("pos").limit(args.first) if "pos" in scored.columns else scored.limit(args.first)
    if args.details_out:
        files.write_jsonl(scored, args.details_out)
    _show(evaluate.summary(scored))


def filter_(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = files.read_crawl(spark, args.crawl).withColumn("ord", F.monotonically_increasing_id()).persist()
    kept = corpus.exact_dedup(corpus.crawl_filter(rows, deny=tuple(args.deny)))
    files.write_jsonl(kept.drop("ord"), args.out)
    _show(corpus.kept_and_removed(rows, kept))


def clean(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = files.read_raw(spark, args.crawl)
    documents = corpus.clean_documents(raw, site_rules(args.site)).persist()
    chunks = corpus.sentence_chunks(documents)
    files.write_jsonl(documents, args.documents)
    files.write_jsonl(chunks, args.chunks)
    _show(corpus.cleaning_stats(raw, documents))


def worklist(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = files.read_crawl(spark, args.documents).withColumn("ord", F.monotonically_increasing_id())
    rows = annotate.exclude_urls(rows, files.read_urls(spark, args.exclude))
    files.write_csv(annotate.worklist(annotate.select_pages(rows, args.limit)), args.out)


def second(spark: SparkSession, args: argparse.Namespace) -> None:
    metadata = spark.read.schema("id string, question string, url string, needs_second_annotation boolean").json(args.metadata)
    subset = annotate.second_annotation(metadata, files.read_qa(spark, args.questions).withColumnRenamed("pos", "ord"))
    files.write_jsonl(subset, args.out)
    files.write_csv(annotate.blind(subset), args.blind)


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    files.export_questions(files.read_qa(spark, args.rows, strict=False), args.out)


RUN = {"answer": answer, "evaluate": evaluate_, "filter": filter_, "clean": clean, "worklist": worklist, "second": second, "export": export}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    RUN[args.command](SparkSession.getActiveSession() or local_session(), args)


if __name__ == "__main__":
    main()

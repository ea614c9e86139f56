"""Command line: ``python -m sparrel.cli COMMAND``. Texts and videos are tables with vectors (plans.engine), or made from a split (plans.ingest)."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from sparrel.operators import summaries
from sparrel.operators.checkers import HttpChecker
from sparrel.plans.engine import Engine
from sparrel.plans.ingest import Settings, ingest, load_encoder
from sparrel.sources import captions, sinks

log = logging.getLogger("sparrel")


#: Options by group: (flag, settings). Knobs that change nothing are taken and ignored, so that old command lines still run.
INPUTS = (
    ("--texts", {"help": "Parquet table of texts with vectors"}),
    ("--videos", {"help": "Parquet table of videos with vectors"}),
    ("--split-csv", {"help": "caption split to make both tables from"}),
    ("--video-root", {}),
    ("--audio-root", {}),
    ("--encoder", {"help": "module:factory of the encoder"}),
    ("--cache-dir", {"help": "keeps vectors and descriptions between runs"}),
    ("--data-json", {"help": "must exist; part of the cache key"}),
    ("--max-words", {"type": int, "default": 32}),
    ("--max-frames", {"type": int, "default": 12}),
    ("--batch-size-val", {"type": int, "default": 100}),
    ("--temperature", {"type": float, "default": 1.0}),
)
IGNORED = (("--model-dir", str), ("--checkpoint", str), ("--clip-weight", str), ("--device", str), ("--sim-header", str), ("--cross-num-hidden-layers", int), ("--audio-query-layers", int))
CHECKER = (
    ("--checker-base-url", {"required": True}),
    ("--checker-api-key", {"required": True}),
    ("--checker-model", {"required": True}),
    ("--checker-timeout-seconds", {"type": float, "default": 180.0}),
    ("--omni-concurrency", {"type": int, "default": 4}),
    ("--rerank-window", {"type": int, "default": 5}),
)
IGNORED_BY_AGENTS = (("--max-iter", int), ("--submit-threshold", float))
HITS = (("--topk-value", {"type": int, "default": 10}),)
RECALL = (("--topk", {"default": "1,5,10"}),)
SAMPLE = (
    ("--mode", {"required": True, "choices": ("t2v", "v2t")}),
    ("--start-index", {"type": int, "default": 0}),
    ("--sample-size", {"type": int, "required": True}),
    ("--output-dir", {"required": True}),
    ("--resume", {"action": "store_true"}),
)
TEXT, VIDEO = (("--query-text", {"required": True}),), (("--query-video-id", {"required": True}),)
COMMANDS = {
    "baseline": (INPUTS, HITS, RECALL),
    "t2v-case": (INPUTS, HITS, TEXT),
    "v2t-case": (INPUTS, HITS, VIDEO),
    "t2v-agent-case": (INPUTS, HITS, CHECKER, TEXT),
    "v2t-agent-case": (INPUTS, HITS, CHECKER, VIDEO),
    "agent-partial-eval": (INPUTS, HITS, RECALL, CHECKER, SAMPLE),
    "agent-merge": ((("--output-dir", {"required": True}), ("inputs", {"nargs": "+"})),),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparrel", description="Cross-modal retrieval and its evaluation")
    commands = top.add_subparsers(dest="command", required=True)
    for name, groups in COMMANDS.items():
        own = commands.add_parser(name)
        for flag, options in (pair for group in groups for pair in group):
            own.add_argument(flag, **options)
        for flag, kind in (*(IGNORED if INPUTS in groups else ()), *(IGNORED_BY_AGENTS if CHECKER in groups else ())):
            own.add_argument(flag, type=kind, help=argparse.SUPPRESS)
    return top


def engine_of(spark: SparkSession, args: argparse.Namespace) -> Engine:
    """From tables with vectors, or from a split and media folders; ValueError where neither is given whole."""
    memory = args.cache_dir
    if args.split_csv:
        if not args.video_root:
            raise ValueError("--split-csv needs --video-root")
        settings = Settings(args.split_csv, args.video_root, args.audio_root, args.encoder, args.cache_dir, args.max_words, args.max_frames, args.batch_size_val, args.temperature, args.data_json)
        texts, videos = ingest(spark, settings)
    else:
        if not (args.texts and args.videos):
            raise ValueError("give --texts and --videos, or --split-csv and --video-root")
        captions.require(args.texts, args.videos)
        texts, videos = spark.read.parquet(args.texts), spark.read.parquet(args.videos)
    return Engine(texts, videos, load_encoder(args.encoder) if args.encoder else None, args.topk_value, memory)


def merge(spark: SparkSession, inputs: list[str], output_dir: str) -> dict:
    merged = summaries.merge_summaries(captions.read_summaries(spark, inputs)) | {"input_dirs": inputs}
    sinks.write_summary(merged, output_dir)
    sinks.begun(output_dir)
    for folder in inputs:  # a shard's lines are one file, passed on as they are read
        sinks.add_lines(captions.trace_lines(folder), output_dir)
    return sinks.rounded(merged)


def run(spark: SparkSession, args: argparse.Namespace):
    if args.command == "agent-merge":
        return merge(spark, args.inputs, args.output_dir)
    engine = engine_of(spark, args)
    if args.command == "baseline":
        return sinks.rounded(engine.evaluate(summaries.parse_ks(args.topk)))
    mode = "t2v" if args.command.startswith("t2v") else "v2t"
    if args.command in ("t2v-case", "v2t-case"):
        if mode == "t2v":
            asked = {"query_text": args.query_text}
            found = engine.retrieve_videos(spark.createDataFrame([(0, args.query_text, "on")], "query_id long, key string, audio_mode string"))
        else:
            asked = {"query_video_id": args.query_video_id}
            found = engine.retrieve_texts(engine.video_query(args.query_video_id).select("query_id", "key", "audio_mode"))
        return {"mode": mode, **asked, "results": [sinks.hit_dict(r) for r in found.orderBy("rank").collect()]}
    model = HttpChecker(args.checker_base_url, args.checker_api_key, args.checker_model, args.checker_timeout_seconds, concurrency=args.omni_concurrency)
    if args.command == "agent-partial-eval":
        ks = summaries.parse_ks(args.topk)
        told = engine.partial_eval(args.mode, model, args.sample_size, args.start_index, ks, args.rerank_window, args.output_dir, resume=args.resume, progress=lambda line: print(line, file=sys.stderr, flush=True))
        return sinks.rounded(told)
    runs, initial, final = engine.case(mode, args.query_text if mode == "t2v" else args.query_video_id, model, args.rerank_window)
    told = sinks.trace(runs.first())
    hits = {name: [sinks.hit_dict(r) for r in table.orderBy("rank").collect()] for name, table in (("initial_hits", initial), ("reranked_hits", final))}
    return {"mode": f"{mode}-agent"} | told | hits


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    for flag, _ in (*IGNORED, *IGNORED_BY_AGENTS):
        if getattr(args, flag.strip("-").replace("-", "_"), None) is not None:
            log.warning("%s changes nothing here", flag)
    spark = SparkSession.builder.appName("sparrel").getOrCreate()
    log.info("running %s", args.command)
    print(sinks.pretty(run(spark, args)))


if __name__ == "__main__":
    main()

"""``python -m sylvan.cli run FILE [OUT]`` and ``export STORE OUT``."""

from __future__ import annotations

import argparse
import sys

from sylvan.config import PipelineConfig
from sylvan.functions import providers
from sylvan.plans import pipeline
from sylvan.session import local_session
from sylvan.sources import text as sources
from sylvan.sources.node_store import NodeStore


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sylvan")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="build summary trees of a text file or a folder of them")
    run.add_argument("input")
    run.add_argument("output", nargs="?", help="the folder for results, unless --output-dir gives it")
    run.add_argument("--output-dir", "-o", default="results")
    run.add_argument("--model", "-m", help="summarization model; 'mock-model' is the deterministic one")
    run.add_argument("--verifier-model", "-v", help="verification model")
    run.add_argument("--verify", action=argparse.BooleanOptionalAction, default=True, help="check the summaries")
    run.add_argument("--max-tokens", type=int, default=500)
    run.add_argument("--tokenizer", help="tokenizer by whose tokens chunks are measured")
    run.add_argument("--semantic", action="store_true")
    out = commands.add_parser("export", help="write outlines and canvases of a stored run again")
    out.add_argument("store")
    out.add_argument("output")
    out.add_argument("--format", choices=["markdown", "canvas", "all"], default="all")
    a = p.parse_args(argv)
    spark = local_session()
    if a.command == "export":
        formats = ("markdown", "canvas") if a.format == "all" else (a.format,)
        pipeline.export_files(spark, NodeStore(spark, a.store), a.output, formats)
        return 0
    try:
        documents = sources.files(spark, a.input).select("doc_id", "content")
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    config = PipelineConfig(
        max_tokens=a.max_tokens, semantic_chunking_mode=a.semantic, tokenizer_model=a.tokenizer or "", verifier_enabled=a.verify,
        summarization_model=a.model or "mock-model", verification_model=a.verifier_model or a.model or "mock-model",
    )
    summarize = providers.chat_model(config.summarization_model, config.llm_temperature, config.max_summary_tokens, config.max_retries)
    check = providers.chat_model(config.verification_model, config.llm_temperature, None, config.max_retries)
    if (summarize or check and a.verify) and providers.api_key() is None:
        print(f"LLM not initialized: {providers.KEY_VARIABLE} is not set", file=sys.stderr)
        return 1
    done = pipeline.build(documents, config, model=summarize)
    pipeline.save(spark, done, a.output or a.output_dir, check, config)
    return 0


if __name__ == "__main__":
    sys.exit(main())

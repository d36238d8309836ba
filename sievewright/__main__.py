"""Command line: python -m sievewright {filter,build,tokenizer,chunks} ..."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions.constants import Thresholds
from sievewright.operators import gates, select, tokens
from sievewright.plans import build
from sievewright.sources import chunks, readers, state


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievewright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, chunk in (("filter", K.CHUNK_TOKENS), ("build", 20 * K.CHUNK_TOKENS)):
        c = sub.add_parser(name, help={"filter": "one source to chunks", "build": "all sources of the catalog to chunks"}[name])
        c.add_argument("input", help="folder of Parquet files" if name == "filter" else "folder with a subfolder for each source")
        c.add_argument("output")
        c.add_argument("--tokenizer", required=True)
        c.add_argument("--chunk-size", type=int, default=chunk)
        c.add_argument("--buffer-docs", type=int, default=K.BUFFER_DOCS)
        c.add_argument("--min-words", type=int, default=Thresholds.min_words)
        c.add_argument("--redact", action="store_true")
        c.add_argument("--fast-signatures", action="store_true", help="minimum hashes by XXH64; all runs into one output must agree")
        c.add_argument("--format", default="parquet", choices=["parquet", "orc", "json", "csv", "text"])
        if name == "filter":
            c.add_argument("--target-tokens", type=int, default=3_000_000_000)
            c.add_argument("--text-field", default="text")
        else:
            c.add_argument("--sources", nargs="+", default=[s for s, *_ in K.SOURCE_CATALOG])
    c = sub.add_parser("tokenizer", help="train a tokenizer on a capped corpus; inputs in order of rank")
    c.add_argument("output")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--vocab-size", type=int, default=64_000)
    c = sub.add_parser("chunks", help="list chunk files, validation ones marked")
    c.add_argument("input")
    c.add_argument("--val-chunks", type=int, default=2)
    return p


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    # Checkpoints go when nothing refers to them any more; a cluster names their folder in spark.checkpoint.dir.
    spark = SparkSession.builder.appName("sievewright").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    if args.command == "chunks":
        from sievewright.operators import pack

        for r in pack.split_validation(chunks.files(spark, args.input), args.val_chunks).orderBy("chunk_id").toLocalIterator():
            print(r.path, r.chunk_id, r.n_tokens, "validation" if r.validation else "training", sep="\t")
        return
    if args.command == "tokenizer":
        rows = None
        for rank, path in enumerate(args.inputs):
            own = gates.arrived(readers.load(spark, path, path, rank))
            rows = own if rows is None else rows.unionByName(own)
        corpus = select.capped_corpus(rows, K.CORPUS_CAPS[: len(args.inputs)], K.CORPUS_CHARS)
        model = tokens.train(corpus, "piece", args.vocab_size)
        with open(args.output, "wb") as f:
            f.write(model)
        return
    model = read_bytes(spark, args.tokenizer)
    settings = build.Settings(Thresholds(min_words=args.min_words), args.buffer_docs, args.chunk_size, None if args.command == "filter" else K.SHARD_CHUNKS, args.redact, fast=args.fast_signatures)
    if args.command == "filter":
        sources, targets = {"source": readers.load(spark, args.input, "source", 0, args.text_field, args.format)}, {"source": args.target_tokens}
    else:
        sources = readers.load_catalog(spark, args.input, args.sources, args.format)
        targets = {r.source: r.target for r in state.catalog(spark).filter(F.col("source").isin(list(sources))).collect()}
        settings = replace(settings, total=sum(target for _, target, _ in K.SOURCE_CATALOG))
    done = build.build(spark, sources, targets, model, args.output, settings)
    print(f"{done.total_tokens} tokens in {done.chunk_idx} chunks; complete: {', '.join(done.completed_sources) or 'none'}; failed: {', '.join(done.failed_sources) or 'none'}")


if __name__ == "__main__":
    main()

"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import bpe, clustering, divergence, licences, mixing, neardup, quality, shards, substring, tiff, tokenfiles, vectordup, warc

MODULES = (mixing, quality, neardup, tokenfiles, licences, bpe, tiff, shards, substring, warc, divergence, clustering, vectordup)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}

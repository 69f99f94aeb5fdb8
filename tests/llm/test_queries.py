"""Registered queries of the subpackage against their SQL, and the corpus pipeline."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rankspark.llm.oracles import ORACLES
from rankspark.llm.queries import QUERIES
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    ok, note = compare(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_languages_and_toxicity_of_held_out_documents(spark):
    """Held-out accuracy over all documents of a larger table."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, sf).join(docs, "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    made = QUERIES["op10_toxicity"](spark, sf)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in made.select("doc_id", "held_out").collect())
    held = made.join(labels, "doc_id").where("held_out")
    assert held.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.93


def test_pipeline_stages(spark):
    """Each stage works on all that the one before kept, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_dedup", "decontamination", "sentencepiece"]
    rejected = QUERIES["op5_language_id"](spark, SF_DIR).where("rejected").select("doc_id")
    before = docs
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF_DIR)
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        if at < 4:
            assert after.columns == columns
        if name == "language_id":
            assert not set(ids) & {r.doc_id for r in rejected.collect()}
            assert len(ids) > 0.95 * docs.count()
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == set(ids)

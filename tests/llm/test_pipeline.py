"""Stages of the pipeline: columns, effects and the whole run, held against the operators' plain versions."""

import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import quality_rules, queries
from tests.llm.test_overlap import plain_line_dedup, plain_links, plain_spans

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_run_by_brute_force(spark, documents):
    """Every stage but the perplexity band by plain code; the band's verdict is taken from its operator, which has its own test."""
    texts = {x.doc_id: x.text for x in documents.collect()}
    kept = {x.doc_id for x in quality_rules.quality(documents).where("kept").collect()}
    left = {k: t for k, t in texts.items() if k in kept}
    lines = plain_line_dedup(left)
    left = {k: t for k, (t, n, gone) in lines.items() if gone == 0 or gone < n}
    links = plain_links(left)
    left = {k: t for k, t in left.items() if links[k][0] == k}
    items = {x.item_id: x.text for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    hit = plain_spans(left, items, 10)
    left = {k: t for k, t in left.items() if not hit[k][3]}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {x.doc_id for x in rows} == set(left)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in left.items():
        own = b"".join(x.ids for x in sorted((x for x in rows if x.doc_id == k), key=lambda x: x.start))
        assert own == np.array(library.encode(t, add_special_tokens=False).ids + [1], dtype="<u4").tobytes()


def test_stages_bear_awkward_and_empty_tables(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, docs, FOLDER)
            if name != "packing":
                assert out.columns == docs.columns, name
            assert (out.count() > 0) == (docs is awkward), name


def test_queries_equal_sql(spark):
    import duckdb

    from tools.compare import rows_of

    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    for key, sql in queries.SQL.items():
        if key == "pipeline":
            continue
        got = queries.QUERIES[key](spark, FOLDER)
        result = con.execute(sql)
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in result.description], result.fetchall()), key


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")) == [*range(1, 14)]

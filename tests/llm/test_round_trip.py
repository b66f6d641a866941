"""Token ids and their decoding in one pass."""

import public_tokenizers

import corpus_pipeline
from chronoloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_one_worker_encodes_and_decodes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, "two words", "Grüße 中文 \x00", "a" * 5000])], "doc_id bigint, text string")
    both = bpe.round_trip(docs, "text", PATH, PATTERN)
    apart = bpe.decode(bpe.encode(docs, "text", PATH, PATTERN), "ids", PATH, PATTERN)
    assert sorted(both.collect(), key=lambda r: r.doc_id) == sorted(apart.collect(), key=lambda r: r.doc_id)
    stage = corpus_pipeline.token_ids(spark, docs, "")
    assert stage._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [r.text for r in stage.orderBy("doc_id").collect()] == ["", "", "two words", "Grüße 中文 \x00", "a" * 5000]

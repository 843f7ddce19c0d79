"""Each stage on its own input, and the whole."""

import sentencepiece as library
import public_tokenizers

import corpus_pipeline as P
from lading.llm.common import settle, table
from lading.llm.quality import quality_report


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, held = docs.columns, [docs]
    for name, stage in P.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        held.append(docs)
        assert docs.columns == columns or name == P.STAGES[-1][0]
    kept = {r.doc_id for r in quality_report(held[0]).where("kept").collect()}
    assert {r.doc_id for r in held[1].collect()} == kept
    alone = {r.doc_id for r in held[2].collect()}
    assert alone <= kept and held[2].count() == len(alone)
    texts = {r.doc_id: r.text for r in held[3].collect()}
    assert set(texts) == alone and not any("token =" in t for t in texts.values())
    lib = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = held[5].collect()
    assert len(out) == held[4].count()
    assert all(r.ids == lib.encode(texts[r.doc_id]) for r in out)


def test_exact_copies_leave_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(30)
    more = docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))
    assert {r.doc_id for r in P.near_dedup(spark, more, sf_dir).collect()} == {r.doc_id for r in P.near_dedup(spark, docs, sf_dir).collect()}


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    assert docs.count() == 0

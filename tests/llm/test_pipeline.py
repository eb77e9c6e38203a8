import re

import pytest

import corpus_pipeline
from sparkloom.llm import quality_rules

from .test_links import clusters, shingles
from .test_mixing_pii import base_spans

pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, small, documents):
    docs = documents
    good = {r.doc_id for r in quality_rules.judged(docs).filter("kept").collect()}
    docs = corpus_pipeline.keep_good(spark, docs, small).cache()
    assert {r.doc_id for r in docs.collect()} == good and docs.columns == documents.columns
    part = clusters({r.doc_id: shingles(r.text, 3) for r in docs.collect()}, 90, 100)
    docs = corpus_pipeline.keep_one_of_each(spark, docs, small).cache()
    assert {r.doc_id for r in docs.collect()} == set(part.values())
    before = {r.doc_id: r.text for r in docs.collect()}
    docs = corpus_pipeline.redact(spark, docs, small).cache()
    for r in docs.collect():
        assert not base_spans(re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", r.text)) or r.text == before[r.doc_id]
        assert (r.text == before[r.doc_id]) or base_spans(before[r.doc_id])
    mixed = corpus_pipeline.mix_sources(spark, docs, small).cache()
    assert mixed.columns == documents.columns
    ids = corpus_pipeline.tokenize(spark, mixed, small)
    assert ids.count() == mixed.count()
    run = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, ids.collect()))
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark, small, odd, none):
    """Nulls, repeats, extra columns and empty tables go through every stage."""
    for docs, least in ((odd, 0), (none, 0), (odd.filter("doc_id = 5 OR doc_id IS NULL"), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() >= least, name
        assert corpus_pipeline.tokenize(spark, docs, small).count() == docs.count()


def test_good_text_does_not_save_a_bad_one(spark, documents):
    """A doc_id may stand for several texts; each is judged by itself."""
    good = documents.join(quality_rules.judged(documents).filter("kept").select("doc_id"), "doc_id", "left_semi").limit(20)
    bad = good.select("doc_id").selectExpr("doc_id", "repeat('$$$ %% ', 80) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = quality_rules.kept(documents.unionByName(bad.select(*documents.columns)))
    assert kept.filter("text LIKE '$$$%'").count() == 0

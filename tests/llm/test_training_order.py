import collections

import duckdb
import pytest

from sparkloom.llm import mixing, queries, registry


@pytest.mark.parametrize("name", ["op8_source_mix", "op8_training_order"])
def test_against_duckdb(spark, small, name):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        want = db.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        want = sorted(want.fetchall())
    df = registry.queries()[name](spark, small)
    assert df.columns == columns
    got = sorted(map(tuple, df.collect()))
    assert len(got) == len(want) and all(abs(a - b) < 1e-6 for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_rows_of_each_pass(spark, documents, odd, none):
    for docs in (documents, odd):
        docs = docs.select("doc_id", "text", "source")
        placed = mixing.placed(docs).collect()
        order = mixing.training_order(docs)
        rows = order.collect()
        assert len(rows) == sum(max(1, r.mix_passes) for r in placed)
        assert len({r.mix_row for r in placed}) == len(placed)
        offsets = {r.mix_row: r for r in placed}
        for r in rows:
            p = offsets[r.mix_row]
            assert (r.mix_pass is None) == (r.mix_position is None) == (p.mix_passes == 0)
            if r.mix_pass is not None:
                s, t = 0.5 if p.mix_rank % 2 else -0.5, r.mix_position
                assert 0 <= t < 1 and abs(p.mix_target * ((1 - s) * t + s * t * t) - p.mix_offset - r.mix_pass * p.mix_size) < 1e-6 * p.mix_target
        got = collections.Counter((r.doc_id, r.mix_words, r.mix_taken) for r in mixing.digest(order).collect())
        assert got == collections.Counter((r.doc_id, r.mix_words, r.mix_words * r.mix_passes) for r in placed)
    assert mixing.training_order(none.select("doc_id", "text", "source")).count() == 0


def test_order_is_by_position(documents):
    parts = mixing.dealt(mixing.placed(documents.select("doc_id", "text", "source")).filter("mix_passes > 0")).select("mix_position").rdd.glom().collect()
    at = [r.mix_position for part in parts for r in part]
    assert len([p for p in parts if p]) > 1 and at == sorted(at)


def test_op8_reaches_the_range_sort(spark, small, monkeypatch):
    seen = []
    dealt = mixing.dealt
    monkeypatch.setattr(mixing, "dealt", lambda p: seen.append(dealt(p)) or seen[-1])
    queries.op8_source_mix(spark, small)
    assert len(seen) == 1 and "mix_position" in seen[0].columns and "rangepartitioning" in seen[0]._jdf.queryExecution().toString()

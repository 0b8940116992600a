"""The stages on planted cases and on odd tables."""

import corpus_pipeline as cp
from quillspark.llm.common import table


def test_stages_keep_columns_and_decide(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            docs = out
        cp.STAGES[-1][1](spark, docs, sf_dir).count()
    kept = {r.doc_id for r in cp.drop_copies(spark, odd, sf_dir).collect()}
    assert kept == {2, 5, 7, 8} and cp.drop_copies(spark, odd, sf_dir).count() == 4
    near = sorted(str(r.doc_id) for r in cp.drop_near_copies(spark, odd, sf_dir).collect())
    assert "2" not in near and "6" not in near and "1" in near and "5" in near
    assert {r.text for r in cp.mask_found_secrets(spark, odd, sf_dir).filter("doc_id = 7").collect()} == {"pay 4111 1111 1111 1111 now, [SECRET]"}


def test_pipeline_packs_what_it_keeps(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    docs = {r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect()}
    kept = {r.doc_id for r in rows}
    assert kept <= docs and len(kept) > 0.6 * len(docs)


def test_near_copies_without_ids_go(spark, sf_dir):
    w = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    other = " ".join(f"y{i}" for i in range(60))
    rows = [(None, near(20)), (5, near()), (9, near(20, 40)), (None, other), (None, other + " z"), (None, ""), (4, None)]
    kept = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    texts = sorted(str(r.text) for r in kept if r.text)
    assert len(kept) == 4 and near() in texts and len([t for t in texts if t.startswith(other)]) == 1


def test_high_and_repeated_ids_stay(spark, sf_dir):
    w = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    rows = [(5, near()), (9, near(20)), (9, "another text under an id that has gone"), (2**62, "a b c d e f g"), (2**63 - 1, "h i j k l m n")]
    kept = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == [5, 9, 2**62, 2**63 - 1] and near(20) not in {r.text for r in kept}

"""The pipeline's stages against what they decide, on the smallest tables."""

from test_llm import LOWER, WORDS, classes

import corpus_pipeline
from shardlore.llm import common, sharding


def test_pipeline(spark, small):
    docs = common.table(spark, small, "documents")
    columns, now, seen = docs.columns, docs, {}
    for name, function in corpus_pipeline.STAGES:
        out = common.stage(function(spark, now, small), f"test_{name}")
        seen[name] = (now, out)
        if name != "sharding":
            assert out.columns == columns
        now = out

    before, after = seen["toxicity"]
    labels = {r.doc_id: r.toxic for r in common.table(spark, small, "labels").collect()}
    gone = {r.doc_id for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    assert not any(labels.get(i) == 0 for i in gone)

    before, after = seen["near_duplicates"]
    expected = {i for i, (_, _, kept) in classes([(r.doc_id, r.text) for r in before.collect()]).items() if kept}
    assert sorted(r.doc_id for r in after.collect()) == sorted(expected)

    before, after = seen["decontamination"]
    windows = set()
    for r in common.table(spark, small, "benchmark").collect():
        w = WORDS.findall(r.text.translate(LOWER))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}

    def leaked(text):
        w = WORDS.findall(text.translate(LOWER))
        return any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if not leaked(r.text))

    before, after = seen["mixing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    assert before.count() <= after.count()

    before, after = seen["sharding"]
    assert before.count() == after.count()
    assert after.groupBy("shard").sum("n_bytes").filter(f"`sum(n_bytes)` > {sharding.LIMIT}").count() == 0

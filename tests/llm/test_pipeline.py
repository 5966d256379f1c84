"""The pipeline stage by stage on a small table, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from strandweave.llm import mixing, training_order
from strandweave.llm.common import load
from strandweave.llm.queries import MIX_TARGETS
from strandweave.session import write_stage

from test_decontaminate import expected
from test_ngram_join import all_links

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SF, "documents")
    results = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = write_stage(stage(spark, docs, SF), name)
        results[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert list(results) == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "training_order"]

    before, after = results["language_id"]
    assert after.count() >= 0.97 * len(before)

    before, after = results["ngram_jaccard_join"]
    classes = all_links([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c[1] for c in classes})

    before, after = results["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in load(spark, SF, "benchmark").collect()]
    judged = expected([(r["doc_id"], r["text"]) for r in before], items)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r[0] for r in judged if not r[5])
    assert 0 < sum(r[5] for r in judged)

    before, after = results["source_mixing"]
    rated, _, _ = mixing.rates(spark.createDataFrame(before, after.schema), mixing.label_domains(load(spark, SF, "labels")), MIX_TARGETS, relative=True)
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({r["doc_id"]: r["copies"] for r in rated.collect() if r["copies"]})

    before, index = results["training_order"]
    encoder = training_order.encoder(corpus_pipeline.tokenizer_path("byte_bpe_50k.tiktoken"))
    tokens = sum(len(encoder.encode_ordinary(r["text"])) + 1 for r in before)
    rows = index.collect()
    assert sum(r["n_tokens"] for r in rows) == tokens and sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

from collections import Counter

import corpus_pipeline
from tapeworks.llm import decontamination, language_id, minhash, packing, secrets
from tapeworks.llm.common import stored


def test_stages_take_effect_and_keep_columns(spark, documents, sf_dir):
    docs, seen = documents, [documents.count()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "minhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == documents.columns
        seen.append(docs.count())
        if name == "minhash near-dedup":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in minhash.near_duplicates(before).collect() if r["kept"]}
        if name == "benchmark decontamination":
            flagged = {r["doc_id"] for r in decontamination.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert flagged and {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - flagged
        if name == "secret scans":
            assert secrets.report(docs).where("spans <> ''").count() == 0
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4]
    rejected = language_id.identify(documents).where(f"lang_pred = 'und' or score < {corpus_pipeline.LEAST_SCORE}").count()
    assert seen[0] - seen[1] == rejected
    whole = corpus_pipeline.run(spark, sf_dir)
    want = packing.token_pieces(docs, corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, whole.select(*key).collect())) == Counter(map(tuple, want.select(*key).collect()))


def test_stages_take_awkward_and_empty_rows(spark, awkward, nothing, sf_dir):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).collect()

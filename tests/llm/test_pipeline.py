"""The pipeline's stages in order, each against its own input."""

import corpus_pipeline
import public_tokenizers

from palimpsest.llm import packing, quality, secretscan
from palimpsest.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["quality rules"]
    kept = quality.quality_rules(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())
    before, after = seen["line dedup"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").isEmpty()
    before, after = seen["near dedup"]
    assert 0 < after.count() <= before.count() and after.select("doc_id").distinct().count() == after.count()
    before, after = seen["secret scans"]
    assert before.count() == after.count()
    assert not any(secretscan.base_spans(r["text"]) for r in after.collect() if r["text"] and "[" not in r["text"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    encoder = packing.WordTokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER)).encoder
    texts = [r["text"] or "" for r in docs.collect()]
    assert sum(r["length"] for r in packed.collect()) == sum(len(encoder.encode(t, add_special_tokens=False).ids) + 1 for t in texts)


def test_run_over_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "x"), (None, "word " * 30), (4, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"w{i}" for i in range(60)))]
    spark.createDataFrame([(a, b, "en", "s", None) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {4}


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    own = {"score": "mine", "kept": "mine", "n_lines": "mine", "n_secrets": "mine", "no": "mine", "row": "mine", "id": "mine", "component": "mine"}
    names = ", ".join(f"{c} string" for c in own)
    rows = [(1, text, 9, *own.values()), (2, "secret = abcdefghij\n" + " ".join(f"v{i}" for i in range(60)), 9, *own.values())]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, n_chars long, {names}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = staged(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        got = docs.collect()
        assert len(got) == 2 and {r[c] for r in got for c in own} == {"mine"}
        nothing = staged(stage(spark, docs.where("false"), SF), "test-stage")
        assert nothing.columns == columns and nothing.count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got) and "[assign]" in {r["doc_id"]: r["text"] for r in got}[2]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0

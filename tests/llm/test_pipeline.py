import public_tokenizers
from pyspark.sql import functions as F
from test_dedup import brute
from test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import minhash_dedup, quality_gam, quality_rules, registry, storage


def test_stages_against_their_operators(spark, sf_dir):
    docs, columns = registry.documents(spark, sf_dir), registry.documents(spark, sf_dir).columns
    labels = quality_rules.read_labels(spark, sf_dir)
    stages = dict(corpus_pipeline.STAGES)
    good = storage.materialize(stages["quality rules"](spark, docs, sf_dir), "good")
    want = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(want)
    better = storage.materialize(stages["quality classifier"](spark, good, sf_dir), "better")
    want = {r.doc_id for r in quality_gam.classify(good, labels).where("predicted = 1").collect()}
    assert better.columns == columns and sorted(r.doc_id for r in better.collect()) == sorted(want)
    texts = {r.doc_id: r.text for r in better.collect()}
    want = sorted(d for d, (_, component) in brute(texts, 80).items() if d == component)
    single = storage.materialize(stages["near duplicates"](spark, better, sf_dir), "single")
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == want
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(texts[d], add_special_tokens=False).ids, 0] for d in want}
    check_packing(stages["best-fit packing"](spark, single, sf_dir).collect(), ids, 2048)


def test_run_on_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, None, "a", 1), (1, text, "en", "a", 1), (2, text + " more", "en", "b", 2), (3, None, "en", None, None), (None, text, "en", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row string, n_words long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = quality_rules.read_labels(spark, str(tmp_path))
    assert quality_rules.keep(docs, labels).count() == 4 and quality_gam.keep(docs, labels).count() == 5
    assert sorted(r.doc_id for r in minhash_dedup.keep(docs).collect()) == [1, 3]
    assert [(r.doc_id, r.piece, r.offset) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(1, 0, 0)]


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.packing_stage(spark, docs.where(F.lit(True)), str(tmp_path)).count() == 0

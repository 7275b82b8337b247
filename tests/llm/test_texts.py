"""Seeded random texts against the library and against texts taken one by one."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import bpe_trie, pretokens, quality_gam, token_orc

SIGNS = "abcİıIi’“ \n\t!?.,ßŁÀßéè漢字🙂é̇Σς0123 ANKARADA  <|>"


def drawn(signs, most, n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    encoder = pretokens.vocabulary(public_tokenizers.path(name))
    texts = ["’ ANKARADAKİ! ev", *drawn(SIGNS, 60, 4000)]
    assert encoder.encode(texts) == encoder.library(texts)


def test_trie_equals_the_library_with_long_pieces_between():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, trie = Tokenizer.from_file(path), bpe_trie.TrieEncoder(path)
    texts = [*drawn(SIGNS, 60, 1500), "http://" + "long/" * 40 + " and short", "x" * 20_000]
    for text, (ids, decoded) in zip(texts, trie.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == np.asarray(want, "<u4").tobytes() and decoded.decode() == library.decode(want, skip_special_tokens=False)
    assert max(map(len, trie.known)) <= bpe_trie.CACHED_LENGTH


def test_trie_on_clashing_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2, "z")], "doc_id long, text string, ids string, n_tokens int, decoded string")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert [(r.doc_id, r.n_tokens) for r in bpe_trie.encode_decode(docs, path).collect()] == [(1, 2)]
    assert bpe_trie.digests(bpe_trie.encode_decode(docs.where(F.lit(False)), path)).count() == 0


def test_orc_prunes_by_id_and_keeps_long_texts(spark, tmp_path):
    """A point read of the written files touches fewer rows than they hold."""
    path, where = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.repeat(F.lit("long text "), 50_000)).otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit(1).alias("part"), F.lit("x").alias("start"))
    token_orc.write_tokens(docs, where, path, end_id=1)
    assert token_orc.read_tokens(spark, where).where("doc_id = 7").first().n_tokens == 100_001
    point = spark.read.orc(where).where("doc_id = 12345")
    assert len(point.collect()) == 1
    scan = point._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 2_000, "row groups without the id are not read"


def measures(texts):
    raw = [t.encode() for t in texts]
    return quality_gam.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))


def test_features_do_not_depend_on_neighbours():
    texts = [*drawn("ab cD\n\t!é9 ", 40, 300), "", " ", "zz", "abcdef"]
    together, apart = measures(texts), np.concatenate([measures([t]) for t in texts])
    assert (together == apart).all()
    longest = quality_gam.FEATURES.index("longest_word")
    assert [round(float(np.expm1(x[longest]))) for x in together] == [max((len(w.encode()) for w in t.split()), default=0) for t in texts]


def test_scores_do_not_depend_on_the_layout(spark):
    texts = drawn("abc de\nF%!. ", 400, 300, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.length("text") > 150).cast("int").alias("quality"))
    one, many = ({r.doc_id: (r.score, r.predicted) for r in quality_gam.classify(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(13)))
    assert one == many and len({s for s, _ in one.values()}) > 10


def test_score_by_brute_force():
    """The sum of one table entry a feature and pair, each found by counting the edges below the value."""
    rng = np.random.default_rng(5)
    table = np.round(rng.random((500, len(quality_gam.FEATURES))), 2)
    model = quality_gam.Model(table, (table[:, 0] + table[:, 1] * table[:, 2] > 0.8).astype(float))
    for row, score in zip(table[:50], model.score(table[:50])):
        total = model.bias + sum(values[sum(e <= x for e in edges)] for values, edges, x in zip(model.single, model.edges, row))
        total += sum(grid[sum(e <= row[a] for e in model.coarse[a]), sum(e <= row[b] for e in model.coarse[b])] for a, b, grid in model.pairs)
        assert np.isclose(score, 1 / (1 + np.exp(-total)))


def test_repeated_ids_teach_once(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i} " * (i % 7 + 1)) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, i % 2) for i in range(1000)], "doc_id long, quality int")
    assert quality_gam.sampled(labels).count() == 10 and quality_gam.sampled(labels, 4).count() == 4
    assert quality_gam.classify(docs, labels).count() == 500

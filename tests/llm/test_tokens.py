import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import bpe_trie, packing, pretokens, registry

ODD = ["", " ", "a", "  a  b ", "x\n\ny", "x \ny\n z", "tab\tx", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "don't we'll  it's\x1cq", "ΣΑΣ É é̂ ﬁ ½ x²", "日本語 テスト 123 4567", "\xa0 x\xa0y z", "w" * 3000 + " " + "é" * 70, "!!'s ''d", "İstanbul KELVIN K", "🎉🎉 👍🏽", "a \n\n b\n", "aaaaaaaa aaa hahahahah"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoder_equals_library(name):
    encoder = pretokens.vocabulary(public_tokenizers.path(name))
    assert encoder.encode(ODD) == encoder.library(ODD)


def test_trie_equals_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, trie = Tokenizer.from_file(path), bpe_trie.TrieEncoder(path)
    for text, (ids, decoded) in zip(ODD, trie.encode(ODD)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == np.asarray(want, "<u4").tobytes() and decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_op7(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in registry.documents(spark, sf_dir).collect()}
    rows = registry.op7_bpe_trie(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in registry.documents(spark, sf_dir).collect()}
    start = 0
    rows = sorted(registry.op8_token_orc(spark, sf_dir).collect())
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def check_packing(rows, ids_of, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, ids in ids_of.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // capacity)))
        assert all(p.length == capacity for p in pieces[1:]) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes())
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_op3(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in registry.documents(spark, sf_dir).collect()}
    used = check_packing(registry.op3_best_fit_packing(spark, sf_dir).collect(), ids, 2048)
    assert used <= 1.03 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_packing_edges(spark):
    schema = "doc_id long, text string, length string, ids int"
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", None, 2), (3, "a b c " * 700, "", None)], schema)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 16).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(rows, {1: [0], 2: [0], 3: [*library.encode("a b c " * 700).ids, 0]}, 16)
    assert packing.pack(docs.where(F.lit(False)), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_fullest_is_best():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = rng.integers(1, 30, 8).tolist()
        counts = {n: lengths.count(n) for n in lengths}
        sums = {0}
        rest = sorted(lengths)[:-1]
        for n in rest:
            sums |= {s + n for s in sums}
        chosen = packing.fullest(counts, 40)
        assert sum(n * k for n, k in chosen) == max(lengths) + max(s for s in sums if s <= 40 - max(lengths))
        assert all(k <= counts[n] for n, k in chosen)


def test_op8_edges(spark, tmp_path):
    from fieldloom.llm import token_orc

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(2, "a", 1), (2, "a", 2), (1, None, 3), (None, "b c", 4)], "doc_id long, text string, part int")
    token_orc.write_tokens(docs, str(tmp_path / "t"), path, end_id=1)
    rows = [(r.doc_id, r.start, r.n_tokens) for r in token_orc.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert rows == [(None, 0, 3), (1, 3, 1), (2, 4, 2), (2, 6, 2)]
    token_orc.write_tokens(docs.where(F.lit(False)), str(tmp_path / "e"), path)
    assert token_orc.checksums(token_orc.read_tokens(spark, str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_full_dictionary_keeps_frequent_words(name, monkeypatch):
    """Words of letters go to the model once; a full dictionary lets rare ones go and no ids change."""
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 40)
    encoder = pretokens.WordVocabulary if name.startswith("word") else pretokens.ByteVocabulary
    encoder = encoder(public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name)))
    assert encoder.direct
    for k in range(30):
        texts = [f"Often été, often word{'abcdefghij'[k % 10] * k} né{k}\nStraße über çà Ǆ ŉ {t}" for t in ODD]
        assert encoder.encode(texts) == encoder.library(texts)
        assert all(len(kept) < 200 for half in (encoder.chunks, encoder.older) for kept in half.values())
    sent = []
    monkeypatch.setattr(encoder, "words", lambda words, lead: sent.extend(words) or type(encoder).words(encoder, words, lead))
    encoder.encode(["x often often"])
    assert "often" not in sent


def test_texts_are_encoded_in_small_groups():
    """Large groups took an executor's memory in the pipeline."""
    assert packing.TEXTS_TOGETHER <= 256 and pretokens.CACHE_ENTRIES <= 500_000


def test_trie_shares_words_in_any_case():
    """Capitalized words of plain texts are no pieces of their own; ids and decoded text stay the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, trie = Tokenizer.from_file(path), bpe_trie.TrieEncoder(path)
    text = "Été ÉTÉ été STRASSE Strasse strasse " + " ".join(t for t in ODD if bpe_trie._PLAIN.fullmatch(t)).replace("\x1c", "")
    want = library.encode(text, add_special_tokens=False).ids
    [(ids, decoded)] = trie.encode([text])
    assert ids == np.asarray(want, "<u4").tobytes() and decoded.decode() == library.decode(want, skip_special_tokens=False)
    trie = bpe_trie.TrieEncoder(path)
    trie.encode(["Été ÉTÉ été STRASSE Strasse strasse"])
    assert len(trie.known) == 2


def test_token_files_encode_in_small_groups():
    from fieldloom.llm import token_orc

    assert token_orc.TEXTS_TOGETHER <= 256


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_are_cut_at_wide_gaps_and_signs(name, monkeypatch):
    """Neither gaps nor signs after words make the library encode known words again."""
    encoder = pretokens.WordVocabulary if name.startswith("word") else pretokens.ByteVocabulary
    encoder = encoder(public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name)))
    encoder.encode(["one two, three!\n\nfour  one &&& été###\n", "two three four one été"])
    sent = []
    monkeypatch.setattr(encoder, "words", lambda words, lead: sent.extend(words) or type(encoder).words(encoder, words, lead))
    monkeypatch.setattr(encoder, "tokenizer", Sent(encoder.tokenizer, sent))
    texts = ["one, two### three### four!", "one  été\n\nfour  two\n", "one été! two###\n"]
    got = encoder.encode(texts)
    assert not {"one", "two", "three", "été"} & set(sent) and max(map(len, sent), default=0) < 7
    assert got == encoder.library(texts)


class Sent:
    """A tokenizer that notes what it is given."""

    def __init__(self, tokenizer, sent):
        self.tokenizer, self.sent = tokenizer, sent

    def encode_batch_fast(self, texts, **options):
        self.sent += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cuts_at_every_kind_of_sign(name, monkeypatch):
    encoder = pretokens.vocabulary(public_tokenizers.path(name))
    signs = [chr(c) for c in [*range(0x250), *range(0x300, 0x310), 0x1680, *range(0x2000, 0x2070), 0x3000, 0x4E00, 0xFEFF]]
    texts = [t for s in signs for t in (f"é{s},'s x", f"a{s} b {s}{s}\n\n{s}, a", f"{s}<|endoftext|>{s} .")]
    assert encoder.encode(texts) == encoder.library(texts)
    monkeypatch.setattr(pretokens, "SIGNS_TOGETHER", 20)
    assert encoder.encode([*texts[:50], "", "a" * 100, ""]) == encoder.library([*texts[:50], "", "a" * 100, ""])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_with_signs_are_no_entries_of_their_own(name):
    encoder = pretokens.WordVocabulary if name.startswith("word") else pretokens.ByteVocabulary
    encoder = encoder(public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name)))
    words, signs = [f"é{a}{b}" for a in "abcde" for b in "vwxyz"], [a * k for a in "#&.!," for k in range(1, 6)]
    texts = ["x " + " ".join(w + s for w in words for s in signs)]
    assert encoder.encode(texts) == encoder.library(texts)
    assert sum(len(kept) for kept in encoder.chunks.values()) <= 1 + len(words) + len(signs)


def test_words_in_any_case_and_place_are_one_entry():
    """Where case and white space have no ids, a word goes to the model once; capitals before a mark are left as they are."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = pretokens.WordVocabulary(path, Tokenizer.from_file(path))
    sent = []
    encoder.words = lambda words, lead: sent.extend(words) or pretokens.WordVocabulary.words(encoder, words, lead)
    texts = ["Zahlen zahlen\nZAHLEN  zAhlen\n\n Zahlen, ZAHLEN#", "zahlen"]
    assert encoder.encode(texts) == encoder.library(texts)
    assert sent == ["zahlen"]
    for case in "H\u0331 h\u0331 W\u030a T\u0308x I\u0307 I\u0323\u0307 K \u0308 \n\u0301a", "<|ENDOFTEXT|> A<|endoftext|>A <|EndOfText|>", "X'S I'LL 'TIS ' S", "A\x01 \x02 B\t C \x01 \n#", "A<|endof text|>B", "\n", "  \n ":
        assert encoder.encode([case]) == encoder.library([case])
        assert encoder.encode([*texts, case, "", case.lower()]) == encoder.library([*texts, case, "", case.lower()])

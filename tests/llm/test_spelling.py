import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import registry, spelling_bands


def brute(docs):
    """Words by the contract; near words by deleting and replacing each code point."""
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for alike in holes.values():
        for w in alike:
            near[w] |= alike - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_op12(spark, sf_dir):
    docs = registry.documents(spark, sf_dir)
    assert rows_of(registry.op12_spelling_bands(spark, sf_dir)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [2, 256])
def test_chains_blocks_and_odd_rows(spark, monkeypatch, block):
    """Chains of forms, ties, letters beyond a to z, long and empty texts, repeated rows, and buckets cut into many blocks."""
    monkeypatch.setattr(spelling_bands, "BLOCK_WORDS", block)
    chain = {"abcdef": 3200, "abcdeg": 600, "abcdhg": 110, "abidhg": 21, "aidhgx": 6, "abcdex": 600, "abcdefs": 7, "zabcdef": 7, "àbcdef": 9, "Àbcdef": 9, "×÷éééé": 8, "fedcba": 40, "short": 50, "ABCDEF": 11, "abcdee": 5, "aabcde": 25}
    text = " ".join(f"{w} " * c for w, c in chain.items())
    rows = [(1, text), (2, None), (3, ""), (4, "1" * 10), (5, "abcdef-abcdeg_abcdhg"), (5, "abcdef-abcdeg_abcdhg"), (None, "ä" * 200_000 + " abcdefgh" * 5)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    got = rows_of(spelling_bands.group(docs))
    assert got == brute(rows) and got["abidhg"][1] == "abcdef" and got["Àbcdef"][0] == "abcdef"
    assert spelling_bands.group(docs.where(F.lit(False))).count() == 0


def test_near_words_agree_in_a_band(spark):
    words = ["".join(p) + "".join(p[::-1]) for p in zip("abcdefghijkl" * 3, "mnopqrstuvwx" * 3, "yzéÿàñ" * 6, "abcabcabcabc" * 3, "zzzyyyxxxwww" * 3, "eieieieieiei" * 3)]
    edits = {w[:i] + c + w[i + k :] for w in words[:12] for i in range(7) for c in ("", "q", "þ") for k in (0, 1) if len(w) - k + len(c) >= 6} - {w for w in words}
    table = spark.createDataFrame([(w, 5) for w in sorted({*words, *edits})], "word string, n long")
    pairs = {(r.a, r.b) for r in spelling_bands.near(spelling_bands.vocabulary(table)).collect()}
    known = sorted({*words, *edits})
    want = {(a, b) for a in known for b in known if a < b and one_edit(a, b)}
    assert {tuple(sorted(p)) for p in pairs} == want and len(pairs) == len(want)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

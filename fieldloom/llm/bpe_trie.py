"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

The last token of a prefix's encoding follows from the last tokens of its shorter prefixes: token t ends prefix p when
t is a suffix of p and the last token of what stands before it may be followed by t. Sorted distinct words are the trie
in depth-first order, so one stack of last tokens is the walk's state and a shared prefix is worked out once.

Nulls and empty texts have no tokens; very long texts and pieces are encoded whole; repeated rows are encoded alike; an
empty table gives no rows; other columns are not read, so their names may be any. Of two merges of one rank the left one
goes first, as in the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pieces a Python worker keeps; beyond it the dictionary is emptied and fills again.
CACHE_ENTRIES = 500_000
CACHED_LENGTH = 48
#: Texts encoded together; their new words share one trie.
TEXTS_TOGETHER = 512
NEVER = 1 << 60
#: Signs at the end of a prefix by which the lengths of its possible last tokens are looked up.
ENDING = 3

_CONTROL_SPACE = re.compile(r"[\x1c-\x1f]")
# Up to U+024F lower case and NFC leave one letter for each, but for U+0130, whose lower case ends in a mark.
_PLAIN = re.compile(r"[\x00-įı-ɏ]*")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.text_of = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        self.signs = str.maketrans({chr(b): s for b, s in enumerate(byte_signs())})
        ids = self.vocab
        self.born = dict.fromkeys(ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[int, int] = {}
        for rank, (left, right) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            a, b, made = ids[left], ids[right], ids[left + right]
            if made in self.parts or max(self.born[a], self.born[b]) >= rank:
                raise ValueError("each token must be made by one merge, of tokens that were made before it")
            self.born[made], self.parts[made], self.merge[a << 20 | b] = rank, (a, b), rank
        self.longest = max(len(t.removesuffix(self.end)) for t in ids)
        self.inner = {t: i for t, i in ids.items() if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in ids.items() if t.endswith(self.end)}
        self.follows: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.raw_of = {i: np.uint32(i).astype("<u4").tobytes() for i in self.text_of}
        self.bytes_of = {i: t.encode() for i, t in self.text_of.items()}
        #: Lengths of the tokens that end in the same signs, longest first.
        self.endings = [self.by_ending(self.inner), self.by_ending(self.final)]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of `token` as it is built, each with the rank of the merge that uses it up."""
        edge, used = [(token, NEVER)], token
        while used in self.parts:
            rank, used = self.born[used], self.parts[used][side]
            edge.append((used, rank))
        return edge

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the border of the two comes before those that make them; ties go left first."""
        key = left << 20 | right
        known = self.follows.get(key)
        if known is None:
            known, ends, starts = True, self.spine(left, 1), self.spine(right, 0)
            for a, a_used in ends:
                for b, b_used in starts:
                    rank = self.merge.get(a << 20 | b)
                    if rank is not None and rank < a_used and rank <= b_used:
                        known = False
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[key] = known
        return known

    def by_ending(self, table: dict[str, int]) -> dict[str, list[int]]:
        """For the last ENDING signs of tokens (all signs of shorter ones), the lengths that tokens so ending have."""
        sizes: dict[str, set[int]] = {}
        for t in table:
            sizes.setdefault(t[-ENDING:], set()).add(len(t))
        return {e: sorted({n for k in range(len(e)) for n in sizes.get(e[k:], ()) if k == 0 or n == len(e) - k}, reverse=True) for e in sizes}

    def last_token(self, word: str, depth: int, path: list[tuple[int, int]], table: dict[str, int], endings: dict[str, list[int]]) -> tuple[int, int]:
        """The last token of word[:depth] and its length, from those of the shorter prefixes in `path`."""
        at, follows = max(0, depth - ENDING), self.follows
        while at < depth - 1 and word[at:depth] not in endings:
            at += 1
        for size in endings.get(word[at:depth], ()):
            if size > depth:
                continue
            token = table.get(word[depth - size : depth])
            if token is None:
                continue
            if size == depth:
                return token, size
            left = path[depth - size][0]
            fits = follows.get(left << 20 | token)
            if fits or fits is None and self.may_follow(left, token):
                return token, size
        raise ValueError(f"no token ends {word[:depth]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The tokens of distinct words, given in byte signs."""
        path, before, out = [(-1, 0)], "", {}
        for word in sorted(words):
            shared = 0
            most = min(len(word) - 1, len(before) - 1, len(path) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared + 1, len(word)):
                path.append(self.last_token(word, depth, path, self.inner, self.endings[0]))
            token, size = self.last_token(word, len(word), path, self.final, self.endings[1])
            at, found = len(word) - size, [token]
            while at:
                token, size = path[at]
                found.append(token)
                at -= size
            out[word], before = found[::-1], word
        return out

    def words(self, piece: str) -> list[str | int]:
        """The words of a piece of text in byte signs; special tokens as their ids."""
        out: list[str | int] = []
        for part in self.special.split(piece):
            if part in self.specials:
                out.append(self.specials[part])
            else:
                text = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.signs) for w in self.pattern.findall(text)]
        return out

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Makes all pieces known, by their ids and their decoded text; what is too long to be kept is returned."""
        missing = [p for p in pieces if p not in self.known]
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known.clear()
            missing = list(pieces)
        parts = [self.words(p) for p in missing]
        encoded = self.encode_words({w for ws in parts for w in ws if isinstance(w, str)})
        once: dict[str, tuple[bytes, bytes]] = {}
        raw_of, bytes_of = self.raw_of, self.bytes_of
        for piece, ws in zip(missing, parts):
            found = [t for w in ws for t in ([w] if isinstance(w, int) else encoded[w])]
            (self.known if len(piece) <= CACHED_LENGTH else once)[piece] = b"".join([raw_of[t] for t in found]), b" ".join([bytes_of[t] for t in found])
        return once

    def lowered(self, text: str) -> str:
        """A text of plain letters in lower case, so that its capitalized words are not pieces of their own."""
        lower = text.lower()
        return lower if _PLAIN.fullmatch(text) and not self.special.search(text) and not self.special.search(lower) else text

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        texts = [self.lowered(t) for t in texts]
        cut = [[p for p in _SPACE.split(t) if p] if _CONTROL_SPACE.search(t) else t.split() for t in texts]
        once, known, out = self.learn(set().union(*cut)), self.known, []
        for pieces in cut:
            found = [once[p] if p in once else known[p] for p in pieces] if once else [known[p] for p in pieces]
            out.append((b"".join([ids for ids, _ in found]), b" ".join([text for _, text in found if text])))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: (id_column, ids binary, n_tokens long, decoded string).

    `vocabulary` is the path of a `tokenizers` file with end-of-word BPE, readable on every executor. `ids` holds
    little-endian unsigned 32-bit integers.
    """
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                part = batch.slice(at, TEXTS_TOGETHER)
                found = trie.encode([t or "" for t in part.column(1).to_pylist()])
                raw = [r for r, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(raw, pa.binary()), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([d for _, d in found], pa.binary()).cast(pa.string())],
                    names=[id_column, "ids", "n_tokens", "decoded"],
                )

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, ids binary, n_tokens long, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """ids and decoded text of encode_decode as SHA-256 hex digests."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))



"""Encoding whole texts with a `tokenizers` file, each distinct word once per Python worker.

A text is cut where its pre-tokenizer would cut it anyway: in front of a space or line break that follows no other white
space, and between a letter and the signs after it. So the ids of the pieces, joined, are the ids of the text. The cuts of
a group of texts are found on their bytes at once, its distinct pieces by Arrow's dictionary encoding, and the ids of texts
are gathered from those of the pieces by Arrow. Pieces are kept as bytes in a dictionary of bounded size; for a vocabulary
that drops white space and case, without the blank in front and in lower case. Of what is missing, words of plain letters go
to the library's model one by one, as each is one pre-token; all else is encoded by the library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fieldloom.llm.bpe_trie import byte_signs

#: Most entries of a worker's dictionary. It has two halves: when the newer one is full it takes the place of the older
#: one, out of which pieces that are wanted again come back.
CACHE_ENTRIES = 500_000
#: Pieces of more bytes are encoded each time they occur.
CACHED_LENGTH = 48
#: Long texts are encoded in groups of about so many signs; a text is never cut.
SIGNS_TOGETHER = 4_000_000

# U+0130 is left out: its lower case ends in a mark that the pre-tokenizer takes together with the signs after it.
_PLAIN = re.compile(r"[!-~À-įı-ɏ]+")
_BYTE_SIGNS = str.maketrans({chr(b): s for b, s in enumerate(byte_signs())})
_TOKEN_ID = attrgetter("id")
_PROBES = ["a", "the", "Zahl", "été", "straßenbahn", "ĳŉ"]
#: Of the two-byte signs from U+00C0 to U+023F all are letters but for these two, and U+0130 ends in a mark as said.
_NO_LETTERS = [sign.encode() for sign in "×÷İ"]
_BLANK, _LETTER, _SIGN, _HIGH = 1, 2, 4, 8
_LOWER = bytes(range(256)).lower()
#: The second-last byte of each white space beyond ASCII.
_WIDE = np.isin(np.arange(256), [chr(c).encode()[-2] for c in range(128, 0x3001) if chr(c).isspace()])
#: No byte of UTF-8.
_NO_BYTE = 0xFF
#: What a byte is: a space or line break, an ASCII letter or digit, another visible ASCII sign, part of a longer sign.
_KINDS = np.array([_HIGH if b > 127 else _BLANK if b in (10, 32) else 0 if b < 33 or b == 127 else _LETTER if chr(b).isalnum() else _SIGN for b in range(256)], np.uint8)


class _Cached:
    """Shared by both vocabularies: the dictionaries and the library behind them."""

    lead = ""
    #: Whether white space has ids; where it has none, each space and line break of a gap is a cut of its own.
    keeps_blanks = True

    def __init__(self, path: str, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The ids of pieces: of words with what stands in front of them, and of all others.
        self.chunks: dict[str, dict[bytes, bytes]] = {"words": {}, "others": {}}
        self.older: dict[str, dict[bytes, bytes]] = {"words": {}, "others": {}}
        self.model = self.tokenizer.model
        self.line_break = self.library(["\n"])[0]
        #: Whether the model by itself gives a word's ids, as it does where nothing else is put around words.
        self.direct = self.words(_PROBES, self.lead) == self.library([self.lead + p for p in _PROBES])

    def signs(self, word: str) -> str:
        """A word in the model's signs, which stand for bytes."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS)

    def words(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of words of plain letters, each of which is one pre-token and goes to the library's model at once."""
        tokenize, before = self.model.tokenize, self.signs(lead).replace(" ", "Ġ")
        ids, ends = array("I"), [0]
        # The library's tokens are let go word by word: held together they take new memory, which costs as much again.
        for word in map(self.signs, words):
            ids.extend(map(_TOKEN_ID, tokenize(before + word)))
            ends.append(4 * len(ids))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, texts: list[str], raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts start in `raw`, their bytes, in which text k starts at offsets[k]."""
        data = np.frombuffer(raw, np.uint8)
        kinds = _KINDS[data]
        cut = (kinds & _BLANK).view(bool)
        if self.keeps_blanks:
            cut[1:] &= data[:-1] > 32
        # A sign after a letter or after a part of a longer one: the kinds' bits lie beside each other.
        signs = np.zeros(len(data), bool)
        is_sign = kinds[1:] & _SIGN
        signs[1:] = is_sign & (kinds[:-1] << 1)
        after_high = np.flatnonzero(is_sign & (kinds[:-1] >> 1)) + 1
        if len(after_high):
            first, second = data[after_high - 2], data[after_high - 1]
            signs[after_high] = (first >= 0xC3) & (first <= 0xC8)
            for sign in _NO_LETTERS:
                signs[after_high] &= (first != sign[0]) | (second != sign[1])
        for special in self.special:
            if special.encode() in raw:
                for k, text in enumerate(texts):
                    if special in text:
                        signs[offsets[k] : offsets[k + 1]] = False
        cut |= signs
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > SIGNS_TOGETHER:
                out += self.together(group)
                group, size = [], 0
        return out + self.together(group)

    def together(self, texts: list[str]) -> list[bytes]:
        """The ids of each text of a group."""
        encoded = [t.encode() for t in texts]
        raw, offsets = b"".join(encoded), np.cumsum([0, *map(len, encoded)])
        if not raw:
            return [b""] * len(texts)
        starts = self.starts(texts, raw, offsets)
        bounds, data = self.bare(raw, starts)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        taken = pa.array(self.filled(pieces), pa.large_binary()).take(found.indices)
        ends, out = np.frombuffer(taken.buffers()[1], np.int64), memoryview(taken.buffers()[2] or b"")
        edges = ends[np.searchsorted(starts, offsets)].tolist()
        result = [bytes(out[a:b]) for a, b in zip(edges, edges[1:])]
        # White space other than ASCII's, in front of a cut: there the text is encoded as a whole.
        wide = self.wide(found.dictionary, pieces)
        if wide:
            which = found.indices.to_numpy()
            whole = np.unique(np.searchsorted(offsets, starts[np.isin(which, wide)], "right") - 1).tolist()
            for k, again in zip(whole, self.library([texts[k] for k in whole])):
                result[k] = again
        return result

    def bare(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, bytes]:
        """The pieces as they are kept: their bytes, and where each starts and the last ends in them."""
        return np.append(starts, len(raw)), raw

    def wide(self, kept: pa.LargeBinaryArray, pieces: list[bytes]) -> list[int]:
        """Which of the pieces end in white space other than ASCII's."""
        ends = np.frombuffer(kept.buffers()[1], np.int64)[1 : len(kept) + 1]
        data = np.frombuffer(kept.buffers()[2] or b"", np.uint8)
        longer = np.flatnonzero(ends > 1)
        ends = ends[longer]
        likely = longer[(data[ends - 1] > 127) & _WIDE[data[ends - 2]]].tolist()
        return [k for k in likely if pieces[k].decode()[-1:].isspace() and pieces[k][-1] > 127]

    def filled(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        for kind, newer in self.chunks.items():
            if len(newer) > CACHE_ENTRIES // 2:
                self.older[kind], self.chunks[kind] = newer, {}
        out = list(map(self.chunks["words"].get, pieces))
        missing = [k for k, ids in enumerate(out) if ids is None]
        for kind, kept in (("others", self.chunks["others"]), *self.older.items()):
            if kept and missing:
                missing = self.put(map(kept.get, [pieces[k] for k in missing]), missing, pieces, out, self.chunks[kind])
        if missing:
            for k, ids in zip(missing, self.encoded([pieces[k] for k in missing])):
                out[k] = ids
        return out

    @staticmethod
    def put(found: Iterable[bytes | None], missing: list[int], pieces: list[bytes], out: list[bytes | None], newer: dict[bytes, bytes]) -> list[int]:
        """Set the ids of missing pieces, and keep them as new; returns what is still missing."""
        left = []
        for k, ids in zip(missing, found):
            if ids is None:
                left.append(k)
            else:
                out[k] = newer[pieces[k]] = ids
        return left

    def encoded(self, missing: list[bytes]) -> list[bytes]:
        """The ids of pieces that are in no dictionary. They are kept, if the pieces are not too long."""
        words: dict[bytes, tuple[list[bytes], list[str]]] = {b" ": ([], []), b"\n": ([], []), b"": ([], [])}
        others = []
        for piece in missing:
            front = piece[:1] if piece[:1] in words else b""
            word = piece[len(front) :].decode()
            if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)) and self.direct:
                words[front][0].append(piece)
                words[front][1].append(word)
            else:
                others.append(piece)
        ids = dict(zip(others, self.library([p.decode() for p in others])))
        self.keep("others", ids)
        for front, (some, bare) in words.items():
            got = self.words(bare, self.lead if front == b" " else "")
            got = dict(zip(some, [self.line_break + g for g in got] if front == b"\n" else got))
            self.keep("words", got)
            ids.update(got)
        return [ids[p] for p in missing]

    def keep(self, kind: str, ids: dict[bytes, bytes]) -> None:
        self.chunks[kind].update(ids if max(map(len, ids), default=0) <= CACHED_LENGTH else [i for i in ids.items() if len(i[0]) <= CACHED_LENGTH])


class WordVocabulary(_Cached):
    """For vocabularies that drop white space and mark word ends."""

    keeps_blanks = False

    def __init__(self, path: str, tokenizer: Tokenizer):
        super().__init__(path, tokenizer)
        #: Whether capitals have the ids of their small letters, in words and in what follows an apostrophe.
        self.folds = self.direct and self.library(["ZAHL'S I'LL"]) == self.library(["zahl's i'll"])

    def bare(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Without the blank in front, which has no ids, and with A-Z in lower case.

        Capitals are left in groups where one stands before a sign from U+0280 on, as a mark may make one letter with a small
        letter and none with its capital, and in groups that hold a special token in any case.
        """
        data = np.frombuffer(raw, np.uint8)
        blank = (_KINDS[data[starts]] & _BLANK).view(bool)
        marked = data.copy()
        marked[starts[blank]] = _NO_BYTE
        lower = None
        if self.folds and not ((data[1:] >= 0xCA) & (data[:-1] - 65 < 26)).any():
            small = raw.translate(_LOWER)
            if not any(special.encode().lower() in small for special in self.special):
                lower = _LOWER
        bounds = np.append(starts, len(raw))
        bounds[1:] -= np.cumsum(blank)
        return bounds, marked.tobytes().translate(lower, bytes([_NO_BYTE]))

    def signs(self, word: str) -> str:
        return super().signs(word.lower())


class ByteVocabulary(_Cached):
    """For byte-level vocabularies, which keep white space; a single space belongs to the word after it."""

    lead = " "


@lru_cache(maxsize=4)
def vocabulary(path: str) -> WordVocabulary | ByteVocabulary:
    """The encoder for a tokenizer file; a Python worker keeps it from task to task."""
    # Spark has a worker on every core, so the library starts no threads of its own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    return (WordVocabulary if getattr(tokenizer.model, "end_of_word_suffix", None) else ByteVocabulary)(path, tokenizer)

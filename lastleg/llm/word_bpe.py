"""Ids of a word-level ``tokenizers`` file, with a vectorised path for the words of Latin-1 languages.

A word's ids depend on the word alone, because the file's pre-tokens end at
white space. Words are cut into pre-tokens by the file's own pattern, and the
merges of all new pre-tokens of a batch are applied together in NumPy: in each
round every pre-token merges its leftmost pair of the least rank, as the
library does one word at a time. Words with other characters, special tokens
or very long pre-tokens, and files with other settings, go to the library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Words and pre-tokens whose ids a worker remembers, about 200 bytes each, before it starts anew.
KNOWN_WORDS, KNOWN_PIECES = 600_000, 400_000
#: Bytes of the longest pre-token that is merged in NumPy.
LONGEST = 48
#: Characters that lower-casing and NFC treat alike in Python and in the library.
_PLAIN = regex.compile("(?m)^[!-~À-ÿ]+$")  # a word of a list with one in each line
_NONE = np.iinfo(np.int32).max


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next of U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Merges:
    """Byte-level BPE with an end-of-word suffix over many pre-tokens at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.width = max(vocab.values()) + 1
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each non-empty pre-token."""
        out: list[bytes] = [b""] * len(pieces)
        if not pieces:
            return out
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            where = group.tolist()
            text = np.frombuffer(b"".join([pieces[k] for k in where]), dtype=np.uint8).reshape(len(where), -1)
            self._merge(text, where, out)
        return out

    def _merge(self, text: np.ndarray, where: list[int], out: list[bytes]) -> None:
        rows, wide = np.array(where), text.shape[1]
        ids = self.inner[text]
        ids[:, -1] = self.last[text[:, -1]]
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if wide > 1 else np.empty((len(rows), 0), np.int32)
        while len(rows):
            if wide > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                done = best == _NONE
            else:
                done = np.ones(len(rows), dtype=bool)
            if done.any():
                blob, size = ids[done].astype("<u4").tobytes(), 4 * wide
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = blob[size * k : size * (k + 1)]
                if done.all():
                    return
                left = ~done
                rows, ids, ranks, at, best = rows[left], ids[left], ranks[left], at[left], best[left]
            # every row that is left merges one pair, so all stay equally long
            every, wide = np.arange(len(rows)), wide - 1
            column = np.arange(wide)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            ids[every, at] = self.made[best]
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
            after, before = np.flatnonzero(at < wide - 1), np.flatnonzero(at > 0)
            ranks[after, at[after]] = self.rank(ids[after, at[after]], ids[after, at[after] + 1])
            ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])


def _known_form(file: dict) -> bool:
    """Whether the file's steps are those that the vectorised path repeats."""
    norm, pre, model = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}, file["model"]
    kinds = [(n["type"], n.get("content")) for n in norm.get("normalizers", [])]
    split, level = (pre.get("pretokenizers", []) + [{}, {}])[:2]
    return (
        kinds == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
        and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and model["type"] == "BPE"
        and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
    )


class WordTokenizer:
    """Ids of a ``tokenizers`` file. Words between plain spaces and line ends are encoded once and remembered."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads cost more than they bring
        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"\n": b""}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.merges = self.cut = None
        if _known_form(file):
            model = file["model"]
            self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
            self.cut = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
            self.special = regex.compile("|".join(regex.escape(t["content"]) for t in file["added_tokens"]) or "(?!)")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids with the end id."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) >= KNOWN_WORDS:
            self.known = {"": b""}
        if len(self.pieces) >= KNOWN_PIECES:
            self.pieces = {"\n": b""}
        known = self.known
        new = [w for w in set(chain.from_iterable(split)) if w not in known]
        if self.merges is not None:
            plain = _PLAIN.findall("\n".join(new))
            if self.special.search("\n".join(plain)):
                plain = [w for w in plain if not self.special.search(w)]
            if plain:
                self._by_merges(plain)
                new = [w for w in new if w not in known]
        self._by_library(new)
        return [b"".join(map(known.__getitem__, words)) + self.end for words in split]

    def _by_merges(self, words: list[str]) -> None:
        cut = [*self.cut.findall("\n".join(words).lower()), "\n"]
        pieces = self.pieces
        fresh = [(p, b) for p in set(cut) if p not in pieces and len(b := p.encode()) <= LONGEST]
        pieces.update(zip([p for p, _ in fresh], self.merges.encode([b for _, b in fresh]), strict=True))
        for p in set(cut).difference(pieces):  # a pre-token is its own only pre-token
            pieces[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
        got = list(map(pieces.__getitem__, cut))
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        ends = np.cumsum(sizes)[sizes == 0].tolist()  # a line end, after each word, has no ids
        self.known.update(zip(words, map(b"".join(got).__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _by_library(self, new: list[str]) -> None:
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, ends = np.array(got.ids, dtype="<u4").tobytes(), (4 * np.searchsorted(got.word_ids, np.arange(len(part) + 1))).tolist()
            for word, begin, end in zip(part, ends, ends[1:], strict=False):
                self.known[word] = ids[begin:end]


@lru_cache(maxsize=2)
def word_tokenizer(path: str, end_id: int) -> WordTokenizer:
    return WordTokenizer(path, end_id)

"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a pre-token the encoder stores the one token that
ends the prefix's BPE encoding. A token t may end a prefix if it is a suffix
of it, and if t may follow the last token of what stands before it: two tokens
may stand side by side iff BPE merges their joint bytes to exactly those two.
That last token is unique for each prefix, so appending bytes only extends the
table, and an edit needs the table again from the edited byte on.

``encode_decode`` handles nulls as empty texts, gives empty texts no ids, keeps
one row for each input row (repeated rows give equal rows) and ignores columns
other than the two it is told to read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lastleg.llm.common import CACHE_ENTRIES, map_batches


class PrefixBPE:
    """Encoder and decoder over a rank file (token bytes in base64, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = list(map(len, self.bytes_of))
        self.longest = max(self.lengths)
        self.suffixes = ahocorasick.Automaton()  # finds all tokens that end at a byte
        for token, rank in ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), rank)
        self.suffixes.make_automaton()
        self.pattern = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._texts: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> PrefixBPE:
        with open(path, "rb") as f:
            rows = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in rows}, pattern)

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for single bytes."""
        if token not in self._splits:
            word = self.bytes_of[token]
            parts = None
            if len(word) > 1:
                pieces = self._merged(word, self.ranks[word])
                parts = (pieces[0], pieces[1]) if len(pieces) == 2 else None
            self._splits[token] = parts
        return self._splits[token]

    def _merged(self, word: bytes, below: int) -> list[int]:
        """Plain BPE with the ranks under ``below``; only for tokens of the vocabulary, which are short."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether BPE leaves this pair of tokens as it is: no merge across the border comes before those that made them."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is not None:
            return known
        limit = len(self.bytes_of)
        a, b, ok = left, right, True
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < limit:
                ok = False
                break
            # undo the latest of the merges that made the two tokens at the border
            if a > b:
                limit, parts = a, self._split(a)
                if parts is None:
                    limit, parts = b, self._split(b)
                    if parts is None:
                        break
                    b = parts[0]
                    limit += 1
                else:
                    a = parts[1]
            else:
                limit, parts = b, self._split(b)
                if parts is None:
                    limit, parts = a, self._split(a)
                    if parts is None:
                        break
                    a = parts[1]
                else:
                    b = parts[0]
                    limit += 1
        if len(self._pairs) >= CACHE_ENTRIES:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    def last_tokens(self, word: bytes, table: list[int] | None = None, start: int = 0) -> list[int]:
        """The last token of every prefix; with a table of an earlier word, only from byte ``start`` on."""
        last, lengths, pairs = (table or [])[:start], self.lengths, self._pairs
        last += [-1] * (len(word) - start)
        back = max(0, start - self.longest)
        for at, token in self.suffixes.iter(word[back:].decode("latin-1")):  # longest first at each byte
            end = back + at
            if end < start or last[end] >= 0:
                continue
            begin = end - lengths[token]
            if begin < 0:
                last[end] = token
            else:
                known = pairs.get((last[begin], token))
                if known is None:
                    known = self._side_by_side(last[begin], token)
                if known:
                    last[end] = token
        if -1 in last:
            raise ValueError("the vocabulary lacks a byte of this text")
        return last

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        last, out, end = self.last_tokens(word), [], len(word)
        while end:
            out.append(last[end - 1])
            end -= self.lengths[last[end - 1]]
        return tuple(reversed(out))

    def _encode_match(self, match: str) -> tuple[int, ...]:
        got = self._words.get(match)
        if got is None:
            got = self.encode_word(match.encode())
            if len(match) <= 64:
                if len(self._words) >= CACHE_ENTRIES:
                    self._words.clear()
                self._words[match] = got
        return got

    def _encode_part(self, part: str) -> tuple[int, ...]:
        got = tuple(chain.from_iterable(map(self._encode_match, self.pattern.findall(part))))
        if len(part) <= 64:
            if len(self._texts) >= CACHE_ENTRIES:
                self._texts.clear()
            self._texts[part] = got
        return got

    #: A space between two white-space characters: only there does cutting a text before its spaces change the matches.
    _RUNS = regex.compile(r"\s (?:\s|\Z)")

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Matches never cross a space that follows a word, so the parts between spaces are encoded once each."""
        if not text:
            return []
        if self._RUNS.search(text):
            return list(chain.from_iterable(map(self._encode_match, self.pattern.findall(text))))
        first, *rest = text.split(" ")
        parts = [first] if first else []
        parts += [" " + p for p in rest]
        known, out = self._texts, []
        for part in parts:
            got = known.get(part)
            out.append(self._encode_part(part) if got is None else got)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PrefixBPE:
    return PrefixBPE.load(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, the ids themselves and the decoded bytes."""

    def run(batch: pa.RecordBatch):
        bpe = encoder(path, pattern)
        names = [str(i) for i in range(len(bpe.bytes_of))] if not hasattr(bpe, "names") else bpe.names
        bpe.names = names
        n, ids_sha, out_sha, all_ids, all_bytes = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text or "")
            back = bpe.decode(ids)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            out_sha.append(hashlib.sha256(back).hexdigest())
            if with_ids:
                all_ids.append(ids)
                all_bytes.append(back)
        got = {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": out_sha}
        yield got | ({"ids": all_ids, "decoded": all_bytes} if with_ids else {})

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    from pyspark.sql import functions as F

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, schema)

"""Token counts under a unigram model, by dynamic programming shared over a trie.

A pre-token is a run of bytes other than ASCII white space, with a word-start
mark before it. Its token count is that of the segmentation with the highest
sum of piece scores (ties: the shorter last piece). Distinct pre-tokens are
inserted into a trie whose nodes keep the forward scores of their prefix, so
these are computed once for all pre-tokens that share it; a terminal keeps the
count. A worker keeps its trie from batch to batch, up to a bounded size, and
takes all new pre-tokens of a batch down it together. Characters outside the
vocabulary cost their UTF-8 bytes, one token each.

The model is a piece list with scores; ``zipf_pieces`` reads a public
vocabulary and scores a piece of rank r by -ln(r + 1), its frequency rank.

Null and empty texts have no pre-tokens and 0 tokens; repeated rows give equal
rows; a null id stays null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import CACHE_ENTRIES, map_batches, texts_of

WORD_START = "▁"
#: Score of one byte of a character outside the vocabulary.
BYTE_SCORE = -20.0
#: Nodes after which a worker begins a new trie; characters of a pre-token beyond which nothing is shared.
TRIE_NODES, DEPTH = 400_000, 64
#: Bits of a character in a key of node and character; a letter that no text has, the root's.
LETTER_BITS, NO_LETTER = 21, 0x110000
_LAST_KEY = np.iinfo(np.int64).max


def zipf_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model file, scored by rank; control and byte pieces take no part."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(r + 1.0) for r, p in enumerate(pieces, start=1)}


class _Endings:
    """Trie of the reversed pieces: which pieces end at a character, read backwards from there."""

    def __init__(self, pieces: dict[str, float]):
        child: dict[int, int] = {}
        ends = {}
        for piece, score in pieces.items():
            state = 0
            for letter in reversed(piece):
                state = child.setdefault(state << LETTER_BITS | ord(letter), len(child) + 1)
            ends[state] = score
        keys = np.array([*child, _LAST_KEY], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.states = keys[order], np.array([*child.values(), 0])[order]
        self.score = np.full(len(keys), -np.inf)  # no piece ends the walk here
        self.score[list(ends)] = list(ends.values())
        self.first = np.zeros(NO_LETTER + 1, dtype=np.int64)
        top = self.keys < 1 << LETTER_BITS
        self.first[self.keys[top]] = self.states[top]

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The state after one letter more; 0 where no piece goes on so."""
        key = states << LETTER_BITS | letters
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.states[at], 0)


class TrieCounter:
    """Token counts of pre-tokens in a trie that a worker keeps from batch to batch.

    Node n stands for a prefix: ``parent[n]`` and ``letter[n]`` are the prefix
    without its last character and that character, ``score[n]`` and
    ``tokens[n]`` its forward score and the tokens of its best segmentation.
    ``children[d]`` leads from the nodes of depth d to the next, as sorted keys
    of node and character. ``known`` holds the terminals' counts. All new
    pre-tokens of a batch go down one character at a time together; the nodes
    that are missing there are appended and scored in one go.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.endings = _Endings(pieces)
        self._clear()

    def _clear(self) -> None:
        self.nodes = 1
        self._parent, self._letter = np.zeros(1024, dtype=np.int64), np.full(1024, NO_LETTER, dtype=np.int64)
        self._score, self._tokens = np.zeros(1024), np.zeros(1024, dtype=np.int64)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        self.known: dict[bytes, int] = {}

    @property
    def score(self) -> np.ndarray:
        return self._score[: self.nodes]

    @property
    def tokens(self) -> np.ndarray:
        return self._tokens[: self.nodes]

    def _append(self, parents: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """New nodes under ``parents``, with scores and counts."""
        new = np.arange(self.nodes, self.nodes + len(parents))
        self.nodes += len(new)
        if self.nodes > len(self._score):
            more = max(self.nodes, 2 * len(self._score)) - len(self._score)
            self._parent, self._letter, self._score, self._tokens = (np.pad(x, (0, more)) for x in (self._parent, self._letter, self._score, self._tokens))
        self._parent[new], self._letter[new] = parents, letters
        width = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)
        best, counts = self._score[parents] + BYTE_SCORE * width, self._tokens[parents] + width
        # the pieces that end here, shorter ones first: up the trie and down the reversed pieces
        row, begin, state = np.arange(len(new)), parents, self.endings.first[letters]
        while True:
            on = state > 0
            row, begin, state = row[on], begin[on], state[on]
            if not len(row):
                break
            through = self._score[begin] + self.endings.score[state]
            better = through > best[row]
            best[row[better]], counts[row[better]] = through[better], self._tokens[begin[better]] + 1
            state, begin = self.endings.step(state, self._letter[begin]), self._parent[begin]
        self._score[new], self._tokens[new] = best, counts
        return new

    def _down(self, depth: int, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The children of ``nodes``, all of one depth, by ``letters``; those that lack are appended."""
        if depth == len(self.children):
            self.children.append((np.array([_LAST_KEY]), np.array([0])))
        keys, ids = self.children[depth]
        key = nodes << LETTER_BITS | letters
        at = np.searchsorted(keys, key)
        found, lack = ids[at], keys[at] != key
        if lack.any():
            fresh, own = np.unique(key[lack], return_inverse=True)
            made, where = self._append(fresh >> LETTER_BITS, fresh & ((1 << LETTER_BITS) - 1)), np.searchsorted(keys, fresh)
            self.children[depth] = np.insert(keys, where, fresh), np.insert(ids, where, made)
            found[lack] = made[own]
        return found

    def _step(self, word: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Forward score and token count of ``word[:end]``, from those of its prefixes."""
        width = len(word[end - 1].encode())
        best, count = scores[end - 1] + BYTE_SCORE * width, counts[end - 1] + width
        for begin in range(end - 1, max(0, end - self.longest) - 1, -1):
            piece = self.pieces.get(word[begin:end])
            if piece is not None and scores[begin] + piece > best:
                best, count = scores[begin] + piece, counts[begin] + 1
        return best, count

    def _beyond(self, word: str, node: int) -> int:
        """The count of a word of more than ``DEPTH`` characters, from the node of its first ``DEPTH`` on."""
        path = [node]
        while path[-1]:
            path.append(int(self._parent[path[-1]]))
        scores, counts = self._score[path[::-1]].tolist(), self._tokens[path[::-1]].tolist()
        for end in range(len(path), len(word) + 1):
            best, count = self._step(word, end, scores, counts)
            scores.append(best)
            counts.append(count)
        return counts[-1]

    def insert(self, words: list[bytes]) -> list[int]:
        """Follow all ``words`` from the root and append the nodes that they lack; the counts at their ends."""
        if not words:
            return []
        begin = "\n" + WORD_START  # no word has a line end
        try:
            text = begin.encode().join([b"", *words]).decode()
        except UnicodeDecodeError:
            text = begin.join(["", *(w.decode("utf-8", "replace") for w in words)])
        letters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        starts = np.flatnonzero(letters == ord("\n")) + 1
        lengths = np.diff(starts, append=len(letters) + 1) - 1
        node, left = np.zeros(len(words), dtype=np.int64), np.arange(len(words))
        for depth in range(min(DEPTH, int(lengths.max()))):
            left = left[lengths[left] > depth]
            node[left] = self._down(depth, node[left], letters[starts[left] + depth])
        counts = self._tokens[node].tolist()
        for k in np.flatnonzero(lengths > DEPTH).tolist():
            counts[k] = self._beyond(text[starts[k] : starts[k] + lengths[k]], int(node[k]))
        return counts

    def count(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        if self.nodes >= TRIE_NODES or len(self.known) >= CACHE_ENTRIES:
            self._clear()
        split, known = [t.split() for t in texts], self.known
        new = list(set().union(*split).difference(known))
        known.update(zip(new, self.insert(new), strict=True))
        get = known.__getitem__
        return [len(w) for w in split], [sum(map(get, w)) for w in split]


@lru_cache(maxsize=2)
def counter(path: str) -> TrieCounter:
    return TrieCounter(zipf_pieces(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens), one row for each row of ``docs``."""

    def run(batch: pa.RecordBatch):
        words, tokens = counter(path).count(texts_of(batch))
        yield {"doc_id": batch.column(0), "n_pretokens": words, "n_tokens": tokens}

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, n_pretokens bigint, n_tokens bigint", rows=500)

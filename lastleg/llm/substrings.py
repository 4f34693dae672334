"""Removal of passages that occur in an earlier document, by suffix automata.

A window is ``width`` consecutive words. A word goes if a window over it also
starts in a document with a smaller id; windows that touch or overlap make one
maximal span.

Windows meet by anchors. A window's anchor is the least hash of the short word
groups in it, so equal windows have equal anchors, and neighbouring windows
mostly share one; a run of windows with one anchor is a segment. Only anchors
that more than one document has go on. The distinct segments of an anchor are
a reference shard: in the order of their least document they are streamed
through the shard's suffix automaton for their matching statistics, which give
for each window the first document that has it, and are then added to the
automaton. Shards are dealt over the cluster instead of broadcast, for their
size grows with the corpus. An anchor with more than ``SHARD`` distinct
segments is no shard; its windows are grouped one by one. Anchors and segments
that very many documents have are dealt over several tasks by ``join_by_key``.

Null texts have no words. A document with fewer words than a window loses
none. A null id is no document to compare with: it loses nothing and removes
nothing. Repeated rows (one id) don't remove each other's words and give equal
rows; nor do different texts of one id. Long texts are taken whole. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import Written, WordHashes, join_by_key, map_batches, mix64, partitions, texts_of, to_batch

WIDTH, GROUP = 13, 5
#: Bytes of a word's hash that segments keep. Two windows of one anchor that differ in one word are taken for equal with a chance of 2^-40.
BYTES = 5
#: Distinct segments of one anchor that one automaton takes: some 300,000 states, a few hundred bytes each.
SHARD = 1 << 14

_hashes = WordHashes()
_multipliers = mix64(np.arange(101, 133, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def anchors_of(h: np.ndarray, width: int) -> np.ndarray:
    """The anchor of every window over word hashes, as signed 64-bit values."""
    group = min(GROUP, width)
    n = len(h) - group + 1
    if len(h) < width:
        return np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(group):
        total += h[k : k + n] * _multipliers[k]
    least, reach, span = mix64(total), 1, width - group + 1
    while reach < span:  # minimum over ``span`` neighbours, in doubling steps
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least.view(np.int64)


def packed(h: np.ndarray) -> np.ndarray:
    """The low bytes of word hashes, a row for each word."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]


def unpacked(words: pa.Array) -> tuple[list[int], list[int]]:
    """The words of a column of segments, one after another, and where each segment begins and the last ends."""
    whole = words.cast(pa.binary())
    offsets = np.frombuffer(whole.buffers()[1], dtype="<i4")[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    raw = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(whole) else np.zeros(0, dtype=np.uint8)
    x = np.zeros((len(raw) // BYTES, 8), dtype=np.uint8)
    x[:, :BYTES] = raw.reshape(-1, BYTES)
    return x.view("<u8").ravel().tolist(), ((offsets - offsets[0]) // BYTES).tolist()


class SuffixAutomaton:
    """Of several word sequences, added in ascending order of their document; a state keeps the first document it occurs in."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w, doc)

    def _state(self, length: int, doc, link: int = -1, edges: dict | None = None) -> int:
        self.next.append({} if edges is None else edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(doc)
        return len(self.length) - 1

    def _clone(self, state: int, old: int, word: int) -> int:
        """Split off the part of ``old`` that follows ``state``."""
        new = self._state(self.length[state] + 1, self.first[old], self.link[old], dict(self.next[old]))
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int, doc: int) -> int:
        old = self.next[last].get(word)
        if old is not None:  # another sequence has been here
            return old if self.length[old] == self.length[last] + 1 else self._clone(last, old, word)
        now = self._state(self.length[last] + 1, doc)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = now
            state = self.link[state]
        if state < 0:
            self.link[now] = 0
        else:
            old = self.next[state][word]
            self.link[now] = old if self.length[old] == self.length[state] + 1 else self._clone(state, old, word)
        return now

    def first_documents(self, words: list[int], width: int) -> list[int | None]:
        """For every window, the first document that has it, from the stream's matching statistics."""
        state, matched, out = 0, 0, []
        for at, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while matched >= width and self.length[self.link[state]] >= width:
                state = self.link[state]
                matched = self.length[state]
            if at >= width - 1:
                out.append(self.first[state] if matched >= width else None)
        return out


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, doc_id), about once for each anchor of a document."""

    def run(batch: pa.RecordBatch):
        anchors, ids = [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            own = np.unique(anchors_of(_hashes.of(text.split()), width))
            anchors.append(own)
            ids.append(np.full(len(own), doc, dtype=np.int64))
        yield {"anchor": pa.array(np.concatenate(anchors)), "doc_id": pa.array(np.concatenate(ids))}

    return map_batches(docs, run, "anchor bigint, doc_id bigint", rows=500)


SEGMENT = "doc_id bigint, text_key bigint, anchor bigint, start int, words binary"


def _segments(docs: DataFrame, width: int) -> DataFrame:
    """Runs of windows with one of the document's shared anchors; equal runs have equal ``segment``."""

    def run(batch: pa.RecordBatch):
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        ids, keys, hashes, anchor, starts, ends, at = [], [], [], [], [], [], 0
        for doc, key, text, shared in zip(get("doc_id"), get("text_key"), texts_of(batch), get("anchors"), strict=True):
            h = _hashes.of(text.split())
            anchors = anchors_of(h, width)
            if not len(anchors):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1], [True])))
            wanted = np.isin(anchors[cuts[:-1]], np.array(shared, dtype=np.int64))
            first = cuts[:-1][wanted]
            ids.append(np.full(len(first), doc, dtype=np.int64))
            keys.append(np.full(len(first), key, dtype=np.int64))
            hashes.append(h)
            anchor.append(anchors[first])
            starts.append((first, first + at))
            ends.append(cuts[1:][wanted] + at + width - 1)
            at += len(h)
        if not hashes:
            return
        begin, end = np.concatenate([g for _, g in starts]), np.concatenate(ends)
        sizes = end - begin
        upto = np.cumsum(sizes)
        taken = np.repeat(begin - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        raw = np.ascontiguousarray(packed(np.concatenate(hashes))[taken])
        offsets = np.concatenate(([0], upto * BYTES)).astype("<i4")
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
        yield {"doc_id": pa.array(np.concatenate(ids)), "text_key": pa.array(np.concatenate(keys)), "anchor": pa.array(np.concatenate(anchor)), "start": pa.array(np.concatenate([f for f, _ in starts]).astype(np.int32)), "words": words}

    return map_batches(docs, run, SEGMENT, rows=500).withColumn("segment", F.xxhash64("words"))


def _first_documents(distinct: DataFrame, width: int) -> DataFrame:
    """(anchor, segment, n_rows, firsts): for each window of a distinct segment, the first document that has it."""
    dealt = distinct.repartition(partitions(distinct.sparkSession), "anchor").sortWithinPartitions("anchor", "least", "segment")
    schema = "anchor bigint, segment bigint, n_rows bigint, firsts array<bigint>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        shard, automaton, held = None, None, None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            firsts, (words, edges) = [], unpacked(column("words"))
            for k, (anchor, least) in enumerate(zip(column("anchor").to_pylist(), column("least").to_pylist(), strict=True)):
                own = words[edges[k] : edges[k + 1]]
                if anchor != shard:
                    shard, automaton, held = anchor, None, (own, least)  # built only if a second segment comes
                    firsts.append([least] * (len(own) - width + 1))
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton()
                    automaton.add(*held)
                firsts.append([least if f is None or f > least else f for f in automaton.first_documents(own, width)])
                automaton.add(own, least)
            if firsts:
                yield to_batch({c: column(c) for c in ("anchor", "segment", "n_rows")} | {"firsts": firsts}, target)

    return dealt.mapInArrow(run, schema)


def _single_windows(distinct: DataFrame, width: int) -> DataFrame:
    """The same for segments of anchors that are too large for one automaton: each window is a group of its own."""

    def run(batch: pa.RecordBatch):
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        rows = [(a, s, n, d, i, w[BYTES * i : BYTES * (i + width)]) for a, s, n, d, w in zip(get("anchor"), get("segment"), get("n_rows"), get("least"), get("words"), strict=True) for i in range(len(w) // BYTES - width + 1)]
        if rows:
            yield dict(zip(("anchor", "segment", "n_rows", "least", "at", "window"), zip(*rows, strict=True), strict=True))

    windows = map_batches(distinct, run, "anchor bigint, segment bigint, n_rows bigint, least bigint, at int, window binary", rows=500)
    total = int(distinct.agg(F.sum(F.octet_length("words") / BYTES - width + 1)).first()[0])
    first = windows.groupBy("window").agg(F.min("least").alias("first"), F.count("*").alias("n_windows"))
    placed = join_by_key(windows, first, ["window"], total, count="n_windows").groupBy("anchor", "segment", "n_rows").agg(F.sort_array(F.collect_list(F.struct("at", "first"))).alias("all"))  # a segment has width - GROUP + 1 windows, or few more
    return placed.select("anchor", "segment", "n_rows", F.transform("all", lambda x: x["first"]).alias("firsts"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that tells the texts of one id apart."""
    return docs.withColumn("text_key", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, work: Written, width: int) -> DataFrame:
    """(doc_id, text_key, starts): the windows of each document that an earlier document has too."""
    known = _keyed(docs.where(F.col("doc_id").isNotNull()))
    seen = work.table(_occurrences(known.select("doc_id", "text"), width), "seen")
    counted = seen.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n_rows"))
    shared = work.table(counted.where("x < y").select("anchor", "n_rows"), "shared")
    total = shared.agg(F.sum("n_rows")).first()[0] or 0
    # one list for each document, no longer than its windows
    wanted = work.table(join_by_key(seen, shared, ["anchor"], total).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    work.drop(keep=1)
    segments = work.table(_segments(known.join(wanted, "doc_id").select("doc_id", "text_key", "text", "anchors"), width), "segments")
    work.drop(keep=1)
    distinct = segments.groupBy("anchor", "segment").agg(F.min("doc_id").alias("least"), F.first("words").alias("words"), F.count("*").alias("n_rows"))
    distinct = work.table(distinct, "shards")
    large = work.table(distinct.groupBy("anchor").count().where(F.col("count") > SHARD).select("anchor"), "large")
    firsts = _first_documents(distinct.join(large, "anchor", "left_anti"), width)
    if large.limit(1).count():
        firsts = firsts.unionByName(_single_windows(distinct.join(large, "anchor", "left_semi"), width))
    firsts = work.table(firsts, "firsts")
    own = segments.select("doc_id", "text_key", "anchor", "segment", "start")
    flagged = join_by_key(own, firsts, ["anchor", "segment"], segments.count())
    at = F.expr("filter(transform(firsts, (f, i) -> if(f < doc_id, start + i, -1)), x -> x >= 0)")
    some = flagged.select("doc_id", "text_key", at.alias("at")).where(F.size("at") > 0)
    # a set: repeated rows give their windows once
    return work.table(some.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("at")).alias("starts")), "flags")


def spans(starts: list[int], width: int) -> list[tuple[int, int]]:
    """The maximal spans of words, from begin to before end, that the windows cover."""
    at = np.unique(np.array(starts, dtype=np.int64))
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > width)  # windows that touch or overlap make one span
    return list(zip(at[np.concatenate(([0], cuts + 1))].tolist(), (at[np.concatenate((cuts, [len(at) - 1]))] + width).tolist(), strict=True))


def without(words: list[bytes], starts: list[int], width: int) -> list[bytes]:
    """``words`` without their repeated spans."""
    kept, at = [], 0
    for begin, end in spans(starts, width):
        kept += words[at:begin]
        at = end
    return kept + words[at:]


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of ``docs``; kept words are joined by one space."""
    work = Written(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    flags = repeated_windows(plain, work, width)
    joined = _keyed(plain).join(flags, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts")

    def run(batch: pa.RecordBatch):
        n, removed, digest, texts = [], [], [], []
        for text, starts in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            n.append(len(words))
            if starts:
                words = without(words, starts, width)
            kept = b" ".join(words)
            removed.append(n[-1] - len(words))
            digest.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        yield {"doc_id": batch.column(0), "n_words": n, "n_removed": removed, "kept_sha256": digest} | ({"kept": texts} if with_text else {})

    out = map_batches(joined, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else ""), rows=500)
    work.drop(keep=1)
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated words taken out of their texts; texts that lose nothing stay as they are, those that lose all become empty. A column n_chars follows its text."""
    work = Written(docs.sparkSession)
    flags = repeated_windows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, width).select(F.col("doc_id").alias("__flag_id"), F.col("text_key").alias("__flag_key"), F.col("starts").alias("__flag_starts"))
    joined = docs.join(flags, (F.col("doc_id") == F.col("__flag_id")) & (F.xxhash64("text") == F.col("__flag_key")), "left").drop("__flag_id", "__flag_key")
    names = docs.columns

    def run(batch: pa.RecordBatch):
        texts = batch.column(names.index("text")).to_pylist()
        lengths = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else []
        for k, starts in enumerate(batch.column(len(names)).to_pylist()):
            if starts:
                texts[k] = b" ".join(without(texts[k].encode().split(), starts, width)).decode()
                if lengths:
                    lengths[k] = len(texts[k])
        changed = {"text": texts, "n_chars": lengths}
        yield {c: changed.get(c, batch.column(i)) for i, c in enumerate(names)}

    out = map_batches(joined, run, docs.schema, rows=500)
    work.drop(keep=1)
    return out

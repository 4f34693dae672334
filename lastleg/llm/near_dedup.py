"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles. Each of the 128 registers
keeps, on an exponential scale (base 1.001) and truncated to 16 bits, the
least of exponentially distributed hash values over the set: registers of two
sets merge by their maximum, and are equal with a chance close to the Jaccard
similarity J. 32 bands of 4 registers give the candidates (a pair at J = 0.8
shares no band with a chance of 5e-8); inside a band J is estimated jointly
from the larger, smaller and equal registers and the two set sizes by maximum
likelihood; what may reach the threshold is verified on the full sets.

No group is expanded into its pairs. Rows with equal sets are one class, which
goes on under a number of its own: an id may have several texts, and each of
them has its own set and links. In a band, the candidates of a class are joined
to a spanning forest of the best estimates; after verification, blocks that
still hold several components are compared once more, all their full sets at
once by a matrix product, and give one link for each two components they join.
Bands with more classes than a block holds are dealt into blocks by a hash
that differs from band to band. Where such a band still holds several
components after that, each class outside its largest component is compared
with every class of the band, cell by cell of two blocks, so no link is lost.

Texts that are null, empty or without words have no set and are linked with
nothing. Repeated rows (one id, equal sets) are one class. Rows of one id with
different texts are documents of their own, linked by their texts alone; each
gets the least id that it reaches. A null id is linked with nothing, its
component is null and it is kept. Long texts are taken whole; empty tables give
no rows. Sets and their sizes are those of 64-bit shingle hashes: two different
shingles of n in a pair of documents are taken for one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import WordHashes, Written, join_by_key, map_batches, mix64, partitions, texts_of, unique_sorted
from lastleg.llm.components import components

REGISTERS, BANDS = 128, 32
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Classes of one band that are compared in one block.
BLOCK = 1024
#: Five deviations of the estimate (0.035 at J = 0.8) under the threshold.
SLACK = 0.17
_GRID = np.arange(0.40, 1.0001, 0.05)

_hashes = WordHashes()
_multipliers = mix64(np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_seeds = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lowered, split at ASCII white space."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    h = _hashes.of(own)
    if len(h) < words:
        return mix64((h * _multipliers[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - words + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        total += h[k : k + n] * _multipliers[k]
    return unique_sorted(mix64(total))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row for each non-empty set."""
    lengths = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    at = 0
    while at < len(sets):
        end = at + 1  # some sets at a time, so that the values stay in cache
        while end < len(sets) and lengths[at:end].sum() + lengths[end] < 20_000:
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.concatenate(([0], np.cumsum(lengths[at : end - 1])))
        for i in range(REGISTERS):
            mixed = (values ^ _seeds[2 * i]) * (_seeds[2 * i + 1] | np.uint64(1))
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0x9FB21C651E98DF25)
            least = np.minimum.reduceat(mixed, starts)
            x = -np.log1p(-(least.astype(np.float64) + 1.0) / 2.0**64 * (1 - 2.0**-53)) / RATE
            out[at:end, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1)
        at = end
    return out


def likely_similarity(above: np.ndarray, below: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood J on a grid, from how many registers of the first set are larger, and smaller."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    share = (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-np.clip(x, 1e-9, 1) * share) / np.log(BASE)

    more, less = chance(u[:, None] - v[:, None] * _GRID), chance(v[:, None] - u[:, None] * _GRID)
    same = np.clip(1 - more - less, 1e-9, 1)
    fit = above[:, None] * np.log(more) + below[:, None] * np.log(less) + (REGISTERS - above - below)[:, None] * np.log(same)
    return _GRID[np.argmax(fit, axis=1)]


def may_link(regs: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Estimates for pairs (i, j); -1 where the sizes alone rule a link out."""
    a, b = regs[i], regs[j]
    n1, n2 = sizes[i].astype(float), sizes[j].astype(float)
    got = likely_similarity((a > b).sum(axis=1), (a < b).sum(axis=1), n1, n2)
    return np.where(np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - 1e-9, got, -1.0)


def block_forest(regs: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of a block's best estimates, and (i, i) for every class that has a likely partner."""
    n, least = len(regs), similarity - SLACK
    estimate = np.full((n, n), -1.0)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        estimate[i, j] = estimate[j, i] = may_link(regs, sizes, np.full(len(j), i), j, similarity)
    yield from ((i, i) for i in np.flatnonzero(estimate.max(axis=1) >= least))
    outside, best, parent = np.ones(n, dtype=bool), np.full(n, -2.0), np.full(n, -1)
    while outside.any():
        i = int(np.argmax(np.where(outside, best, -3.0)))
        if best[i] >= least:
            yield min(i, int(parent[i])), max(i, int(parent[i]))
        outside[i] = False
        closer = outside & (estimate[i] > best)
        best[closer], parent[closer] = estimate[i][closer], i


def shared_counts(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Exact intersection sizes of all sets of a block, by products of their incidence matrices."""
    sizes = [len(x) for x in sets]
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(sets)), sizes), np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[at]
    row, column = row[column >= 0], column[column >= 0]  # what only one set has is in no intersection
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[row[part], column[part] - low] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def block_links(sets: list[np.ndarray], component: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """True links between different components of a block: one for each two that they join."""
    both, sizes = shared_counts(sets), np.array([len(x) for x in sets])
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    label = component.copy()
    for i in range(len(sets)):
        for j in np.flatnonzero(linked[i]):
            if label[j] != label[i]:
                yield i, int(j)
                label[label == label[j]] = label[i]


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batch: pa.RecordBatch):
        sets = [shingle_set(t, words) for t in texts_of(batch)]
        full = [k for k, s in enumerate(sets) if len(s)]
        regs = [None] * len(sets)
        for k, r in zip(full, registers([sets[k] for k in full]), strict=True):
            regs[k] = r.astype("<u2").tobytes()
        whole = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield {"doc_id": batch.column(0), "text_key": batch.column(2), "n_shingles": [len(s) for s in sets], "whole": whole, "regs": regs}

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, "doc_id bigint, text_key bigint, n_shingles bigint, whole binary, regs binary", rows=500)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys from batches that are sorted by key."""
    left: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if left is None else pa.concat_tables([left, now])
        if not now.num_rows:
            continue
        keys = now["key"].to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if whole:
            yield now.slice(0, whole)
        left = now.slice(whole)
    if left is not None and left.num_rows:
        yield left


def _spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal keys. Blocks are dealt evenly by a hash and hold about BLOCK classes; larger ones are taken in parts."""
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))).tolist()
    for start, end in zip(edges, edges[1:], strict=False):
        for at in range(start, end, 2 * BLOCK):
            yield at, min(at + 2 * BLOCK, end)


def _dealt(bands: DataFrame) -> DataFrame:
    return bands.repartition(partitions(bands.sparkSession), "key").sortWithinPartitions("key", "rep")


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    ordered = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in ordered], type=pa.int64()) for k in (0, 1)], names=["a", "b"])


def _candidates(bands: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) to verify from rows (key, rep, n, regs): forests of the best estimates; (a, a) where a has a likely partner."""

    def run(batches):
        for table in _groups(batches):
            regs = np.frombuffer(b"".join(table["regs"].to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            keys, reps, sizes = (table[c].to_numpy() for c in ("key", "rep", "n"))
            spans = list(_spans(keys))
            found: set[tuple[int, int]] = set()
            two = np.array([s for s, e in spans if e - s == 2], dtype=np.int64)
            if len(two):
                for k in two[may_link(regs, sizes, two, two + 1, similarity) >= similarity - SLACK]:
                    a, b = int(reps[k]), int(reps[k + 1])
                    found |= {(a, a), (b, b), (min(a, b), max(a, b))}
            for s, e in spans:
                if e - s > 2:
                    for i, j in block_forest(regs[s:e], sizes[s:e], similarity):
                        a, b = int(reps[s + i]), int(reps[s + j])
                        found.add((min(a, b), max(a, b)))
            yield _pair_batch(found)

    return _dealt(bands).mapInArrow(run, "a bigint, b bigint").distinct()


def _links_across(bands: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that the forests have missed, from rows (key, rep, component, members) of blocks with several components."""
    percent = round(100 * similarity)

    def run(batches):
        for table in _groups(batches):
            keys, reps, comps = (table[c].to_numpy() for c in ("key", "rep", "component"))
            found = set()
            for s, e in _spans(keys):
                sets = [np.frombuffer(x, dtype="<u8") for x in table["members"].slice(s, e - s).to_pylist()]
                for i, j in block_links(sets, comps[s:e], percent):
                    a, b = int(reps[s + i]), int(reps[s + j])
                    found.add((min(a, b), max(a, b)))
            yield _pair_batch(found).rename_columns(["u", "v"])

    return _dealt(bands).mapInArrow(run, "u bigint, v bigint").distinct()


def _cells(large: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, rep, component, outside): cells in which each class outside its band's largest component meets all classes of the band.

    ``large`` holds (band, size, rep). Both sides are dealt into parts of half a
    block by a hash, so no task holds a band. Bands of one component give none.
    """
    marked = large.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = marked.groupBy("band", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"))
    mixed = marked.join(most, "band").where(F.col("most.n") < F.col("size")).withColumn("outside", F.col("component") != F.col("most.component"))
    half = BLOCK // 2
    parts, parts_out = F.ceil(F.col("size") / half), F.ceil((F.col("size") - F.col("most.n")) / half)
    own, own_out = (F.pmod(F.xxhash64("rep", "band", F.lit(side)), n) for side, n in enumerate((parts, parts_out)))
    columns = ["rep", "component", "outside"]
    every = mixed.select("band", *columns, own.alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts_out - 1)).alias("q")).withColumn("outside", F.lit(False))
    outer = mixed.where("outside").select("band", *columns, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("p"), own_out.alias("q"))
    return every.unionByName(outer).select(F.xxhash64("band", "p", "q").alias("key"), *columns)


def _likely_ends(cells: DataFrame, similarity: float) -> DataFrame:
    """Ids of the classes in likely pairs of two components, from rows (key, rep, component, outside, n, regs)."""

    def run(batches):
        for table in _groups(batches):
            regs = np.frombuffer(b"".join(table["regs"].to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            keys, reps, sizes, comps, outside = (table[c].to_numpy() for c in ("key", "rep", "n", "component", "outside"))
            found: set[int] = set()
            for s, e in _spans(keys):
                for i in np.flatnonzero(outside[s:e]) + s:
                    j = np.flatnonzero(comps[s:e] != comps[i]) + s
                    if len(j):
                        j = j[may_link(regs, sizes, np.full(len(j), i), j, similarity) >= similarity - SLACK]
                    if len(j):
                        found.add(int(reps[i]))
                        found.update(reps[j].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), type=pa.int64())], names=["rep"])

    return _dealt(cells).mapInArrow(run, "rep bigint").distinct()


def _full_sets(plain: DataFrame, ends: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(rep, members) of the classes whose numbers ``ends`` (rep) names."""

    def run(batch: pa.RecordBatch):
        reps, whole = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rep", "whole"))
        rep, members = [], []
        for number, text, key in zip(reps, texts_of(batch), whole, strict=True):
            own = shingle_set(text, words).astype("<u8").tobytes()
            if xxhash.xxh3_128_digest(own) == key:  # a repeated id may have other texts too
                rep.append(number)
                members.append(own)
        yield {"rep": rep, "members": members}

    named = ends.join(classes.select("rep", "least_id", "text_key", "whole"), "rep").withColumnRenamed("least_id", "doc_id")
    texts = plain.withColumn("text_key", F.xxhash64("text")).join(named, ["doc_id", "text_key"])
    return map_batches(texts.select("rep", "text", "whole"), run, "rep bigint, members binary", rows=500)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    percent = round(100 * similarity)
    first, second = (sets.select(F.col("rep").alias(x), F.col("members").alias(f"set_{x}")) for x in "ab")

    def run(batch: pa.RecordBatch):
        a, b, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "set_a", "set_b"))
        linked = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * both >= percent * (len(p) + len(q) - both))
        yield {"u": [i for i, k in zip(a, linked, strict=True) if k], "v": [i for i, k in zip(b, linked, strict=True) if k]}

    return map_batches(pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b"), run, "u bigint, v bigint", rows=500)


def _resolved(docs: DataFrame, work: Written, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, root, component_id) for every row: root numbers the component, null without a set or an id."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = work.table(_sketches(plain, words), "sketches")
    own_set = sketches.where("whole is not null and doc_id is not null").groupBy("whole")
    least = F.min(F.struct("doc_id", "text_key"))
    classes = own_set.agg(least.alias("least"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("n_rows"))
    # an id may have several texts, so classes are numbered; the numbers are fixed once they are written
    columns = ["whole", F.col("least.doc_id").alias("least_id"), F.col("least.text_key").alias("text_key"), "n", "regs", "n_rows"]
    classes = work.table(classes.select(F.monotonically_increasing_id().alias("rep"), *columns), "classes")

    width = 2 * REGISTERS // BANDS
    keys = classes.select("rep", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {width} + 1, {width})))")).alias("key"))
    shared = work.table(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("n_rows", F.col("size")), "bands")
    # a band with more classes than a block holds is dealt into blocks, in another way for each band
    block = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("size") / BLOCK))).otherwise(0)
    band = F.when(F.col("size") > BLOCK, F.col("key"))
    met = join_by_key(keys, shared, ["key"], BANDS * classes.count())
    dealt = work.table(met.select(F.xxhash64("key", block).alias("key"), "rep", band.alias("band"), "size"), "members")
    members, large = dealt.select("key", "rep"), dealt.where("band is not null").select("band", "size", "rep")
    with_regs = members.join(classes.select("rep", "n", "regs"), "rep")

    found = work.table(_candidates(with_regs, similarity), "candidates")
    ends = found.where("a = b").select(F.col("a").alias("rep")).distinct()
    sets = work.table(_full_sets(plain, ends, classes, words), "sets")
    if sets.count() > sets.select("rep").distinct().count():  # rows that repeat an id and its text
        sets = work.table(sets.dropDuplicates(["rep"]), "sets")

    links = work.table(_verified(found.where("a <> b"), sets, similarity), "links")
    linked = work.table(components(links, work), "components")
    apart = members.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = apart.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    # classes without a likely partner have no set here and drop out
    again = apart.join(mixed, "key").join(sets, "rep").select("key", "rep", "component", "members")
    more = work.table(_links_across(again, similarity), "links")
    if more.limit(1).count():
        links = links.unionByName(more)
        linked = work.table(components(links, work), "components")

    if large.limit(1).count():
        cells = work.table(_cells(large, linked), "cells")
        ends = work.table(_likely_ends(cells.join(classes.select("rep", "n", "regs"), "rep"), similarity), "ends")
        if ends.limit(1).count():
            lacking = ends.join(sets.select("rep"), "rep", "left_anti")
            both = sets.join(ends, "rep", "left_semi").unionByName(_full_sets(plain, lacking, classes, words).dropDuplicates(["rep"]))
            across = work.table(_links_across(cells.drop("outside").join(both, "rep").select("key", "rep", "component", "members"), similarity), "links")
            if across.limit(1).count():
                linked = work.table(components(links.unionByName(across), work), "components")

    placed = classes.select("whole", "rep", "least_id", "n_rows").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    first = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n_rows").alias("n_root"), F.count("*").alias("n_rows"))
    first = work.table(first, "first")
    total = sketches.count()
    of_class = work.table(join_by_key(placed.select("whole", "root", F.col("n_rows").alias("n_class")), first.drop("n_root"), ["root"], total).withColumnRenamed("n_class", "n_rows"), "placed")
    rows = join_by_key(sketches.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("whole")).alias("whole")), of_class, ["whole"], total, "left")
    return work.table(rows.select("doc_id", "text_key", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id")), "result")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    work = Written(docs.sparkSession)
    rows = _resolved(docs, work, words, similarity, id_col, text_col)
    work.drop(keep=1)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component.

    That is a row of the component's least id (of several texts of that id, the
    one of the least text hash). Rows without words, or with a null id, all
    stay, but for rows that repeat an id and its text, which stay once.
    """
    work = Written(docs.sparkSession)
    rows = _resolved(docs, work, words, similarity, "doc_id", "text")
    alone = rows.where("root is null and doc_id is not null").select(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key"))
    one = rows.where("root is not null and doc_id = component_id").groupBy("root", F.col("doc_id").alias("__kept_id")).agg(F.min("text_key").alias("__kept_key")).select("__kept_id", "__kept_key")
    kept = work.table(alone.unionByName(one).distinct(), "kept")
    work.drop(keep=1)
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("__text_key", F.xxhash64("text"))
    named = named.join(kept, (F.col("doc_id") == F.col("__kept_id")) & (F.col("__text_key") == F.col("__kept_key")), "left_semi")
    return named.dropDuplicates(["doc_id", "__text_key"]).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))

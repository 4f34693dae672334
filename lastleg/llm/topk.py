"""Exact top-k inner products by distributed histogram selection.

Every query block is scored against every candidate block as one integer
matrix product. Score histograms per query are summed over all blocks and
refined round by round: each round cuts the bin that holds the kth highest
score into ``bins`` finer ones, until a bin is one score wide. The last pass
scores again, keeps what reaches the query's kth score and breaks ties by the
smaller id; a block never gives more than k rows for a query, so equal vectors
in any number stay cheap.

Query blocks meet candidate blocks by an equi-join on (query block, lane):
nothing is broadcast or collected, and a block's size is fixed.

Components become floor(1024 * x) as bigint. Vectors that are null, empty,
hold a null or a non-finite component, or have a null id take no part. A
vector is compared only with those of its own length. Rows are numbered, and
only the query's own row is left out: another row with its id or its vector is
a candidate. Each row of a repeated query id is a query of its own, so that id
has as many answers. Empty tables give no rows. Scores must fit into 63 bits;
where components are so large that they might not, the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastleg.llm.common import Written, map_batches, partitions

QUERY_BLOCK, CANDIDATE_BLOCK, BINS = 256, 4096, 1024
#: Blocks of candidates for each task, on average, so that no task goes without.
LANES = 4
#: Largest magnitude for which a product of float64 matrices is exact, and for which one of bigints doesn't wrap.
EXACT, WHOLE = float(1 << 53), float(1 << 62)

BLOCK = "dims int, width int, rows binary, ids binary, vectors binary"


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of (row, id, array<bigint>) as blocks of one length of vector, in the least integer width that holds them."""

    def run(batch: pa.RecordBatch):
        numbers, ids = (np.array(batch.column(k).to_pylist(), dtype="<i8") for k in (0, 1))
        lists = batch.column(2)
        lengths = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
        starts = np.concatenate(([0], np.cumsum(lengths)))
        for dims in np.unique(lengths):
            own = np.flatnonzero(lengths == dims)
            block = values[(starts[own][:, None] + np.arange(dims)).ravel()]
            width = next(w for w in (2, 4, 8) if w == 8 or (-(1 << (8 * w - 1)) <= block.min() and block.max() < 1 << (8 * w - 1)))
            yield {"dims": [int(dims)], "width": [width], "rows": [numbers[own].tobytes()], "ids": [ids[own].tobytes()], "vectors": [block.astype(f"<i{width}").tobytes()]}

    return map_batches(vectors, run, BLOCK, rows=rows)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the queries, row numbers and ids of the candidates, and all scores."""
    q, c = (np.frombuffer(row[f"{k}_vectors"], dtype=f"<i{row[f'{k}_width']}").reshape(-1, row["dims"]).astype(np.float64) for k in "qc")
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * row["dims"]
    if bound < EXACT:
        product = (q @ c.T).astype(np.int64)
    elif bound < WHOLE:
        whole = [np.frombuffer(row[f"{k}_vectors"], dtype=f"<i{row[f'{k}_width']}").reshape(-1, row["dims"]).astype(np.int64) for k in "qc"]
        product = whole[0] @ whole[1].T
    else:
        raise ValueError("components are too large: scores may not fit into 63 bits")
    return (*(np.frombuffer(row[k], dtype="<i8") for k in ("q_rows", "c_rows", "c_ids")), product)


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    work = Written(spark)
    # without comparing: a component may be null or NaN, and then the vector takes no part
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    plain = plain.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & sound)
    plain = plain.select("id", F.transform("vector", lambda x: F.floor(x * 1024.0).cast("bigint")).alias("vector"))
    # the numbers of rows are fixed once they are written
    stored = work.table(plain.select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "vectors")

    # few rows make few blocks: a query's block meets every candidate block
    n, asked = stored.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    lanes = max(1, min(LANES * partitions(spark), max(partitions(spark), n // CANDIDATE_BLOCK)))
    query_blocks = _blocks(stored.where(F.col("id") % every == 0).repartition(max(1, min(partitions(spark), asked // QUERY_BLOCK)), "row"), QUERY_BLOCK)
    named = lambda x: ["dims", *(F.col(c).alias(f"{x}_{c}") for c in ("width", "rows", "ids", "vectors"))]
    query_blocks = work.table(query_blocks.select(F.monotonically_increasing_id().alias("block"), *named("q")), "queries")
    lane = F.pmod(F.xxhash64("c_rows"), F.lit(lanes))
    candidates = _blocks(stored, CANDIDATE_BLOCK).select(*named("c")).withColumn("lane", lane)
    # every candidate block goes to the lane of its hash; every query block goes to all lanes
    pairs = candidates.join(query_blocks.drop("q_ids").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("lane", F.col("lane").cast("bigint")), ["lane", "dims"])

    def summed(low_width: DataFrame | None) -> DataFrame:
        """Counts of scores by bin; a task leaves out the bins below those that hold its own k highest."""
        with_bounds = pairs if low_width is None else pairs.join(low_width, "block")

        def run(batch: pa.RecordBatch):
            for row in _dicts(batch):
                q_rows, c_rows, _, scores = _scores(row)
                lows, widths = (np.frombuffer(row[x], dtype="<i8") for x in ("lows", "widths")) if "lows" in row else (None, None)
                query, at, count = [], [], []
                for i in range(len(q_rows)):
                    own = scores[i][c_rows != q_rows[i]]
                    if not len(own):  # the block holds the query alone
                        continue
                    if lows is None:
                        place = own >> 20
                    else:
                        own = own[own >= lows[i]]
                        if not len(own):
                            continue
                        place = np.minimum((own - lows[i]) // widths[i], bins)
                    bin_at, n = np.unique(place, return_counts=True)
                    above = np.concatenate((np.cumsum(n[::-1])[::-1][1:], [0]))
                    keep = above < k
                    query += [int(q_rows[i])] * int(keep.sum())
                    at += bin_at[keep].tolist()
                    count += n[keep].tolist()
                yield {"block": [row["block"]] * len(query), "query": query, "bin": at, "n": count}

        return map_batches(with_bounds, run, "block bigint, query bigint, bin bigint, n bigint").groupBy("block", "query", "bin").agg(F.sum("n").alias("n"))

    # round 0: bins of 2^20 scores, whatever their range; then each round cuts the kth score's bin into ``bins``
    found, low, width = summed(None), F.col("bin") * (1 << 20), 1 << 20
    while True:
        order = Window.partitionBy("block", "query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        total = Window.partitionBy("block", "query")
        reach = found.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(total)).where((F.col("upto") >= k) | (F.col("upto") == F.col("all")))
        kth = work.table(reach.groupBy("block", "query").agg(F.max(low).alias("low")), "bounds")
        if width == 1:
            break
        step = max(1, width // bins)
        # each query's lower bound, in the order of its block
        packed = query_blocks.select("block", "q_rows").join(kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query", "low"))).alias("low")), "block")
        bounds = work.table(map_batches(packed, _bound_rows(step), "block bigint, lows binary, widths binary"), "bounds")
        found = summed(bounds).join(kth, ["block", "query"])
        low, width = F.col("low") + F.col("bin") * step, step

    packed = query_blocks.select("block", "q_rows").join(kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query", "low"))).alias("low")), "block")
    bounds = work.table(map_batches(packed, _bound_rows(1), "block bigint, lows binary, widths binary"), "bounds")

    def kept(batch: pa.RecordBatch):
        for row in _dicts(batch):
            q_rows, c_rows, c_ids, scores = _scores(row)
            lows = np.frombuffer(row["lows"], dtype="<i8")
            query, ids, value = [], [], []
            for i in range(len(q_rows)):
                at = np.flatnonzero((scores[i] >= lows[i]) & (c_rows != q_rows[i]))
                at = at[np.lexsort((c_ids[at], -scores[i][at]))[:k]]
                query += [int(q_rows[i])] * len(at)
                ids += c_ids[at].tolist()
                value += scores[i][at].tolist()
            yield {"query": query, "vec_id": ids, "score": value}

    best = map_batches(pairs.join(bounds, "block"), kept, "query bigint, vec_id bigint, score bigint")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    named_rows = stored.where(F.col("id") % every == 0).select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    out = work.table(best.join(named_rows, "query").select("query_id", "rank", "vec_id", "score"), "result")
    work.drop(keep=1)
    return out


def _bound_rows(step: int):
    def run(batch: pa.RecordBatch):
        for block, ids, low in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            by_query = dict(low)
            # a query without any candidate has no bound; nothing reaches it
            lows = [by_query.get(int(q), np.iinfo(np.int64).max) for q in np.frombuffer(ids, dtype="<i8")]
            yield {"block": [block], "lows": [np.array(lows, dtype="<i8").tobytes()], "widths": [np.full(len(lows), step, dtype="<i8").tobytes()]}

    return run

"""Approximate nearest neighbours by learned partitions (operator 4).

A neighbour graph of a bounded sample is cut into balanced partitions, a softmax classifier learns each
sample vector's partition from the vector, and routes every vector to its most probable partition and
each query to several. Routed queries are reranked exactly. A partition is stored in blocks of bounded
size, so that one with most of the rows (copies of a vector) is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Vectors that the graph and the classifier are fitted to: about this many, evenly by a hash of the id.
SAMPLE = 8_000
PARTITIONS, PROBES, NEIGHBOURS = 16, 12, 10
#: Vectors of a block, and queries that are held against a block at once.
BLOCK, QUERIES = 16_384, 2_048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row with other rows, as indices."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15) -> np.ndarray:
    """Assigns the graph's nodes to parts of at most 10 % over the mean, few edges between parts.

    Starts from balanced cuts along principal axes; then nodes move to the part that most of their
    neighbours are in, largest gain first, while that part has room."""
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        g = groups.pop()
        y = x[g] - x[g].mean(axis=0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        order = g[np.argsort(y @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, g in enumerate(groups):
        label[g] = i
    room = int(np.ceil(1.1 * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[graph[:, j]]), 1)
            np.add.at(votes, (graph[:, j], label), 1)
        best = votes.argmax(axis=1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit_router(x: np.ndarray, label: np.ndarray, parts: int, rounds: int = 150, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """A softmax classifier (weights, bias) of the partitions, by Adam on soft targets."""
    scale = 1 / max(float(np.sqrt((x * x).sum(axis=1).mean())), 1e-12)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    target = np.eye(parts)[label]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    y = x * scale
    for k in range(1, rounds + 1):
        z = y @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
        for q, grad, (m, v) in ((w, y.T @ g, state[0]), (b, g.sum(axis=0), state[1])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            q -= rate * 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-12)
    return w * scale, b


def valid(table: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v array<double>) of rows whose vector takes part: id and vector not null, not empty, all
    components finite, not all zero, and of the commonest length (the shortest of several)."""
    v = F.col(column).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def search(table: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20, parts: int = PARTITIONS, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (id divisible by every) among all
    other rows, by inner product in double precision, ties to the smaller id.

    Vectors that are null, empty, zero, of another length or with null or non-finite components take no
    part. Rows of equal id count apart, and none is a candidate of a query with that id. An empty table
    gives an empty result. Queries are held against blocks of the partitions they are routed to."""
    spark = table.sparkSession
    common.prepare(spark)
    rows = common.stored(valid(table, key, column), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    chosen = rows if n <= sample else rows.where(F.shiftrightunsigned(F.xxhash64("id"), 32) < int(sample / n * (1 << 32)))
    x = np.array([r["v"] for r in chosen.orderBy("id").select("v").collect()], np.float64)
    parts = max(1, min(parts, len(x) // 8))
    label = balanced_partition(x, neighbour_graph(x, NEIGHBOURS), parts) if parts > 1 else np.zeros(len(x), np.int64)
    router = spark.sparkContext.broadcast(fit_router(x, label, parts))  # dimension x parts numbers
    probes = min(probes, parts)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = router.value
        for pdf in batches:
            if len(pdf):
                z = np.stack(pdf["v"].to_numpy()) @ w + b
                order = np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32)
                pdf["parts"] = list(order)
                yield pdf

    routed = common.stored(rows.mapInPandas(route, "id long, v array<double>, parts array<int>"), "routed")
    counts = routed.groupBy(F.col("parts")[0].alias("part")).count().collect()  # at most `parts` rows
    blocks = {r["part"]: -(-r["count"] // BLOCK) for r in counts}
    n_queries = routed.where(F.col("id") % every == 0).count()
    groups = max(1, -(-n_queries // QUERIES))
    table_of = F.create_map(*[F.lit(v) for p, m in sorted(blocks.items()) for v in (p, m)])
    spread = F.xxhash64("id", "v")
    base = routed.select("id", "v", F.col("parts")[0].alias("part"), F.lit(False).alias("query"), spread.alias("h"))
    base = base.withColumn("block", F.pmod("h", table_of[F.col("part")]).cast("int"))
    base = base.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = routed.where(F.col("id") % every == 0).select("id", "v", F.explode("parts").alias("part"), F.lit(True).alias("query"), F.shiftright(spread, 8).alias("h"))
    asked = asked.where(F.col("part").isin(list(blocks))).withColumn("block", F.explode(F.sequence(F.lit(0), table_of[F.col("part")] - 1)))
    asked = asked.withColumn("group", F.pmod("h", F.lit(groups)).cast("int"))

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id", kind="stable")
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        a, b, ids = np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy()), c["id"].to_numpy()
        # BLAS adds in another order than the exact scores; sums of d products differ by less than this
        margin = 4 * np.finfo(float).eps * a.shape[1] * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
        out = []
        for i in range(0, len(a), 256):
            s = a[i : i + 256] @ b.T
            s[q["id"].to_numpy()[i : i + 256, None] == ids[None, :]] = -np.inf
            if s.shape[1] > k:  # all that reach the k-th score, so that ties are settled by id
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None] - margin[i : i + 256, None]
                r, col = np.nonzero((s >= least) & (s > -np.inf))
            else:
                r, col = np.nonzero(s > -np.inf)
            exact = np.einsum("ij,ij->i", a[i : i + 256][r], b[col])
            found = pd.DataFrame({"query_id": q["id"].to_numpy()[i : i + 256][r], "vec_id": ids[col], "score": exact, "row": r})
            out.append(found.sort_values(["row", "score", "vec_id"], ascending=[True, False, True]).groupby("row").head(k))
        return pd.concat(out)[["query_id", "vec_id", "score"]]

    found = base.select("id", "v", "query", "part", "block", "group").unionByName(asked.select("id", "v", "query", "part", "block", "group"))
    found = found.groupBy("part", "block", "group").applyInPandas(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

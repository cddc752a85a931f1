"""MinHash near-dedup by DartMinHash (operator 2).

Each element of a weighted set (a document's shingles) throws darts: points of a unit-rate Poisson process
in its region, weight by rank, drawn from the element's hash alone, each falling on one of the
signature's coordinates. A document keeps the darts below its elements' weights, and at each coordinate
the one of lowest rank. Two documents agree at a coordinate with the probability of their weighted Jaccard
similarity. The expected number of darts is about n + k log k, not n * k.

Equal texts form one class at once. Texts that share a band of coordinates meet in a bucket. First each text
is held against one other, the least text of all its buckets, so that a group of near copies costs one
comparison for each member. Buckets whose members are then in one component are done. The texts of all other
buckets form coarse groups, in which all similarities are exact, from sparse products over shingles that at
least two members have, in blocks of bounded size, and only a spanning forest of the links at or above the
threshold leaves a task. Classes are the connected components of all links. Every pair of texts that share a
bucket is thus either compared or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair misses all bands with probability (1 - 0.8**ROWS)**BANDS = 2e-5.
BANDS, ROWS = 36, 6
#: A block holds about this many documents and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1_000, 1_500_000
#: Texts that are held against one text in a task, about.
STAR_DOCS = 250
_TAIL = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 16)))))  # P(Poisson(1) <= i)
_RANK_BITS, _MARK_BITS = 42, 22


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(elements: np.ndarray, weights: np.ndarray | None, doc: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc * k + coordinate, packed rank and mark) of every dart of rank below its document's limit that
    falls below its element's weight. Weight regions are [0, 1), [1, 2), [2, 4), ...; in a region of width
    w the cells of the process are 1 / w long in rank, so each has one dart on average."""
    slots, packed = [], []
    top = 1.0 if weights is None else max(1.0, float(weights.max(initial=1.0)))
    for region in range(1 + int(np.ceil(np.log2(top)))):
        low, width = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0 ** (region - 1))
        some = np.arange(len(elements)) if weights is None else np.flatnonzero(weights > low)
        cells = np.ceil(limit[doc[some]] * width).astype(np.int64)
        who = np.repeat(some, cells)
        cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = common.mix(elements[who] ^ common.mix(cell.astype(np.uint64), region), 1)
        darts = np.searchsorted(_TAIL, _uniform(seed), side="right")
        at = np.repeat(np.arange(len(who)), darts)
        order = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        h = common.mix(seed[at] + order.astype(np.uint64), 2)
        rank = (cell[at] + _uniform(h)) / width
        own = doc[who[at]]
        ok = rank < limit[own]
        if weights is not None:
            ok &= low + width * _uniform(common.mix(h, 3)) < weights[who[at]]
        h, rank, own = h[ok], rank[ok], own[ok]
        g = common.mix(h, 4)
        slots.append(own * k + (g % np.uint64(k)).astype(np.int64))
        packed.append((np.minimum(rank * 2.0**30, 2.0**_RANK_BITS - 1).astype(np.uint64) << np.uint64(_MARK_BITS)) | (g >> np.uint64(64 - _MARK_BITS)))
    return np.concatenate(slots), np.concatenate(packed)


def signatures(elements: np.ndarray, sizes: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signature (k values) of each document; elements are distinct in a document, documents lie one after
    another. Documents without elements have all ones. weights: of each element, 1 if None."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    total = sizes.astype(np.float64) if weights is None else np.bincount(doc, weights, n)
    out = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    limit = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-9), 0.0)
    todo = np.ones(len(elements), bool)
    while todo.any():
        slot, value = _throw(elements[todo], None if weights is None else weights[todo], doc[todo], limit, k)
        np.minimum.at(out, slot, value)
        lacking = (out.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1) & (total > 0)
        limit = np.where(lacking, limit * 2, limit)
        todo = lacking[doc]
    return out.reshape(n, k)


def _distinct(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, sizes, counts) with each document's repeats gone."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((elements, doc))
    e, d = elements[order], doc[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return e[new], np.bincount(d[new], minlength=len(sizes)), np.diff(np.append(first, len(e)))


def text_key(text: str = "text") -> Column:
    """128-bit hash of a text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """doc_id, text_key, n_shingles, keys (a hash for each band) of rows (doc_id, text) with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_slices(batches, 1 << 20):
            shingles, sizes = common.shingle_hashes(texts, SHINGLE)
            keep = [i for i, n in enumerate(sizes.tolist()) if n]
            elements, sizes, counts = _distinct(shingles, sizes)
            sizes = sizes[keep]
            keys = []
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            for first in range(0, len(keep), 256):
                part = slice(bounds[first], bounds[min(first + 256, len(keep))])
                s = signatures(elements[part], sizes[first : first + 256], bands * rows, counts[part].astype(float) if weighted else None).reshape(-1, bands, rows)
                key = np.full(s.shape[:2], 7, np.uint64) + np.arange(bands, dtype=np.uint64)[None, :]
                for r in range(rows):
                    key = common.mix(key ^ s[:, :, r], r)
                keys += key.view(np.int64).tolist()
            yield pa.record_batch([pa.array([ids[i]["doc_id"] for i in keep], pa.int64()), pa.array([ids[i]["text_key"] for i in keep], pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "keys"])

    return docs.select(F.struct("doc_id", text_key().alias("text_key")).alias("id"), "text").mapInArrow(run, "doc_id long, text_key binary, n_shingles long, keys array<long>")


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component.

    Alternates large-star and small-star steps, each a partial aggregate and a join, stored in shared
    storage, until nothing changes; rounds grow with the logarithm of the size."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    e = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        pairs = both(e)
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = pairs.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(small_min, F.col("a") == F.col("k"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, e = e, common.stored(small, name)
        common.discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        # a forest of stars: each node has one parent, and no parent has a parent
        if now[0] == now[2] and (now == before or e.join(e.select(F.col("a").alias("p")), F.col("b") == F.col("p"), "left_semi").isEmpty()):
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def verified(texts: list[str], weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each text and their number: its shingles or, weighted, a shingle's first, second ...
    occurrence, so that the Jaccard similarity of these sets is that of the counts."""
    shingles, sizes = common.shingle_hashes(texts, SHINGLE)
    elements, sizes, counts = _distinct(shingles, sizes)
    if not weighted:
        return elements, sizes
    turn = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return common.mix(np.repeat(elements, counts) ^ common.mix(turn.astype(np.uint64), 11), 12), np.bincount(doc, counts, len(sizes)).astype(np.int64)


def links_to_first(texts: list[str], threshold: float = THRESHOLD, weighted: bool = False) -> np.ndarray:
    """Whether each text but the first has a similarity of at least threshold to the first."""
    elements, sizes = verified(texts, weighted)
    first, rest = np.sort(elements[: sizes[0]]), elements[sizes[0] :]
    at = np.minimum(np.searchsorted(first, rest), max(len(first) - 1, 0))
    shared = (first[at] == rest) if len(first) else np.zeros(len(rest), bool)
    both = np.bincount(np.repeat(np.arange(len(texts) - 1), sizes[1:]), shared, len(texts) - 1)
    union = sizes[0] + sizes[1:] - both
    return (both > 0) & (both >= threshold * union - 1e-6 * union)


def links_in_block(ids: list[int], texts: list[str], side: np.ndarray | None, threshold: float = THRESHOLD, weighted: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links at or above threshold, and each document's number of links.

    side: False and True for the documents of two blocks, between which links are sought; None: among all."""
    n = len(ids)
    elements, sizes = verified(texts, weighted)
    doc = np.repeat(np.arange(n), sizes)
    _, column, df = np.unique(elements, return_inverse=True, return_counts=True)
    if side is None:
        shared = df[column] > 1
    else:
        a = np.zeros(len(df), bool)
        b = np.zeros(len(df), bool)
        a[column[~side[doc]]] = True
        b[column[side[doc]]] = True
        shared = (a & b)[column]
    doc, column = doc[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    left = np.arange(n) if side is None else np.flatnonzero(~side)
    right = np.arange(n) if side is None else np.flatnonzero(side)
    common_count = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(n, np.int64)
    place[left] = np.arange(len(left))
    if side is not None:
        place[right] = np.arange(len(right))
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    step = max(256, (1 << 22) // max(n, 1))
    for first in range(0, width, step):
        lo, hi = np.searchsorted(column, [first, first + step])
        d, c = doc[lo:hi], column[lo:hi] - first
        m = np.zeros((n, min(step, width - first)), np.float32)
        m[d, c] = 1
        common_count += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common_count
    linked = common_count >= threshold * union - 1e-6 * union
    linked &= common_count > 0
    if side is None:
        np.fill_diagonal(linked, False)
    degree = np.zeros(n, np.int64)
    degree[left] += linked.sum(axis=1)
    if side is not None:
        degree[right] += linked.sum(axis=0)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    # breadth-first over rows, so that at most n - 1 pairs are looked at twice
    root = np.arange(n)
    for i in range(len(left)):
        near = right[linked[i]]
        for j in near[root[near] != root[left[i]]].tolist() if len(near) else []:
            x, y = find(int(left[i])), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((ids[int(left[i])], ids[j]))
        if len(near):
            root[near] = root[left[i]] = find(int(left[i]))
    return forest, degree


def _lone() -> Column:
    """Rows without words."""
    return F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """doc_id, class_id, copies of every row of docs (doc_id, text; other columns are ignored).

    class_id: least doc_id of the documents connected by links, which are equal texts or pairs whose sets
    of shingles (five lower-cased words; fewer words: all of them) have a Jaccard similarity of at least
    threshold; with weighted, shingles count as often as they occur, in the signatures and in the similarity.
    copies: rows with this text. Rows without words (null, empty, white space) and rows of null id are classes
    of their own. Rows of equal id and text are copies; rows of equal id with different texts have the class of
    their text each, and two classes may have the same least doc_id. An empty table gives an empty result."""
    base = docs.select(F.col("doc_id").cast("long"), "text")
    out = text_classes(docs, threshold, bands, rows, weighted).select("doc_id", "class_id", "copies")
    alone = base.where(_lone() | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return out.unionByName(alone)


def first_of_classes(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that near-duplicates leave: of each class a row of the least doc_id, of its
    texts the one of least hash. Rows without words stay, once for each id and text. Rows of null id stay."""
    kept = text_classes(docs).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.*")
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn("text_key", text_key())
    found = keyed.where(~_lone()).join(kept, ["doc_id", "text_key"], "left_semi").unionByName(keyed.where(_lone()))
    return found.dropDuplicates(["doc_id", "text_key"]).select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """doc_id, text_key, root (a number of the class), class_id, copies of rows with an id and a word.

    Each distinct text (by its 128-bit text_key) is a node of its own, numbered when the table of texts is stored."""
    spark = docs.sparkSession
    common.prepare(spark)
    base = docs.select(F.col("doc_id").cast("long"), "text")
    table = common.stored(sketch(base.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()), bands, rows, weighted), "sketch")
    texts = table.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    texts = common.stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    # the representative's keys; rows of equal id and text have the same
    reps = table.join(texts.select("node", "rep", texts["text_key"].alias("_key")), (F.col("text_key") == F.col("_key")) & (F.col("doc_id") == F.col("rep"))).select("node", "keys")
    banded = common.stored(reps.select("node", F.posexplode("keys").alias("band", "key")), "bands")
    first = banded.groupBy("band", "key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").drop("last")
    shared = common.stored(banded.join(first, ["band", "key"]).select("band", "key", "node", "first"), "buckets")
    common.discard(banded)

    def with_text(members: DataFrame) -> DataFrame:
        """members (node, ...) with rep and text of each node; each text travels once for each of its rows."""
        known = members.join(texts.select("node", "rep", "text_key"), "node")
        return base.withColumn("_key", text_key()).join(known, (F.col("doc_id") == F.col("rep")) & (F.col("_key") == F.col("text_key"))).select("text", *members.columns)

    def dealt(members: DataFrame, key: str, most: int) -> DataFrame:
        """members with blocks: in how many blocks their group is cut, by its texts and its shingles."""
        sized = members.join(texts.select("node", "n_shingles"), "node")
        groups = sized.groupBy(key).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
        return members.join(groups.select(key, F.ceil(F.greatest(F.col("n") / most, F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks")), key)

    # each text and the least text of its buckets
    stars = shared.where("node <> first").groupBy("node").agg(F.min("first").alias("centre"))
    stars = dealt(stars, "centre", STAR_DOCS).select("node", "centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    stars = common.stored(stars, "stars")
    centres = stars.select(F.col("centre").alias("node"), "centre", "block").distinct()

    def star(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        pdf = pd.concat([pdf[pdf["node"] == pdf["centre"]], pdf[pdf["node"] != pdf["centre"]]])
        linked = pdf[1:][links_to_first(pdf["text"].tolist(), threshold, weighted)] if len(pdf) > 1 else pdf[:0]
        return pd.DataFrame({"a": linked["node"], "b": linked["centre"]}).astype("int64")

    links = common.stored(with_text(stars.unionByName(centres)).groupBy("centre", "block").applyInPandas(star, "a long, b long"), "links")
    classes = connected_components(links, "classes")

    # buckets whose texts are in several components, and their texts in coarse groups
    rooted = shared.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band", "key")
    edges = shared.join(mixed, ["band", "key"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    coarse = common.stored(connected_components(edges, "coarse"), "coarse")
    members = dealt(coarse, "root", BLOCK_DOCS).select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # a row for each pair of blocks that its block is in: (block, j) and (i, block)
    spread = with_text(members).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("node", "text", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").drop_duplicates("node")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        forest, _ = links_in_block(pdf["node"].tolist(), pdf["text"].tolist(), None if i == j else (pdf["block"] == j).to_numpy(), threshold, weighted)
        return pd.DataFrame({"a": [x for x, _ in forest], "b": [y for _, y in forest]}).astype("int64")

    found = spread.groupBy("root", "i", "j").applyInPandas(run, "a long, b long")
    more = classes.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    classes = connected_components(more.unionByName(found), "classes")
    by_text = texts.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_text.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_text = by_text.join(least, "root").select("text_key", "root", "class_id", "copies")
    return table.select("doc_id", "text_key").join(by_text, "text_key").select("doc_id", "text_key", "root", "class_id", "copies")

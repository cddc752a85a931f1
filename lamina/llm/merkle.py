"""Merkle manifest of a dataset (operator 11), with a DuckDB engine for blocks inside Spark's tasks.

Each row is a leaf, a SHA-256 of its fields. The leaves of a group are numbered in order and dealt to aligned buckets
of FANOUT**DEPTH, so that no run of siblings crosses one. An executor takes buckets as Arrow tables and runs, level by
level, an ordered string_agg and sha256 in DuckDB; a bucket becomes its root. Bucket roots are the nodes of the next
tier, which is dealt and folded in the same way until each group has one root; these form tiers of their own up to the
root of the dataset. On the way back the paths of a tier are joined to the buckets below it, where DuckDB cuts the
siblings of every node out of the strings of its runs. No task has more than whole buckets of bounded size.

A path is a list of strings `before|after`, one for each level; the bar stands for the node's own digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Nodes of a run, and levels that a bucket folds: 4,096 nodes.
FANOUT, DEPTH = 8, 4
#: Nodes that one DuckDB query takes, about.
AT_ONCE = 8_192
_DIGEST = 64


def leaf(*values: Column) -> Column:
    """SHA-256 of the values: of each its length in UTF-8 bytes, a colon and itself, or a minus sign for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(start: str) -> str:
    """SQL: the digest `start` folded along `path`."""
    return f"list_reduce(list_prepend({start}, path), lambda digest, x: sha256(replace(x, '|', digest)))"


#: SQL: the digest of all siblings along `path`.
PROOF = "sha256(replace(array_to_string(path, ''), '|', ''))"


class Blocks:
    """Level queries over whole buckets in an in-memory DuckDB of one thread, within a task."""

    def __init__(self, fanout: int, depth: int):
        self.fanout, self.depth = fanout, depth
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})

    def fold(self, nodes: pa.Table) -> pa.Table:
        """k, root of each bucket of nodes (k, i, h, levels); the runs of each level stay as tables r0, r1, ...

        A bucket is folded `levels` times, which leaves one node."""
        self.db.register("nodes", nodes)
        self.db.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT k, i, h, levels FROM nodes")
        for j in range(self.depth):
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE r{j} AS SELECT k, i // {self.fanout} AS i, string_agg(h, '' ORDER BY i) AS run, any_value(levels) AS levels FROM l{j} WHERE levels > {j} GROUP BY ALL")
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE l{j + 1} AS SELECT k, i, sha256(run) AS h, levels FROM r{j}")
        roots = " UNION ALL ".join(f"SELECT k, h AS root FROM l{j} WHERE levels = {j}" for j in range(self.depth + 1))
        return self.db.sql(f"SELECT * FROM ({roots}) ORDER BY k").to_arrow_table()

    def paths(self, nodes: pa.Table, buckets: pa.Table, query: str) -> pa.Table:
        """query over p: the columns of nodes and of their buckets (k, above and others), and path, which goes from the
        node to the bucket's root and on along above."""
        self.fold(nodes)
        self.db.register("buckets", buckets)
        joins, parts, size = [], [], 1
        for j in range(self.depth):
            at = f"{_DIGEST} * (n.i // {size} % {self.fanout})"
            joins.append(f"LEFT JOIN r{j} ON r{j}.k = n.k AND r{j}.i = n.i // {size * self.fanout}")
            parts.append(f"substr(r{j}.run, 1, {at}) || '|' || substr(r{j}.run, {at} + {_DIGEST + 1})")
            size *= self.fanout
        path = f"list_concat(list_filter([{', '.join(parts)}]::VARCHAR[], lambda x: x IS NOT NULL), above)"
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE p AS SELECT n.*, b.* EXCLUDE (k), {path} AS path FROM nodes n JOIN buckets b USING (k) {' '.join(joins)}")
        return self.db.sql(query).to_arrow_table()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in parts of about AT_ONCE nodes."""
    for batch in batches:
        first = size = 0
        for i, n in enumerate(batch.column("h").value_lengths().to_pylist()):
            size += n
            if size >= AT_ONCE or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first)
                first, size = i + 1, 0


def _nodes(part: pa.RecordBatch, members: list[str]) -> pa.Table:
    """k (the place of the bucket in part), i (the place in it), levels and the members of every node."""
    n = part.column("h").value_lengths().to_numpy(zero_copy_only=False)
    k = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    levels = part.column("levels").to_numpy(zero_copy_only=False)[k]
    return pa.table({"k": k, "i": i, "levels": levels, **{c: part.column(c).flatten() for c in members}})


class Tree:
    """Tiers of buckets over numbered nodes (g, rank, h and members) up to one root for each g."""

    def __init__(self, nodes: DataFrame, members: dict[str, str], fanout: int = FANOUT, depth: int = DEPTH):
        self.fanout, self.depth, self.size, self.members = fanout, depth, fanout**depth, members
        self.tiers = [self._tier(nodes, members)]
        while (self.tiers[-1].agg(F.max("b")).first()[0] or 0) > 0:
            self.tiers.append(self._tier(self.tiers[-1].select("g", F.col("b").alias("rank"), F.col("root").alias("h")), {}))

    def _tier(self, nodes: DataFrame, members: dict[str, str]) -> DataFrame:
        """Stored buckets: g, b, levels, arrays h and members in order of rank, root."""
        names, fanout, depth = ["h", *members], self.fanout, self.depth
        n = F.col("n")
        levels = F.when(n > self.size, depth)
        for j in range(depth + 1):
            levels = levels.when(n <= fanout**j, j)
        sizes = nodes.groupBy("g").agg(F.count("*").alias("n")).select("g", levels.alias("levels"))
        own = F.sort_array(F.collect_list(F.struct("rank", *names)))  # of at most fanout**depth nodes
        rows = nodes.groupBy("g", F.floor(F.col("rank") / self.size).cast("long").alias("b")).agg(own.alias("m")).join(sizes, "g")
        rows = rows.select("g", "b", "levels", *(F.col(f"m.{c}").alias(c) for c in names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = Blocks(fanout, depth)
            for part in _cut(batches):
                root = blocks.fold(_nodes(part, ["h"])).column("root").combine_chunks().cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, root], names=[*part.schema.names, "root"])

        kinds = ", ".join(f"{c} array<{t}>" for c, t in {"h": "string", **members}.items())
        return common.stored(rows.mapInArrow(run, f"g string, b long, levels int, {kinds}, root string"), "tier")

    def roots(self) -> DataFrame:
        """g, root."""
        return self.tiers[-1].select("g", "root")

    def down(self, above: DataFrame, query: str, schema: str, carried: dict[str, str] | None = None) -> DataFrame:
        """query over p of the first tier's nodes, for paths that go on along above (g, above and carried columns)."""
        carried, fanout, depth = carried or {}, self.fanout, self.depth
        above = above.withColumn("b", F.lit(0).cast("long"))
        step = f"SELECT g, b * {self.size} + i AS b, path AS above{''.join(', ' + c for c in carried)} FROM p"
        kinds = "g string, b long, above array<string>" + "".join(f", {c} {t}" for c, t in carried.items())
        for tier in reversed(self.tiers):
            last = tier is self.tiers[0]

            def run(batches: Iterator[pa.RecordBatch], own: str = query if last else step, names: tuple = ("h", *self.members) if last else ("h",)) -> Iterator[pa.RecordBatch]:
                blocks = Blocks(fanout, depth)
                for part in _cut(batches):
                    buckets = pa.table({"k": np.arange(part.num_rows), **{c: part.column(c) for c in ("g", "b", "above", *carried)}})
                    yield from blocks.paths(_nodes(part, names), buckets, own).to_batches()

            joined = tier.drop("root").join(above, ["g", "b"])
            above = joined.mapInArrow(run, schema if last else kinds)
        return above


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row (doc_id, source, lang, n_chars, text).

    Groups are the values of lang, null first, in order of their bytes. Rows of a group ascend by doc_id, null first;
    rows of equal id by their leaf, so that equal rows are leaves of their own that may stand for each other. Null
    fields have a sign of their own and null is not the empty text. tampered: rows whose text is changed to lower case
    before the root is folded again; null says no. Other columns are ignored; an empty table gives an empty result."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    values = lambda text: leaf(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], text)
    changed = F.when(F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False), values(lowered(docs["text"])))
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"), "doc_id", values(docs["text"]).alias("h"), changed.alias("changed"))
    nodes = common.ranked(common.in_order(leaves, "g", "doc_id", "h"), "g")
    tree = Tree(nodes, {"doc_id": "bigint", "changed": "string"}, fanout, depth)
    groups = tree.roots().select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("h"))
    top = Tree(common.ranked(common.in_order(groups, "g", "name"), "g"), {"name": "string"}, fanout, depth)
    root = top.roots().first()
    start = top.roots().select("g", F.array().cast("array<string>").alias("above"))
    above = top.down(start, "SELECT name AS g, path AS above, h AS subroot FROM p", "g string, above array<string>, subroot string")
    query = f"SELECT doc_id, h AS leaf, subroot, {PROOF} AS proof_sha256, {folded('coalesce(changed, h)')} AS folded_root FROM p"
    rows = tree.down(above, query, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string", {"subroot": "string"})
    whole = F.lit(root["root"] if root else None).cast("string")
    return rows.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def checked_manifest(docs: DataFrame) -> DataFrame:
    """manifest() of docs in which a third of the rows, by crc32 of the id, is tampered with."""
    return manifest(docs, tampered=common.remainder("doc_id", 3) == 0)

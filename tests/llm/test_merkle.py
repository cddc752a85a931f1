"""The Merkle manifest against a tree built row by row."""

import hashlib
import random
import zlib

import pytest

from lamina.llm import common, merkle


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes, fanout):
    """The root, and for each node its siblings before and after it on each level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, places):
            first = p // fanout * fanout
            path.append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        places = [p // fanout for p in places]
    return nodes[0], paths


def brute(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for i, source, lang, n, text in rows:
        leaf = digest("".join(map(field, (i, source, lang, n, text))))
        changed = digest("".join(map(field, (i, source, lang, n, lower(text))))) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else leaf
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, changed, i))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in langs}
    root, top = tree([built[g][0] for g in langs], fanout)
    for g, above in zip(langs, top):
        for (_, _, leaf, folded, i), path in zip(sorted(groups[g]), built[g][1]):
            for before, after in path + above:
                folded = digest(before + folded + after)
            yield i, leaf, built[g][0], root, digest("".join(a + b for a, b in path + above)), folded, folded == root


@pytest.mark.parametrize("fanout,depth,n", [(8, 4, 90), (2, 2, 90), (3, 1, 40)])
def test_manifest(spark, fanout, depth, n):
    rng = random.Random(n)
    text = lambda: "".join(rng.choice("aAzZ é😀|-:\n") for _ in range(rng.randint(0, 30)))
    rows = [(i, rng.choice(["s", "", None]), rng.choice(["en", "en", "en", "é", "zz", "", None]), rng.choice([i, None]), rng.choice([text(), "", None])) for i in range(-3, n)]
    rows += [(None, None, "en", None, "NULL"), (7, "s", "en", 1, "X"), (7, "s", "en", 1, "X"), (7, "s", "en", 1, "Y"), (n, "s", "alone", 1, "A" * 70_000)]
    docs = spark.createDataFrame([(*r, "extra", "x", 5) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string, g string, rank int")
    got = merkle.manifest(docs, common.remainder("doc_id", 3) == 0, fanout, depth)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, fanout)))
    assert {r.verified for r in merkle.manifest(docs, None, fanout, depth).collect()} == {True}


def test_empty_and_single(spark):
    kind = "doc_id long, source string, lang string, n_chars int, text string"
    assert merkle.checked_manifest(spark.createDataFrame([], kind)).count() == 0
    row = merkle.checked_manifest(spark.createDataFrame([(1, None, None, None, None)], kind)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == digest("")

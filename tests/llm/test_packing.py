"""Packing: ids against the tokenizers library, every id once, gapless sequences, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import common, packing
from lamina.llm.vocabulary import read_content

WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "a", "B", "é", "É", "×", "÷", "ª", "½", "²", "¿", "1", "23", "!", "\n", " ", "\t", "ß", "Ÿ", "ſ", "­", "x's", "l", "le", "v", "中", "İ", "<|endoftext|>", "\x85", "\xa0", "\x00"]


def padding(used, longest=2048):
    return 0 if used & (used - 1) == 0 else longest - used


def test_ids_as_the_library_gives_them():
    rng, own, library = random.Random(3), packing.Encoder(read_content(WORD)), Tokenizer.from_file(WORD)
    assert own.cuts
    texts = ["".join(rng.choice(PARTS[: 33 if k % 3 else None]) for _ in range(rng.randint(0, 30))) for k in range(3000)] + ["x" * 3000, "ab " * 5000, "", "é" * 700]
    for first in range(0, len(texts), 40):
        part = texts[first : first + 40]
        ids, n = own.encode(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(x, add_special_tokens=False).ids for x in part]
        if first % 200 == 0:
            own._forget()


def test_spans_of_one_hash_are_told_apart(monkeypatch):
    rng = random.Random(4)
    spans = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 20, 300]))) for _ in range(500)] + [b"y" * 299 + b"a", b"y" * 299 + b"b"]
    ends = np.cumsum([len(x) for x in spans])
    for mask in (None, 3):
        if mask:
            hashes = common.span_hashes
            monkeypatch.setattr(common, "span_hashes", lambda *a: hashes(*a) & np.uint64(mask))
        found, number = common.distinct_spans(b"".join(spans), np.append(0, ends[:-1]), ends)
        assert [found[i] for i in number.tolist()] == spans and len(set(found)) == len(found)


@pytest.mark.parametrize("name", ["mixed", "one length", "short", "halves", "one"])
def test_plan(name):
    """Every rank of every length has its place; no place is taken twice; sequences have no gaps."""
    rng = random.Random(name)
    histogram = {"mixed": {rng.randint(1, 64): rng.randint(1, 50) for _ in range(60)}, "one length": {40: 900}, "short": {1: 700, 2: 9, 3: 1}, "halves": {33: 100, 31: 90, 64: 5}, "one": {37: 1}}[name]
    plan = packing.Plan(histogram, 64)
    taken, used = defaultdict(list), Counter()
    for length, count in histogram.items():
        piece, first, size, sequence, offset = plan.place(np.full(count, length), np.arange(count))
        ids = [set() for _ in range(count)]
        for p, f, n, s, o in zip(*(x.tolist() for x in (piece, first, size, sequence, offset))):
            assert n > 0 and not ids[p] & set(range(f, f + n))
            ids[p] |= set(range(f, f + n))
            taken[s] += range(o, o + n)
            used[s] += n
        assert all(x == set(range(length)) for x in ids)
    assert all(sorted(x) == list(range(len(x))) and len(x) <= 64 for x in taken.values())
    assert sum(padding(n, 64) for n in used.values()) <= packing.MAX_PADDING * sum(used.values())


@pytest.mark.parametrize("longest,few", [(2048, 200_000), (64, 0)])
def test_packing(spark, longest, few, monkeypatch):
    monkeypatch.setattr(packing, "FEW_CUTS", few)
    rng, library = random.Random(8), Tokenizer.from_file(WORD)
    texts = [None, "", " \n", "a", "word " * 9000, "don't stop", "中文 x"] + [" ".join(rng.choice(["abc", "de", "fgh,", "x1"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    rows = [(i, t, "x", 3, 4) for i, t in enumerate(texts)] + [(4, "word " * 1100, "x", 3, 4), (None, "no id", None, None, None)] + [(5, "word " * 1100, "y", 0, 0)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, start int, rank int")
    kind = packing.id_type(WORD)
    ids = packing.encoded(docs, WORD, longest=longest)
    pieces = common.stored(packing.pack(ids, kind, longest), "pieces")
    got = pieces.collect()
    exp = Counter((i, n) for i, n in ((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, *_ in rows))
    own = defaultdict(list)
    whole = {r.sequence_id: np.frombuffer(r.ids, kind).tolist() for r in packing.sequences(ids, pieces, kind).collect()}
    for r in got:
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
        own[r.row, r.doc_id, r.doc_tokens].append((r.start, part))
    docs_back = Counter()
    for (_, i, n), parts in own.items():
        flat, at = [], 0
        for start, part in sorted(parts):
            assert start == at
            at += len(part)
            flat += part
        assert len(flat) == n
        docs_back[i, tuple(flat)] += 1
    assert docs_back == exp
    assert sum(map(len, whole.values())) == sum(r.length for r in got) and max(map(len, whole.values())) <= longest
    assert sum(padding(len(x), longest) for x in whole.values()) <= 0.01 * sum(map(len, whole.values()))
    assert packing.packed(docs.where("false"), WORD).count() == 0

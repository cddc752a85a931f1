"""Each operator against a brute-force version, an exact round trip or held-out accuracy; odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import ann, binary_output, bpe_codec, common, language_id, lm_scoring, media, mixing, near_dedup, queries, token_counts, toxicity
from lamina.llm.vocabulary import read_content, vocabulary

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t", "a", "a b c d e f g", "don't 'S ΑΣ ﬁ İ ½ 中文\x1c x\x85y <|endoftext|> <|startoftext|>z", "x" * 3000, "word " * 9000, "a  b   c \n d ", "é" * 50, "😀👩‍👩‍👧 !?…"]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with nulls, repeated rows and ids, and columns whose names operators use too."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(80)]
    base = texts[15].split()
    texts += [" ".join(base[:-1] + ["new"]), texts[15], texts[16], texts[16] + " tail"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None][i % 3], i, "extra") for i, t in enumerate(texts)]
    rows += [rows[20], (None, "null id text", None, None, None, None), (21, "another text with the id", "en", "a", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, score string")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


def test_token_counts(docs, rows):
    t = Tokenizer.from_file(WORD)
    exp = Counter((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x, _ in rows)
    assert Counter(map(tuple, token_counts.token_counts(docs, WORD).collect())) == exp
    own = token_counts.counter(read_content(WORD))
    assert all(own.count(x, chunk=5) == own.count(x) for _, x, _ in rows)
    assert token_counts.token_counts(docs.where("false"), WORD).count() == 0


def test_chunk_maps():
    """Maps of chunks inside a run compose to the library's count, whatever the order of composition."""
    t, own, rng = Tokenizer.from_file(WORD), token_counts.counter(read_content(WORD)), random.Random(9)
    letters = lambda n, some: "".join(rng.choice(some) for _ in range(n))
    for text in ["a" * 1001, "ab" * 700, letters(3000, "etaoinshr"), letters(900, "abc") + "1234" * 99 + letters(800, "é中z"), "!?" * 400, "haha" * 300 + " x " + "lol" * 300]:
        exp = len(t.encode(text, add_special_tokens=False).ids)
        for chunk in (1, 3, 7, 64, 1000):
            maps = own.maps(text, chunk)
            left, state, total = [], token_counts.START, 0
            for m in maps:
                state, n = m.follow(state)
                left.append((state, total := total + n))
            assert left == [m(token_counts.START) for m in token_counts.scan(maps)] and total == exp == own.count(text, chunk), (text[:9], chunk)
    assert len(own.maps("ab" * 700, 64)) > 20 and all(m.known for m in own.maps("ab" * 700, 64))


def test_token_counts_of_long_runs():
    """Runs of a million characters without white space, and a small cap on the states that are kept."""
    t, own, rng = Tokenizer.from_file(WORD), token_counts.RunCounter(vocabulary(read_content(WORD))), random.Random(10)
    own.machine.most = 2000
    for text in ["".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "a" * 300_000, "x1" * 100_000]:
        assert own.count(text) == len(t.encode(text, add_special_tokens=False).ids)


def test_bpe_codec(docs, rows):
    t, sha = Tokenizer.from_file(WORD), lambda s: hashlib.sha256(s.encode()).hexdigest()
    exp = Counter()
    for i, x, _ in rows:
        ids = t.encode(x, add_special_tokens=False).ids
        exp[(i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(map(tuple, bpe_codec.digests(docs, WORD).collect())) == exp
    assert all(r.decoded == t.decode(r.ids, skip_special_tokens=False) for r in bpe_codec.encode(docs, WORD).collect())
    c = bpe_codec.Codec(vocabulary(read_content(WORD)))
    for n in (10, 300):
        s = c.vocab.symbols("abc" * n)
        assert c.merge(list(s)) == c._merge_long(list(s))


def test_bpe_codec_merges_pieces_together(monkeypatch):
    """New pieces are merged many at a time, through full caches, blocks inside a text, and pieces too long for it."""
    t, rng = Tokenizer.from_file(WORD), random.Random(3)
    letters = "abcdeXYZ'st 12 \t\n\x1c\x00éßĲŁ日本ЖΣς🙂.,!"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", " ", "a<|startoftext|><|endoftext|> b", "reading " * 300 + "x" * 300 + " é" * 50, "a" * 64 + " " + "b" * 65 + " " + "é" * 40]
    own, long = bpe_codec.Codec(vocabulary(read_content(WORD))), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda symbols: long.append(len(symbols)) or merge(symbols))
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    exp = [(len(i), " ".join(map(str, i)), t.decode(i, skip_special_tokens=False)) for i in ids]
    assert own.all(texts) == exp and own.all(texts) == exp
    assert sorted(set(long)) == [65, 80, 300]  # no piece of up to 64 letters is merged by itself
    assert max(map(len, own.numbers)) <= bpe_codec.LONGEST and own.numbers.keys() == own.decoded.keys()
    monkeypatch.setattr(bpe_codec, "KEPT", 20)
    monkeypatch.setattr(bpe_codec, "BLOCK", 7)
    monkeypatch.setattr(bpe_codec, "STEP", 3)
    assert own.all(texts) == exp == [own.both(x) for x in texts]


def test_token_id_files(docs, rows):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1024, 60000), (5000, 2**32 - 1), (3000, 1)):
        x = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        assert (binary_output.unpack(binary_output.pack(x)) == x).all()
    x = np.full(4000, 7, np.uint32)
    x[::500] = 4_000_000_000
    assert len(binary_output.pack(x)) < 400 and (binary_output.unpack(binary_output.pack(x), 2, 3) == x[2048:3072]).all()
    image = binary_output.pack(x, doc_ids=[3, None, -1], lengths=[1, 0, 3999])
    assert (binary_output.unpack(image) == x).all() and binary_output.documents(image)[0] == [3, None, -1] and binary_output.documents(image)[1].tolist() == [1, 0, 3999]
    assert binary_output.token_id_files(docs.where("false"), BYTE).collect() == []
    t = Tokenizer.from_file(BYTE)
    got = sorted(binary_output.token_id_files(docs, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    at, exp = 0, defaultdict(Counter)
    for i, x, _ in rows:
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        exp[i][(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    for r in got:
        assert r.start == at
        at += r.n_tokens
        exp[r.doc_id][(r.n_tokens, r.ids_crc32)] -= 1
    assert not any(v for c in exp.values() for v in c.values())


def test_encoding_by_pieces():
    """Texts of all kinds of neighbours: every cut is one that the library's splitter makes too."""
    t, own, rng = Tokenizer.from_file(BYTE), binary_output.encoder(read_content(BYTE)), random.Random(11)
    signs = [" ", " ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "'", "'s", "'ll", "'T", ".", "...", "%%", "-", "_", "×", "÷", "½", "é", "ÀÉ", "ſ", "ŉ", "a", "Bc", "the", "xyz", "1", "23", "٣", "中文", "e\u0301", "\u0301", "😀", "\x00", "ﬁ", "ß", "<|endoftext|>", "<|", "ζ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["q" * 5000 + " " * 3000 + "\n" * 999 + "é" * 999]
    for first in range(0, len(texts), 500):
        ids, n = own.encode(texts[first : first + 500])
        for text, got in zip(texts[first : first + 500], np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids, text


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(docs, rows):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    named = [(i, shingles(x), x) for i, x, _ in rows if i is not None]
    parent = {i: i for i, _, _ in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, sa, ta in named:
        for b, sb, tb in named:
            if a < b and sa and sb and (ta == tb or len(sa & sb) >= 0.8 * len(sa | sb)):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id not in (None, 21):  # id 21 has two texts
            assert r.class_id == find(r.doc_id)
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_near_dedup_of_one_id_with_two_texts(spark):
    """Both texts of an id find their near copies, and one document of each class stays in the pipeline."""
    import corpus_pipeline

    text = lambda mark: " ".join(f"{mark}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " end"), (3, text("b") + " end"), (4, text("c")), (4, text("a")), (5, text("c") + " end"), (1, text("b")), (6, text("b"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, 2), (1, 1, 3), (2, 1, 1), (3, 1, 1), (4, 4, 1), (4, 1, 2), (5, 4, 1), (1, 1, 3), (6, 1, 3)])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, text("a")), (1, text("b")), (4, text("c"))]


def classes_by_brute_force(texts, weighted=False):
    """Each text's least linked text, by all pairs."""
    def bag(t):
        w = t.lower().split()
        c = Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        return c if weighted else Counter(set(c))

    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_near_dedup_of_chains_and_weights(spark, monkeypatch):
    """Chains of links, texts that are similar to a group's centre only through others, pairs below the threshold, and
    repeated passages that count once in sets and often in weights; blocks of a few texts."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 6)
    monkeypatch.setattr(near_dedup, "STAR_DOCS", 3)
    rng, texts = random.Random(12), []
    for g in range(6):
        words = [f"{g}w{i}" for i in range(100)]
        for step in range(14):
            texts.append(" ".join(words))
            words = words[1:] + [f"{g}n{step}"] if g < 4 else [w if rng.random() > 0.03 else f"{g}x{rng.random()}" for w in words]
    for k in range(5):
        passage = " ".join(f"p{k}v{i}" for i in range(30))
        texts += [passage + " " + " ".join(f"q{k}{i}" for i in range(40)), (passage + " ") * 4 + " ".join(f"q{k}{i}" for i in range(40))]
    order = rng.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, texts[t]) for i, t in enumerate(order)], "doc_id long, text string")
    for weighted in (False, True):
        exp = classes_by_brute_force([texts[t] for t in order], weighted)
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, weighted=weighted).collect()}
        assert [got[i] for i in range(len(order))] == exp and len(set(exp)) > 8


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    e = common.mix(np.arange(300, dtype=np.uint64))
    wa, wb = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    for a, b in ((wa, wb), (np.ones(300), np.where(np.arange(300) < 150, 1.0, 0.0))):
        keep = b > 0
        s = near_dedup.signatures(np.concatenate([e, e[keep]]), np.array([300, keep.sum()]), 2000, np.concatenate([a, b[keep]]))
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - exact) < 0.05


def test_links_between_blocks():
    rng = random.Random(2)
    base = [str(i) for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 else "z" for w in base) for _ in range(40)]
    exact = {(i, j) for i in range(40) for j in range(40) if i != j and len(shingles(texts[i]) & shingles(texts[j])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[j]))}
    _, degree = near_dedup.links_in_block(list(range(40)), texts, None)
    assert degree.tolist() == [sum(a == i for a, _ in exact) for i in range(40)]
    side = np.arange(40) >= 20
    forest, degree = near_dedup.links_in_block(list(range(40)), texts, side)
    assert degree.tolist() == [sum(a == i and side[a] != side[b] for a, b in exact) for i in range(40)] and all(p in exact for p in forest)


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[100:200] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, []), (940, [0.0] * 16), (960, [float("nan")] * 16), (980, [None] * 16), (1000, [1.0] * 3), (None, x[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.search(df, parts=8, probes=8).collect()
    exp = {}
    for q in range(0, 700, 20):
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-float((x[q] * x[i]).sum()), i))[:20]
        exp |= {(q, r + 1): i for r, i in enumerate(order)}
    hits = sum(exp[(r.query_id, r["rank"])] == r.vec_id for r in got)
    assert len(got) == len(exp) == hits  # all partitions probed
    assert all(r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-12, abs=1e-12) for r in got)
    assert ann.search(df.where("false")).count() == 0 and ann.search(df.where("vec_id in (0, 1)")).collect()[0].vec_id == 1


def test_ann_recall_and_large_norms(spark):
    """Recall with fewer probes than partitions; ties of vectors of large norm go to the smaller id."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 24))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    got = {(r.query_id, r.vec_id) for r in ann.search(df).collect()}
    exp = {(q, int(i)) for q in range(0, 2500, 20) for i in [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20]}
    assert ann.PROBES < ann.PARTITIONS and len(got & exp) >= 0.9 * len(exp)
    big = np.tile(rng.normal(size=24) * 1e6, (60, 1))
    same = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(big)] + [(3, big[3].tolist())], "vec_id long, embedding array<double>")
    rows = ann.search(same).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [1, 2, 3, 3, *range(4, 20)]


def test_toxicity_by_brute_force():
    """Scores are the noisy-or of sentence scores, the span is that of the most toxic sentence, long and odd texts too."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(60)] + ["awful", "Dreck"]
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))) + rng.choice(["", "!", "\n?"]) for _ in range(400)]
    model = toxicity.fit(texts, [int("awful" in t or "Dreck" in t) for t in texts])
    assert len(model.weights) > 3
    for text in [*texts[:80], "", " ...", "12 34", texts[0] * 2000]:
        scores = []
        for m in re.finditer(r"[^.!?\n。！？]+", text):
            found = set(re.findall(r"[^\W\d_]+", m[0].lower()))
            if found:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in found for f in ([w] if len(w) < 5 else [w, w[:4] + "*", w[:5] + "*"]))
                scores.append((1 / (1 + math.exp(-z)), m.span()))
        score, start, end, top = model.score(text)
        assert score == pytest.approx(1 - math.prod(1 - p for p, _ in scores), abs=1e-9) and (not scores or top == pytest.approx(max(scores)[0]))
        assert not scores or any((start, end) == span and p == pytest.approx(top) for p, span in scores)


def test_toxicity_of_long_texts():
    """Many clean documents in one stay clean, whatever their number, and a toxic sentence in them is found and located."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    plain, harm = [word() for _ in range(400)], [word() for _ in range(12)]
    sentence = lambda bad: " ".join([*(rng.choice(plain) for _ in range(7)), *rng.sample(harm, 3 * bad)])
    def text(n, bad):
        return ". ".join(sentence(bad and i == n // 2) for i in range(n)) + "."
    train = [(text(rng.randint(3, 30), k % 5 == 0), int(k % 5 == 0)) for k in range(1200)]
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    for n in (5, 40, 400, 2500):
        clean = [text(n, False) for _ in range(20)]
        assert sum(model.score(t)[0] >= toxicity.THRESHOLD for t in clean) == 0
        for t in clean[:10]:
            parts = t.split(". ")
            parts[n // 3] = sentence(True)
            found = model.score(". ".join(parts))
            assert found[0] >= toxicity.THRESHOLD and ". ".join(parts)[found[1] : found[2]].strip() == parts[n // 3].strip()


def test_empty_tables_and_repeated_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "bad harm word" if i % 2 else "good plain word") for i in range(40)] * 2 + [(None, "bad harm word"), (3, "good plain word")], "doc_id long, text string")
    got = Counter(r.doc_id for r in toxicity.toxicity(docs, labels).collect())
    assert got == Counter([*range(40), *range(40), None, 3])
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0 and toxicity.toxicity(docs, labels.where("false")).where("predicted = 1").count() == 0
    assert bpe_codec.encode(docs.where("false"), WORD).count() == 0 == bpe_codec.digests(docs.where("false"), WORD).count()
    assert Counter(r.doc_id for r in bpe_codec.digests(docs, WORD).collect()) == got


def test_language_by_brute_force(spark):
    """Predictions and cosines against profiles made letter by letter, whatever texts stand beside a text."""
    rng = random.Random(14)
    sets = {"x": "abcde", "y": "cdefgé", "z": "αβγδε"}
    data = [(i, " ".join("".join(rng.choice(sets["xyz"[i % 3]]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 15))) + rng.choice(["", ".", " 1!"]), "xyz"[i % 3]) for i in range(120)]
    data += [(200, "a", "x"), (201, "-Ab c", None), (202, None, "x"), (203, "ab " * 30_000, None), (5, "cd", "y"), (5, "cd", "y")]
    own, k = language_id.space(language_id.DIMENSIONS, language_id.GRAM), language_id.DIMENSIONS

    def profile(text):
        out = np.zeros(k)
        grams = Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            grams.update(f" {w} "[i : i + 3] for i in range(len(w)))
        for g, n in grams.items():
            v = np.ones(k)
            for i, c in enumerate(g):
                v = v * np.roll(own.letter(ord(c)).astype(float), i)
            out += n * v
        return out / max(np.linalg.norm(out), 1e-9)

    sums = {}
    for i, t, lang in data:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + profile(t)
    names = sorted(sums)
    table = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    docs = spark.createDataFrame([(*r, "s") for r in data], "doc_id long, text string, lang string, extra string")
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 4)) for r in language_id.language_id(docs).collect()))
    exp = []
    for i, t, _ in data:
        c = table @ profile(t)
        exp.append((i, names[int(c.argmax())] if t else "und", round(float(np.clip(c.max(), 0, 1)), 4) if t else 0.0))
    assert [r[:2] for r in got] == [r[:2] for r in sorted(exp)] and np.abs(np.array([r[2] for r in got]) - np.array([r[2] for r in sorted(exp)])).max() < 1e-3
    assert language_id.language_id(docs.where("false")).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    data, labels = [], []
    for i in range(600):
        parts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(5)]
        toxic = i % 5 == 0
        if toxic:
            parts[3] += " badword"
        data.append((i, ". ".join(parts)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(data + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) and got[i].predicted == (i % 5 == 0) for i in held)
    r = got[held[0] if held[0] % 5 == 0 else next(i for i in held if i % 5 == 0)]
    assert "badword" in data[r.doc_id][1][r.top_start : r.top_end]
    assert got[900].score == 0 == got[901].score and len(got) == 603
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).where("predicted = 1").count() == 0


def test_language_id(spark):
    rng = random.Random(7)
    sets = {"x": "abcde", "y": "defgh", "z": "αβγδε"}
    data = []
    for i in range(300):
        lang = "xyz"[i % 3]
        data.append((i, " ".join("".join(rng.choice(sets[lang]) for _ in range(6)) for _ in range(20)), lang))
    docs = spark.createDataFrame(data + [(900, None, "x"), (901, "123 !", "y"), (902, "", None), (None, "abc", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert all(got[i].lang_pred == "xyz"[i % 3] for i in range(300)) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und", ""}


def test_lm_scores(docs, rows):
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    exp = defaultdict(list)
    for i, t, _ in rows:
        w = split(t)
        exp[i].append((len(w), sum(x in c for x in w), round(sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    for options in ({}, {"hot_words": 40, "filter_bytes": 4096}):
        got = defaultdict(list)
        for r in lm_scoring.lm_scores(docs, **options).collect():
            assert r.train_tokens == n and r.held_out == held(r.doc_id) and math.isfinite(r.score)
            got[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6)))
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in exp.items()}
    assert lm_scoring.lm_scores(docs.where("false")).count() == 0


def lm_brute_force(rows):
    """(id, number of tokens, score) of every row, with quantised counts of all training pairs, sorted by repr."""
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [None]
    learned = [split(t) for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    c, pairs = Counter(w for t in learned for w in t), Counter(x for t in learned for x in zip([None, *t], t))
    n, v = sum(c.values()), len(c)
    levels = defaultdict(list)
    for x in pairs.values():
        levels[math.frexp(x)[1]].append(x)

    def score(before, w):
        level = math.frexp(pairs[before, w])[1]
        seen = min(sum(levels[level]) / len(levels[level]) if level else 0, c[before], c[w])
        return math.log10((seen + lm_scoring.MU * (c[w] + 0.1) / (n + 0.1 * (v + 1))) / (c[before] + lm_scoring.MU))

    return sorted(((i, len(split(t)), sum(score(*x) for x in zip([None, *split(t)], split(t)))) for i, t, _ in rows), key=repr)


def lm_compare(docs, exp, **options):
    """The filter's false answers, about one in a hundred, only raise scores."""
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in lm_scoring.lm_scores(docs, **options).collect()), key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in exp]
    more = [a[2] - b[2] for a, b in zip(got, exp)]
    assert min(more) > -1e-6 and sum(more) < 5e-3 * sum(r[1] for r in exp), (min(more), sum(more))


def test_lm_levels_keep_counts():
    """Readings of all pairs add up to their counts, so words' probabilities sum to 1 on average over contexts."""
    rng = np.random.default_rng(1)
    c = rng.zipf(1.6, 20000).clip(1, 10**9)
    means = lm_scoring.level_counts(lm_scoring.level_sums(c[:9000]) + lm_scoring.level_sums(c[9000:]))
    assert means[0] == 0 and means[1] == 1 and means[np.frexp(c.astype(float))[1]].sum() == pytest.approx(c.sum())
    assert lm_scoring.level_counts(lm_scoring.level_sums(c[:0]))[3] == 6


def test_lm_score_has_all_pairs(docs, rows):
    """Pairs seen once count, and however small the filter's segments are, none is left out."""
    for filter_bytes in (lm_scoring.FILTER_BYTES, 512):
        lm_compare(docs, lm_brute_force(rows), filter_bytes=filter_bytes)


def test_lm_score_of_rare_words(docs, rows):
    """The formula is one for all words: few words in a shard or many, scores are equal."""
    for hot_words in (lm_scoring.HOT_WORDS, 20):
        lm_compare(docs, lm_brute_force(rows), hot_words=hot_words)


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets by filling sources until none is above its cap."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > most * sizes[s]] or free
        out |= {s: min(weight[s] * unit, float(most * sizes[s])) for s in full}
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def test_mixing_targets(spark):
    rng = random.Random(8)
    for sizes in [{"a": 10, "b": 1000, None: 5}, {"a": 0, None: 0}, {"x": 7}, {"a": 5, "b": 2, "c": 1, "d": 5}, *({"s%d" % i if i else None: rng.choice([0, 1, 30, 1000]) for i in range(9)} for _ in range(4))]:
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(t.encode().split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    total = sum(r.size for r in got)
    by = {r.source_size: r for r in got}
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == total
    for s, r in by.items():
        assert abs(sum(x.taken for x in got if x.source_size == s) - r.target) <= mixing.QUANTUM * len(by)
    for r in mixing.mix_sources(docs, quantum=1).collect():
        assert abs(r.copies * r.size - r.taken) <= r.size * 1.5
    assert mixing.mix_sources(docs.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 24_000, "b": 9_600, "c": 90_000}, {f"s{i:03d}": 40 + 13 * i for i in range(101)}, {"a": 6_000, "b": 70_000, "c": 300}])
def test_mixing_with_capped_sources(spark, sizes):
    """Sources at their cap have no packets past their target; what they lack comes from the others, whole."""
    for seed in range(4 if len(sizes) < 9 else 1):
        rng, rows = random.Random(seed), []
        for s, n in sizes.items():
            while n:
                k = min(n, rng.randint(1, 400))
                rows.append((len(rows) + 100_000 * seed, "w " * k, s))
                n -= k
        got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert sum(r.taken for r in got) == sum(sizes.values()) and len(got) == len(rows)
        by = defaultdict(list)
        for r in got:
            by[r.source_size].append(r)
        for own in by.values():
            assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.QUANTUM and all(r.taken <= 3 * r.size for r in own)


def thue_morse(letters, n):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_collide_in_polynomials(spark, n):
    """Thue-Morse words, which collide in every polynomial modulo 2**64, are words of their own in each operator."""
    rows = [(i, thue_morse(x, n)) for i, x in zip((1, 2, 3), ("ab", "ba", "ab"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()) == [(1, 1), (2, 2), (3, 1)]
    library = Tokenizer.from_file(BYTE)
    exp = {i: zlib.crc32(np.array([*library.encode(x).ids, 0], "<u4").tobytes()) for i, x in rows}
    assert {r.doc_id: r.ids_crc32 for r in binary_output.token_id_files(docs, BYTE).collect()} == exp
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    new = spark.createDataFrame([(held, rows[0][1]), (next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10), rows[1][1])], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm_scoring.lm_scores(new).collect()}[held] == 1  # the end token


def test_mixing_sql(spark, docs, tmp_path):
    """The query and its SQL agree on odd rows, on a source that fills its cap, and on no rows."""
    import duckdb

    long = spark.createDataFrame([(1000 + i, "word " * 40, s) for i, s in enumerate(["c", "c", "c", "d", None])], "doc_id long, text string, source string")
    for name, part in (("odd", docs), ("capped", docs.unionByName(long, allowMissingColumns=True)), ("none", docs.where("false"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        exp = con.sql(queries.MIXING_SQL)
        got = queries.op7_mixing(spark, f"{tmp_path}/{name}")
        assert got.columns == exp.columns
        key = lambda r: tuple((v is not None, v) for v in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(exp.fetchall(), key=key)


def test_media(docs, rows):
    got = media.media_features(docs).collect()
    exp = Counter()
    for i, t, _ in rows:
        p = media.padded(t)
        exp[(i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == exp
    for p in (b"", bytes(range(256)) * 9, b"a" * 70_000):
        m = media.encode_payload(p)
        fast, slow = media.Decoder(m), media.Decoder(m, arrays=False)
        assert fast.payload() == p and all((fast.coefficients[c] == slow.coefficients[c]).all() for c in (1, 2, 3))
    with pytest.raises(ValueError):
        media.Decoder(b"no image")


def test_media_tensors(docs):
    """Tensors and features against a plain inverse transform, coefficient by coefficient, of the payload's own numbers."""
    some = [r for r in media.media_features(docs).collect() if r.payload_bytes <= 700]
    texts = {}
    for r in docs.collect():
        texts.setdefault(hashlib.sha256(media.padded(r.text)).hexdigest(), media.padded(r.text))
    basis = np.array([[[[(0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for v in range(8)] for u in range(8)] for x in range(8)] for y in range(8)])
    assert len(some) > 20
    for r in some[:25]:
        d = media.Decoder(media.encode_payload(texts[r.payload_sha256]))
        planes = []
        for c in d.coefficients.values():
            square = np.zeros((*c.shape[:2], 64))
            square[:, :, media.ZIGZAG] = c
            p = np.einsum("yxuv,rcuv->rycx", basis, square.reshape(*c.shape[:2], 8, 8)).reshape(c.shape[0] * 8, c.shape[1] * 8)
            planes.append(p if len(planes) == 0 else np.kron(p, np.ones((2, 2))))
        y, cb, cr = planes
        rgb = np.stack([y + 128 + 1.402 * cr, y + 128 - 0.344136 * cb - 0.714136 * cr, y + 128 + 1.772 * cb], axis=2)
        got = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert np.abs(got - np.clip(rgb, 0, 255)).max() <= 0.51
        size, *means = r.feature.split()
        assert size == f"{r.width}x{r.height}" and [float(m) for m in means] == pytest.approx(got.reshape(-1, 3).mean(axis=0).tolist(), abs=0.0051)
    assert media.media_features(docs.where("false")).count() == 0


def test_media_in_strips(monkeypatch):
    """Strips of any size give the same files and tensors."""
    rng = np.random.default_rng(5)
    for p in (bytes(rng.integers(0, 256, 60_000, np.uint8)), bytes(rng.integers(0, 90, 60_000, np.uint8)), b"x"):
        whole = media.encode_payload(p)
        x = media.Decoder(whole).rgb()
        monkeypatch.setattr(media, "STRIP", 8)
        d = media.Decoder(whole)
        assert media.encode_payload(p) == whole and d.payload() == p and (d.rgb() == x).all()
        monkeypatch.undo()


def test_jpeg_scans_with_runs():
    """A grey image of two blocks with zero runs, an end-of-block run and refinement, coded by hand."""
    table = lambda kind, symbols: media._table(kind, symbols, 4)
    frame = media._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\1" * 64) + frame + table(0, list(range(12))) + table(0x10, [0x00, 0x01, 0x21, 0x10, 0xF0])
    bits = lambda s: np.array([int(x) for x in s.replace(" ", "")], np.uint8)
    dc = media._scan(((1, 0),), 0, 0, 0, 0, bits("0010 11  0001 0"))  # 3, then 3 - 1
    first = media._scan(((1, 0),), 1, 63, 0, 1, bits("0010 1  0000  0001 0 0000"))  # run 2, +1; end; -1; end
    # block 0: a new +1 after one zero, the 1 at place 3 is passed and corrected; ends of both blocks
    fix = media._scan(((1, 0),), 1, 63, 1, 0, bits("0010 1 1  0000  0000 0"))
    d = media.Decoder(head + dc + first + fix + b"\xff\xd9")
    a, b = d.coefficients[1][0]
    assert (a[0], b[0]) == (3, 2) and a[3] == 3 and a[4] == 1 and b[1] == -2 and np.count_nonzero(a) == 3 and np.count_nonzero(b) == 2
    assert d.rgb().shape == (8, 16, 3)


def test_inverse_transform_and_upsampling():
    m = media.encode_payload(b"\0" * 384)
    d = media.Decoder(m)
    for c in d.coefficients.values():
        c[:] = 0
    d.coefficients[1][:, :, 0] = 8 * 50
    d.coefficients[3][0, 0, 0] = 8 * 10
    x = d.rgb()
    assert x.shape == (16, 16, 3) and (x == np.array([192, 171, 178], np.uint8)).all()


def test_rare_languages_are_learned(spark):
    rows = [(i, "abc abd acd " * 3, "x") for i in range(2000)] + [(5000 + i, "fgh fgi fhi " * 3, "y") for i in range(2)] + [(None, "abc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, prototypes = language_id.train(docs, max_train=20)
    assert names == ["x", "y"] and prototypes.shape == (2, language_id.DIMENSIONS)
    assert language_id.train(docs.where("false"))[0] == []


def test_toxicity_training_is_bounded(spark, monkeypatch):
    """No more characters reach the driver than stated, whatever the texts' lengths."""
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: taken.append(sum(map(len, texts))))
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1) * (4000 if i == 3 else 1)) for i in range(300)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    for most in (100, 1000, 10**9):
        toxicity.train(docs, labels, max_chars=most)
        assert taken[-1] <= most
    assert taken[1] > 0 and taken[2] == sum(5 * (i % 7 + 1) * (4000 if i == 3 else 1) for i in range(300))

import hashlib
import math
import random
import re
import shutil
from collections import Counter
from pathlib import Path

import corpus_pipeline as P
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import toxicity
from tests.llm.test_operators import classes_by_brute_force, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

def test_pipeline(spark, tmp_path):
    for t in ("documents", "labels"):
        shutil.copy(Path("/root/testdata/sf0.001") / f"{t}.parquet", tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "near-duplicates", "mixing", "encoding"]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        out = spark.read.parquet(f"{d}/{name}")
        assert tuple(out.columns) == P.COLUMNS
        if name == "mixing":
            assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3
        else:
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "near-duplicates":
            assert out.select("text").distinct().count() == out.count()
        docs = out
    last = P.STAGES[-1][1](spark, docs, d).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exp = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    exp = Counter((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))) for i, ids in exp)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == exp
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, d).collect()) == exp


def test_toxicity_stage_by_brute_force(spark, tmp_path):
    """The documents stay whose noisy-or over sentences is below the threshold; planted ones go, most clean ones stay."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows, bad = [], set()
    for i in range(500):
        parts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(rng.randint(1, 6))]
        if i % 6 == 0:
            parts[-1] += " " + rng.choice(["vile", "rotten"])
            bad.add(i)
        rows.append((i, ". ".join(parts), "en", "s", 1))
    rows += [(600, None, "en", "s", 0), (601, "", "en", "s", 0), (602, rows[0][1] * 3000, "en", "s", 0), (603, rows[1][1] * 300, "en", "s", 0), rows[6], rows[7]]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, int(i in bad)) for i in range(500)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = Counter(r.doc_id for r in P.drop_toxic(spark, docs, str(tmp_path)).collect())
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where(~P.common.held_out("doc_id", 4, 2)))

    def score(text):
        stay, sentences = 1.0, [x for s in re.split(r"[.!?\n。！？]", text or "") if (x := set(re.findall(r"[^\W\d_]+", s.lower())))]
        for found in sentences:
            z = model.bias - toxicity.FALL * math.log(max(1, len(sentences) / toxicity.TYPICAL)) + sum(model.weights.get(f, 0.0) for w in found for f in ([w] if len(w) < 5 else [w, w[:4] + "*", w[:5] + "*"]))
            stay *= 1 - 1 / (1 + math.exp(-z))
        return 1 - stay

    assert kept == Counter(r[0] for r in rows if score(r[1]) < P.MAX_TOXICITY)
    assert not kept.keys() & (bad | {602}) and len(kept.keys() - bad) > 400 and kept[600] == kept[601] == 1 and kept[7] == 2


def test_near_duplicates_stage_by_brute_force(spark):
    """Of each class of all pairs' links the row of least id stays."""
    rng = random.Random(22)
    texts = []
    for g in range(25):
        words = [f"{g}w{i}" for i in range(rng.randint(5, 90))]
        texts += [" ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in words) for _ in range(rng.randint(1, 6))]
    texts += rng.sample(texts, 10)
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = [r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(classes_by_brute_force(texts)))


def mixed_by_brute_force(rows):
    """Copies of each row: packets of 64 words in order of finish time, until the words of all rows are spent."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    size = {k: len((t or "").split()) for k, (_, t, _) in enumerate(rows)}
    totals = Counter()
    for k, (_, _, source) in enumerate(rows):
        totals[source] += size[k]
    goals, packets = targets(dict(totals)), []
    for number, source in enumerate(sorted(goals, key=lambda s: (s is None, s or ""))):
        queue = [k for k in range(len(rows)) if rows[k][2] == source]
        queue.sort(key=lambda k: (int(md5(f"{rows[k][0]} {md5(rows[k][1] or '')}")[:15], 16), rows[k][0]))
        at = 0
        for turn in range(3):
            for k in queue:
                for first in range(0, size[k], 64):
                    words = min(64, size[k] - first)
                    at += words
                    packets.append((at / goals[source], number, at, words, k, turn))
    left, served = sum(size.values()), Counter()
    for _, _, _, words, k, turn in sorted(packets):
        served[k, turn] += min(words, left)
        left -= min(words, left)
    return Counter({k: n for k in size if (n := sum(2 * served[k, turn] >= size[k] > 0 for turn in range(3)))})


def test_mixing_stage_by_brute_force(spark):
    rng = random.Random(23)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 3, 40, 200, 900]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    rows += [(200, "word " * 30_000, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    got = Counter(r.doc_id for r in P.mix(spark, docs, "").collect())
    assert got == Counter({rows[k][0]: n for k, n in mixed_by_brute_force(rows).items()}) and set(got.values()) == {1, 2, 3}


def test_odd_rows(spark, tmp_path):
    rows = [(1, "the same text of some words here", "en", "a", 1), (1, "the same text of some words here", "en", "a", 1), (None, None, None, None, None), (2, "", None, None, 0), (3, "the same text of some words here", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.drop_toxic(spark, docs, str(tmp_path)).count() == 5
    assert sorted(str(r.doc_id) for r in P.drop_near_duplicates(spark, docs, "").collect()) == ["1", "2", "None"]
    assert {r.doc_id for r in P.keep_languages(spark, docs, "").collect()} <= {1, 3}
    for stage in (P.keep_languages, P.drop_near_duplicates, P.mix):
        assert stage(spark, docs.where("false"), "").count() == 0
    assert P.mix(spark, docs, "").where(F.col("text").isNull()).count() == 0


def test_texts_of_unlearned_languages_go(spark):
    """Texts in letters that no learned language has go, short and mixed texts of a learned language stay."""
    rng = random.Random(3)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcdefgh", 40), "x", "a", 1) for i in range(40)]
    rows += [(100 + i, text(letters, 60), None, "a", 1) for i, letters in enumerate(["абвгдежз", "αβγδεζηθ", "אבגדהוזח", "กขคฆงจฉช"] * 5)]
    rows += [(200, "ab.", None, "a", 1), (201, "12 !?", None, "a", 1), (202, text("abcdefgh", 30) + " " + text("абвгд", 10), None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.keep_languages(spark, docs, "").collect()) == [*range(40), 200, 202]


def test_texts_of_unlearned_languages_in_the_same_script_go(spark):
    """Long texts of an unlearned language go though half of its letters are those of a learned one; repeated words and
    mostly learned texts stay."""
    rng = random.Random(4)
    learned, other = [
        ["".join(rng.choice(consonants) + rng.choice(vowels) + rng.choice(ends) for _ in range(rng.randint(1, 3))) for _ in range(150)]
        for consonants, vowels, ends in (("bdfgklmnprst", "aeo", ["", "n", "r", "s"]), ("chjkmnpqtvwz", "iouy", ["", "", "k", "n", "sz"]))
    ]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(learned, 150), "x", "a", 1) for i in range(60)] + [(100 + i, text(other, 150), None, "a", 1) for i in range(20)]
    rows += [(200, text(learned, 8) + (" " + learned[0]) * 500, None, "a", 1), (201, text(learned, 3000) + text(other, 500), None, "a", 1)]
    kept = sorted(r.doc_id for r in P.keep_languages(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert kept == [*range(60), 200, 201]

"""Decomposition and chunking: the cases of the fixtures, and invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import chunking as C
from lamina.operators import decompose as D
from lamina.sources import epub, files


def chunks_of(spark, text, target, tolerance):
    df = spark.createDataFrame([("a", 0, "L", text)], "leaf_id string, segment_index int, segment_label string, content_text string")
    return C.chunk_segments(df, C.ChunkConfig(target, tolerance)).orderBy("chunk_index").collect()


def segments_of(spark, text, f):
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(f(F.col("text"))).alias("s")).select("s.*")
    return [(r["segment_index"], r["segment_label"], r["content_text"]) for r in df.orderBy("segment_index").collect()]


LINE = "a" * 44
FENCED = "x" * 59 + "\n```\n" + "code line\n" * 3 + "```\n" + "y" * 59


@pytest.mark.parametrize(
    "text, target, tolerance, check",
    [
        ("One short sentence.", 20, 10, lambda c: [r.content_text for r in c] == ["One short sentence."] and c[0].chunk_label == "L"),
        (f"{LINE}\n\n{LINE}", 10, 5, lambda c: len(c) >= 2),
        (f"{LINE}\n# Head\nbody text", 10, 5, lambda c: len(c) >= 2 and any(r.content_text.startswith("# Head") for r in c)),
        (FENCED, 20, 10, lambda c: all(r.content_text.count("```") in (0, 2) for r in c)),
        ("\n".join(["abcdefghij"] * 20), 10, 5, lambda c: len(c) > 1),
        ("tiny\n# Head\n" + "z" * 199, 20, 10, lambda c: c[0].content_text.startswith("tiny\n# Head")),
        ("b" * 39 + ".\n" + "c" * 39 + ".", 10, 5, lambda c: len(c) >= 2),
        ("\n\n".join(["d" * 32] * 3), 5, 2, lambda c: [r.chunk_label for r in c] == [f"L [{i + 1}/{len(c)}]" for i in range(len(c))]),
        ("", 10, 5, lambda c: len(c) == 1),
    ],
)
def test_chunk_cases(spark, text, target, tolerance, check):
    assert check(chunks_of(spark, text, target, tolerance))


def test_line_classes(spark):
    lines = ["# a", "## b", "```", "", "  ", "x.", "x?", "x!", "plain", "####### no", "#x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    assert [r["s"] for r in df.orderBy("i").select(C.classify_line(F.col("x"))["score"].alias("s")).collect()] == [100, 95, 80, 20, 20, 10, 10, 10, 0, 0, 0]


def simulate(text, cfg):
    """The chunking rules once more, line by line."""
    if len(text) <= cfg.ceiling:
        return [text]
    lines, score_of = text.split("\n"), []
    inside = False
    for line in lines:
        t = line.strip()
        m = re.match(r"(#{1,6})( |$)", t)
        if t.startswith(("```", "~~~")) and not m:
            score_of.append((80, "post" if inside else "pre"))
            inside = not inside
        elif inside:
            score_of.append((0, None))
        elif m:
            score_of.append(([100, 95, 90, 85, 85, 85][len(m[1]) - 1], "pre"))
        elif not t:
            score_of.append((20, "post"))
        elif t[-1] in ".?!":
            score_of.append((10, "post"))
        else:
            score_of.append((0, None))
    decay = lambda s: max(0.0, 1 - abs(s - cfg.target) / cfg.target)
    out, start, size = [], 0, 0
    for i, (line, (score, kind)) in enumerate(zip(lines, score_of)):
        n = len(line) + 1
        size += n
        if size < cfg.least:
            continue
        if kind == "pre" and i > start and size - n >= cfg.least and (score * decay(size - n) >= 10 or size - n >= cfg.target):
            out.append(lines[start:i])
            start, size = i, n
            if size < cfg.least:
                continue
        if kind == "post" and (score * decay(size) >= 10 or size >= cfg.target) or size >= cfg.ceiling:
            out.append(lines[start : i + 1])
            start, size = i + 1, 0
    if start < len(lines):
        out.append(lines[start:])
    return [x for x in ("\n".join(c).rstrip() for c in out) if x]


def test_chunks_equal_simulation_and_lose_nothing(spark):
    rng = random.Random(3)
    pool = ["word " * 8, "Sentence ends.", "", "# Head", "### Deep", "```", "~~~", "é" * 30, "x" * 70, "  # indented", "why?", "\t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(str(i), 0, "L", t) for i, t in enumerate(texts)], "leaf_id string, segment_index int, segment_label string, content_text string")
    cfg = C.ChunkConfig(30, 15)
    got: dict[int, list] = {}
    for r in C.chunk_segments(df, cfg).orderBy("leaf_id", "chunk_index").collect():
        got.setdefault(int(r["leaf_id"]), []).append(r["content_text"])
    for i, t in enumerate(texts):
        assert got.get(i, []) == simulate(t, cfg)
        assert "".join("".join(got.get(i, [])).split()) == "".join(t.split())


def test_bad_config():
    with pytest.raises(ValueError):
        C.ChunkConfig(10, 10)


def test_plain_text(spark):
    assert segments_of(spark, "", D.plain_text) == [] == segments_of(spark, " \n\n \n", D.plain_text)
    assert len(segments_of(spark, "one paragraph", D.plain_text)) == 1
    assert len(segments_of(spark, "Head\n\nSub\n\n" + "body " * 40, D.plain_text)) == 1
    assert len(segments_of(spark, "a" * 2000 + "\n\n" + "b" * 2000, D.plain_text)) == 2
    assert segments_of(spark, "--- My Title\nx", D.plain_text)[0][1] == "my title"
    assert segments_of(spark, "=== Other", D.plain_text)[0][1] == "other"
    text = "\n\n".join(f"--- S{i}\n\n" + "w " * 700 for i in range(3))
    parts = segments_of(spark, text, D.plain_text)
    assert len(parts) >= 2 and "".join("".join(p[2] for p in parts).split()) == "".join(text.split())
    assert [p[1] for p in parts][1:] == ["s1", "s2"]  # short titles move on with their section


def test_markdown(spark):
    f = lambda t: [(b, c) for _, b, c in segments_of(spark, t, D.markdown)]
    assert f("# A\nx\n# B\ny") == [("A", "x"), ("B", "y")]
    assert f("intro\n# A\nx") == [("preamble", "intro"), ("A", "x")]
    assert f("no heading") == [("preamble", "no heading")]
    assert [b for b, _ in f("# A\n1\n## B\n2\n### C\n3")] == ["A", "B", "C"]
    assert f("#x\ny") == [("preamble", "#x\ny")]
    assert f("# A\n\n# B\nx") == [("B", "x")]
    assert f("") == []
    assert f("# A\r\nx\r\ny") == [("A", "x\ny")]


def test_html(spark):
    f = lambda t: [(b, c) for _, b, c in segments_of(spark, t, D.html)]
    assert f("<h1>A</h1>x<h2>B</h2>y") == [("A", "x"), ("B", "y")]
    assert f("<p>one <b>two</b></p>") == [("preamble", "one two")]
    assert f("<h1>a &amp; b</h1>&lt;x&gt; &quot;&#39;&nbsp;.") == [("a & b", "<x> \"' .")]
    assert f('<H2 class="c">T</H2>ü <i>é</i>') == [("T", "ü é")]
    assert f("<h1>gone</h1> <h1>stay</h1>x > y <cut") == [("stay", "x  y")]
    assert f("") == []


def book(toc=True, bodies=("<p>One <b>text</b></p>", "<p>Two</p>")):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="x"/>' for i in range(len(bodies))) + '<item id="ncx" href="t.ncx"/>' * toc
        z.writestr("OEBPS/c.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref={chr(34)}c{i}{chr(34)}/>' for i in range(len(bodies)))}</spine></package>")
        if toc:
            z.writestr("OEBPS/t.ncx", "".join(f'<navPoint><navLabel><text>Label — {i}</text></navLabel><content src="c{i}.xhtml#x"/></navPoint>' for i in range(len(bodies))))
        for i, b in enumerate(bodies):
            z.writestr(f"OEBPS/c{i}.xhtml", b)
    return out.getvalue()


def test_epub(spark):
    assert epub.segments(book()) == [(0, "Label — 0", "One text"), (1, "Label — 1", "Two")]
    assert epub.segments(book(False, ("<p> </p>", "x"))) == [(0, "chapter 1", "x")]
    with pytest.raises(ValueError):
        epub.segments(b"no zip")
    df = spark.createDataFrame([("a", bytearray(book())), ("b", bytearray(b"no zip"))], "leaf_id string, content binary")
    rows = epub.epub_segments(df).collect()
    assert len(rows) == 3 and [r for r in rows if r.leaf_id == "b"][0].error
    whole = book()
    at = whole.index(b"<p>One")
    broken = whole[:at] + b"<p>Two" + whole[at + 6 :]  # a member whose checksum is wrong
    rows = epub.epub_segments(spark.createDataFrame([("a", bytearray(broken)), ("b", bytearray(whole))], "leaf_id string, content binary")).collect()
    assert [r.error is not None for r in sorted(rows, key=lambda r: r.leaf_id)] == [True, False, False]


def test_files(tmp_path):
    assert files.supported("a.md") and files.supported("x/b.jpeg") and not files.supported("a.MD") and not files.supported(".md") and not files.supported("a.rs")
    for p in ("a.md", "b.txt", "skip.rs", "sub/c.pdf", ".hidden/d.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert [p[len(str(tmp_path)) + 1 :] for p in files.collect_files(str(tmp_path))] == ["a.md", "b.txt", "sub/c.pdf"]
    with pytest.raises(Exception, match="directory"):
        files.expand([str(tmp_path)], False)


def packed(paragraphs):
    """plain_text by brute force, for paragraphs of one byte a character."""
    done, parts = [], []
    for p in paragraphs:
        if not parts or sum(map(len, parts)) + len(p) <= D.TARGET or (len(p) <= D.STICKY and len(parts[-1]) <= D.STICKY):
            parts.append(p)
            continue
        k = max([i + 1 for i, x in enumerate(parts) if len(x) > D.STICKY] or [1])
        done.append(parts[:k])
        parts = [*parts[k:], p]
    return ["\n\n".join(g) for g in [*done, parts] if g]


@pytest.mark.parametrize("block", [3, 4096])
def test_folds_in_blocks(spark, monkeypatch, block):
    """Segments and chunks do not depend on the blocks in which a text is folded, at either side of their ends."""
    monkeypatch.setattr(T, "FOLD_BLOCK", block)
    r = random.Random(7)
    sizes = lambda n: [r.choice([r.randint(1, 80), 80, 81, r.randint(81, 700), r.randint(1400, 1600)]) for _ in range(n)]
    for n in (1, 2, 3, 4, 6, 7, 200, 9000 if block > 3 else 500):
        paragraphs = [r.choice("abc") * k for k in sizes(n)]
        assert [x[2] for x in segments_of(spark, "\n\n".join(paragraphs), D.plain_text)] == packed(paragraphs)
    short = ["x" * 10] * 9000
    assert [x[2] for x in segments_of(spark, "\n\n".join(short), D.plain_text)] == packed(short)
    lines = [r.choice(["# Head", "word " * 12, "An end.", "", "```", "plain", "## Sub"]) for _ in range(9000 if block > 3 else 700)]
    cfg = C.ChunkConfig(40, 20)
    text = "\n".join(lines)
    chunk = lambda: [tuple(c) for c in spark.createDataFrame([(text,)], "t string").select(C.chunks(F.col("t"), F.lit("x"), cfg).alias("c")).first().c]
    got = chunk()
    monkeypatch.setattr(T, "FOLD_BLOCK", 1 << 20)
    assert got == chunk() and len(got) > 20

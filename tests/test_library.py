"""Intake, store, reads, providers and the stream, end to end on small files."""

import json
import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lamina.errors import Ambiguous, EngineError, NotFound
from lamina.operators.embed import HashingProvider, HttpProvider, embed_images, embed_query, provider_of
from lamina.plans import events as E
from lamina.plans import ingest as I
from lamina.plans.library import Library, results_json
from lamina.plans.store import Part, Store, mark, merge
from lamina.sources import decomposers, files, pdf
from lamina.streaming.intake import run_available, run_events, run_folder, take_in

AS_OF = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "a.md").write_text("# Cats\ncats purr\n# Dogs\ndogs bark")
    (d / "b.html").write_text("<h1>Fish</h1>fish swim é")
    (d / "c.txt").write_text("plain words about birds")
    (d / "copy.txt").write_text("plain words about birds")
    (d / "bad.txt").write_bytes(b"\xff\xfe")
    (d / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (d / "broken.epub").write_bytes(b"no zip")
    return d


@pytest.fixture(scope="module")
def library(spark, folder):
    rows = files.read_files(spark, files.collect_files(str(folder)))
    return rows, I.ingest(rows, AS_OF, "pets", ["t", "u", "t"], provider=HashingProvider(32))


def test_ingest(library):
    rows, lib = library
    status = {r.source_path.rsplit("/")[-1]: r.status for r in lib.leaves.collect()}
    assert status == {"a.md": "ready", "b.html": "ready", "c.txt": "ready", "bad.txt": "error", "p.png": "ready", "broken.epub": "error"}
    r = I.report(rows, lib).first()
    assert (r.total, r.ingested, r.errors, r.skipped) == (7, 4, 2, 1)
    image = lib.chunks.where("chunk_label = 'p.png'").first()
    assert image.content_text is None and image.embedding is None


class Touchy(HashingProvider):
    """Fails on a word, and sees images."""

    provider_name = "touchy"

    def embed_batch(self, texts):
        if any("bark" in t for t in texts):
            raise OSError("no barking")
        return super().embed_batch(texts)

    def embed_image_bytes(self, images):
        return [[float(len(b))] * self.dimension for b in images]


def test_provider_errors_stay_with_their_leaf(spark, folder):
    rows = files.read_files(spark, files.collect_files(str(folder)))
    lib = I.ingest(rows, AS_OF, provider=Touchy(4))
    got = {r.source_path.rsplit("/")[-1]: r for r in lib.leaves.collect()}
    assert {n for n, r in got.items() if r.status == "error"} == {"a.md", "bad.txt", "broken.epub"}
    assert got["a.md"].error == "OSError: no barking" and got["a.md"].segment_count == 0
    assert lib.segments.where(F.col("leaf_id") == got["a.md"].content_hash).count() == 0 == lib.chunks.where(F.col("leaf_id") == got["a.md"].content_hash).count()
    image = lib.chunks.where("chunk_label = 'p.png'").first()
    assert image.embedding == [8.0] * 4 and image.content_text is None and "image" not in lib.chunks.columns
    with pytest.raises(EngineError):
        embed_images(HashingProvider(4), [b"x"])


def test_segments_are_skipped(spark, folder):
    """One failing segment leaves the rest of its leaf; what is left without segments is an error."""
    rows = files.read_files(spark, [str(folder / "a.md"), str(folder / "c.txt"), str(folder / "bad.txt")]).unionByName(
        spark.createDataFrame([("z/only.md", bytearray(b"# Dogs\ndogs bark"), "h", "markdown")], "source_path string, content binary, content_hash string, format string"))
    lib = I.ingest(rows, AS_OF, provider=Touchy(4), skip_segments=True)
    got = {r.source_path.rsplit("/")[-1]: (r.status, r.segment_count, r.skipped_segments) for r in lib.leaves.collect()}
    assert got == {"a.md": ("ready", 1, 1), "c.txt": ("ready", 1, 0), "bad.txt": ("error", 0, 0), "only.md": ("error", 0, 1)}
    r = I.report(rows, lib).first()
    assert (r.ingested, r.errors, r.segments, r.skipped_segments, r.chunks) == (2, 2, 2, 2, 2)
    q = F.array(*(F.lit(x) for x in embed_query(HashingProvider(4), "cats purr")))
    assert {r.content for r in lib.search(q, limit=9).collect()} == {"cats purr", "plain words about birds"}


def test_folder_is_listed_before_it_is_read(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"text {i}")
    read, read_files = [], files.read_files
    monkeypatch.setattr(files, "read_files", lambda s, paths: read.append(len(paths)) or read_files(s, paths))
    assert "content" not in files.listing(spark, str(folder))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert run_folder(spark, str(folder), store) == 3 and run_folder(spark, str(folder), store) == 0 and read == [3]
    (folder / "1.txt").write_text("text changed")
    (folder / "new.md").write_text("# T\nnew")
    assert run_folder(spark, str(folder), store, most=1) == 2 and read == [3, 1, 1]
    assert store.load().leaves.where("status = 'ready'").count() == 5 == store.load().chunks.count()
    assert all(p.state == "ready" for p in store.snapshot())


def test_intake_that_dies(spark, tmp_path, monkeypatch):
    """Leaves of a run that dies are processing; the same run takes them over, another one after repair()."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("words")
    store = Store(spark, str(tmp_path / "store"))
    rows = files.read_files(spark, [str(tmp_path / "in" / "a.txt")])

    def dies(*a, **k):
        raise RuntimeError("dies")

    with monkeypatch.context() as m:
        m.setattr("lamina.streaming.intake.ingest", dies)
        with pytest.raises(RuntimeError):
            take_in(rows, store, "one")
    assert [r.status for r in store.load().leaves.collect()] == ["processing"]
    take_in(rows, store, "two")
    assert [r.status for r in store.load().leaves.collect()] == ["processing"] and store.load().chunks.count() == 0
    store.repair(now=time.time() + 7200)
    take_in(rows, store, "two")
    assert [r.status for r in store.load().leaves.collect()] == ["ready"] and store.load().chunks.count() == 1


def test_rendered_pages_are_embedded(spark):
    def backend(content):
        yield from [(0, "text", None), (1, None, b"png")]

    rows = spark.createDataFrame([("a.pdf", bytearray(b"x"), "h", "pdf")], "source_path string, content binary, content_hash string, format string")
    lib = I.ingest(rows, AS_OF, provider=Touchy(2), pdf=backend)
    assert {r.segment_index: r.embedding for r in lib.chunks.collect()}[1] == [3.0, 3.0] and lib.leaves.first().segment_count == 2


def test_events(spark):
    leaves = spark.createDataFrame([(h, f"/r/{h}.txt", "ready", AS_OF) for h in "abcde"] + [("g", "/r/g.txt", "gone", AS_OF)], "content_hash string, source_path string, status string, updated_at timestamp")
    rows = [
        (1, "moved", "a", "/r/x/a.txt"), (2, "deleted", "a", "/r/a.txt"), (3, "deleted", "b", "/r/b.txt"), (4, "deleted", "c", "/r/c.txt"), (5, "created", "c", "/r/c2.txt"),
        (6, "created", "new", "/r/n.txt"), (7, "updated", "newer", "/r/n.txt"), (8, "moved", "d", "/other/d.txt"), (9, "moved", "e", "/r/e.exe"), (10, "created", "g", "/r/g.txt"), (11, "moved", None, None), (7, "updated", "newer", "/r/n.txt"),
    ]
    events = E.since(spark.createDataFrame(rows, "event_id long, event_type string, content_hash string, path string"), 0, ["/r"])
    later = datetime(2025, 2, 2)
    got = {r.content_hash: (r.source_path, r.status, r.updated_at == later) for r in E.apply_events(leaves, events, later).collect()}
    assert got == {"a": ("/r/x/a.txt", "ready", True), "b": ("/r/b.txt", "gone", True), "c": ("/r/c2.txt", "ready", True), "d": ("/r/d.txt", "ready", False), "e": ("/r/e.exe", "ready", True), "g": ("/r/g.txt", "ready", True)}
    again = E.apply_events(E.apply_events(leaves, events, later), events, datetime(2025, 3, 3))
    assert again.where("updated_at > '2025-03-01'").count() == 0
    assert [tuple(r) for r in E.wanted(events, leaves).collect()] == [("/r/n.txt", "newer")]
    assert E.apply_events(leaves, events.where("false"), later).exceptAll(leaves).count() == 0 == E.wanted(events.where("false"), leaves).count()


def test_event_stream(spark, library, tmp_path):
    _, lib = library
    store = Store(spark, str(tmp_path / "store"))
    store.commit(lib)
    leaf = lib.leaves.where("format = 'markdown'").first()
    for n, (kind, path) in enumerate((("moved", "/new/a.md"), ("deleted", "/new/a.md"), ("deleted", "/elsewhere.md"))):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / f"{n}.json").write_text(json.dumps({"event_id": n, "event_type": kind, "content_hash": leaf.content_hash, "path": path}))
        run_events(spark, str(tmp_path / "log"), store, str(tmp_path / "cp"))
        now = store.load()
        own = now.leaves.where(F.col("content_hash") == leaf.content_hash).first()
        assert (own.source_path, own.status) == ("/new/a.md", "ready" if n == 0 else "gone") and now.leaves.count() == 6
        assert now.segments.count() == lib.segments.count() and len(store.parts()) == min(n + 2, 3)


def test_search_and_reads(library):
    _, lib = library
    q = F.array(*(F.lit(x) for x in embed_query(HashingProvider(32), "cats purr")))
    top = lib.search(q, limit=2).collect()
    assert top[0].content == "cats purr" and top[0].score == pytest.approx(1, abs=1e-3)
    assert lib.search(q, tags=[]).count() == 0 == lib.search(q, collections=["x"]).count() and lib.search(q, tags=["u", "none"]).count() == 4
    leaf = lib.leaves.where("format = 'markdown'").first().content_hash
    assert [r.segment_label for r in lib.outline(leaf).collect()] == ["Cats", "Dogs"]
    assert lib.read(leaf, 1).first().content == "dogs bark" and lib.read(leaf, 1, 5, 2).count() == 0 and lib.read(leaf, 0, 0).first().mode == "chunk"
    one = lib.leaf(leaf).first()
    assert (one.tags, one.chunk_count) == (["t", "u"], 2)
    assert lib.list_leaves(status="error").count() == 2 and lib.collections().first()[0] == "pets" and lib.health()["status"] == "ok" and lib.health()["version"]
    assert lib.resolve_prefix(leaf[:60]) == leaf and lib.resolve_prefix("%") is None
    with pytest.raises(Ambiguous):
        lib.resolve_prefix("")
    with pytest.raises(NotFound) as e:
        lib.require("leaf", lib.leaf("none"), "the leaf")
    assert e.value.code == -32602 and set(e.value.data()) == {"tool", "constraint", "next_action"}


def test_store_and_stream(spark, folder, library, tmp_path):
    _, lib = library
    store = Store(spark, str(tmp_path / "store"))
    assert store.load() is None
    store.commit(lib)
    assert store.load().leaves.count() == 6 == merge(store.load(), lib).leaves.count()
    assert mark(lib.leaves, "error", lib.segments.select("leaf_id"), AS_OF, "x").where("error = 'x'").count() == 4
    other = Store(spark, str(tmp_path / "stream"))
    for n in (6, 7):
        run_available(spark, str(folder), other, str(tmp_path / "cp"))
        assert other.load().leaves.count() == n and len(other.parts()) == n - 5
        (folder / "new.txt").write_text("new words")


def test_store_survives_a_commit_that_dies(spark, library, tmp_path, monkeypatch):
    _, lib = library
    store = Store(spark, str(tmp_path))
    first = store.commit(lib)

    def dies(*a):
        raise RuntimeError("dies")

    monkeypatch.setattr(store, "_point", dies)
    with pytest.raises(RuntimeError):
        store.commit(lib)
    monkeypatch.undo()
    assert store.parts() == [first] and store.load().leaves.count() == 6
    with pytest.raises(OSError):
        store._point([Part("other")], 1)  # a number that is taken
    assert store.parts() == [first]


def test_appended_leaves_replace_failed_ones(spark, library, tmp_path):
    _, lib = library
    store = Store(spark, str(tmp_path))
    store.commit(lib)
    bad = lib.leaves.where("status = 'error'")
    n = bad.count()
    store.append(Library(bad.withColumn("status", F.lit("ready")), *(getattr(lib, t).where("false") for t in ("segments", "chunks", "leaf_tags"))))
    now = store.load()
    assert n == 2 and len(store.parts()) == 2 and now.leaves.count() == 6 == now.leaves.where("status = 'ready'").count() and now.chunks.count() == lib.chunks.count()
    store.commit(now)
    assert len(store.parts()) == 1 and store.load().leaves.where("status = 'ready'").count() == 6


def test_names_with_glob_signs_and_link_loops(spark, tmp_path):
    for name in ("a[1].txt", "b{x,y}.txt", "c*.txt", "d?.md", "e.rs"):
        (tmp_path / name).write_text(name)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.txt").write_text("f")
    (tmp_path / "sub" / "loop").symlink_to(tmp_path)
    paths = files.collect_files(str(tmp_path))
    names = sorted(p.rsplit("/")[-1] for p in paths)
    assert names == ["a[1].txt", "b{x,y}.txt", "c*.txt", "d?.md", "f.txt"]
    got = {r.source_path.rsplit("/")[-1]: bytes(r.content).decode() for r in files.read_files(spark, paths).collect()}
    assert sorted(got) == names and all(got[n] == n for n in names if n != "f.txt")
    (tmp_path / "sub" / "loop").unlink()
    assert sorted(r.source_path.rsplit("/")[-1] for r in files.read_folder(spark, str(tmp_path)).select("source_path").collect()) == names


def test_what_is_not_there(library):
    _, lib = library
    leaf = lib.leaves.where("format = 'markdown'").first().content_hash
    with pytest.raises(NotFound) as e:
        lib.outline("none")
    assert json.loads(e.value.json())["code"] == -32602 and json.loads(e.value.json())["data"]["tool"] == "outline"
    with pytest.raises(NotFound):
        lib.read_or_raise(leaf, 9)
    with pytest.raises(NotFound):
        lib.leaf_or_raise("none")
    assert lib.leaf_or_raise(leaf).first().chunk_count == 2
    assert lib.read_or_raise(leaf, 1).first().content == "dogs bark"


def test_pdf_backend(spark):
    def backend(content):
        if content == b"bad":
            raise ValueError("broken")
        yield from [(0, " text ", None), (1, None, None), (2, None, b"png")]

    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "leaf_id string, content binary")
    rows = sorted(map(tuple, pdf.pdf_segments(df, backend).drop("image").collect()), key=str)
    assert rows == [("a", 0, "p. 1", "text", None), ("a", 2, "p. 3", None, None), ("b", None, None, None, "ValueError: broken")]


class Ranges:
    """A backend that is asked for ranges of pages; page 40 of a file `torn` cannot be read."""

    def pages(self, content):
        if content == b"bad":
            raise ValueError("broken")
        return 0 if content == b"none" else 100

    def pages_of(self, content, first, last):
        for page in range(first, last):
            if content == b"torn" and page == 40:
                raise OSError("torn page")
            yield page, f"page {page}", None

    def __call__(self, content):
        return self.pages_of(content, 0, self.pages(content))


def test_pdf_page_ranges(spark):
    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad")), ("c", bytearray(b"torn")), ("d", bytearray(b"none"))], "leaf_id string, content binary")
    ranges = pdf.page_ranges(df.where("leaf_id = 'a'"), Ranges(), 4)
    assert ranges.count() == 25 and ranges.select(F.spark_partition_id()).distinct().count() > 1
    rows = pdf.pdf_segments(df, Ranges()).collect()
    assert sorted(r.segment_index for r in rows if r.leaf_id == "a") == list(range(100))
    assert [(r.leaf_id, r.segment_index, r.error) for r in rows if r.error and r.leaf_id == "b"] == [("b", None, "ValueError: broken")]
    torn = [r for r in rows if r.leaf_id == "c"]
    assert [(r.segment_index, r.error) for r in torn if r.error] == [(32, "OSError: torn page")] and len(torn) == 93
    files_ = df.where("leaf_id in ('a', 'c')").select(F.col("leaf_id").alias("source_path"), "content", F.col("leaf_id").alias("content_hash"), F.lit("pdf").alias("format"))
    got = {r.source_path: (r.status, r.segment_count, r.skipped_segments) for r in I.ingest(files_, AS_OF, pdf=Ranges(), skip_segments=True).leaves.collect()}
    assert got == {"a": ("ready", 100, 0), "c": ("ready", 92, 1)}
    got = {r.source_path: r.status for r in I.ingest(files_, AS_OF, pdf=Ranges()).leaves.collect()}
    assert got == {"a": "ready", "c": "error"}


class Tables:
    """A third format: a section for each column of a file of comma-separated values."""

    extensions = ("csv",)

    def format_name(self):
        return "table"

    def decompose(self, content, path):
        head, *rows = [line.split(",") for line in content.decode().splitlines()]
        for i, name in enumerate(head):
            yield name, "\n".join(r[i] for r in rows)


def test_registered_format(spark, tmp_path):
    (tmp_path / "a.csv").write_text("city,river\nBern,Aare\nBasel,Rhein")
    (tmp_path / "torn.csv").write_bytes(b"a,b\n1")
    (tmp_path / "b.txt").write_text("plain")
    assert len(files.collect_files(str(tmp_path))) == 1
    decomposers.register(Tables())
    try:
        rows = files.read_folder(spark, str(tmp_path))
        lib = I.ingest(rows, AS_OF)
        assert {r.source_path.rsplit("/")[-1]: (r.format, r.status, r.segment_count) for r in lib.leaves.collect()} == {"a.csv": ("table", "ready", 2), "torn.csv": ("table", "error", 0), "b.txt": ("plain_text", "ready", 1)}
        assert {(r.segment_index, r.segment_label, r.content_text) for r in lib.segments.where("segment_label <> 'plain'").collect()} == {(0, "city", "Bern\nBasel"), (1, "river", "Aare\nRhein")}
        with pytest.raises(EngineError):
            decomposers.register(type("Other", (Tables,), {"format_name": lambda self: "other"})())
    finally:
        decomposers.unregister("table")
    assert len(files.collect_files(str(tmp_path))) == 1


def test_results_as_json(library):
    _, lib = library
    q = F.array(*(F.lit(x) for x in embed_query(HashingProvider(32), "cats purr")))
    got = json.loads(results_json(lib.search(q, limit=2), query="cats purr"))
    assert got["count"] == 2 and got["query"] == "cats purr" and got["results"][0]["content"] == "cats purr" and got["results"][0]["citation"]["segment_index"] == 0
    leaf = lib.leaves.where("format = 'image'").first().content_hash
    assert json.loads(results_json(lib.read(leaf, 0), "reads"))["reads"][0]["chunks"][0]["content"] is None


def test_http_provider():
    class Handler(BaseHTTPRequestHandler):
        short = False

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(texts)][::-1]
            body = json.dumps({"data": data[1:] if Handler.short else data}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = HttpProvider(f"http://127.0.0.1:{server.server_port}", "m", 2, batch_size=2)
    assert p.embed_batch(["a", "bb", "ccc"]) == [[1, 1], [2, 1], [3, 1]]
    Handler.short = True
    with pytest.raises(EngineError):
        p.embed_batch(["a", "b"])
    server.shutdown()
    with pytest.raises(EngineError):
        provider_of("http", url="", model="", dimension=1)
    with pytest.raises(EngineError):
        provider_of("none")

from pyspark.sql import functions as F

from gleanframe.functions.text import collapse_whitespace, log_excerpt, strip
from gleanframe.operators.chunks import chunk_documents
from gleanframe.operators.reports import export_results
from gleanframe.operators.store import Store
from gleanframe.plans.sample import SPEC
from gleanframe.sources.convert import convert_files, folder_documents, html_to_text
from gleanframe.sources.documents import extension, read_text, route, scan_folder
from gleanframe.sources.exports import read_export
from gleanframe.streaming.ingest import folder_stream, ingest


def base(path):
    return path.rsplit("/", 1)[-1]


def test_folder(spark, tmp_path):
    files = {
        "a.md": b"x\r\ny\rz",
        "B.TXT": b"\xef\xbb\xbfhi",
        "d.txt": b"a\xff",
        "c.pdf": b"%PDF",
        "e.csv": b"1,2",
        ".h.md": b"hidden",
        "_u.md": b"hidden",
        "empty.md": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.md").write_bytes(b"nested")
    documents = read_text(scan_folder(spark, str(tmp_path)))
    found = {base(r.file): (r.status, r.content) for r in documents.collect()}
    assert found == {
        "a.md": ("ok", "x\ny\nz"),
        "B.TXT": ("ok", "﻿hi"),
        "d.txt": ("undecodable", None),
        "c.pdf": ("convertible", None),
        "e.csv": ("unsupported", None),
    }
    assert {base(r.file) for r in chunk_documents(documents, 2).collect()} == {"a.md", "B.TXT"}


def test_routing(spark):
    cases = {
        "/x/a.md": (".md", "text"), "/x/a.TXT": (".txt", "text"), "a.b.PDF": (".pdf", "convertible"),
        "/x.md/a": ("", "unsupported"), "/x/.md": ("", "unsupported"), "..txt": ("", "unsupported"),
        "a.": (".", "unsupported"), "/x/.a.docx": (".docx", "convertible"), "": ("", "unsupported"),
        "x.pptx": (".pptx", "convertible"),
    }
    frame = spark.createDataFrame([(p,) for p in cases], "p string")
    rows = frame.select("p", extension(F.col("p")).alias("e"), route(F.col("p")).alias("k")).collect()
    assert {r.p: (r.e, r.k) for r in rows} == cases


def test_conversion_errors_stay_with_their_document(spark):
    def broken(data):
        raise RuntimeError("bad file")

    registry = {".html": html_to_text, ".pdf": broken, ".docx": lambda data: None}
    rows = [
        ("a.html", b"<p>one<script>x</script> two</p><p>a &amp; b</p>"),
        ("b.pdf", b"x"), ("c.docx", b"x"), ("d.pptx", b"x"), ("e.html", b"\xff"),
    ]
    files = spark.createDataFrame(rows, "file string, data binary")
    found = {r.file: r for r in convert_files(files, registry).collect()}
    assert found["a.html"].content == "one two\n\na & b"
    assert [found[f].status for f in ("b.pdf", "c.docx", "d.pptx", "e.html")] == [
        "failed", "empty", "unsupported", "failed",
    ]
    assert found["b.pdf"].error == "RuntimeError: bad file"


def test_folder_with_converters(spark, tmp_path):
    for name, data in {
        "a.MD": b"x\r\ny", "b.txt": b"a\xff", "c.Pdf": b"one", "d.docx": b"two", "e.csv": b"3",
    }.items():
        (tmp_path / name).write_bytes(data)

    def shout(data):
        return data.decode().upper()

    documents = folder_documents(spark, str(tmp_path), {".pdf": shout})
    found = {base(r.file): (r.status, r.content) for r in documents.collect()}
    assert found == {
        "a.MD": ("ok", "x\ny"),
        "b.txt": ("undecodable", None),
        "c.Pdf": ("ok", "ONE"),
        "d.docx": ("unsupported", None),
        "e.csv": ("unsupported", None),
    }


def test_export_with_stray_quotes(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(
        '"file_name","quote","score"\n"one.txt","plain","1"\n"two.x.txt","on a 4\'5" stand","8"\n'
        '"three.txt",""Girl" has been","9"\n"four.txt","said ""no"" twice",""\n'
    )
    rows = read_export(spark, str(path), ["file_name", "quote", "score"]).collect()
    assert [(r.stem, r.quote, r.score) for r in rows] == [
        ("one", "plain", "1"), ("two.x", 'on a 4\'5" stand', "8"),
        ("three", '"Girl" has been', "9"), ("four", 'said "no" twice', None),
    ]


def test_export_round_trip(spark, tmp_path):
    rows = [("f", ' a "b", c ', "x\ny"), ("g", "", None)]
    export_results(spark.createDataFrame(rows, "file string, a string, b string"), f"{tmp_path}/e")
    back = read_export(spark, f"{tmp_path}/e", ["file", "a", "b"], multi_line=True).collect()
    assert sorted((r.file, r.a, r.b) for r in back) == [("f", ' a "b", c ', "x\ny"), ("g", None, None)]


def test_text_functions(spark):
    text = "  a\t\x1cb\n\n c "
    row = spark.createDataFrame([(text,)], "t string").select(
        strip(F.col("t")).alias("stripped"),
        collapse_whitespace(F.col("t")).alias("collapsed"),
        log_excerpt(F.col("t"), 3).alias("excerpt"),
        log_excerpt(F.col("t"), 50).alias("whole"),
    ).first()
    assert row.stripped == text.strip()
    assert row.collapsed == " ".join(text.split())
    assert row.excerpt == f"{text[:3]}\n...\n(first 3 out of {len(text)} characters shown)\n"
    assert row.whole == text


def test_folder_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("one. two.")
    (folder / "b.csv").write_text("no")
    store = Store(spark, f"{tmp_path}/store", SPEC)

    def run():
        ingest(
            folder_stream(spark, str(folder)), store, f"{tmp_path}/progress", 5, one_row_per_file=True
        ).awaitTermination()
        return sorted((base(r.file), r.start, r.end) for r in store.chunks().collect())

    first = run()
    assert {name for name, _, _ in first} == {"a.md"}
    (folder / "a.md").write_text("changed to something longer")
    (folder / "new.md").write_text("fresh")
    second = run()
    assert [c for c in second if c[0] == "a.md"] == first
    assert {name for name, _, _ in second} == {"a.md", "new.md"}
    assert run() == second


def test_double_dots_are_one_file(spark, tmp_path):
    (tmp_path / "a..md").write_text("text")
    rows = folder_documents(spark, str(tmp_path)).collect()
    assert [(r.content, r.status) for r in rows] == [("text", "ok")]


def test_stream_converts_and_keeps_what_it_cannot(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.md", "b.pdf", "c.docx"):
        (folder / name).write_bytes(b"bytes of " + name.encode())
    stream = folder_stream(spark, str(folder), converters={".pdf": lambda data: data.decode() + "!"})
    query = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    found = {r.file.rsplit("/", 1)[1]: (r.content, r.status) for r in spark.table("arrived").collect()}
    assert found == {
        "a.md": ("bytes of a.md", "ok"), "b.pdf": ("bytes of b.pdf!", "ok"), "c.docx": (None, "unsupported"),
    }

import io
import struct
import time
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanloom.operators import review, sinks
from spanloom.sources import files
from spanloom.streaming import queue

SOURCES = "array<struct<documentId:string,docType:string,page:int>>"


def test_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿line one  \r\nline two\n".encode())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n1 0 obj<</Type /Page /Contents 2 0 R>>endobj\n2 0 obj<<>>stream\n(Advisor: John D. Carter) Tj\nendstream endobj")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\n1 0 obj<</Type /Page /Contents 2 0 R>>endobj\n2 0 obj<</Filter /FlateDecode>>stream\n" + zlib.compress(b"[(Hello) -20 ( World and more)] TJ") + b"\nendstream endobj")
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    with zipfile.ZipFile(tmp_path / "d.hwpx", "w") as z:
        z.writestr("Contents/section1.xml", "<x><hp:t>second</hp:t></x>")
        z.writestr("Contents/section0.xml", "<x><hp:t>A &amp; </hp:t><hp:t>B</hp:t></x>")
    (tmp_path / "e.png").write_bytes(b"x")
    (tmp_path / "f.hwp").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["a.txt"].pages[0].text == "line one\nline two" and got["a.txt"].hasTextLayer
    assert "Carter" in got["b.pdf"].pages[0].text and got["c.pdf"].pages[0].text == "Hello World and more"
    assert got["bad.pdf"].pages[0].text == "" and got["bad.pdf"].note and not got["bad.pdf"].hasTextLayer
    assert got["d.hwpx"].pages[0].text == "A & B\nsecond" and got["e.png"].pages[0].imagePath.endswith("e.png") and got["f.hwp"].pageCount == 0


def test_hwp_records():
    units = lambda *u: struct.pack(f"<{len(u)}H", *u)
    body = units(*map(ord, "가나"), 13, 11, 1, 2, 3, 4, 5, 6, 7, ord("x"), 24, ord("y"))
    data = struct.pack("<I", 66 | 2 << 20) + b"zz" + struct.pack("<I", 67 | len(body) << 20) + body
    assert files.section_text(data) == "가나\nxy"
    long = units(*[ord("a")] * 3000)
    assert files.section_text(struct.pack("<II", 67 | 0xFFF << 20, len(long)) + long) == "a" * 3000


def test_names_of_entries():
    assert files.entry_name(bytes([0xC0, 0xCC, 0xC1, 0xD8, 0xC8, 0xA3]), 0) == "이준호"
    assert files.entry_name("이준호".encode(), 0x800) == "이준호"
    bad = ["../../etc/passwd", "a/../../../b.txt", "../ms-out-sibling/evil.txt"]
    assert all(map(files.leaves_root, bad)) and not files.leaves_root("a/b/c.txt")
    short = files.safe_component("가" * 120 + ".pdf")
    assert len(short.encode()) <= 200 and short.endswith(".pdf") and files.safe_component("..") == "_" and files.safe_component("a/b\x01") == "a_b"


def test_unzip_and_layout(spark, tmp_path):
    for name, entries in (("w.zip", ["top/학위논문/a.pdf", "top/b.txt", "__MACOSX/x", "top/.DS_Store"]), ("flat.zip", ["a.pdf", "c/d.txt"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for e in entries:
                z.writestr(e, b"data")
    got = files.unzip(spark, str(tmp_path))
    rows = {(r.archive.rsplit("/", 1)[1], r.filename): (r.wrapper, r.category) for r in review.layout(got.select("archive", "path")).collect()}
    assert rows == {("w.zip", "a.pdf"): ("top", "학위논문"), ("w.zip", "b.txt"): ("top", None), ("flat.zip", "a.pdf"): (None, None), ("flat.zip", "d.txt"): (None, "c")}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../x", b"1")
        z.writestr(" a /b\x85.txt", b"2")
    assert list(files.unpack(out.getvalue())) == [("_/x", b"1", None), ("a/b.txt", b"2", None)]


def test_a_broken_archive_gives_a_note(spark, tmp_path, monkeypatch):
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    for name, n in (("good.zip", 1), ("many.zip", 3)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for i in range(n):
                z.writestr(f"{i}.txt", b"data")
    assert sorted((r.archive.rsplit("/", 1)[1], r.path, (r.note or "")[:12]) for r in files.unzip(spark, str(tmp_path)).where("path is null or archive like '%good.zip'").collect()) == [("broken.zip", None, "not readable"), ("good.zip", "0.txt", "")]
    monkeypatch.setattr(files, "ENTRIES_MOST", 2)
    assert [n for *_, n in files.unpack((tmp_path / "many.zip").read_bytes())] == ["not readable: too many entries"]


def made_pdf() -> bytes:
    """Two pages out of object order, in an object stream, with a font whose codes only its Unicode map explains."""
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <C774> <0002> <C900> endbfchar 1 beginbfrange <0003> <0004> <D638> endbfrange"
    inside = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [4 0 R 3 0 R] /Resources <</Font <</F1 7 0 R>>>>>>", b"<</Type /Page /Contents 6 0 R>>", b"<</Type /Page /Contents [5 0 R]>>"]
    head, at = [], 0
    for n, o in enumerate(inside, 1):
        head.append(f"{n} {at}")
        at += len(o) + 1
    first = " ".join(head).encode() + b" "
    packed = lambda n, extra, body: b"%d 0 obj<<%s /Filter /FlateDecode /Length %d>>stream\n%s\nendstream endobj\n" % (n, extra, len(z := zlib.compress(body)), z)
    return b"%PDF-1.5\n" + packed(9, b"/Type /ObjStm /N 4 /First %d" % len(first), first + b" ".join(inside)) + packed(5, b"", b"BT /F1 9 Tf <000100020003> Tj 0 -10 Td (\\000\\004) Tj ET") + packed(6, b"", b"BT (second (page)) Tj T* [(a) -300 (b) 20 (c)] TJ ET") + b"7 0 obj<</Type /Font /ToUnicode 8 0 R>>endobj\n" + packed(8, b"", cmap)


def test_pdf_of_object_streams():
    assert files.pdf_pages(made_pdf()) == ["이준호 혹", "second (page) a bc"]
    with pytest.raises(ValueError):
        files.pdf_pages(b"nothing")


def test_hwp_leaves_out_a_bad_section(monkeypatch):
    body = struct.pack("<2H", *map(ord, "가나"))
    good = struct.pack("<I", 67 | len(body) << 20) + body
    deflate = lambda b: (c := zlib.compressobj(wbits=-15)).compress(b) + c.flush()
    for header in ({}, {"FileHeader": bytes(36) + b"\x01"}):
        monkeypatch.setattr(files, "compound_streams", lambda data, h=header: {"BodyText/Section0": b"\xff\xff", "BodyText/Section10": deflate(good), "BodyText/Section2": deflate(good), **h})
        assert files.hwp_text(b"") == "가나\n가나"


def people(spark):
    rows = [("1", "a", "이, 준호", ["supervisor", "coauthor"], [("d1", "hindex", 2)], None, True, False, "pending"), ("1", "b", "Kim", [], [], 'x "y"', False, False, "rejected"), ("1", "c", "Me", ["coauthor"], [], None, False, True, "pending")]
    return spark.createDataFrame(rows, f"applicant_id string, id string, canonical_name string, roles array<string>, sources {SOURCES}, affiliation string, needs_human boolean, is_self boolean, final_status string")


def test_exports(spark, tmp_path):
    out = sinks.roster_export(people(spark))
    assert [r.value for r in sinks.csv_lines(out).collect()] == ['"이, 준호","지도교수, 공저자",,구글스칼라(hindex) p.2,Y,N']
    sinks.write_csv(out, str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text("utf-8").startswith("﻿canonical_name,roles,affiliation,sources,needs_human,is_self\n")
    with zipfile.ZipFile(io.BytesIO(sinks.xlsx_bytes(out))) as z:
        assert "지도교수, 공저자" in z.read("xl/worksheets/sheet1.xml").decode()


def test_actions(spark):
    actions = spark.createDataFrame([("a", "edit", " New "), ("b", "exclude", None)], "id string, action string, name string")
    after, audit = review.act(people(spark), actions)
    assert {r.id: (r.canonical_name, r.final_status) for r in after.collect()} == {"a": ("New", "edited"), "b": ("Kim", "rejected"), "c": ("Me", "pending")}
    assert {(r.person_id, r.field, r.old_value, r.new_value) for r in audit.collect()} == {("a", "canonical_name", "이, 준호", "New"), ("b", "final_status", "rejected", "rejected")}


def test_replacements(spark, tmp_path):
    old = spark.createDataFrame([("1", "x", None), ("2", "e", "E"), ("3", "f", None)], "applicant_id string, name string, external_id string")
    new = spark.createDataFrame([("9", "n", "E"), ("8", "m", None)], old.schema)
    assert {r.applicant_id for r in review.upload(old, new).collect()} == {"1", "3", "8", "9"}
    assert {(r.applicant_id, r.name) for r in review.replace_partition(old, spark.createDataFrame([("1", "y", None)], old.schema), "applicant_id").collect()} == {("1", "y"), ("2", "e"), ("3", "f")}
    flags = spark.createDataFrame([("1", "ambiguous"), ("1", "seal"), ("2", "ambiguous")], "applicant_id string, flag_type string")
    assert sorted(map(tuple, review.replace_ambiguous(flags, flags.limit(0), old.where("applicant_id = '1'")).collect())) == [("1", "seal"), ("2", "ambiguous")]
    sinks.write_by_key(old, str(tmp_path / "t"), "applicant_id")
    sinks.write_by_key(spark.createDataFrame([("1", "z", None)], old.schema), str(tmp_path / "t"), "applicant_id")
    assert {r.name for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"z", "e", "f"}


def test_cache(spark):
    t = lambda d: datetime(2024, 1, d)
    cached = spark.createDataFrame([("r10", t(1)), ("r1", t(30)), ("used", t(1)), ("new", t(31))], "path string, modificationTime timestamp")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    flags = spark.createDataFrame([("used",), (None,)], "crop_path string")
    assert {r.path for r in review.expired(cached, now).collect()} == {"r10", "used"}
    assert {r.path for r in review.orphan_files(cached, flags, now).collect()} == {"r10"}
    snaps = spark.createDataFrame([(f"s{i:02}",) for i in range(16)], "path string")
    assert {r.path for r in review.keep_newest(snaps).collect()} == {"s00", "s01"}


def test_order_and_sources(spark):
    df = spark.createDataFrame([("Kim", False), ("나", False), ("가", False), ("하", True)], "canonical_name string, needs_human boolean").withColumn("name_candidates", F.array())
    assert [r.canonical_name for r in review.korean_order(df).collect()] == ["하", "가", "나", "Kim"]
    flags = spark.createDataFrame([("f", "1", "ambiguous", "이, 준호 / 없음")], "flag_id string, applicant_id string, flag_type string, label string")
    got = {r.name: len(r.sources) for r in review.candidate_sources(flags, people(spark)).collect()}
    assert got == {"이, 준호": 1, "없음": 0}


def jobs(spark, *rows):
    return spark.createDataFrame([(i, "p", s, "{}", 0, n, None, datetime(2024, 1, 1 + k)) for k, (i, s, n) in enumerate(rows)], queue.JOB)


def test_queue(spark):
    state = lambda df: {r.id: (r.status, r.attempts) for r in df.collect()}
    assert state(queue.claim(jobs(spark, ("a", "done", 1), ("b", "queued", 0), ("c", "queued", 0)))) == {"a": ("done", 1), "b": ("running", 1), "c": ("queued", 0)}
    assert state(queue.claim(jobs(spark, ("a", "queued", 3), ("b", "queued", 0)))) == {"a": ("error", 3), "b": ("queued", 0)}
    assert state(queue.recover(jobs(spark, ("a", "running", 1)))) == {"a": ("queued", 1)}
    assert state(queue.claim(jobs(spark, ("a", "done", 1)))) == {"a": ("done", 1)}
    done = queue.finish(jobs(spark, ("a", "running", 1)), "a").first()
    assert (done.status, done.progress) == ("done", 100)


def test_queue_stream(spark, tmp_path):
    jobs(spark, ("a", "queued", 0), ("b", "done", 0)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queue.JOB).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        queue.drain(stream, lambda b: b.select("id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_queue_loop(spark, tmp_path):
    """Jobs of two batches: one fails, one is worn out, one is left running by work that dies and is recovered with the next batch."""
    path, cp, inbox = str(tmp_path / "jobs"), str(tmp_path / "cp"), tmp_path / "in"
    jobs(spark, ("a", "queued", 0), ("b", "queued", 0), ("c", "queued", 3), ("d", "queued", 0)).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema(queue.JOB).parquet(str(inbox))
    work = lambda rows: rows.where("id <> 'd'").select("id", F.when(F.col("id") == "b", "broken").alias("error"))
    queue.run_queue(spark, stream, work, path, cp).awaitTermination()
    state = lambda v: {r.id: (r.status, r.attempts, r.error) for r in spark.read.schema(queue.JOB).parquet(f"{path}/v{v}").collect()}
    assert state(2) == {"a": ("done", 1, None), "b": ("error", 1, "broken"), "c": ("error", 3, "too many attempts"), "d": ("running", 1, None)}
    assert queue.recovered(spark.read.schema(queue.JOB).parquet(f"{path}/v2")).first()[0] == 1
    jobs(spark, ("e", "queued", 0)).write.mode("append").parquet(str(inbox))
    queue.run_queue(spark, stream, lambda rows: rows.select("id", F.lit(None).cast("string").alias("error")), path, cp).awaitTermination()
    assert {k: v[:2] for k, v in state(4).items()} == {"a": ("done", 1), "b": ("error", 1), "c": ("error", 3), "d": ("done", 2), "e": ("done", 1)}


def test_wait_and_snapshots(spark, tmp_path):
    seen = iter(["queued", "running", "done", "x"])
    assert queue.wait_for(lambda: next(seen), seconds=0) == "done" and queue.wait_for(lambda: "running", 3, 0) == "running"
    gone = [sinks.snapshot(spark, {"t": spark.range(3)}, str(tmp_path / "s"), f"2024-01-0{i}", keep=2) for i in range(1, 5)]
    assert gone == [[], [], ["2024-01-01"], ["2024-01-02"]] and spark.read.parquet(str(tmp_path / "s" / "2024-01-04" / "t")).count() == 3


def test_models_of_processes(spark):
    known = [(10, 9, "worker"), (9, 8, "python"), (8, 1, "python vllm serve org/Model-7B/ --port 80"), (20, 1, "/usr/bin/ollama runner"), (30, 1, "x"), (40, 41, "a"), (41, 40, "b"), (50, 8, "vllm serve y --served-model-name named")]
    got = files.models_of(spark.createDataFrame([(p,) for p in (10, 20, 30, 40, 50, 99)], "pid int"), spark.createDataFrame(known, "pid int, ppid int, cmdline string"))
    assert dict(map(tuple, got.collect())) == {10: "Model-7B", 20: "ollama", 30: "unknown", 40: "unknown", 50: "named", 99: "unknown"}
    lines = spark.createDataFrame([("0, GPU-a, 5, 10, 50",), ("bad",), ("1, GPU-b, x, 10, 50",)], "line string")
    assert [tuple(r) for r in files.csv_fields(lines, files.CARD).orderBy("index").collect()] == [(0, "GPU-a", 5, 10, 50), (1, "GPU-b", None, 10, 50)]


def test_display_orders(spark):
    t = lambda d: datetime(2024, 1, d)
    applicants = spark.createDataFrame([("a", t(1)), ("b", t(3)), ("c", t(2))], "applicant_id string, created_at timestamp")
    none = spark.createDataFrame([], "applicant_id string, needs_human boolean")
    jobs_ = spark.createDataFrame([], "id string, status string, payload string, created_at timestamp")
    assert [r.applicant_id for r in review.applicant_summary(applicants, none, none, jobs_).collect()] == ["b", "c", "a"]
    flags = spark.createDataFrame([("b", "d1", t(1)), ("a", "d2", t(1)), ("b", "gone", t(2))], "applicant_id string, document_id string, created_at timestamp").withColumns({"status": F.lit("open"), "person_id": F.lit("p")})
    docs = spark.createDataFrame([("d1", "f", "hwp"), ("d2", "f", None)], "document_id string, filename string, format string")
    got = review.review_queue(flags, applicants.select("applicant_id", F.lit("n").alias("name")), docs, spark.createDataFrame([], "person_id string, name_raw string")).collect()
    assert [(r.applicant_id, r.document_id, r.format) for r in got] == [("a", "d2", "pdf"), ("b", "gone", "pdf"), ("b", "d1", "hwp")]


MINUTE = 60_000


def test_limiter(spark):
    rows = [("four", i * MINUTE, "fail") for i in range(4)] + [("five", i * MINUTE, "fail") for i in range(5)] + [("five", 10 * MINUTE, "success"), ("five", 65 * MINUTE, "success")]
    rows += [("slow", i * 16 * MINUTE, "fail") for i in range(6)] + [("four", 5 * MINUTE, "success"), ("clear", 0, "fail")]
    rows += [("clear", i * MINUTE, o) for i, o in enumerate(["fail", "fail", "fail", "success", "fail", "fail"], 1)]
    got = queue.limited(spark.createDataFrame(rows, "key string, ts long, outcome string")).collect()
    assert {(r.key, r.ts) for r in got if not r.allowed} == {("five", 10 * MINUTE)}


def test_limiter_stream(spark, tmp_path):
    spark.createDataFrame([("k", i * MINUTE, "fail") for i in range(6)], "key string, ts long, outcome string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts long, outcome string").parquet(str(tmp_path / "in"))
    q = queue.limited_stream(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()  # timers keep it from ending by itself
    deadline = time.time() + 40
    while time.time() < deadline and spark.sql("select * from limited").count() < 6:
        time.sleep(0.5)
    q.stop()
    assert sorted((r.ts, r.allowed) for r in spark.sql("select * from limited").collect()) == [(i * MINUTE, i < 5) for i in range(6)]


def test_gpu(spark):
    cards = spark.createDataFrame([("u", 0, 5, 10, 50)], "uuid string, index int, memory_used int, memory_total int, utilization int")
    procs = spark.createDataFrame([("u", 1, 3), ("gone", 2, 4)], "uuid string, pid int, memory int")
    lines = {r.line for r in files.gpu_metrics(cards, procs, spark.createDataFrame([(1, "m")], "pid int, model string")).collect()}
    assert 'gpu_model_memory{gpu="0",model="m"} 3' in lines and 'gpu_model_memory{gpu="?",model="other"} 4' in lines and 'gpu_memory_used{gpu="0"} 5' in lines

"""Registered queries on files, exports, state changes and small rules, with SQL; those on made files compare with their contents."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

from pyspark.sql import functions as F

from spanloom.functions import rules
from spanloom.operators import extract, process, review, sinks
from spanloom.plans import catalog
from spanloom.plans.catalog import PEOPLE_SQL, query, read
from spanloom.sources import files
from spanloom.streaming import queue


def values(rows, columns):
    """A VALUES list of these rows."""
    def one(v):
        return "null" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({columns})"


# ---- files


def pdf(content: bytes, extra: bytes = b"") -> bytes:
    return b"%PDF-1.4\n1 0 obj<</Type /Page /Contents 2 0 R>>endobj\n2 0 obj<<" + extra + b">>stream\n" + content + b"\nendstream endobj"


def archive(entries) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


HWPX = archive([("Contents/section10.xml", "<x><hp:t>last</hp:t></x>"), ("Contents/section2.xml", "<x><hp:t>A &amp; </hp:t><hp:t>&#44032;</hp:t></x>"), ("mimetype", "x")])
MADE = [
    ("a/one.txt", "﻿line one  \r\nline two\n\n".encode()), ("a/two.MD", b"# title\t\n"), ("b/plain.pdf", pdf(b"BT (Advisor: John D. Carter) Tj ET")), ("b/packed.pdf", pdf(zlib.compress(b"[(Hello) -20 ( World and more)] TJ"), b"/Filter /FlateDecode")),
    ("b/scan.pdf", pdf(b"q Q")), ("b/bad.pdf", b"nothing"), ("c/h.hwpx", HWPX), ("c/broken.hwp", b"broken"), ("d/p.png", b"x"), ("d/odd.xyz", b"x"),
]
SCANNED = [
    ("a/one.txt", "text", 1, True, False, "line one\nline two"), ("a/two.MD", "text", 1, True, False, "# title"), ("b/plain.pdf", "pdf", 1, True, False, "Advisor: John D. Carter"), ("b/packed.pdf", "pdf", 1, True, False, "Hello World and more"),
    ("b/scan.pdf", "pdf", 1, False, True, ""), ("b/bad.pdf", "pdf", 1, False, True, ""), ("c/h.hwpx", "hwp", 1, True, False, "A & 가\nlast"), ("c/broken.hwp", "hwp", 0, False, True, ""), ("d/p.png", "image", 1, False, False, ""), ("d/odd.xyz", "image", 1, False, True, ""),
]


@query("select * from " + values(SCANNED, "path, format, page_count, has_text, noted, text"))
def file_scan(spark, sf_dir):
    got = files.scan_contents(spark.createDataFrame([(p, bytearray(c)) for p, c in MADE], "path string, content binary"))
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "|")
    return got.select("path", "format", F.col("pageCount").alias("page_count"), F.col("hasTextLayer").alias("has_text"), F.col("note").isNotNull().alias("noted"), text.alias("text"))


LONG = "가" * 120 + ".pdf"
ZIPS = [
    ("w.zip", archive([("top/학위논문/a.pdf", b"1"), ("top/b.txt", b"2"), ("__MACOSX/x", b"3"), ("top/.DS_Store", b"4"), ("top/dir/", b"")])), ("flat.zip", archive([("a.pdf", b"5"), ("c/d.txt", b"6"), ("../up.txt", b"7"), ("c/ e\x07 .txt", b"8")])),
    ("long.zip", archive([(LONG, b"9")])), ("broken.zip", b"PK and no more"),
]
UNZIPPED = [
    ("w.zip", "top/학위논문/a.pdf", "top", "학위논문", "a.pdf", "1"), ("w.zip", "top/b.txt", "top", None, "b.txt", "2"), ("flat.zip", "a.pdf", None, None, "a.pdf", "5"), ("flat.zip", "c/d.txt", None, "c", "d.txt", "6"), ("flat.zip", "_/up.txt", None, "_", "up.txt", "7"),
    ("flat.zip", "c/e .txt", None, "c", "e .txt", "8"), ("long.zip", "가" * 65 + ".pdf", None, None, "가" * 65 + ".pdf", "9"),
]


@query("select * from " + values([*((*r, False) for r in UNZIPPED), ("broken.zip", None, None, None, None, None, True)], "archive, path, wrapper, category, filename, content, noted"))
def unzip_entries(spark, sf_dir):
    got = files.unzip_contents(spark.createDataFrame([(p, bytearray(c)) for p, c in ZIPS], "path string, content binary"))
    placed = review.layout(got.where("path is not null").select("archive", "path"))
    return got.join(placed, ["archive", "path"], "left").select("archive", "path", "wrapper", "category", "filename", F.col("content").cast("string").alias("content"), F.col("note").isNotNull().alias("noted"))


@query("select event_id, case event_id % 5 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'text/plain; charset=utf-8' when 3 then 'image/jpeg' else 'application/octet-stream' end mime, case event_id % 5 when 0 then 'pdf' when 1 then 'image' when 2 then 'text' when 3 then 'image' end format from events")
def file_types(spark, sf_dir):
    name = F.concat(F.lit("x/"), F.col("event_type"), F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".txt", ".Jpeg", ".zip"])), (F.col("event_id") % 5 + 1).cast("int")))
    return read(spark, sf_dir, "events").select("event_id", files.mime_type(name).alias("mime"), rules.format_of(name).alias("format"))


HEADERS_SQL = r"""with f as (select c_custkey, (['pdf', 'PNG', 'hwp', 'txt', 'md'])[c_custkey % 5 + 1] ext, replace(c_name, '#', ' ') || ([' 이력서(1)', '''s "x"', '!~*_-+&'])[c_custkey % 3 + 1] as name from customer),
g as (select *, case when c_custkey % 7 = 0 then 'document-' || substr('id' || c_custkey || '-0123456789', 1, 8) || '.' || lower(ext) else name || '.' || ext end n,
  case lower(ext) when 'pdf' then 'application/pdf' when 'png' then 'image/png' when 'txt' then 'text/plain; charset=utf-8' else 'application/octet-stream' end t from f)
select c_custkey, t content_type, case when t <> 'application/octet-stream' and c_custkey % 4 <> 0 then 'inline' else 'attachment' end || '; filename="' || regexp_replace(regexp_replace(n, '[^\x20-\x7e]', '_', 'g'), '["\\]', '_', 'g')
  || '"; filename*=UTF-8''''' || replace(replace(replace(replace(replace(url_encode(n), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')') content_disposition from g"""


@query(HEADERS_SQL)
def file_headers(spark, sf_dir):
    k = F.col("c_custkey")
    ext = F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".hwp", ".txt", ".md"])), (k % 5 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, [" 이력서(1)", "'s \"x\"", "!~*_-+&"])), (k % 3 + 1).cast("int"))
    name = F.concat(F.when(k % 7 == 0, "ㄱㄴ").otherwise(F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), end)), ext)
    ident = F.concat(F.lit("id"), k.cast("string"), F.lit("-0123456789"))
    served = files.file_headers(ident, name, F.concat(F.lit("/x/"), k.cast("string"), ext), k % 4 == 0)
    return read(spark, sf_dir, "customer").select("c_custkey", served.alias("h")).select("c_custkey", "h.content_type", "h.content_disposition")


@query("select c_custkey, c_name from customer where c_custkey = 7")
def lookup_by_key(spark, sf_dir):
    return files.by_key(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 7)


CARDS = ["0, GPU-a, 5, 10, 50", "1, GPU-b, 7, 10, 0", "garbled"]
USED = ["GPU-a, 10, 3", "GPU-a, 20, 1", "GPU-b, 30, 2", "GPU-gone, 40, 4", "GPU-b, 11, 5"]
TREE = [(10, 9, "worker"), (11, 9, "worker"), (9, 8, "python"), (8, 1, "python vllm serve org/Model-7B/ --port 80"), (20, 1, "ollama runner"), (30, 1, "x")]
METRICS = [f'gpu_{m}{{gpu="{i}"}} {v}' for i, card in enumerate([(5, 10, 50), (7, 10, 0)]) for m, v in zip(("memory_used", "memory_total", "utilization"), card)]
METRICS += [f'gpu_model_memory{{gpu="{g}",model="{m}"}} {v}' for g, m, v in [("0", "Model-7B", 3), ("0", "ollama", 1), ("1", "unknown", 2), ("1", "Model-7B", 5), ("?", "unknown", 4)]]


@query("select * from " + values([(x,) for x in METRICS], "line"))
def accelerator_metrics(spark, sf_dir):
    lines = lambda xs: spark.createDataFrame([(x,) for x in xs], "line string")
    used = files.csv_fields(lines(USED), files.PROCESS)
    return files.gpu_metrics(files.csv_fields(lines(CARDS), files.CARD), used, files.models_of(used.select("pid"), spark.createDataFrame(TREE, "pid int, ppid int, cmdline string")))


# ---- an applicant's documents

KIND = "struct<pageNumber:int,text:string,hasText:boolean,imagePath:string>"


def attached(spark):
    page = lambda t: [(1, t, bool(t), None)]
    rows = [("1", "a", "1_[학위논문]_x.pdf", None, "pdf", page(catalog.THESIS), 1, True, None), ("1", "b", "1_hindex.png", None, "image", page(""), 1, False, None), ("1", "c", "1_x.pdf", "학술지", "pdf", page(catalog.ARTICLE), 1, True, None),
            ("2", "d", "2_bad.hwp", None, "hwp", [], 0, False, "not readable"), ("2", "e", "2_[학위논문]_y.txt", None, "text", page("지도교수 이주영\n심사위원 이조영"), 1, True, None)]
    made = spark.createDataFrame(rows, f"applicant_id string, document_id string, filename string, folder_category string, format string, pages array<{KIND}>, pageCount int, hasTextLayer boolean, note string")
    marks = spark.createDataFrame([("a", 2, "seal", 0.9)], "documentId string, page int, type string, confidence double")
    return made, spark.createDataFrame([("1", "Gildong Hong"), ("2", "이주영")], "applicant_id string, name string"), marks


FLAGGED = [("1", "a", "seal", "p.2 (90%)"), ("1", "b", "needs_vision", None), ("2", None, "ambiguous", "이주영 / 이조영"), ("2", "d", "needs_vision", "not readable")]
ROSTER = [("1", "이준호", "supervisor,committee", 2, False, False), ("1", "박서준", "committee", 1, False, False), ("1", "최지훈", "committee", 1, False, False), ("1", "윤도현", "department_head", 1, False, False), ("1", "John D. Carter", "supervisor,coauthor", 2, False, False),
          ("1", "Gildong Hong", "coauthor", 1, True, False), ("1", "Mark Lee", "coauthor", 1, False, False), ("2", "이주영", "supervisor", 1, True, True), ("2", "이조영", "committee", 1, False, True)]


@query("select * from " + values(FLAGGED, "applicant_id, document_id, flag_type, label"))
def process_flags(spark, sf_dir):
    made, applicants, marks = attached(spark)
    return process.process(made, applicants, marks=marks)["flags"].select("applicant_id", "document_id", "flag_type", "label")


@query("select * from " + values(ROSTER, "applicant_id, canonical_name, roles, n_sources, is_self, needs_human"))
def process_people(spark, sf_dir):
    made, applicants, _ = attached(spark)
    out = process.process(made, applicants, extract.rule_people)["aggregates"]
    return out.select("applicant_id", "canonical_name", F.array_join("roles", ",").alias("roles"), F.size("sources").alias("n_sources"), "is_self", "needs_human")


@query("select * from " + values([f for f in FLAGGED if f[2] != "ambiguous" and f[2] != "seal"], "applicant_id, document_id, flag_type, label"))
def reaggregate_flags(spark, sf_dir):
    """After one of two confusable mentions has gone, the flag that named them goes, and no other."""
    made, applicants, _ = attached(spark)
    out = process.process(made, applicants)
    _, flags = process.reaggregate(out["persons"].where("name_raw <> '이조영'"), out["documents"], applicants.where("applicant_id = '2'"), out["flags"])
    return flags.select("applicant_id", "document_id", "flag_type", "label")


# ---- review tables


@query(f"""with {PEOPLE_SQL}, f as (select applicant_id, [min(canonical_name), max(canonical_name), 'Nobody'] names from people group by 1), e as (select applicant_id, generate_subscripts(names, 1) - 1 i, unnest(names) as name from f)
select e.applicant_id, i, e.name, coalesce(len(sources), 0) n_sources from e left join people p on e.applicant_id = p.applicant_id and e.name = p.canonical_name""")
def candidate_sources(spark, sf_dir):
    p = catalog.people(spark, sf_dir)
    label = F.concat_ws(" / ", F.min("canonical_name"), F.max("canonical_name"), F.lit("Nobody"))
    flags = p.groupBy("applicant_id").agg(label.alias("label")).withColumns({"flag_id": F.col("applicant_id"), "flag_type": F.lit("ambiguous")})
    return review.candidate_sources(flags, p).select(F.col("flag_id").alias("applicant_id"), "i", "name", F.size("sources").cast("long").alias("n_sources"))


@query("""select coalesce(c_name, cast(l_suppkey as varchar)) applicant, case l_returnflag when 'A' then '도장' when 'R' then '손글씨' else 'odd' end flag, case when l_linenumber = 1 then '' else o_orderpriority end as document, coalesce(case when l_linenumber % 2 = 0 then l_linestatus end, '') as label
from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey and c_custkey % 2 = 0 where l_returnflag <> 'N'""")
def queue_export(spark, sf_dir):
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("applicant_name"))
    q = line.join(orders, line.l_orderkey == orders.o_orderkey).join(c, "o_custkey", "left").select(
        "applicant_name", F.col("l_suppkey").cast("string").alias("applicant_id"), F.when(F.col("l_returnflag") == "A", "seal").when(F.col("l_returnflag") == "R", "handwriting").otherwise("odd").alias("flag_type"),
        F.when(F.col("l_linenumber") != 1, F.col("o_orderpriority")).alias("filename"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("label"))
    return sinks.queue_export(q.where("flag_type <> 'odd'"))


@query(f"""with {PEOPLE_SQL} select applicant_id, canonical_name from people where list_contains(roles, 'committee') or list_contains(roles, 'supervisor') or list_contains(roles, 'co_supervisor')""")
def search_by_label(spark, sf_dir):
    """Parts of role labels: 지도교수, 부지도교수 and 심사위원 each hold one."""
    p = catalog.people(spark, sf_dir)
    hits = [review.roster(p, "all", q).select("applicant_id", "canonical_name") for q in ("지도", "심사")]
    return hits[0].unionByName(hits[1]).distinct()


@query("""with n as (select c_custkey id, case when c_custkey % 3 = 0 then cast(c_custkey // 30 as varchar) end ext, c_custkey > 100 fresh from customer)
select id, ext, fresh from n where fresh or ext is null or ext not in (select ext from n where fresh and ext is not null)""")
def upload_replace(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.floor(F.col("c_custkey") / 30).cast("string")).alias("external_id"), (F.col("c_custkey") > 100).alias("fresh"))
    return review.upload(c.where("not fresh"), c.where("fresh")).withColumnRenamed("external_id", "ext")


@query("""select o_orderkey, o_custkey, o_orderpriority kind from orders where not (o_custkey % 5 = 0 and o_orderpriority = '1-URGENT') union all select -c_custkey, c_custkey, 'new' from customer where c_custkey % 5 = 0""")
def replace_ambiguous(spark, sf_dir):
    """Only the applicants' flags of that kind are made anew."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("applicant_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "ambiguous").otherwise(F.col("o_orderpriority")).alias("flag_type"))
    again = read(spark, sf_dir, "customer").where("c_custkey % 5 = 0")
    new = again.select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("applicant_id"), F.lit("new").alias("flag_type"))
    out = review.replace_ambiguous(o, new, again.select(F.col("c_custkey").alias("applicant_id")))
    return out.select("o_orderkey", F.col("applicant_id").alias("o_custkey"), F.when(F.col("flag_type") == "ambiguous", "1-URGENT").otherwise(F.col("flag_type")).alias("kind"))


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3) union all select 0, c_custkey from customer where c_nationkey = 3")
def replace_partition(spark, sf_dir):
    new = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.lit(0).cast("long").alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"))
    return review.replace_partition(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), new, "o_custkey")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return review.cascade(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("""with n as (select n_nationkey, n_name from nation order by n_name desc limit 14) select n_name path from nation where n_name not in (select n_name from n)""")
def snapshot_retention(spark, sf_dir):
    return review.keep_newest(read(spark, sf_dir, "nation").select(F.col("n_name").alias("path")))


@query("select n_name as name, '' || n_nationkey as key, n_regionkey || ' <&>' as note from nation")
def xlsx_cells(spark, sf_dir):
    """A sheet written and read back from its XML."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key"), F.concat(F.col("n_regionkey").cast("string"), F.lit(" <&>")).alias("note"))
    with zipfile.ZipFile(io.BytesIO(sinks.xlsx_bytes(nation))) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    rows = [[t.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") for t in re.findall(r'<t xml:space="preserve">(.*?)</t>', row)] for row in re.findall("<row>(.*?)</row>", sheet)]
    return spark.createDataFrame(rows[1:], ", ".join(f"{c} string" for c in rows[0]))


# ---- small rules over tables


@query("""select o_orderkey, case when fmt in ('hwp', 'text') or kind not in ('degree_thesis', 'research_project') then '' when fmt <> 'image' and kind = 'degree_thesis' then '1,2' else '1' end pages, case when o_custkey % 3 = 0 then 'all' when o_custkey % 3 = 1 then 'external_id' else 'id' end selector
from (select *, (['pdf', 'hwp', 'image', 'text'])[o_orderkey % 4 + 1] fmt, (['degree_thesis', 'research_project', 'hindex'])[o_custkey % 3 + 1] kind from orders)""")
def page_and_id_rules(spark, sf_dir):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    who = F.when(F.col("o_custkey") % 3 == 0, "all").when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("24-"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    pages = F.array_join(rules.mark_pages(pick(["pdf", "hwp", "image", "text"], "o_orderkey"), pick(["degree_thesis", "research_project", "hindex"], "o_custkey")).cast("array<string>"), ",")
    return read(spark, sf_dir, "orders").select("o_orderkey", pages.alias("pages"), rules.selector(who).alias("selector"))


@query("select doc_id, trim(text) <> '' and doc_id % 3 <> 0 as to_text from documents")
def hybrid_routes(spark, sf_dir):
    page = F.struct(F.lit(1).alias("pageNumber"), F.col("text"), (F.col("doc_id") % 3 != 0).alias("hasText"))
    return read(spark, sf_dir, "documents").select("doc_id", rules.routes_to_text(F.array(page)).alias("to_text"))


@query("""select event_id, case when event_id % 3 = 0 then null else '24' || event_id % 7 || '-' || event_id end external_id, case when event_id % 3 <> 0 then '24' || event_id % 7 end round, 'p.' || event_id % 9 || ' (' || cast(floor(value / 100 * 100 + 0.5) as bigint) || '%)' as label,
  list_filter(['Seal', 'dog', 'SIGNATURE', 'handwriting'], lambda x: lower(x) in ('seal', 'signature', 'handwriting') and length(x) <= event_id % 12 + 3)::varchar kept from events""")
def ids_and_labels(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ident = F.concat(F.lit("24"), (F.col("event_id") % 7).cast("string"), F.lit("-"), F.col("event_id").cast("string"))
    folder = F.when(F.col("event_id") % 3 == 0, ident).otherwise(F.concat(ident, F.lit(" (홍길동)")))
    marks = F.filter(F.array(*(F.struct(F.lit(x).alias("type")) for x in ("Seal", "dog", "SIGNATURE", "handwriting"))), lambda m: F.length(m["type"]) <= F.col("event_id") % 12 + 3)
    kept = F.concat(F.lit("["), F.array_join(F.transform(rules.known_marks(marks), lambda m: m["type"]), ", "), F.lit("]"))
    x = rules.external_id(folder)
    return e.select("event_id", x["external_id"].alias("external_id"), x["round"].alias("round"), rules.mark_label((F.col("event_id") % 9).cast("int"), F.col("value") / 100).alias("label"), kept.alias("kept"))


SETTING = ["http://a|m1,http://b|m2", " http://a | m1 , |x, http://b|", "", "http://c|m|extra"]


@query("select * from " + values([(SETTING[0], "http://a>m1;http://b>m2"), (SETTING[1], "http://a>m1"), (SETTING[2], ""), (SETTING[3], "http://c>m")], "setting, endpoints"))
def endpoint_lists(spark, sf_dir):
    made = F.array_join(F.transform(rules.endpoints(F.col("setting")), lambda e: F.concat(e["url"], F.lit(">"), e["model"])), ";")
    return spark.createDataFrame([(s,) for s in SETTING], "setting string").select("setting", made.alias("endpoints"))


# ---- queue


def event_jobs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "done", "error"])), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").cast("string").alias("id"), F.lit("process").alias("type"), status.alias("status"), F.col("props").alias("payload"), F.lit(0).alias("progress"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("created_at"))


@query("""with j as (select event_id, (['queued', 'queued', 'done', 'error'])[event_id % 4 + 1] s, event_id % 5 a from events),
c as (select *, s = 'queued' and a < 3 ok from j)
select cast(event_id as varchar) id, case when s <> 'queued' then s when not ok then 'error' when event_id % 7 = 0 then 'running' when event_id % 7 = 1 then 'error' else 'done' end status, cast(a + ok::int as int) attempts,
  case when s = 'queued' and not ok then 'too many attempts' when ok and event_id % 7 = 1 then 'broken' end error, case when ok and event_id % 7 > 1 then 100 else 0 end progress from c""")
def queue_round(spark, sf_dir):
    """Recovery, claims of all queued jobs, and outcomes; jobs without one stay running."""
    jobs = queue.claim_all(queue.recover(event_jobs(spark, sf_dir)))
    n = F.col("id").cast("long") % 7
    outcome = jobs.where((F.col("status") == "running") & (n != 0)).select("id", F.when(n == 1, "broken").alias("error"))
    return queue.finish_all(jobs, outcome).select("id", "status", "attempts", "error", "progress")


@query("select count(*) filter (event_id % 4 = 1) recovered from events")
def queue_recovered(spark, sf_dir):
    return queue.recovered(event_jobs(spark, sf_dir))


@query("""select cast(event_id as varchar) id, case when event_id = 1 then 'done' when event_id = 5 then 'error' else (['queued', 'running', 'done', 'error'])[event_id % 4 + 1] end status, case when event_id = 5 then 'broken' end error, case when event_id = 1 then 100 else 0 end progress from events
union all select 'new', 'queued', null, 0""")
def queue_enqueue_finish(spark, sf_dir):
    jobs = event_jobs(spark, sf_dir)
    jobs = queue.enqueue(jobs, jobs.where("id = '1'").withColumn("id", F.lit("new")))
    return queue.finish(queue.finish(jobs, "1"), "5", "broken").select("id", "status", "error", "progress")


@query("""with recursive e as (select cast(user_id as varchar) key, event_id seq, epoch_ms(ts::timestamp) ts, case when event_type = 'purchase' then 'success' else 'fail' end outcome, row_number() over (partition by user_id order by ts, event_id) rn from events),
s as (select key, 0::bigint rn, 0::bigint ts, ''::varchar outcome, false allowed, 0::bigint start, 0::bigint fails, 0::bigint blocked from (select distinct key from e)
union all select key, rn, ts, outcome, allowed, case when not allowed then start when outcome = 'success' then 0 when fresh then ts else start end,
    case when not allowed then fails when outcome = 'success' then 0 when fresh then 1 else fails + 1 end,
    case when not allowed then blocked when outcome = 'success' then 0 when (case when fresh then 1 else fails + 1 end) >= 5 then ts + 3600000 else 0 end
  from (select e.key, e.rn, e.ts, e.outcome, e.ts >= s.blocked allowed, s.start, s.fails, s.blocked, s.blocked > 0 or s.fails = 0 or e.ts - s.start > 900000 fresh from s join e on e.key = s.key and e.rn = s.rn + 1))
select key, ts, outcome, allowed, blocked blocked_until from s where rn > 0""")
def rate_limit_blocks(spark, sf_dir):
    """Times are rounded to milliseconds as epoch_ms does, halves away from 1970; within one, the exact times order attempts."""
    e = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ms = F.call_function("div", F.when(us < 0, us - 500).otherwise(us + 500), F.lit(1000))  # cuts off towards 0
    return queue.limited(e.select(F.col("user_id").cast("string").alias("key"), ms.alias("ts"), F.struct(us, "event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "success").otherwise("fail").alias("outcome")))


@query("""with recursive e as (select cast(user_id % 20 as varchar) key, cast(row_number() over (partition by user_id % 20 order by ts, event_id) as bigint) rn, event_type from events),
d as (select *, rn // 2 * 100000 ts, case when event_type = 'purchase' then 'success' else 'fail' end outcome from e),
s as (select key, 0::bigint rn, 0::bigint ts, ''::varchar outcome, false allowed, 0::bigint start, 0::bigint fails, 0::bigint blocked from (select distinct key from d)
union all select key, rn, ts, outcome, allowed, case when not allowed then start when outcome = 'success' then 0 when fresh then ts else start end,
    case when not allowed then fails when outcome = 'success' then 0 when fresh then 1 else fails + 1 end,
    case when not allowed then blocked when outcome = 'success' then 0 when (case when fresh then 1 else fails + 1 end) >= 5 then ts + 3600000 else 0 end
  from (select d.key, d.rn, d.ts, d.outcome, d.ts >= s.blocked allowed, s.start, s.fails, s.blocked, s.blocked > 0 or s.fails = 0 or d.ts - s.start > 900000 fresh from s join d on d.key = s.key and d.rn = s.rn + 1))
select key, ts, outcome, count(*) attempts, count(*) filter (allowed) allowed from s where rn > 0 group by 1, 2, 3""")
def rate_limit_bursts(spark, sf_dir):
    """Two attempts at a time, 100 seconds apart, so that keys are blocked again and again."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy(F.col("user_id") % 20).orderBy("ts", "event_id"))  # stand-in times
    d = e.select((F.col("user_id") % 20).cast("string").alias("key"), rank.cast("long").alias("seq"), F.when(F.col("event_type") == "purchase", "success").otherwise("fail").alias("outcome"))
    out = queue.limited(d.withColumn("ts", F.floor(F.col("seq") / 2) * 100000))
    return out.groupBy("key", "ts", "outcome").agg(F.count("*").alias("attempts"), F.count_if("allowed").alias("allowed"))

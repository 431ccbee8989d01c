"""The registered queries over the test tables, each with its SQL where SQL can say it.

Stand-ins: applicants are customers, documents orders, mentions line items, jobs events; names are supplier keys
or, where script matters, two Hangul syllables made from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import names, rules
from spanloom.operators import extract, resolve, review, sinks
from spanloom.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins

KIND_SQL = "case l_returnflag when 'N' then 'printed' when 'R' then 'handwritten' else 'seal' end"
NEEDS_SQL = "(l_returnflag <> 'N' or 1 - l_discount * 3 < 0.75)"
ROLE_SQL = "['" + "','".join(rules.ROLES) + "'][l_linenumber]"


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, rules.ROLES)), F.col("l_linenumber"))
    kind = F.when(F.col("l_returnflag") == "N", "printed").when(F.col("l_returnflag") == "R", "handwritten").otherwise("seal")
    confidence = 1 - F.col("l_discount") * 3
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("name"), kind.alias("source_kind"), confidence.alias("confidence"), role.alias("role"))
    return d.withColumn("needs_human", rules.needs_human(F.col("source_kind"), F.col("confidence")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("applicant_id"), F.col("o_orderpriority").alias("doc_type"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = persons(spark, sf_dir).join(documents(spark, sf_dir), "document_id")
    source = F.struct(F.col("document_id").alias("documentId"), F.col("doc_type").alias("docType"), "page", "role")
    return joined.groupBy("applicant_id", F.col("name").alias("id")).agg(
        F.concat(F.lit("Person "), F.col("name").cast("string")).alias("canonical_name"), F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set(source)).alias("sources"),
        F.max("needs_human").alias("needs_human"), (F.pmod("name", F.lit(17)) == 0).alias("is_self"),
    ).withColumns({"name_candidates": F.array().cast("array<string>"), "affiliation": F.when(F.pmod("id", F.lit(3)) == 0, F.concat(F.lit("Dept, "), F.pmod("id", F.lit(7)).cast("string"))), "final_status": F.when(F.pmod("id", F.lit(5)) == 0, "rejected").otherwise("pending")})


PEOPLE_SQL = f"""people as (select o_custkey applicant_id, l_suppkey id, 'Person ' || l_suppkey canonical_name, list_sort(list(distinct {ROLE_SQL})) roles,
  list_sort(list(distinct {{'documentId': o_orderkey, 'docType': o_orderpriority, 'page': l_linenumber, 'role': {ROLE_SQL}}})) sources,
  bool_or{NEEDS_SQL} needs_human, l_suppkey % 17 = 0 is_self, case when l_suppkey % 3 = 0 then 'Dept, ' || (l_suppkey % 7) end affiliation,
  case when l_suppkey % 5 = 0 then 'rejected' else 'pending' end final_status
  from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_suppkey)"""


# ---- summaries


@query(f"""select o_orderpriority doc_type, {KIND_SQL} source_kind, count(*) total, count(*) filter ({NEEDS_SQL}) needs
from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
def review_volume(spark, sf_dir):
    joined = persons(spark, sf_dir).join(documents(spark, sf_dir), "document_id")
    return joined.groupBy("doc_type", "source_kind").agg(F.count("*").alias("total"), F.count_if("needs_human").alias("needs"))


@query(f"""with v as (select o_orderpriority doc_type, {KIND_SQL} source_kind, {NEEDS_SQL} needs from lineitem join orders on l_orderkey = o_orderkey),
g as (select doc_type, source_kind, count(*) total, count(*) filter (needs) needs from v group by 1, 2 union all select null, null, count(*), count(*) filter (needs) from v)
select *, cast(floor(needs / total * 100 + 0.5) as bigint) pct from g""")
def review_volume_rollup(spark, sf_dir):
    return review.review_volume(persons(spark, sf_dir), documents(spark, sf_dir))


@query(f"""with p as (select o_custkey applicant_id, l_suppkey, bool_or{NEEDS_SQL} needs from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
a as (select applicant_id, count(*) people, count(*) filter (needs) needs from p group by 1),
d as (select o_custkey applicant_id, count(*) documents from orders group by 1),
j as (select cast(json_extract_string(props, '$.k') as bigint) applicant_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) job_status from events group by 1)
select c_custkey applicant_id, c_name as name, coalesce(people, 0) people, coalesce(needs, 0) needs, coalesce(documents, 0) documents, job_status,
  case when job_status in ('queued', 'running') then 'running' when job_status = 'error' then 'error' when coalesce(needs, 0) > 0 then 'needs_human' else 'ok' end badge
from customer left join a on c_custkey = a.applicant_id left join d on c_custkey = d.applicant_id left join j on c_custkey = j.applicant_id""")
def applicant_summary(spark, sf_dir):
    applicants = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("applicant_id"), F.col("c_name").alias("name"))
    out = review.applicant_summary(applicants, people(spark, sf_dir), documents(spark, sf_dir), jobs(spark, sf_dir))
    return out.withColumn("badge", review.status_badge(F.col("job_status"), F.col("needs")))


def jobs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.regexp_replace("props", '"k"', '"applicantId"').alias("payload"), F.col("ts").alias("created_at"))


@query("select json_extract_string(props, '$.k') as key, arg_max(event_type, struct_pack(ts := ts, id := event_id)) job_status from events group by 1")
def latest_job_status(spark, sf_dir):
    return review.latest_status(jobs(spark, sf_dir), F.get_json_object("payload", "$.applicantId"))


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def latest_job_top1(spark, sf_dir):
    return review.newest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query("select event_id, event_type from (select *, row_number() over (partition by event_type order by ts, event_id) rn from events) where rn = 1")
def oldest_queued(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"""select l_orderkey document_id, l_linenumber page, case l_returnflag when 'A' then 'seal' when 'R' then 'handwriting' else 'low_confidence' end flag_type,
  c_name applicant_name, o_orderpriority filename, s_name name_raw
from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join supplier on l_suppkey = s_suppkey
where {NEEDS_SQL} and o_orderstatus = 'O'""")
def review_queue_join(spark, sf_dir):
    p = persons(spark, sf_dir).withColumns({"flag_type": rules.flag_type(F.col("source_kind"), F.col("confidence")), "person_id": F.col("name")}).where("flag_type is not null")
    d = documents(spark, sf_dir)
    flags = p.join(d.select("document_id", "applicant_id", F.when(F.col("status") == "O", "open").otherwise("resolved").alias("status")), "document_id")
    applicants = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("applicant_id"), F.col("c_name").alias("name"))
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name_raw"))
    out = review.review_queue(flags.select("document_id", "page", "flag_type", "applicant_id", "person_id", "status"), applicants, d.select("document_id", F.col("doc_type").alias("filename"), F.lit("pdf").alias("format")), known)
    return out.select("document_id", "page", "flag_type", "applicant_name", "filename", "name_raw")


@query(f"select case l_returnflag when 'A' then 'seal' when 'R' then 'handwriting' else 'low_confidence' end flag_type, count(*) flags from lineitem where {NEEDS_SQL} group by 1")
def queue_flag_counts(spark, sf_dir):
    return review.flag_counts(persons(spark, sf_dir).select(rules.flag_type(F.col("source_kind"), F.col("confidence")).alias("flag_type")).where("flag_type is not null"))


@query(f"with {PEOPLE_SQL} select role, count(*) people from (select unnest(roles) role from people) group by 1")
def role_counts(spark, sf_dir):
    return review.role_counts(people(spark, sf_dir))


@query(f"""with {PEOPLE_SQL}, o as (select unnest({rules.ROLES}) role, generate_subscripts({rules.ROLES}, 1) i),
f as (select applicant_id, id, needs_human, (select arg_min(o.role, o.i) from o where list_contains(p.roles, o.role)) role from people p)
select role, count(*) people, count(*) filter (needs_human) to_review from f group by 1""")
def primary_role_groups(spark, sf_dir):
    return review.primary_roles(people(spark, sf_dir))


@query(f"with {PEOPLE_SQL} select document_id, count(*) people from (select distinct applicant_id, id, unnest(sources).documentId document_id from people where not is_self) group by 1")
def people_per_document(spark, sf_dir):
    return review.people_per_document(people(spark, sf_dir))


@query(f"with {PEOPLE_SQL} select applicant_id, canonical_name, needs_human from people where list_contains(roles, 'committee') and (lower(canonical_name) like '%person 1%' or lower(affiliation) like '%person 1%')")
def search_filter(spark, sf_dir):
    return review.roster(people(spark, sf_dir), "committee", "pErson 1").select("applicant_id", "canonical_name", "needs_human")


@query("""with a as (select c_custkey, c_acctbal, coalesce('ext:' || case when c_custkey % 3 = 0 then c_mktsegment || '-' || c_nationkey end, 'name:' || c_mktsegment || c_nationkey) as key from customer),
r as (select *, row_number() over (partition by key order by c_acctbal desc, c_custkey desc) rn, first_value(c_custkey) over (partition by key order by c_acctbal desc, c_custkey desc) survivor from a)
select c_custkey applicant_id, key, survivor from r where rn > 1""")
def applicant_dedupe(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    code = F.col("c_nationkey").cast("string")
    a = c.select(F.col("c_custkey").alias("applicant_id"), F.concat("c_mktsegment", code).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit("-"), code)).alias("external_id"), F.col("c_acctbal").alias("created_at"))
    return review.duplicate_applicants(a)


@query("""select o_orderkey path, o_orderdate modificationTime from orders where o_orderdate < timestamp '1997-01-01' - interval 1 day
and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')""")
def orphan_crops(spark, sf_dir):
    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modificationTime"))
    flags = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).alias("crop_path"))
    return review.orphan_files(files, flags, F.lit("1997-01-01").cast("timestamp"))


@query("""select o_custkey applicant_id, o_orderkey document_id from orders where o_orderstatus in ('O', 'F') and o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 3)""")
def needs_vision_docs(spark, sf_dir):
    fmt = F.when(F.col("status") == "O", "image").when(F.col("status") == "F", "pdf").otherwise("text")
    d = documents(spark, sf_dir).select("applicant_id", "document_id", fmt.alias("format"), F.lit(False).alias("has_text_layer"), F.lit(None).cast("string").alias("note"))
    return review.vision_flags(d, persons(spark, sf_dir).where("page = 3")).select("applicant_id", "document_id")


LABELS_SQL = "map(" + str(rules.ROLES) + ", " + str([rules.ROLE_LABELS[r] for r in rules.ROLES]) + ")"


@query(f"""with {PEOPLE_SQL}, e as (select canonical_name, array_to_string(list_transform(roles, lambda r: {LABELS_SQL}[r]), ', ') roles, coalesce(affiliation, '') affiliation,
  array_to_string(list_transform(sources, lambda s: s.docType || ' p.' || s.page), '; ') sources, case when needs_human then 'Y' else 'N' end n, case when is_self then 'Y' else 'N' end s from people where not is_self and final_status <> 'rejected')
select canonical_name || ',' || case when roles like '%,%' then '"' || roles || '"' else roles end || ',' || case when affiliation like '%,%' then '"' || affiliation || '"' else affiliation end || ',' || sources || ',' || n || ',' || s as value from e""")
def roster_export(spark, sf_dir):
    return sinks.csv_lines(sinks.roster_export(people(spark, sf_dir)))


@query("""select c_custkey person_id, case when c_nationkey % 4 = 0 then 'canonical_name' else 'final_status' end field, case when c_nationkey % 4 = 0 then c_name else 'pending' end old_value,
case c_nationkey % 4 when 0 then 'Renamed' when 1 then 'confirmed' else 'rejected' end new_value, ['edit', 'confirm', 'reject', 'exclude'][c_nationkey % 4 + 1] as action from customer""")
def correction_transitions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("applicant_id"), F.col("c_name").alias("canonical_name"), F.lit("pending").alias("final_status"))
    what = F.element_at(F.array(*map(F.lit, ["edit", "confirm", "reject", "exclude"])), F.col("c_nationkey") % 4 + 1)
    return review.act(p, c.select(F.col("c_custkey").alias("id"), what.alias("action"), F.lit(" Renamed ").alias("name")))[1].drop("applicant_id")


@query(f"""select l_suppkey applicant_id, l_orderkey % 50 documentId, l_linenumber page, {ROLE_SQL} role, arg_min(l_partkey, struct_pack(a := l_orderkey, b := l_partkey)) part from lineitem group by 1, 2, 3, 4""")
def source_dedupe(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    role = F.element_at(F.array(*map(F.lit, rules.ROLES)), F.col("l_linenumber"))
    s = line.select(F.col("l_suppkey").alias("applicant_id"), (F.col("l_orderkey") % 50).alias("documentId"), F.col("l_linenumber").alias("page"), role.alias("role"), F.struct("l_orderkey", "l_partkey").alias("seq"), F.col("l_partkey").alias("part"))
    return resolve.dedupe_sources(s).drop("seq")


# ---- names

NAMES = ["이 준 호", "이  준  호", "김 철수", "  John   D.  Carter ", "이준호 (인)", "鄭周哲", "John 정", "J Carter", "Carter, John D.", "CK Kim", "Chang Kim", "J C", "", "Junho LEE", "이주영", "이조영", "박철수", "박철민", "정민", "정민호", "G. Hong", "Gildong Hong", "42", "가 나", "J.  Núñez", "Núñez, José"]
VALUES = "(values " + ", ".join("('" + n + "')" for n in NAMES) + ") v(name)"
NORM = r"trim(regexp_replace(trim(regexp_replace(nfc_normalize(name), '[\s  　]+', ' ', 'g')), '\(\s*(인|서명|signature|seal)\s*\)', '', 'gi'))"
NORM_SQL = f"case when regexp_full_match({NORM}, '[가-힣]( [가-힣])+') then replace({NORM}, ' ', '') else {NORM} end"


def named(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


@query(f"select name, {NORM_SQL} norm from {VALUES}")
def name_normalize(spark, sf_dir):
    return named(spark).withColumn("norm", names.normalize(names.nfc("name")))


@query(f"""with n as (select name, {NORM_SQL} norm from {VALUES}), f as (select *, regexp_matches(norm, '[가-힣]') k, regexp_matches(norm, '[㐀-䶿一-鿿]') h, regexp_matches(norm, '[A-Za-z]') l from n)
select name, case k::int + h::int + l::int when 0 then 'unknown' when 1 then case when k then 'korean' when h then 'han' else 'latin' end else 'mixed' end script from f""")
def name_script(spark, sf_dir):
    return named(spark).select("name", names.script(names.normalize(F.col("name"))).alias("script"))


def hangul(n):
    """Two syllables from a number."""
    syllable = lambda k: F.decode(F.unhex(F.hex(44032 + n * k % 11172)), "UTF-16BE")
    return F.concat(syllable(29), syllable(588))


# ---- resolution


@query("""with m as (select l_orderkey d, l_linenumber p, l_suppkey % 5 n, l_returnflag = 'N' printed from lineitem)
select d document_id, p page, case when printed then null when exists(select 1 from m q where q.d = m.d and q.printed and q.n = m.n) then 'confirmed'
when exists(select 1 from m q where q.d = m.d and q.printed) then 'mismatch' else 'unverifiable' end status from m""")
def cross_check(spark, sf_dir):
    p = persons(spark, sf_dir)
    m = p.select(F.col("document_id").alias("documentId"), "page", hangul(F.pmod("name", F.lit(5))).alias("nameRaw"), F.col("source_kind").alias("sourceKind"), F.lit("degree_thesis").alias("docType"))
    return resolve.cross_check(m).select(F.col("documentId").alias("document_id"), "page", F.col("verificationStatus").alias("status"))


# ---- texts

FILES = ["2401-000001_[학위논문]_a study of regional planning (영문 박사).pdf", "2401-000001_hindex.png", "x/y/2401-000002_[학술논문] title (국문 석사).pdf", "mystery.bin", "a_b_c.HWPX", "notes.md"]
FILE_VALUES = "(values " + ", ".join(f"('{f}')" for f in FILES) + ") v(filename)"
NAME_PATTERN = r"^([^_]+)_(?:\[([^\]]+)\]_?)?(.*)$"


@query(rf"""with b as (select filename, regexp_replace(regexp_replace(filename, '^.*[/\\]', ''), '\.[^.]*$', '') base from {FILE_VALUES})
select filename, nullif(trim(regexp_extract(base, '{NAME_PATTERN}', 1)), '') applicant_id, nullif(trim(regexp_extract(base, '{NAME_PATTERN}', 2)), '') tag, nullif(trim(regexp_extract(base, '{NAME_PATTERN}', 3)), '') title,
case when regexp_matches(base, '(?i)박사|doctoral|ph\.?\s?d') then 'doctoral' when regexp_matches(base, '(?i)석사|master') then 'master' end as degree,
case when regexp_matches(base, '(?i)영문|english') then 'en' when regexp_matches(base, '(?i)국문|korean') then 'ko' end as language, base from b""")
def parse_filename(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in FILES], "filename string").select("filename", rules.parse_filename(F.col("filename")).alias("p")).select("filename", "p.*")


FOLDERS = ["2401-000001 (홍길동)", "2401-000002", "x (y) ", "2402-7 ( A B )"]


@query(r"""select folder, case when m then trim(regexp_extract(folder, '^(.*?)\s*\(([^)]+)\)\s*$', 1)) else trim(folder) end applicant_id, case when m then trim(regexp_extract(folder, '^(.*?)\s*\(([^)]+)\)\s*$', 2)) end as name
from (select folder, regexp_matches(folder, '^(.*?)\s*\(([^)]+)\)\s*$') m from (values """ + ", ".join(f"('{f}')" for f in FOLDERS) + ") v(folder))")
def parse_folder(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in FOLDERS], "folder string").select("folder", rules.parse_folder(F.col("folder")).alias("p")).select("folder", "p.*")


@query(rf"select doc_id, len(regexp_extract_all(text, '{extract.EMAIL}')) emails, split_part(regexp_extract(text, '{extract.EMAIL}'), '@', 2) as domain from documents")
def author_block_emails(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(f"({extract.EMAIL})"), 1)
    first = F.regexp_extract("text", extract.EMAIL, 0)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("emails"), F.regexp_extract(first, "@(.*)$", 1).alias("domain"))


@query(rf"select doc_id, len(regexp_extract_all(text, '{extract.LATIN}')) found from documents")
def title_case_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({extract.LATIN})"), 1)).cast("long").alias("found"))


THESIS = "제목\n지도교수  이준호\n2020\n심사위원장  박서준  (인)\n심사위원    최지훈  (인)\n심사위원    이준호  (인)\n학과장      윤도현\nAdvisor: John D. Carter"
ARTICLE = "Green Infrastructure Planning\nGildong Hong, John Carter, Mark Lee\nSome University\nghong@example.edu\nAbstract\nText\nReferences\nSmith, J., Brown, K."


def text_pages(spark, sf_dir, doc_type):
    given = spark.createDataFrame([(-1, THESIS if doc_type == "degree_thesis" else ARTICLE)], "doc_id long, text string")
    d = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(given)
    page = F.struct(F.lit(1).alias("pageNumber"), F.col("text"), F.lit(True).alias("hasText"), F.lit(None).cast("string").alias("imagePath"))
    return d.select(F.col("doc_id").cast("string").alias("documentId"), F.lit(doc_type).alias("docType"), F.array(page).alias("pages"))


@query(r"""select page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') as text from pages""")
def xml_text_runs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", rules.xml_runs(F.col("html")).alias("text"))


PEOPLE = ["이준호", "John Carter", "교수", "심사위원", "University Press", "J. Kim", "Green Infrastructure Planning", "One", "a b", "이 준 호"]
KO = "', '".join(rules.KO_STOPWORDS)


@query(rf"""select s, (regexp_matches(s, '^[가-힣](?:\s?[가-힣]){{1,3}}$') and replace(s, ' ', '') not in ('{KO}'))
or (regexp_matches(s, '^{extract.LATIN}$') and not regexp_matches(s, '(?i)\b(?:{'|'.join(rules.LATIN_STOPWORDS)})\b')) person from (values {', '.join(f"('{p}')" for p in PEOPLE)}) v(s)""")
def form_check(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in PEOPLE], "s string").select("s", rules.is_person_name(F.col("s")).alias("person"))


# ---- queue


@query("""with j as (select event_id, ts, case when event_type = 'click' then 'queued' else 'running' end status, event_id % 4 attempts from events), o as (select event_id from j where status = 'queued' order by ts, event_id limit 1)
select cast(event_id as varchar) id, case when event_id in (from o) then case when attempts >= 3 then 'error' else 'running' end else status end status, cast(attempts + case when event_id in (from o) and attempts < 3 then 1 else 0 end as int) attempts from j""")
def queue_state_machine(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    j = e.select(F.col("event_id").cast("string").alias("id"), F.lit("process").alias("type"), F.when(F.col("event_type") == "click", "queued").otherwise("running").alias("status"), F.col("props").alias("payload"), F.lit(0).alias("progress"),
                 (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("created_at"))
    return queue.claim(j).select("id", "status", "attempts")


from spanloom.plans import people_queries, state_queries  # noqa: E402, F401  they register their own

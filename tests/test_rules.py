from pyspark.sql import functions as F

from spanloom.functions import rules


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_policy(spark):
    cases = [("seal", 0.99, False, True), ("handwritten", 1.0, False, True), ("signature", 0.95, False, True), ("printed", 0.9, False, False), ("printed", 0.75, False, False), ("printed", 0.5, False, True), ("printed", 0.99, True, True)]
    df = spark.createDataFrame(cases, "k string, c double, a boolean, w boolean")
    assert df.where(rules.needs_human(F.col("k"), F.col("c"), F.col("a")) != F.col("w")).count() == 0
    assert [r[0] for r in df.select(rules.flag_type(F.col("k"), F.col("c"))).collect()] == ["seal", "handwriting", "signature", None, None, "low_confidence", None]


def test_not_printed_is_always_reviewed(spark):
    df = spark.range(100).select((F.col("id") / 100).alias("c"), F.explode(F.array(*map(F.lit, ["seal", "signature", "handwritten"]))).alias("k"))
    assert df.where(~rules.needs_human(F.col("k"), F.col("c"))).count() == 0


def test_person_names(spark):
    want = {"이준호": True, "John Carter": True, "교수": False, "심사위원": False, "University Press": False, "John": False, "이 준 호": True, "Department Of Biology": False}
    got = spark.createDataFrame([(k,) for k in want], "s string").select("s", rules.is_person_name(F.col("s"))).collect()
    assert dict(map(tuple, got)) == want


def test_files(spark):
    p = lambda s: one(spark, rules.parse_filename(F.lit(s)).alias("p")).p
    a = p("2401-000001_[학위논문]_a study of regional planning (영문 박사).pdf")
    assert (a.applicant_id, a.tag, a.degree, a.language) == ("2401-000001", "학위논문", "doctoral", "en")
    b = p("2401-000001_hindex.png")
    assert (b.tag, b.title) == (None, "hindex") and p("x_y (국문 석사).pdf").degree == "master"
    f = one(spark, rules.parse_folder(F.lit("2401-000001 (홍길동)")).alias("f"), rules.parse_folder(F.lit("2401-000002")).alias("g"), rules.external_id(F.lit("2401-000001 (홍길동)")).alias("e"))
    assert tuple(f.f) == ("2401-000001", "홍길동") and tuple(f.g) == ("2401-000002", None) and tuple(f.e) == ("2401-000001", "2401")
    formats = {"a.pdf": "pdf", "a.PNG": "image", "a.hwp": "hwp", "a.hwpx": "hwp", "a.txt": "text", "a.zip": None, "a": None}
    got = spark.createDataFrame([(k,) for k in formats], "s string").select("s", rules.format_of(F.col("s"))).collect()
    assert dict(map(tuple, got)) == formats


def test_classify(spark):
    cases = [("학위논문", None, None, None, "degree_thesis"), ("대표연구실적", None, None, None, "representative_research"), ("학술논문", "hindex", None, None, "journal_article"), (None, "H-Index.png", None, None, "hindex"), (None, None, "학술지 게재", None, "journal_article"),
             (None, None, "학위논문", "abstract", "degree_thesis"), (None, None, None, "지도 교수 김", "degree_thesis"), (None, None, None, "연구책임자", "research_project"), (None, "mystery.bin", None, None, "unknown"), (None, None, None, "Keywords: x", "journal_article")]
    df = spark.createDataFrame(cases, "t string, f string, d string, c string, w string")
    assert [r[0] == r[1] for r in df.select(rules.classify(*map(F.col, "tfdc"))["doc_type"], "w").collect()] == [True] * len(cases)


def test_text(spark):
    r = one(spark, rules.decode_entities(F.lit("a &lt;b&gt; &#44032;&#65; &amp;lt;")).alias("e"), rules.xml_runs(F.lit('<x><hp:t>A &amp;</hp:t><hp:t a="1"> B</hp:t></x>')).alias("x"), rules.clean_lines(F.lit(" a  \r\nb\t\n")).alias("c"), rules.clean_blocks(F.lit("a \t b\n\n\n\nc ")).alias("k"), rules.strip_markers(F.lit("Kim1,*†")).alias("m"))
    assert r.e == "a <b> 가A &lt;" and r.x == "A & B" and r.c == "a\nb" and r.k == "a b\n\nc" and r.m == "Kim,"


def test_answers(spark):
    good = '```json\n{"persons":[{"name":"John Carter","role":"thesis advisor","extra":1},{"name":"이준호","source_kind":"SEAL","confidence":7,"page":2,"is_self":true}]}\n```'
    me = F.lit("J Carter")
    r = one(spark, rules.response_persons(F.lit(good), F.lit("degree_thesis"), me).alias("p"), rules.response_persons(F.lit("none"), F.lit("x")).alias("none"), rules.response_persons(F.lit("{}"), F.lit("x")).alias("empty"))
    assert [(p.nameRaw, p.role, p.sourceKind, p.sourcePage, p.confidence, p.isSelf, p.ocrConfidence) for p in r.p] == [("John Carter", "supervisor", "printed", 1, 0.6, True, None), ("이준호", "committee", "seal", 2, 1.0, True, 7.0)]
    assert r.none is None and r.empty == []  # no JSON is a failed call, no persons an answer
    bad = ['{"role":"x"}', '{"name":""}', '{"name":null}', '{"name":"A","confidence":"high"}', '{"name":"A","page":"x"}', '{"name":"A","is_self":"yes"}', '{"name":5}', '"A"', "null"]
    df = spark.createDataFrame([(f'{{"persons":[{{"name":"B"}},{b}]}}',) for b in bad] + [('{"persons":{}}',), ('{"persons":null}',)], "a string")
    assert [r[0] for r in df.select(rules.response_persons(F.col("a"), F.lit("x"))).collect()] == [[]] * (len(bad) + 2)
    fine = spark.createDataFrame([('{"persons":[{"name":" ","role":null,"confidence":null,"page":1.5}]}',)], "a string").select(F.explode(rules.response_persons(F.col("a"), F.lit("x"))).alias("p")).first().p
    assert (fine.nameRaw, fine.role, fine.sourcePage, fine.confidence) == (" ", "coauthor", 1, 0.6)


def test_prompt(spark):
    pages = lambda *t: F.array(*(F.struct(F.lit(x).alias("text")) for x in t))
    r = one(spark, rules.prompt(F.lit("degree_thesis"), pages("a" * 9000, "", "b" * 9000), F.lit("홍길동")).alias("p"), rules.prompt(F.lit("odd"), pages(" ")).alias("q"))
    body = r.p.user.split("[document]\n")[1].split("\n[end]")[0]
    assert len(body) == 12000 and body.startswith("a" * 9000 + "\n\nb") and "홍길동" in r.p.user and "지도교수" in r.p.user
    assert "page images" in r.q.user and '"persons"' in r.q.system


def test_marks_and_export(spark):
    box = F.struct(F.lit(0.9).alias("x"), F.lit(-1.0).alias("y"), F.lit(0.5).alias("w"), F.lit(2.0).alias("h"))
    r = one(spark, rules.clamp_box(box).alias("b"), rules.mark_label(F.lit(2), F.lit(0.905)).alias("l"), rules.csv_cell(F.lit('a "b", c')).alias("q"), rules.csv_cell(F.lit("a\rb")).alias("r"), rules.mark_pages(F.lit("pdf"), F.lit("degree_thesis")).alias("p"), rules.mark_pages(F.lit("hwp"), F.lit("degree_thesis")).alias("n"), rules.primary_role(F.array(F.lit("coauthor"), F.lit("committee"))).alias("role"), rules.clamp01(F.lit(float("nan"))).alias("nan"), rules.endpoints(F.lit("http://a|m1, http://b, |x,http://c|m2")).alias("e"))
    assert (r.b.x, r.b.y, round(r.b.w, 9), r.b.h) == (0.9, 0.0, 0.1, 1.0)
    assert r.l == "p.2 (91%)" and r.q == '"a ""b"", c"' and r.r == "a\rb" and r.p == [1, 2] and r.n == [] and r.role == "committee" and r.nan == 0
    assert [e.model for e in r.e] == ["m1", "m2"]

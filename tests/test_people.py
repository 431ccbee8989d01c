from pyspark.sql import functions as F

from spanloom.operators import extract, process, resolve
from spanloom.plans.catalog import ARTICLE, THESIS

MENTION = "applicant_id string, doc_seq int, person_seq int, nameRaw string, role string, affiliation string, sourceKind string, sourcePage int, confidence double, isSelf boolean, documentId string, filename string, docType string"


def people(spark, *rows, self_name=None):
    made = [("1", i, 0, n, role, None, kind, 1, conf, False, doc, "f", "degree_thesis") for i, (n, role, kind, conf, doc) in enumerate(rows)]
    applicants = spark.createDataFrame([("1", self_name)], "applicant_id string, name string") if self_name else None
    return resolve.aggregate_people(spark.createDataFrame(made, MENTION), applicants).orderBy("seq").collect()


def named(*names):
    return [(n, "coauthor", "printed", 0.9, f"d{i}") for i, n in enumerate(names)]


def test_merge(spark):
    (p,) = people(spark, ("John D. Carter", "supervisor", "printed", 0.9, "a"), ("J Carter", "coauthor", "printed", 0.9, "b"))
    assert p.roles == ["supervisor", "coauthor"] and len(p.sources) == 2 and p.canonical_name == "John D. Carter" and not p.needs_human


def test_order_matters(spark):
    assert len(people(spark, *named("John Carter", "James Carter", "J Carter"))) == 2
    assert len(people(spark, *named("John Carter", "J Carter", "James Carter"))) == 1


def test_self_review_and_sources(spark):
    got = people(spark, *named("Gildong Hong", "John Carter"), self_name="G Hong")
    assert [p.is_self for p in got] == [True, False]
    for kind, conf, want in (("seal", 0.95, True), ("printed", 0.4, True), ("printed", 0.9, False)):
        assert people(spark, ("A B", "coauthor", kind, conf, "d"))[0].needs_human == want
    (p,) = people(spark, *[("Daniel Kim", "coauthor", "printed", 0.9, "d")] * 4)
    assert len(p.sources) == 1


def test_candidates(spark):
    a, b = people(spark, *named("이주영", "이조영"))
    assert [(c.name, c.score) for c in a.name_candidates] == [("이주영", 1.0), ("이조영", 0.85)] and a.needs_human and b.needs_human
    assert people(spark, *named("정민", "정민호"))[0].name_candidates[1].score == 0.7
    assert all(not p.name_candidates for names in (["박철수", "박철민"], ["김종성", "류종성"], ["C Lee", "J Lee", "HJ Lee"]) for p in people(spark, *named(*names)))
    made = resolve.aggregate_people(spark.createDataFrame([("1", i, 0, n, "coauthor", None, "printed", 1, 0.9, False, "d", "f", "x") for i, n in enumerate(["이주영", "이조영", "김민수"])], MENTION))
    assert [r.label for r in resolve.ambiguous_flags(made).collect()] == ["이주영 / 이조영"]


VOTE = "document_id string, model int, person_seq int, nameRaw string, role string, affiliation string, sourceKind string, sourcePage int, confidence double, ocrConfidence double, isSelf boolean"


def vote(spark, *rows, least=1):
    df = spark.createDataFrame([("d", m, i, n, "coauthor", None, "printed", 1, c, None, False) for i, (m, n, c) in enumerate(rows)], VOTE)
    return {r.nameRaw: r for r in resolve.ensemble_vote(df, 3, least).collect()}


def test_votes(spark):
    assert vote(spark, (0, "이준호", 0.9), (1, "이준호", 0.8), (2, "이 준 호", 0.7))["이준호"].confidence == 1
    got = vote(spark, (0, "J Carter", 0.6), (1, "John Carter", 0.9))
    assert abs(got["John Carter"].confidence - 2 / 3) < 1e-9 and len(got["John Carter"].nameCandidates) == 2 and abs(got["John Carter"].ocrConfidence - 0.75) < 1e-9
    assert set(vote(spark, (0, "이준호", 0.9), (1, "이준호", 0.9), (2, "박서준", 0.9), least=2)) == {"이준호"}


def test_cross_check(spark):
    rows = [("t", "이준호", "printed", "degree_thesis"), ("t", "이 준 호", "seal", "degree_thesis"), ("t", "박서준", "seal", "degree_thesis"), ("u", "박서준", "seal", "degree_thesis"), ("v", "박서준", "seal", "journal_article")]
    got = resolve.cross_check(spark.createDataFrame(rows, "documentId string, nameRaw string, sourceKind string, docType string")).collect()
    assert sorted((r.documentId, r.sourceKind, r.verificationStatus or "") for r in got) == [("t", "printed", ""), ("t", "seal", "confirmed"), ("t", "seal", "mismatch"), ("u", "seal", "unverifiable"), ("v", "seal", "")]


def docs(spark, *rows):
    return spark.createDataFrame([(f"d{i}", kind, [(k + 1, t, True, None) for k, t in enumerate(texts)]) for i, (kind, *texts) in enumerate(rows)], "documentId string, docType string, pages array<struct<pageNumber:int,text:string,hasText:boolean,imagePath:string>>")


def test_thesis(spark):
    got = extract.rule_people(docs(spark, ("degree_thesis", THESIS, "none", "지도교수 김철수"), ("degree_thesis", "제목\n2020"), ("degree_thesis", "부 지도교수  김민수; 홍길동 위원장"))).collect()
    by = lambda d: sorted((r.role, r.nameRaw) for r in got if r.documentId == d)
    assert by("d0") == [("committee", "박서준"), ("committee", "이준호"), ("committee", "최지훈"), ("department_head", "윤도현"), ("supervisor", "John D. Carter"), ("supervisor", "이준호")]
    assert by("d1") == [] and by("d2") == [("co_supervisor", "김민수"), ("committee", "홍길동")]


def test_article(spark):
    d = docs(spark, ("journal_article", ARTICLE), ("unknown", "Title\nEmily Park and John Carter\nGreen Infrastructure Planning"), ("hindex", ARTICLE), ("journal_article", "One line only, John Carter"), ("journal_article", ""))
    got = extract.rule_people(d).collect()
    assert [r.nameRaw for r in got if r.documentId == "d0"] == ["Gildong Hong", "John Carter", "Mark Lee"] and {r.affiliation for r in got if r.documentId == "d0"} == {"example.edu"}
    assert [r.nameRaw for r in got if r.documentId == "d1"] == ["Emily Park", "John Carter"] and {r.documentId for r in got} == {"d0", "d1"}
    mine = extract.tag_self(extract.rule_people(d), spark.createDataFrame([("d0", "J Carter")], "documentId string, selfName string"))
    assert {(r.documentId, r.nameRaw) for r in mine.where("isSelf").collect()} == {("d0", "John Carter")}


def test_a_models_seal_reaches_a_flag(spark):
    """The answer of an image model for a scanned page, through routing and aggregation, ends in a seal's flag."""
    d = docs(spark, ("degree_thesis", THESIS)).unionByName(spark.createDataFrame([("scan", "degree_thesis", [(1, "", False, "p.png")])], "documentId string, docType string, pages array<struct<pageNumber:int,text:string,hasText:boolean,imagePath:string>>"))
    found = extract.hybrid(d, extract.rule_people, lambda x: extract.model_people(x, lambda s, u, images: '{"persons":[{"name":"박서준","source_kind":"seal","confidence":0.95}]}' if images == ["p.png"] else "{}"))
    assert found.columns == extract.MENTION
    mentions = found.select(F.lit("1").alias("applicant_id"), F.col("documentId").alias("doc_seq"), "person_seq", *extract.MENTION[2:], "documentId", F.lit("f").alias("filename"), F.lit("degree_thesis").alias("docType"))
    by = {r.canonical_name: r for r in resolve.aggregate_people(mentions.drop("ocrEngine", "ocrConfidence")).collect()}
    assert by["박서준"].needs_human and {s.sourceKind for s in by["박서준"].sources} == {"printed", "seal"} and not by["최지훈"].needs_human


def scanned(spark):
    page = lambda n, t: (n, t, bool(t), None)
    rows = [("1", "a", "1_[학위논문]_x.pdf", None, "pdf", [page(1, THESIS)], 1, True, None), ("1", "b", "1_hindex.png", None, "image", [page(1, "")], 1, False, None), ("1", "c", "1_x.pdf", "학술지", "pdf", [page(1, ARTICLE)], 1, True, None),
            ("2", "d", "2_bad.hwp", None, "hwp", [], 0, False, "not readable"), ("2", "e", "2_[학위논문]_y.txt", None, "text", [page(1, "지도교수 이주영\n심사위원 이조영")], 1, True, None)]
    files = spark.createDataFrame(rows, "applicant_id string, document_id string, filename string, folder_category string, format string, pages array<struct<pageNumber:int,text:string,hasText:boolean,imagePath:string>>, pageCount int, hasTextLayer boolean, note string")
    return files, spark.createDataFrame([("1", "Gildong Hong"), ("2", None)], "applicant_id string, name string")


def test_process(spark):
    files, applicants = scanned(spark)
    marks = spark.createDataFrame([("a", 2, "seal", 0.9)], "documentId string, page int, type string, confidence double")
    out = process.process(files, applicants, marks=marks)
    assert {r.document_id: r.doc_type for r in out["documents"].collect()} == {"a": "degree_thesis", "b": "hindex", "c": "journal_article", "d": "unknown", "e": "degree_thesis"}
    flags = sorted((r.applicant_id, r.document_id or "", r.flag_type, r.label or "") for r in out["flags"].collect())
    assert flags == [("1", "a", "seal", "p.2 (90%)"), ("1", "b", "needs_vision", ""), ("2", "", "ambiguous", "이주영 / 이조영"), ("2", "d", "needs_vision", "not readable")]
    people = {(r.applicant_id, r.canonical_name): r for r in out["aggregates"].collect()}
    assert people["1", "Gildong Hong"].is_self and people["1", "이준호"].roles == ["supervisor", "committee"] and people["2", "이조영"].needs_human
    assert len(people["1", "John D. Carter"].sources) == 2 and out["persons"].where("name_initials = 'J Carter'").count() == 2
    # again, over what is there: the same tables
    again = process.replaced(out, process.process(files, applicants, marks=marks), applicants)
    for name in out:
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, out[name].collect())), name


def test_reaggregate(spark):
    files, applicants = scanned(spark)
    out = process.process(files, applicants)
    fewer = out["persons"].where("name_raw <> '이조영'")
    people, flags = process.reaggregate(fewer, out["documents"], applicants.where("applicant_id = '2'"), out["flags"])
    assert [(r.applicant_id, r.canonical_name, r.sources[0].evidence) for r in people.collect()] == [("2", "이주영", None)]
    assert sorted(r.flag_type for r in flags.collect()) == ["needs_vision", "needs_vision"]


def test_nulls_and_decomposed_names(spark):
    import unicodedata

    nfd = lambda s: unicodedata.normalize("NFD", s)
    rows = [("1", 0, 0, nfd("이준호"), "coauthor", None, "printed", None, None, None, "d", "f", "x"), ("1", 1, 0, "이준호", "coauthor", None, "printed", 1, 0.9, False, "e", "f", "x"), ("1", 2, 0, None, None, None, None, None, None, None, None, None, None)]
    got = resolve.aggregate_people(spark.createDataFrame(rows, MENTION)).orderBy("seq").collect()
    assert [(p.canonical_name, len(p.sources), p.needs_human) for p in got] == [("이준호", 2, True), ("", 1, True)]
    assert vote(spark, (0, "이준호", None), (1, nfd("이준호"), 0.8))[nfd("이준호")].ocrConfidence == 0.8
    rows = [("t", "이준호", "printed", "degree_thesis"), ("t", nfd("이준호"), "seal", "degree_thesis"), ("t", None, "seal", "degree_thesis"), (None, "A B", "seal", "degree_thesis")]
    got = resolve.cross_check(spark.createDataFrame(rows, "documentId string, nameRaw string, sourceKind string, docType string")).collect()
    assert sorted((r.documentId or "", r.nameRaw or "", r.verificationStatus or "") for r in got) == sorted([("t", "이준호", ""), ("t", nfd("이준호"), "confirmed"), ("t", "", "mismatch"), ("", "A B", "unverifiable")])
    near = resolve.near_duplicates(spark.createDataFrame([("1", nfd("이주영")), ("1", "이조영"), ("1", None)], "applicant_id string, canonical_name string"))
    assert {(r.name, r.other, r.kind) for r in near.collect()} == {("이주영", "이조영", "misread"), ("이조영", "이주영", "misread")}


def test_groups_by_blocks_are_those_by_all_pairs():
    import random

    from spanloom.functions import names

    rng = random.Random(5)
    pool = ["John Carter", "J Carter", "James Carter", "J. Carter", "Jane Carter", "CARTER", "j carter", "이준호", "이 준 호", "박서준", "J C", "", "John 정", "Carter, John", "M Lee", "Mary Lee"]
    for _ in range(300):
        parsed = [names.parse(rng.choice(pool)) for _ in range(rng.randint(0, 12))]
        want = []
        for i, n in enumerate(parsed):
            home = next((g for g in want if any(parsed[j].same(n) for j in g)), None)
            want.append([i]) if home is None else home.append(i)
        assert resolve.greedy_groups(parsed) == want


def test_routing_and_models(spark):
    d = docs(spark, ("degree_thesis", THESIS), ("degree_thesis", "  "))
    seen = extract.hybrid(d, lambda x: x.select("documentId").selectExpr("*", "'text' as via"), lambda x: x.select("documentId").selectExpr("*", "'image' as via"))
    assert {tuple(r) for r in seen.collect()} == {("d0", "text"), ("d1", "image")}

    def call(system, user, images):
        if "thesis advisor" in user.lower():
            raise OSError("down")
        return "sorry" if "no answer" in user else '{"persons":[{"name":"A B","role":"PI","source_kind":"seal","is_self":false}]}'

    asked = docs(spark, ("degree_thesis", "x"), ("degree_thesis", "Thesis Advisor: C"), ("degree_thesis", "no answer"))
    assert [(r.documentId, r.nameRaw, r.role, r.sourceKind) for r in extract.model_people(asked, call).collect()] == [("d0", "A B", "principal_investigator", "seal")]
    assert [r.error for r in extract.ask_model(asked, call).orderBy("documentId").collect()] == [None, "OSError: down", "the answer is no JSON"]
    won = extract.ensemble_people(asked, {"m1": call, "m2": lambda *a: '{"persons":[{"name":"A B","confidence":0.9}]}'}, 1).orderBy("documentId").collect()
    assert [(r.documentId, r.nameRaw, r.confidence) for r in won] == [("d0", "A B", 1.0), ("d1", "A B", 0.5), ("d2", "A B", 0.5)]
    made = lambda f, p, box: None if p == 2 else f"{f}-{p}.png"
    marks = extract.detect_marks(spark.createDataFrame([("d0", "pdf", "degree_thesis", "f"), ("d1", "pdf", "hindex", "f")], "documentId string, format string, docType string, filepath string"), lambda f, p: [{"type": "SEAL", "x": 0.5, "y": 0.5, "w": 0.9, "h": 0.1, "confidence": 2.0}, {"type": "dog", "x": 0.0, "y": 0.0, "w": 0.0, "h": 0.0, "confidence": 0.1}])
    assert [(r.documentId, r.page, r.type, r.bbox.w, r.confidence) for r in marks.orderBy("page").collect()] == [("d0", 1, "seal", 0.5, 1.0), ("d0", 2, "seal", 0.5, 1.0)]
    cut = extract.cut_marks(marks, spark.createDataFrame([("d0", "f")], "documentId string, filepath string"), made)
    assert [r.cropPath for r in cut.orderBy("page").collect()] == ["f-1.png", None]

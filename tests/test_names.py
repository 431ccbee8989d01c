import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import names
from spanloom.operators.resolve import near_kind

NORMAL = {"이 준 호": "이준호", "이  준  호": "이준호", "김 철수": "김 철수", "  John   D.  Carter ": "John D. Carter", "이준호 (인)": "이준호", None: "", "": ""}
MATCH = [("John D. Carter", "J Carter"), ("Gildong Hong", "G Hong"), ("CK Kim", "Chang Kim"), ("이 준 호", "이준호"), ("John Carter", "J. Carter"), ("Junho LEE", "Junho Lee"), ("Carter, John", "J Carter")]
APART = [("John Carter", "John Lee"), ("John Carter", "Gary Carter"), ("John D. Carter", "Gregory Carter"), ("S Hong", "G Hong"), ("이준호", "Junho Lee"), ("J C", "John Carter"), ("이주영", "이조영"), ("", "")]


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_normalize_and_script(spark):
    got = values(spark, [(k,) for k in NORMAL], "n string").select("n", names.normalize(names.nfc("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == NORMAL
    kinds = {"이준호": "korean", "John Carter": "latin", "鄭周哲": "han", "John 정": "mixed", "12": "unknown"}
    assert {r[0]: r[1] for r in values(spark, [(k,) for k in kinds], "n string").select("n", names.script(F.col("n"))).collect()} == kinds


def test_composed_form(spark):
    import unicodedata

    texts = ["이준호", "각 갂 힣 가나다", "José Núñez", "Ångström Çelik", "Nguyễn Văn Ệ", "ẽé", "plain", "", "가\u11a8", "\u1100\u1161\u11a8x", "e\u0301\u0301", "\u0301e"]
    rows = [(f(t),) for t in texts for f in (lambda t: t, lambda t: unicodedata.normalize("NFD", t))]
    got = values(spark, [*rows, (None,)], "n string").select("n", names.nfc("n").alias("x")).collect()
    assert [r.x for r in got] == [None if r.n is None else unicodedata.normalize("NFC", r.n) for r in got]


def test_matching_agrees_with_the_parsed_form(spark):
    pairs = [(a, b, True) for a, b in MATCH] + [(a, b, False) for a, b in APART]
    for a, b, want, got, back in values(spark, pairs, "a string, b string, w boolean").select("*", names.matches(F.col("a"), F.col("b")), names.matches(F.col("b"), F.col("a"))).collect():
        assert got == back == want == names.parse(a).same(names.parse(b)), (a, b)


def test_forms(spark):
    rows = values(spark, [("John D. Carter",), ("J Carter",), ("이준호",), ("J C",), ("Carter",), ("LEE",), ("",)], "n string").select("n", names.initials_form(F.col("n")).alias("i"), names.key(F.col("n")).alias("k"), names.completeness(F.col("n")).alias("c")).collect()
    by = {r.n: r for r in rows}
    assert by["John D. Carter"].i == "J Carter" and by["J C"].i is None
    assert by["John D. Carter"].k == by["J Carter"].k == "latin:j carter" and by["이준호"].k == "korean:이준호"
    assert {n: r.c for n, r in by.items()} == {n: names.parse(n).completeness for n in by} == {"John D. Carter": 3, "J Carter": 2, "이준호": 3, "J C": 1, "Carter": 2, "LEE": 1, "": 1}


NEAR = [("이주영", "이조영", "misread"), ("정민", "정민호", "abbrev"), ("박철수", "박철민", None), ("김민수", "김민호", None), ("김종성", "류종성", None), ("C Lee", "J Lee", None), ("이주영", "이주영", None)]


def test_near(spark):
    got = values(spark, NEAR, "a string, b string, w string").select("w", names.near_duplicate(F.col("a"), F.col("b")), "a", "b").collect()
    assert all(w == x == near_kind(a, b) for w, x, a, b in got)
    d = values(spark, [("이주영", "이조영"), ("박철수", "박철민"), ("김민수", "김민호"), ("홍길동", "홍길동")], "a string, b string").select(names.jamo_distance(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in d] == [1, 3, 2, 0]


@given(st.text(max_size=20), st.text(max_size=20))
def test_matching_is_symmetric(a, b):
    x, y = names.parse(a), names.parse(b)
    assert x.same(y) == y.same(x)
    assert x.same(x) == bool(x.norm)


@pytest.mark.parametrize("s", ["이", "A"])
def test_single(s):
    assert names.parse(s).completeness == 1

import pytest
from lexweave.functions import patterns, text
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def on(spark):
    def run(make, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]

    return run


def test_strip_and_width(on):
    assert on(text.strip, "  a ", "　b ", None, "") == ["a", "b", None, ""]
    assert on(text.narrow, "（１２）　Ａ") == ["(12) A"]


def test_lines(on):
    assert on(text.lines, "a\r\nb\n\nc\n", "", "x\x0by z") == [["a", "b", "", "c"], [], ["x", "y", "z"]]


def test_tokens(on):
    assert on(text.tokens, "Straße 12", "휴학 a", "가나다", "") == [["strasse", "12"], ["휴학", "휴학", "a"], ["가나다", "가나", "나다", "가나다"], []]


def test_sentences(on):
    assert on(text.sentences, "하나. 둘! 셋\n넷", " . ", "") == [["하나.", "둘!", "셋", "넷"], ["."], []]


def test_slug_and_paths(on):
    assert on(text.slug, " 학칙 A(b)--c ", "!!") == ["학칙-a-b-c", ""]
    assert on(text.canonical_path, "./a//b/./c.pdf", "/a/") == ["a/b/c.pdf", "/a"]
    assert on(text.stem, "x/y.tar.gz", ".hidden", "a") == ["y.tar", ".hidden", "a"]


def test_headings(on):
    assert on(lambda x: patterns.chapter(x)["title"], "제 1 장 총칙", "제2장", "제1절 x") == ["총칙", None, None]
    got = on(patterns.article, "제12조의2(휴학) ① 본문", "제3조", "제3조에 따라 한다", "부칙")
    assert (got[0].number, got[0].fragment, got[0].title, got[0].body) == ("제12조의2", "12-2", "휴학", "① 본문")
    assert (got[1].number, got[1].title, got[1].body) == ("제3조", None, None)
    assert got[2].body == "에 따라 한다" and got[3] is None


def test_clauses(on):
    got = on(patterns.clauses, "앞 ① 하나 ② 둘", "표시 없음", "⑳끝")
    assert [(s.number, s.text, s.raw) for s in got[0]] == [(None, "앞", "앞"), ("1", "하나", "① 하나"), ("2", "둘", "② 둘")]
    assert [s.number for s in got[1]] == [None] and got[2][0].number == "20"


def test_items_are_no_dates(on):
    got = on(patterns.items, "다음 1. 하나 12. 둘", "2026.04.14. 시행", "3.5점", "없음")
    assert [(s.number, s.text) for s in got[0]] == [(None, "다음"), ("1", "하나"), ("12", "둘")]
    assert got[1] == [] and [s.number for s in got[2]] == ["3"] and got[3] == []


def test_sub_items(on):
    got = on(patterns.sub_items, "앞 가. 하나 나. 둘", "한다. 끝")
    assert [(s.number, s.text) for s in got[0]] == [("가", "하나"), ("나", "둘")] and got[1] == []


def test_appendices_and_tables(on):
    got = on(patterns.appendix, "부 칙", "부칙에 따라", "[별표 3] 등록금", "별표 2 수업", "【서식 제 1 호】 원서", "별표")
    assert [None if g is None else (g.kind, g.number, g.title, g.table) for g in got] == [("supplementary", None, "부칙", False), None, ("annex", "3", "별표 3", True), ("annex", "2", "별표 2", True), ("form", "제 1 호", "서식 제 1 호", False), None]
    assert [None if g is None else g.title for g in on(patterns.table, "[표 1] x", "표 2 y", "표")] == ["표 1", "표 2", None]

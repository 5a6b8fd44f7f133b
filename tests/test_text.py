"""Texts that the synthetic tables lack: Korean regulations, personal data, odd values."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import coerce, masking, text
from millrace.operators import chunking

REGULATION = "머리말\n제1장 총칙\n제1조(목적) 이 규정은 개정일 2024년 3월 5일 시행한다.\n제2조(정의) 짧다.\n제3조(휴가) " + "긴 조문이다. " * 200


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("kind, value, want", [
    ("rrn", "900101-1234567", "900101-*******"), ("rrn", "9001011234567", "900101-*******"), ("rrn", "12345", "*****"),
    ("name", "홍길동", "홍*동"), ("name", "이산", "이*"), ("name", "John Smith", "J*** S****"),
    ("phone", "010-1234-5678", "010-****-5678"), ("phone", "01012345678", "010-****-5678"), ("phone", "0212345678", "**********"),
    ("addr", "서울시 강남구 테헤란로 123", "서울시 강남구 ***"), ("email", "hong@hospital.kr", "h***@hospital.kr"), ("email", "@x", "***"),
    ("id", "PT20240001", "PT****01"), ("id", "PT20", "PT****"), ("name", None, ""), ("name", "", ""), ("name", "None", ""), ("phone", "NULL", ""),
])
def test_masks(spark, kind, value, want):
    assert one(spark, lambda x: masking.mask(x, kind), value) == want


def test_kinds_from_names():
    assert [masking.kind_of(c) for c in ("PT_NM", "HP_NO", "jumin_no", "hotel_code", "WARD_CD")] == ["name", "phone", "rrn", "phone", None]
    kinds = {"rrn": "주민번호 주민등록번호 birth_no ID_NO PTMIPPSID omt02idnoa reg_no SSN", "name": "환자명 성함 이름 PAT_NM ptname user_nm", "phone": "전화번호 휴대폰 핸드폰 TEL_NO contact", "addr": "주소 거주지 HOME_ADDR", "email": "이메일 E_MAIL", "id": "pat_no EMP_NO chart_no patient_id PTMIPTNO"}
    assert {c: masking.kind_of(c) for names in kinds.values() for c in names.split()} == {c: kind for kind, names in kinds.items() for c in names.split()}
    assert not any(map(masking.kind_of, ("l_orderkey", "o_totalprice", "병동", "dept_cd", "n_regionkey")))


def test_masking_fails_closed(spark):
    with pytest.raises(ValueError):
        masking.mask_frame(spark.range(1), {"id": "nonsense"})


@pytest.mark.parametrize("raw, want", [
    ("Ａ１　（가）", "A1 (가)"), ("a\x00b\x07", "ab"), ("▶ 하나\n● 둘", "• 하나\n• 둘"), ("“x” ‘y’", "\"x\" 'y'"), ("a\n- 3 -\nb", "a\n\nb"), ("a\nPage 2 of 9\nb", "a\n\nb"),
    ("a\n2024년 1월 2일\nb", "a\n\nb"), ("a\n담당 팀장 부장\nb", "a\nb"), ("규정-\n집 exam-\nple", "규정집 example"), ("a \t  b\n\n\n\nc  ", "a b\n\nc"),
])
def test_clean(spark, raw, want):
    assert one(spark, text.clean, raw) == want


def test_pages_of_noise(spark):
    assert one(spark, text.is_contents, "목 차\n가 ..... 1\n나 ..... 2\n다 ..... 3") is True
    assert one(spark, text.is_contents, "목 차\n가 ..... 1") is False
    assert one(spark, text.is_revisions, "개정 이력 1차") is True
    assert one(spark, text.is_revisions, "개정 이력 제1조") is False


def test_structure_and_scores(spark):
    s = one(spark, text.structure, REGULATION)
    assert (s.article, s.article_title, s.chapter, s.chapter_title, s.dates) == ("제1조, 제2조, 제3조", "목적", "제1장", "총칙", ["2024.03.05"])
    assert one(spark, text.structure, "none").article is None
    assert one(spark, text.hangul_ratio, "가나ab1") == pytest.approx(0.4)
    assert one(spark, text.quality, "short") == 0.0
    assert one(spark, text.quality, "가나다 라마바 사아자. 차카타, 파하") == pytest.approx(1.0)


def test_article_chunks():
    chunks = chunking.split_articles(REGULATION, 500, 50)
    assert chunks[0].startswith("제1조") and "제2조" in chunks[0] and "머리말" not in "".join(chunks)
    assert all(len(c) <= 500 for c in chunks) and len(chunks) > 3
    assert chunking.split_articles("no articles here", 500, 50) == ["no articles here"]


def test_articles_share_chunks_by_room():
    """Each article with its neighbours while they fit; one too long is cut by itself and shares with none."""
    articles = [f"제{i}조 " + "가" * n for i, n in enumerate((10, 20, 200, 5, 5, 60, 60, 90), 1)]
    got = chunking.split_articles("앞\n" + "\n".join(articles), 100, 10)
    assert got[0] == "\n\n".join(articles[:2]) and got[-3:] == ["\n\n".join(articles[3:6]), articles[6], articles[7]]
    assert "".join(got[1:-3]).startswith("제3조") and "".join(got[1:-3]).count("가") >= 200 and max(map(len, got)) <= 100


@pytest.mark.parametrize("source, size, overlap", [("word " * 500, 100, 20), ("x" * 1000, 64, 10), ("a.b.c\n\n" * 90, 50, 0), ("", 10, 0), ("  ", 10, 0)])
def test_recursive_chunks(source, size, overlap):
    chunks = chunking.split_recursively(source, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(chunks).split()) >= set(source.split()) or "x" in source
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(source.split())


def test_heading_chunks():
    found = chunking.split_headings("# T\nintro that is long enough to stay in the index\n## C\n<!-- page 1 -->\nbody that is long enough to stay in the index\n### S\nshort")
    assert [(c["title"], c["chapter"]) for c in found] == [("T", ""), ("T", "C")]
    assert "page 1" not in found[1]["content"]


@pytest.mark.parametrize("n", [0, 1, 799, 800, 801, 1449, 1450, 1451, 2101])
def test_windows(spark, n):
    source = "".join(chr(97 + i % 26) for i in range(n))
    want, rest = [], source
    while len(rest) > 800:
        want.append(rest[:800])
        rest = rest[650:]
    want += [rest] if rest else []
    assert one(spark, text.windows, source) == want


def test_coercion(spark):
    rows = spark.createDataFrame([("1,234 원",), ("",), (None,), ("x",), ("-5",)], "x string")
    assert [r[0] for r in rows.select(coerce.clean_amount(F.col("x"))).collect()] == [1234, 0, 0, 0, -5]
    assert [r[0] for r in rows.select(coerce.safe_int(F.col("x"))).collect()] == [0, 0, 0, 0, -5]
    values = spark.sql("SELECT array(4.0, 1.0, 3.0, 2.0) AS v")
    assert values.select(coerce.percentile_upper(F.col("v"), 0.5)).first()[0] == 3.0
    assert one(spark, coerce.sex, " 여 ") == "F" and one(spark, coerce.sex, "?") == ""
    assert one(spark, coerce.room_parts, "10203").room_key == "0102"


def test_tokens_keep_every_script(spark):
    assert one(spark, text.tokens, "제1조 Élan, v1.2 a!") == ["제1조", "élan", "v1.2"]
    assert one(spark, lambda x: text.header(x, F.lit("3"), F.lit("")), "규정") == "[규정 | p.3]\n"


def test_markdown_of_structure_and_tables(spark):
    assert one(spark, text.structured_markdown, "제1장 총칙\n 제2절 범위\n제3조(목적) 글\n① 항\n글") == "## 제1장 총칙\n### 제2절 범위\n#### 제3조(목적) 글\n- ① 항\n글"
    rows = spark.sql("SELECT array(array('a', 'b'), array('', null), array('1', ' 2 ')) AS x, cast(array() AS array<array<string>>) AS y")
    assert rows.select(text.markdown_table(F.col("x"))).first()[0] == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert rows.select(text.markdown_table(F.col("y"))).first()[0] == ""


def test_cut_at_a_break(spark):
    assert one(spark, text.at_break, "x" * 300 + ". " + "y" * 300) == "x" * 300 + ". "
    assert one(spark, text.at_break, "x " + "y" * 600) == ("x " + "y" * 600)[:400]
    assert one(spark, text.at_break, "short") == "short"
    assert one(spark, text.masked_card, "1234-5678-9012-3456") == "1234-****-****-3456"
    assert one(spark, text.masked_card, "123") == "123"

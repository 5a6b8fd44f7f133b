"""Text, document, masking and retrieval queries on the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import coerce, masking, text
from millrace.operators import chunking, embed, modes, retrieval
from millrace.operators.inverted import InvertedIndex
from millrace.plans.catalog import query
from millrace.session import spread, table


@query("str01_half_width", "SELECT n_nationkey, n_name AS plain, 'A1! ' || n_name AS half FROM nation")
def str01_half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("plain"), text.half_width(F.concat(F.lit("Ａ１！　"), "n_name")).alias("half"))


@query("str02_plain_marks", "SELECT doc_id, md5(translate(text, '▶●“”‘’', '••\"\"''''')) AS h FROM documents")
def str02_plain_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain_marks(F.col("text"))).alias("h"))


@query("str05_even_space", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', e'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def str05_even_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.even_space(F.col("text"))).alias("h"))


@query("etl01_clean")
def etl01_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also STR-03, STR-04, ETL-04: cleaned, scored and flagged; short or poor texts are left out."""
    # Through explode, so that what follows uses the cleaned text and its score instead of working them out for each use.
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cleaned = docs.select("doc_id", F.explode(F.array(text.clean(F.col("text")))).alias("text"))
    scored = cleaned.select("doc_id", "text", F.explode(F.array(text.quality(F.col("text")))).alias("quality"))
    long = F.length("text")
    kept = scored.where((long >= 50) & ~((long > 100) & (F.col("quality") < 0.1)))
    return kept.withColumn("noise", text.is_contents(F.col("text")) | text.is_revisions(F.col("text")))


@query(
    "str03_idle_lines",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 5 THEN '' WHEN o_orderkey % 8 = 5 THEN 'Page ' || o_orderkey || ' of' WHEN o_orderkey % 8 = 6 THEN o_orderkey || '/' || o_custkey || '/1' ELSE '- ' || o_orderkey END || e'\n본문' AS text FROM orders""",
)
def str03_idle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: page numbers in several dresses, date lines and approval boxes go; lines that only look like them stay."""
    key, other = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    dresses = (
        F.concat(F.lit("- "), key, F.lit(" –")), F.concat(F.lit("  "), key, F.lit(" / "), other), F.concat(F.lit("Page "), key, F.lit("  of "), other), F.date_format("o_orderdate", "yyyy년 M월 d일"),
        F.concat(F.lit("담당 "), key, F.lit(" 팀장\n- 1 -")), F.concat(F.lit("Page "), key, F.lit(" of")), F.concat(key, F.lit("/"), other, F.lit("/1")), F.concat(F.lit("- "), key))
    line = F.element_at(F.array(*dresses), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.without_headers(F.concat(line, F.lit("\n본문"))).alias("text"))


@query(
    "str04_joined_words",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '규정집' WHEN 1 THEN lower(substr(p_name, 1, 1)) || 'ple' WHEN 2 THEN e'규-\nple' ELSE p_partkey || e'-\n9' END || ' well-known' AS text FROM part""",
)
def str04_joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: halves of one script are joined over a line's end; of two scripts, or numbers, not."""
    key, gap = F.col("p_partkey"), F.lit("-  \n ")
    halves = F.when(key % 4 == 0, F.concat(F.lit("규정"), gap, F.lit("집"))).when(key % 4 == 1, F.concat(F.lower(F.substring("p_name", 1, 1)), gap, F.lit("ple"))).when(key % 4 == 2, F.lit("규-\nple")).otherwise(F.concat(key.cast("string"), F.lit("-\n9")))
    return table(spark, sf_dir, "part").select("p_partkey", text.joined_words(F.concat(halves, F.lit(" well-known"))).alias("text"))


@query(
    "etl02_noise_pages",
    "SELECT doc_id, doc_id % 6 IN (0, 1) AS contents, doc_id % 6 = 3 AS revisions FROM documents",
)
def etl02_noise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETL-02, ETL-03: each document as a page of contents in two languages, as one with too few entries, of revisions, of revisions with an article, or as it is."""
    key = F.col("doc_id").cast("string")
    entries = F.concat_ws("\n", *(F.concat(F.lit(f"{i} ....... "), key, F.lit(" ")) for i in range(3)))
    heads = (F.concat(F.lit("목  차\n"), entries), F.concat(F.lit("Contents\n"), entries), F.concat(F.lit("차례\n가 ... "), key), F.concat(F.lit("개정 이력 "), key), F.concat(F.lit("개정 이력 제 "), key, F.lit(" 조")), F.lit("글"))
    page = F.concat(F.element_at(F.array(*heads), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), "0123456789.", ""))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(page)).alias("page"))
    return pages.select("doc_id", text.is_contents(F.col("page")).alias("contents"), text.is_revisions(F.col("page")).alias("revisions"))


@query(
    "etl06_regulations",
    """SELECT o_orderkey, '제' || o_orderkey || '조, 제' || (o_orderkey + 1) || '조, 제' || (o_orderkey + 2) || '조' AS article, o_orderstatus || ' 제도 (상' AS article_title, '제' || o_custkey || '장' AS chapter, '총칙 ' || o_orderstatus AS chapter_title,
    '제2절' AS section, strftime(o_orderdate, '%Y.%m.%d') || ',1999.01.09' AS dates FROM orders""",
)
def etl06_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06, ETL-06: a regulation for each order, with a chapter, a section, four articles, a title that holds the word for numbered parts and ends at the first closing bracket, and dates of events and others."""
    key = lambda n: (F.col("o_orderkey") + n).cast("string")
    rule = F.concat(
        F.lit("규정 2001.1.1\n제 "), F.col("o_custkey").cast("string"), F.lit("장  총칙 "), "o_orderstatus", F.lit(". 뒤\n제2절 범위\n제"), key(0), F.lit("조 （"), "o_orderstatus", F.lit(" 제도 (상)） 개정일 "), F.date_format("o_orderdate", "yyyy년 M월 d일"),
        F.lit("\n제"), key(1), F.lit("조(둘) 시행: 1999. 1. 9\n제"), key(2), F.lit("조 공포 99.1.1\n제"), key(3), F.lit("조 끝 발효 2020.2.2 제안"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(text.structure(rule))).alias("s"))
    return found.select("o_orderkey", "s.article", "s.article_title", "s.chapter", "s.chapter_title", "s.section", F.array_join("s.dates", ",").alias("dates"))


@query(
    "mth01_hangul_ratio",
    r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{Nd}]')) > 0 THEN len(regexp_extract_all(text, '[가-힣]')) / len(regexp_extract_all(text, '[\p{L}\p{Nd}]')) ELSE 0 END AS ratio FROM documents",
)
def mth01_hangul_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.hangul_ratio(F.col("text")).alias("ratio"))


@query("etl06_structure")
def etl06_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: numbers, titles and dates of articles and chapters. The tables have none; tests use Korean texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.structure(F.col("text")).alias("s")).select("doc_id", "s.article", "s.chapter", "s.section", F.size("s.dates").alias("dates"))


@query(
    "etl11_windows",
    """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(n - 800, 0) / 650) AS BIGINT) + 1)) AS i FROM d)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 650 + 1, 800)) AS h FROM w""",
)
def etl11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.windows(F.col("text"))).alias("chunk_index", "content")).select("doc_id", "chunk_index", F.md5("content").alias("h"))


@query("etl05_article_chunks")
def etl05_article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ETL-06 and ETL-07."""
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "articles", 1000, 200)


@query(
    "etl05_regulation_chunks",
    """SELECT o_orderkey, c AS chunk_index, md5(CASE c WHEN 0 THEN '제 ' || o_orderkey || ' 조 ' || repeat('가', 400) || e'\n\n제2조 ' || repeat('나', 400) ELSE '제3조 ' || repeat('다', 400 + o_custkey % 100) END) AS h FROM orders, (VALUES (0), (1)) v(c)""",
)
def etl05_regulation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETL-05: a regulation for each order: what stands before the first article is in no chunk, two short articles share one, the third has its own."""
    article = lambda head, sign, n: F.concat(head, F.repeat(F.lit(sign), n))
    key = F.col("o_orderkey").cast("string")
    rule = F.concat(
        F.lit("머리말 "), key, F.lit("\n"), article(F.concat(F.lit("제 "), key, F.lit(" 조 ")), "가", F.lit(400)), F.lit("\n\n\n"), article(F.lit("제2조 "), "나", F.lit(400)), F.lit("\n"),
        article(F.lit("제3조 "), "다", (F.col("o_custkey") % 100 + 400).cast("int")), F.lit(" \n"))
    found = chunking.chunk(table(spark, sf_dir, "orders").select("o_orderkey", rule.alias("text")), "o_orderkey", "text", "articles", 1000, 200)
    return found.select("o_orderkey", "chunk_index", F.md5("content").alias("h"))


@query("etl10_markdown_chunks")
def etl10_markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ETL-12: pages as Markdown, by their headings."""
    md = F.col("html")
    for depth in range(1, 5):
        md = F.regexp_replace(md, f"(?i)<h{depth}(?:\\s[^>]*)?>", "\n" + "#" * depth + " ")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(md, "<[^>]*>", "\n").alias("md"))
    return chunking.chunk_markdown(pages, "page_id", "md")


@query("etl08_headers", "SELECT doc_id, md5('[' || source || ' | p.' || doc_id || e']\n' || text) AS headed FROM documents")
def etl08_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = text.header(F.col("source"), F.col("doc_id").cast("string"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(head, "text")).alias("headed"))


@query(
    "etl14_column_groups",
    """WITH c AS (SELECT c_nationkey AS t, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
    SELECT t, CAST((i - 1) // 10 AS INTEGER) AS grp, array_to_string(list(name ORDER BY i), ', ') AS columns FROM c GROUP BY 1, 2""",
)
def etl14_column_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ETL-15: members of a table in groups of ten, as text."""
    from pyspark.sql import Window

    numbered = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("t"), F.col("c_name").alias("name"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("i"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"])
    return numbered.groupBy("t", F.floor((F.col("i") - 1) / 10).cast("int").alias("grp")).agg(F.array_join(ordered, ", ").alias("columns"))


@query(
    "str10_tokens",
    r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{N}_\s.]', ' ', 'g')), '\s+'), lambda t: length(t) > 1)) AS n FROM documents",
)
def str10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n").cast("long").alias("n"))


@query("str11_term_map", "SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN replace(text, 'the', 'THE') WHEN contains(text, 'of') THEN replace(text, 'of', 'OF') ELSE text END AS mapped FROM conversations")
def str11_term_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also STR-13 and RET-12: the longest phrase that occurs is replaced."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_map(F.col("text"), {"of": "OF", "the": "THE"}).alias("mapped"))


@query("str17_amounts", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders")
def str17_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also STR-16 and STR-19: an amount with separators and back."""
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.clean_amount(F.concat(F.lit("₩ "), coerce.thousands(F.round("o_totalprice")))).alias("amount"))


@query("str19_formats", "SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS amount, format('{:,}', CAST(floor(o_totalprice / 10000) AS BIGINT)) || '만' AS man FROM orders")
def str19_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also STR-20 and STR-21."""
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.thousands(F.round("o_totalprice")).alias("amount"), coerce.ten_thousands(F.col("o_totalprice")).alias("man"))


@query(
    "str23_rooms",
    "SELECT p_partkey, substr(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 1, 2) AS ward, substr(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 3, 2) AS room, substr(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 5, 2) AS bed FROM part WHERE p_partkey < 1000000",
)
def str23_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = coerce.room_parts(F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("r")).select("p_partkey", "r.ward", "r.room", "r.bed")


@query("str24_hashes", "SELECT doc_id, substr(md5(text), 1, 12) AS m12, substr(sha256(text), 1, 16) AS s16 FROM documents")
def str24_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 12).alias("m12"), F.substring(F.sha2("text", 256), 1, 16).alias("s16"))


@query("str25_previews", "SELECT conv_id, turn, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '…' ELSE text END AS preview FROM conversations")
def str25_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.truncated(F.col("text"), 30).alias("preview"))


@query("dtm01_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d8, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter_start, year(o_orderdate)::INTEGER AS y, strftime(o_orderdate - INTERVAL 1 DAY, '%m/%d') AS day_before FROM orders")
def dtm01_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also DTM-02, DTM-03 and DTM-05."""
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(d, "yyyyMMdd").alias("d8"), F.date_format(F.trunc(d, "MM"), "yyyy-MM-dd").alias("month_start"), F.date_format(F.trunc(d, "QUARTER"), "yyyy-MM-dd").alias("quarter_start"), F.year(d).alias("y"), F.date_format(F.date_sub(d, 1), "MM/dd").alias("day_before"))


@query("dtm06_local_time", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS kst FROM events")
def dtm06_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also DTM-04 and DTM-07."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss").alias("kst"))


@query("jsn01_props", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events WHERE props IS NOT NULL")
def jsn01_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also MAP-01."""
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").where(F.col("props").isNotNull()).select("event_id", F.try_element_at(F.map_values(parsed), F.lit(1)).alias("first_value"))


@query("mth05_similarity", "SELECT vec_id, greatest(0.0::DOUBLE, 1 - label / 10) * 100 AS pct, 1 / (1 + abs(label)) AS score FROM embeddings")
def mth05_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also MTH-04 and MTH-06."""
    label = F.col("label").cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", retrieval.similarity_pct(label).alias("pct"), retrieval.normalised(label).alias("score"))


@query("pii03_names", "SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS masked FROM customer")
def pii03_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also PII-02..PII-08 (their golden values are in the tests)."""
    return table(spark, sf_dir, "customer").select("c_custkey", masking.mask(F.col("c_name"), "name").alias("masked"))


@query("pii09_mask_frame", "SELECT s_suppkey, substr(s_name, 1, 1) || repeat('*', length(s_name) - 1) AS s_name, s_nationkey FROM supplier")
def pii09_mask_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also PII-01, PII-13: columns found by name."""
    return masking.mask_frame(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query(
    "pii15_korean_columns",
    """SELECT c_custkey AS "번호", '홍*' || translate(right(c_name, 1), '0123456789', '가나다라마바사아자차') AS "환자명", '010-****-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS "휴대폰", '9' || '***@a.kr' AS "이메일",
    '900101-*******' AS birth_no, 'PT****' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS pat_no, '서울시 강남구 ***' AS "주소" FROM customer""",
)
def pii15_korean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also PII-01..PII-08: every kind by the names that hospital tables use."""
    number = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        number.alias("번호"), F.concat(F.lit("홍길"), F.translate(F.substring("c_name", -1, 1), "0123456789", "가나다라마바사아자차")).alias("환자명"),
        F.concat(F.lit("010-1234-"), F.lpad((number % 10000).cast("string"), 4, "0")).alias("휴대폰"), F.concat(F.lit("9"), number, F.lit("@a.kr")).alias("이메일"),
        F.lit("900101-1234567").alias("birth_no"), F.concat(F.lit("PT2024"), F.lpad((number % 100).cast("string"), 2, "0")).alias("pat_no"), F.concat(F.lit("서울시 강남구 "), number).alias("주소"))
    return masking.mask_frame(rows)


@query("pii10_without_personal", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def pii10_without_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also PII-14 and PRJ-03."""
    return masking.drop_personal(table(spark, sf_dir, "customer"), None)


@query(
    "pii16_free_text",
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\d{6}-[1-4]\d{6}', '[RRN]', 'g'), '\bPT\d{7}\b', '[PATIENT_ID]', 'g'), '\b01[016789]-?\d{3,4}-?\d{4}\b', '[PHONE]', 'g'),
    '[A-Za-z0-9._-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g') AS masked FROM conversations""",
)
def pii16_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", masking.mask_text(F.col("text")).alias("masked"))


@query(
    "pii16_patient_names",
    """SELECT c_custkey, '[PATIENT_NAME] ' || CASE c_custkey % 3 WHEN 0 THEN '[PATIENT_ID]' WHEN 1 THEN '[PHONE]' ELSE '[RRN]' END || ', 환자 ' || c_name || ' 환자A' AS masked FROM customer""",
)
def pii16_patient_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII-16: names behind the word for a patient, of two to four syllables, with numbers of three kinds; a blank or another script ends the rule."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("환자"), F.element_at(F.array(*map(F.lit, ("홍길", "홍길동", "남궁홍길"))), (key % 3 + 1).cast("int")))
    digits = F.lpad(key.cast("string"), 7, "0")
    number = F.when(key % 3 == 0, F.concat(F.lit("PT"), digits)).when(key % 3 == 1, F.concat(F.lit("010-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 4, 4))).otherwise(F.concat(F.lit("900101-2"), F.substring(digits, 2, 6)))
    return table(spark, sf_dir, "customer").select("c_custkey", masking.mask_text(F.concat(name, F.lit(" "), number, F.lit(", 환자 "), "c_name", F.lit(" 환자A"))).alias("masked"))


@query(
    "ret01_vector_search",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM v q JOIN v c ON q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d) SELECT query_id, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 10""",
)
def ret01_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SRT-06, RET-09 and FLT-14: every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_search(vectors, queries, 10).withColumn("distance", F.round("distance", 6))


BM25 = r"""d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{N}_\s.]', ' ', 'g')), '\s+'), lambda t: length(t) > 1) AS terms FROM documents),
s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d), p AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, n), m AS (SELECT avg(idf) AS mean_idf FROM f),
q AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{N}_\s.]', ' ', 'g')), '\s+'), lambda t: length(t) > 1)) AS term FROM benchmark),
a AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY 1, 2),
x AS (SELECT a.query_id, p.id, round(sum(times * (CASE WHEN idf < 0 THEN mean_idf * 0.25 ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN f USING (term) JOIN a USING (term), m, s GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE score > 0)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("ret04_bm25", f"WITH {BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM b WHERE rank <= 20")
def ret04_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also RET-03, SRT-07 and FLT-13: all questions of the benchmark over all documents."""
    return retrieval.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), 20)


@query(
    "ret05_fusion",
    f"""WITH {BM25}, v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 97, id) AS rank FROM b),
    u AS (SELECT query_id, id, rank FROM b WHERE rank <= 20 UNION ALL SELECT query_id, id, rank FROM v WHERE rank <= 20), z AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z) WHERE rank <= 10""",
)
def ret05_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JOIN-15, RET-06 and MTH-03: two rankings by reciprocal ranks."""
    index, questions = InvertedIndex.build(table(spark, sf_dir, "documents")), _questions(spark, sf_dir)
    return retrieval.fuse([index.search(questions, 20), index.search(questions, 20, order=lambda i: i % 97)], 10)


def _overlap(question, text):
    """A stand-in scorer: the share of a question's words that the text has."""
    words = question.str.lower().str.split().map(set)
    return sum_shares(words, text.str.lower().str.split().map(set))


def sum_shares(a, b):
    import pandas as pd

    return pd.Series([len(x & y) / max(len(x), 1) for x, y in zip(a, b)], dtype=float)


@query("ret07_rerank")
def ret07_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also RET-08, RET-10 and UDF-02: fused hits by a pair scorer, here the share of the question's words."""
    docs, questions = table(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    hits = retrieval.bm25(docs, questions, 15)
    joined = retrieval.with_documents(hits, docs.select("doc_id", "text", "source")).join(questions.withColumnRenamed("text", "question"), "query_id")
    return retrieval.rerank(joined, _overlap, 3).select("query_id", "rerank", "rank", "id", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "ret14_contexts",
    f"""WITH {BM25} SELECT b.query_id, array_to_string(list('[' || rank || '] ' || source || e'\\n' || substr(text, 1, 300) ORDER BY rank), e'\\n\\n') AS context FROM b JOIN documents ON doc_id = id WHERE rank <= 3 GROUP BY 1""",
)
def ret14_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also RET-15..RET-17."""
    docs = table(spark, sf_dir, "documents")
    hits = retrieval.bm25(docs, _questions(spark, sf_dir), 3)
    return retrieval.contexts(retrieval.with_documents(hits, docs.select("doc_id", "text", "source")))


@query(
    "ret25_keyword_score",
    "SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'en') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN lang = 'en' THEN 1.5::DOUBLE ELSE 0 END AS score FROM documents",
)
def ret25_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.lit("the"), F.lit("en"))
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.keyword_score(F.col("text"), F.array("lang"), words).alias("score"))


def _mode(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    docs = embed.embed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "text", embed.hashed_words())
    rewrites = [lambda x: modes.without_noise(x, [r"\b(?:the|of|and)\b"]), lambda x: F.lower(F.substring_index(x, " ", 6))]
    found = modes.search(docs, _questions(spark, sf_dir), modes.MODES[name], embed.hashed_words(), _overlap, rewrites)
    return found.select("query_id", "rank", "id", "source")


@query("ret09_fast_mode")
def ret09_fast_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also RET-18, RET-27, ETL-17 and UDF-01, by an encoder that needs no model."""
    return _mode(spark, sf_dir, "fast")


@query("ret10_standard_mode")
def ret10_standard_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also RET-06 and RET-19."""
    return _mode(spark, sf_dir, "standard")


@query("ret11_deep_mode")
def ret11_deep_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also RET-13, STR-12, STR-14 and SET-03."""
    return _mode(spark, sf_dir, "deep")

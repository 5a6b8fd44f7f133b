"""Chunking of long texts along their structure."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, groupby, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ".", " ", "")
BOUNDARY = re.compile(r"제\s*\d+\s*조")
#: What stands between articles in one chunk.
BETWEEN = "\n\n"
HEADING = re.compile(r"(?m)^(#{1,4})\s+(.*)$")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that occurs; neighbours share up to `overlap` characters.

    Pieces longer than `size` are cut at the next separator; the empty one cuts between characters.
    """
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    separator = next((s for s in separators if s == "" or s in text), "")
    parts = list(text) if separator == "" else [p + (separator if i < text.count(separator) else "") for i, p in enumerate(text.split(separator))]
    finer = separators[separators.index(separator) + 1 :] if separator in separators else ("",)
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if len(part) > size:
            if held:
                out.append("".join(held))
                held, length = [], 0
            out += split_recursively(part, size, overlap, finer or ("",))
            continue
        if length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        out.append("".join(held))
    return [s for piece in out if (s := piece.strip())]


def split_articles(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole articles: short neighbours together, long ones cut further. Without two articles, cut as any text.

    What stands before the first article is in no chunk, as in the documents' own index.
    """
    starts = [m.start() for m in BOUNDARY.finditer(text)]
    if len(starts) < 2:
        return split_recursively(text, size, overlap)
    articles = [text[a:b].strip() for a, b in pairwise([*starts, len(text)])]

    def shelf(last: tuple[int, int], article: str) -> tuple[int, int]:
        """The number of an article's chunk, and how full it is with it; an article too long for any chunk has one to itself."""
        number, filled = last
        fits = 0 < filled and filled + len(article) <= size
        return (number, filled + len(BETWEEN) + len(article)) if fits else (number + 1, len(article))

    numbers = (number for number, _ in [*accumulate(articles, shelf, initial=(0, 0))][1:])
    chunks = ([a for _, a in own] for _, own in groupby(zip(numbers, articles), key=lambda x: x[0]))
    return [piece for own in chunks for piece in (split_recursively(own[0], size, overlap) if len(own[0]) > size else [BETWEEN.join(own)])]


def split_headings(text: str, size: int = 800, overlap: int = 150, least: int = 30) -> list[dict]:
    """Chunks of Markdown with the headings they stand under, `<!-- -->` removed; those under `least` characters are left out."""
    out, under = [], {}
    marks = [*HEADING.finditer(text)]
    spans = [(None, 0, marks[0].start() if marks else len(text)), *((m, m.start(), n.start() if n else len(text)) for m, n in zip(marks, [*marks[1:], None]))]
    for mark, start, end in spans:
        if mark:
            level = len(mark[1])
            under = {k: v for k, v in under.items() if k < level} | {level: mark[2].strip()}
        for piece in split_recursively(text[start:end], size, overlap, ("\n\n", "\n", "。", ". ", " ", "")):
            content = re.sub(r"(?s)<!--.*?-->", "", piece).strip()
            if len(content) >= least:
                out.append({"content": content, **{name: under.get(k, "") for k, name in ((1, "title"), (2, "chapter"), (3, "section"), (4, "article"))}})
    return out


def chunk(docs: DataFrame, id_col: str, text_col: str, how: str = "articles", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk_index, content) of every chunk; null and empty texts have none. `how`: articles or recursive."""
    split = {"articles": split_articles, "recursive": split_recursively}[how]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, k, c) for i, text in zip(pdf["id"], pdf["text"]) if text for k, c in enumerate(split(text, size, overlap))]
            yield pd.DataFrame(found, columns=["id", "chunk_index", "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, chunk_index int, content string")
    return rows.withColumnRenamed("id", id_col)


def chunk_markdown(docs: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 150) -> DataFrame:
    """Chunks of Markdown with their headings, the first of equal ones in each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                seen: set[str] = set()
                for c in split_headings(text or "", size, overlap):
                    if c["content"] not in seen:
                        rows.append({"id": i, "chunk_index": len(seen), **c})
                        seen.add(c["content"])
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "content", "title", "chapter", "section", "article"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, chunk_index int, content string, title string, chapter string, section string, article string"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return rows.withColumnRenamed("id", id_col).withColumn("content_hash", F.md5("content"))

from millrace.plans import texts


def test_headings_keep_their_depth(spark, tmp_path):
    html = "<h1>Book</h1><h2 class='x'>Part</h2><H3>Piece</H3><h4>Point</h4><p>" + "some words of a text " * 5 + "</p>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    last = texts.etl10_markdown_chunks(spark, str(tmp_path)).orderBy("chunk_index").collect()[-1]
    assert (last.title, last.chapter, last.section, last.article) == ("Book", "Part", "Piece", "Point")

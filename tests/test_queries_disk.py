"""What queries over an index of documents shuffle, with no join sent around for its bytes alone."""

import random

import pytest

from millrace.plans import catalog
from tests.test_inverted_disk import shuffled


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    rng, path = random.Random(6), str(tmp_path_factory.mktemp("many"))
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    docs = [(i, f"s{i % 3}", " ".join(rng.choices(vocabulary, k=200))) for i in range(4000)]
    asked = [(q, " ".join(rng.choices(vocabulary, k=5))) for q in range(20)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield path, sum(len(d[2]) for d in docs)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["ret04_bm25", "ret05_fusion", "ret07_rerank", "ret10_standard_mode", "ret11_deep_mode", "ret14_contexts"])
def test_texts_and_postings_are_not_shuffled(spark, many, name):
    path, size = many
    before = shuffled(spark)
    assert catalog.queries()[name](spark, path).count() >= 20
    assert shuffled(spark) - before < size / 2

from millrace.plans import texts


def test_rooms_of_long_numbers(spark, tmp_path):
    spark.createDataFrame([(123456,), (1234567,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.p_partkey for r in texts.str23_rooms(spark, str(tmp_path)).collect()) == [123456, 1234567]

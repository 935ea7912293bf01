from sedimenta.functions.sql import register


def test_functions(spark):
    assert "count_tokens" in register(spark, "words")
    spark.createDataFrame([("a b  c", '{"x": 1}'), (None, None)], "t string, j string").createOrReplaceTempView("texts")
    rows = spark.sql("""SELECT count_tokens(t) AS n, split_text(t, 'recursive', 2, 0) AS s, same_json(j, '{"x":1.0}') AS e, csv_cells('1,"a, b"') AS c, trim_blanks(concat(t, ' ')) AS b FROM texts""").collect()
    assert [tuple(r) for r in rows] == [(3, ["a b", "c"], True, ["1", "a, b"], "a b  c"), (None, None, None, ["1", "a, b"], None)]

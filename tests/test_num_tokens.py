from logspark.workload.queries import QUERIES


def test_largest_token_before_the_tail_counts(spark, tmp_path):
    turns = [(1, n, "z" if n == 3 else "a", "text") for n in range(200)] + [(2, 0, "b", "text")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in QUERIES["num_tokens"](spark, str(tmp_path)).collect()] == [(28,)]

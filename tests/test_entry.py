import __spark_entry__


def test_catalogue_queries_have_rows(spark):
    sf = "/root/testdata/sf0.001"
    from quern.plans.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES)
    assert __spark_entry__.entry(spark).count() > 0
    for name in ("match_decide", "snapshot_diff", "rate_limit", "edit_similarity"):
        assert QUERIES[name](spark, sf).count() > 0

import datetime

from quillspark.plans import reports

DAY = datetime.datetime(2024, 1, 1)


def tables(spark, folder, orders):
    spark.createDataFrame([(k, f"Customer#{k}") for k in range(300)], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_all_articles_newest_first(spark, tmp_path):
    orders = [(i, i, "F", 1000.0 + i, DAY + datetime.timedelta(days=i % 150)) for i in range(200)] + [(900, 1, "O", 460000.0, DAY)]
    folder = tables(spark, tmp_path, orders)
    got = reports.articles_list(spark, folder).collect()
    assert sorted(r.id for r in got) == list(range(200))
    assert [r.day for r in got] == sorted((r.day for r in got), reverse=True)
    # Articles exist, so no candidate may stand in, even where none reaches the threshold of this query.
    assert reports.articles_existing(spark, folder).collect() == []


def test_candidates_alone_are_limited(spark, tmp_path):
    folder = tables(spark, tmp_path, [(i, i, "O", 400000.0 + i, DAY) for i in range(200)])
    got = reports.articles_list(spark, folder, "F").collect()
    assert [r.author_id for r in got] == list(range(199, 99, -1))
    assert {r.article_status for r in got} == {"draft"}

from quillspark.operators import walk


def test_a_chain_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(3)], "source int, target int").coalesce(1)
    got = walk.reachable(edges, spark.createDataFrame([(0,)], "node int"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i) for i in range(4)]

"""Agreement of labels is that of every vector."""

import math

from __spark_entry__ import queries


def test_every_vector_is_asked(spark, tmp_path):
    rows = [(i, [math.cos(i), math.sin(i)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: r.hit_rate for r in queries()["label_agreement"](spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == list(range(60))
    best = lambda i: sorted(range(60), key=lambda j: (-round(math.cos(i - j), 6), j))[:10]
    assert got == {i: round(sum(j % 3 == i % 3 for j in best(i)) / 10, 6) for i in range(60)}

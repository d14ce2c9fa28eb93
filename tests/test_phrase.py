from pyspark.sql import functions as F

from passagework.operators import index


def test_only_the_words_of_a_phrase_are_posted(spark):
    texts = spark.createDataFrame([(1, "salt and the sea and the sand"), (2, "the and"), (3, "nothing here")], "id long, text string")
    tokens = index.tokenised(texts, "id", F.col("text"))
    post = index.postings(tokens, ["and", "the"])
    assert {r.term for r in post.collect()} == {"and", "the"}
    assert [tuple(r) for r in index.phrase(post, ["and", "the"]).collect()] == [tuple(r) for r in index.phrase(index.postings(tokens), ["and", "the"]).collect()] == [(1, 2)]

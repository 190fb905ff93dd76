from tidemark.operators import wordvectors


def test_training_is_dealt_out_by_words(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "alpha beta gamma delta epsilon " * 4) for i in range(20)], "id int, text string")
    assert wordvectors.skipgram(rows, size=8, rounds=1).getNumPartitions() == 1
    monkeypatch.setattr(wordvectors, "WORDS", 100)
    model = wordvectors.skipgram(rows, size=8, rounds=2)
    assert model.getNumPartitions() == 4 and model.getVectors().count() == 5
    assert wordvectors.skipgram(rows, size=8, rounds=1, partitions=2).getNumPartitions() == 2

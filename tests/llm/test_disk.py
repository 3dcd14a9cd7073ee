from wedgeworks.llm import ngram_join
from wedgeworks.llm.common import forget


def test_join_lets_go_of_what_its_steps_leave(spark, monkeypatch):
    """Between the large steps; how much disk that saves is for the check tool to say."""
    calls = []
    monkeypatch.setattr(ngram_join, "forget", lambda session: calls.append(session) or forget(session))
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z " + "w" * (i % 3)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.without_copies(docs, n=5, percent=80, classes=3).collect()) == [0]
    assert len(calls) >= 5

"""Classification costs the different texts, not the claims."""

from recollect.operators import govern


def test_each_different_text_is_classified_once(spark, monkeypatch):
    said = ["I love tea.", "I am tired.", None, "", "I was born in Oslo; I love tea."]
    seen, write = [], govern.materialize
    monkeypatch.setattr(govern, "materialize", lambda df, name: seen.append(df.count()) or write(df, name))
    claims = spark.createDataFrame([(i, said[i % 5]) for i in range(500)], "id int, said string")
    got = govern.classify(claims, "said").collect()
    assert seen == [5] and len(got) == 500
    assert {(r["said"], r["claim_type"], r["status"]) for r in got} >= {("I love tea.", "preference_habit", "classified"), (None, None, "unclassified"), ("", None, "unclassified")}

"""case_facts reads a part's rows once each and sorts nothing that it only counts."""

from recordlake.operators import caseparts


def test_facts_of_odd_rows_without_sorting(spark):
    r = '{"docket_entries": ["text", null, 7, {"FILEDATE": " ", "filed": "2020-02-02", "RTEXT": "x", "text": {"a": 1}}, {"filedDate": "2019-01-01", "title": 5}, {"URL": " "}], "documents": [{"sha": ""}, {"hash": 12}], "parties": "none", "title": "A v. B"}'
    df = spark.createDataFrame([(1, r), (2, '{"docket_entries": {"filed": "2020-01-01"}, "title": " ", "CASETITLE": "In the Matter of: Cee"}')], "k int, r string")
    facts = caseparts.case_facts(df, "k", "r").select("k", "docket_events", "filing_date", "documents", "captured_documents", "parties", "case_title")
    assert sorted(map(tuple, facts.collect())) == [(1, 2, "2020-02-02", 1, 1, 2, "A v. B"), (2, 0, "", 0, 0, facts.where("k = 2").first()["parties"], "In the Matter of: Cee")]
    assert "array_sort" not in facts._jdf.queryExecution().optimizedPlan().toString()

from fieldloom.llm import quality_rules


def test_lines_of_f_count_and_form_feeds_do_not(spark):
    docs = spark.createDataFrame([(1, "f\nf\n ff \n ff "), (2, "\f\n\f\nword\n\f ")], "doc_id long, text string")
    rows = quality_rules.measures(docs).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dup_lines) for r in rows] == [(4, 2), (1, 0)]

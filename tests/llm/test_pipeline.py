"""The pipeline on the smallest tables, each stage against its operator or plain code."""

import corpus_pipeline as p
from gaugeline.llm import quality_rules
from gaugeline.llm._common import read_table
from gaugeline.llm.queries import ORACLE_SQL, QUERIES
from test_simhash_near import brute_first

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read_table(spark, D, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality":
            rules = quality_rules.fit_rules(before, read_table(spark, D, "labels"))
            want = {r.doc_id for r in quality_rules.judge(before, rules).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "near_duplicates":
            # Five words and a similarity of 0.8: operator 8's own query, of three words and two bits, has another contract.
            assert sorted(r.doc_id for r in docs.collect()) == brute_first([(r.doc_id, r.text) for r in before.collect()])[1]
        if name == "personal_data":
            assert not docs.where("text RLIKE '[a-z]@[a-z]+[.][a-z]'").count()
        if name == "encoding":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in docs.collect())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] < sizes[4] == sizes[5]


def test_stages_take_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns; a table without rows; labels without rows."""
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty.write.parquet(f"{tmp_path}/labels.parquet")
    for k, docs in enumerate((odd, none)):
        for name, stage in p.STAGES:
            columns = docs.columns
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
            before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}-{name}")
            if name != "encoding":
                assert docs.columns == columns
            if name == "quality" and not k:  # without labels only the base rule rejects
                want = [r for r in quality_rules.judge(before, []).collect() if r.kept]
                assert docs.count() == len(want) > 5
        assert (docs.count() > 0) == (not k)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)

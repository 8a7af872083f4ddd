import corpus_pipeline
from archivemill.llm import op4_chosen_path, op7_decontamination

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert after.count() == before.count()
        else:
            assert after.schema == docs.schema
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            assert op4_chosen_path.similar(after).where("n_links > 0 OR class_id != doc_id").isEmpty()
        if name == "decontamination":
            assert op7_decontamination.contamination(after, benchmark).where("contaminated").isEmpty()
            assert after.where("n_chars != length(text)").isEmpty()
        before = after
    assert 0 < corpus_pipeline.run(spark, SF).count() == before.count() < docs.count()


def test_stages_take_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0

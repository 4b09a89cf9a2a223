from loomdoc.llm import decontamination, jaccard_join, licenses, mixing, quality, secrets, sharding, substrings, token_counts, toxicity


def test_every_operator_takes_an_empty_table(spark, empty):
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert licenses.scan(empty).count() == 0
    import public_tokenizers

    assert token_counts.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert decontamination.clean(empty, items).count() == 0
    assert sharding.shard(empty).count() == 0
    assert jaccard_join.components(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert quality.judge(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0


def test_every_stage_takes_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

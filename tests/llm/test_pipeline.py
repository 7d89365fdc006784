"""The stages one after the other, and each query on the smallest tables."""

from __future__ import annotations


from pyspark.sql import functions as F

import corpus_pipeline
from kinspark.llm import entry, minhash, quality, repeats, rules
from kinspark.llm.scratch import settled

DATA = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in quality.scored(docs, labels).where("predicted = 1").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "suffix_dedup", "pack"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settled(stage(spark, docs, DATA), name)
        assert after.columns == docs.columns
        if name == "quality_rules":
            assert ids(after) == ids(rules.measure(docs).where("kept"))
        elif name == "quality_classifier":
            assert ids(after) == [i for i in ids(docs) if i in good]
        elif name == "near_dedup":
            assert ids(after) == ids(minhash.linked(docs).where("kept"))
        else:
            assert ids(after) == ids(docs)
            assert after.where("n_chars <> char_length(text)").count() == 0
            sizes = {r.doc_id: r.n_bytes - r.n_removed for r in repeats.removed(docs).collect()}
            assert all(len(r.text.encode()) <= sizes[r.doc_id] for r in after.collect())
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(docs)
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_all_queries_are_registered():
    import __spark_entry__ as e

    found = [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert len(found) == 14 and {n.split("_")[0] for n in entry.queries()} == {f"op{i}" for i in range(1, 14)}


def test_stages_on_odd_and_empty_tables(spark, odd, odd_rows, nothing, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and clashing names, through all stages."""
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40, 60)], "doc_id long, quality int")
    for name, table in (("odd", odd), ("nothing", nothing)):
        where = str(tmp_path / name)
        table.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, settled(stage(spark, docs, where), stage_name)
            assert docs.columns == table.columns
            assert docs.count() <= before.count()
            if stage_name in ("quality_rules", "quality_classifier"):
                assert docs.exceptAll(before).count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, where)
        assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        assert corpus_pipeline.run(spark, where).count() == packed.count()


def test_a_run_leaves_one_stage_s_table(spark):
    from kinspark.llm.scratch import shared_folder

    folder = spark._jvm.java.io.File(shared_folder(spark).removeprefix("file://"))
    before = set(folder.list())
    corpus_pipeline.run(spark, DATA)
    left = {x.rsplit("-", 1)[0] for x in set(folder.list()) - before}
    assert left == {"suffix_dedup", "pieces"}


def test_texts_that_are_not_utf_8_pass_all_stages(spark, tmp_path):
    """Texts that end inside a character, or hold a byte that no character has."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    raw = "CASE WHEN doc_id % 20 = 1 THEN concat(binary(text), X'20C3') WHEN doc_id % 20 = 2 THEN concat(X'61FF6220', binary(text)) ELSE binary(text) END"
    where = str(tmp_path)
    docs.selectExpr("doc_id", f"string({raw}) AS text", "lang", "source", "n_chars").write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert docs.where("NOT is_valid_utf8(text)").count() > 10
    kept = settled(corpus_pipeline.quality_rules(spark, docs, where), "quality_rules")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rules.measure(docs).where("kept").collect())
    both = kept.join(docs.select("doc_id", F.col("text").alias("given")), "doc_id")
    assert both.where("is_valid_utf8(given) AND text <> given").count() == 0
    assert {r.text[-2:] for r in both.where("doc_id % 20 = 1").collect()} == {" \ufffd"}
    assert {r.text[:4] for r in both.where("doc_id % 20 = 2").collect()} == {"a\ufffdb "}
    assert settled(corpus_pipeline.quality_classifier(spark, kept, where), "quality_classifier").exceptAll(kept).count() == 0
    assert corpus_pipeline.run(spark, where).count() > 0

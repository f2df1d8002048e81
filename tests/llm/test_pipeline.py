import corpus_pipeline
from pyspark.sql import functions as F

from roadweave.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    lang = corpus_pipeline.language(spark, docs, SF)
    assert lang.columns == docs.columns and 0.9 * n <= lang.count() <= n
    good = corpus_pipeline.good(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert good.columns == docs.columns and good.join(clean.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * clean.count()
    one = corpus_pipeline.distinct(spark, docs, SF)
    assert one.columns == docs.columns and one.select("text").distinct().count() == one.count() < n
    mixed = corpus_pipeline.mixed(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).collect()[0][0] <= 3


def test_registered_queries():
    names = sorted(queries())
    assert [int(n[2:].split("_")[0]) for n in names if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert set(oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "packing"]


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, SF)
        assert got.columns == odd_docs.columns if name != "packing" else set(got.columns) >= {"doc_id", "sequence_id", "offset"}
        rows = got.count()
        if name == "language_id":
            assert not {2, 3, 5} & {r.doc_id for r in got.collect()}  # null, empty, white space
        if name == "near_dedup":
            assert rows == odd_docs.count() - 1 and got.where("doc_id = 1").count() == 1  # the repeated row; texts without words stand alone
        if name == "packing":
            assert got.where("doc_id = 1").count() == 2 and {r.length for r in got.where("doc_id in (2, 3)").collect()} == {1}
        assert stage(spark, no_docs, SF).count() == 0


def test_whole_run(spark):
    """The stages by hand, each from what the one before kept; the run's pieces are those of the mixed documents."""
    from tokenizers import Tokenizer
    import collections
    import public_tokenizers

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expect = collections.Counter()
    for d in docs.collect():
        n = len(plain.encode(d["text"] or "", add_special_tokens=False).ids) + 1
        expect[d["doc_id"], n] += 1
    whole = collections.Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    totals = collections.Counter()
    for (doc, n), times in expect.items():
        totals[doc] += n * times
    assert whole == totals
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024

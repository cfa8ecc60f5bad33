from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, langid, neardup, queries, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, "s", None), (10**6 + 1, "123 456", None, "s", 7), (10**6 + 2, "my own password=0123abcdef is here", "en", "s", 34), (None, "some words without an id", None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs, SF)
    assert named.columns == docs.columns and docs.count() - named.count() == 2
    kept = stages["near_dedup"](spark, named, SF)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1 and kept.count() < named.count()
    clean = stages["secret_scan"](spark, kept, SF)
    assert clean.count() == kept.count() and clean.filter(F.col("n_chars") != F.length("text")).isEmpty()
    assert clean.filter(F.col("text").rlike("password=[0-9a-f]{8}")).isEmpty() and not clean.filter(F.col("text").contains("[SECRET]")).isEmpty()
    packed = stages["packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.select("doc_id").collect()}
    load = defaultdict(int)
    for r in packed:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 4096 and len(load) == -(-sum(load.values()) // 4096)
    assert stages["language_id"](spark, docs.filter("false"), SF).isEmpty()


def test_language_id_without_labels(spark):
    """Without any label the documents with letters stay; those without go."""
    rows = [(1, "some words", None, "s", 10), (2, "123 456", None, "s", 7), (3, None, None, "s", None), (4, "", None, "s", 0), (5, "1 \u6f22 2", None, "s", 5), (None, "\u00e9", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language_id(spark, docs, SF)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["lang"]) for r in got.collect()} == {(1, "und"), (5, "und"), (None, "und")}


def test_near_dedup_of_repeats(spark):
    """Rows that repeat an id and rows without one are documents like others."""
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "en", "s", 1)] * 3 + [(None, text, "en", "s", 1)] * 3 + [(3, text + " eleven", "en", "t", 2), (9, "", None, None, 0), (9, None, None, None, None), (None, "quite another text", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(False, 3, text + " eleven"), (False, 9, ""), (False, 9, ""), (True, 0, "quite another text")]
    none = corpus_pipeline.near_dedup(spark, docs.filter("doc_id is null and n_chars = 1"), SF)
    assert none.count() == 1


def test_stages_on_hard_tables(spark):
    """Empty tables, nulls in every column, clashing names and a long text."""
    names = ["lang_pred", "score", "_label", "_row", "spans", "sequence_id", "item", "id", "text_", "grp"]
    rows = [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None), (2, "word " * 50_000, "en", "s", 250_000), (3, "bearer q8Zr1LxV0tPw7YbN3kHs5DfG", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.withColumn(n, F.lit("x"))
    for table in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns, name
            assert (out.count() == 0) == (table.count() == 0), name
        assert corpus_pipeline.packing(spark, table, SF).isEmpty() == table.isEmpty()
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secret_scan(spark, docs.filter("doc_id = 3"), SF).collect()}
    assert clean == {3: ("bearer [SECRET]", 15)}


def test_run(spark):
    """The whole pipeline, against its stages' rules worked out apart."""
    from loomgraph.llm import langid, neardup, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lettered = {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    labels = langid.identify(docs, langid.train(docs)).collect()
    assert {r["doc_id"] for r in labels if r["lang_pred"] != langid.UND} == lettered
    kept = {r["doc_id"] for r in neardup.near_duplicates(docs.filter(F.col("doc_id").isin(sorted(lettered)))).filter("kept").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == kept
    tokenizer = tokens.encoder(queries.tokenizer("word_bpe_49k.json")).tokenizer
    length = defaultdict(int)
    load = defaultdict(int)
    for r in got:
        length[r["doc_id"]] += r["length"]
        load[r["sequence_id"]] += r["length"]
    want = {i: len(tokenizer.encode(secrets.redacted(texts[i], secrets.spans_of(texts[i])[1]), add_special_tokens=False).ids) + 1 for i in kept}
    assert length == want and len(load) == -(-sum(load.values()) // 4096)


def test_batches_are_bounded(spark):
    """Every stage bounds the bytes of a batch for Python; a limit of the session's own stays."""
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words "), 400), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4400).cast("long").alias("n_chars"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    before = spark.conf.get(common.ARROW_BYTES, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(common.ARROW_BYTES)
            stage(spark, docs.limit(10), SF)
            most = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(most) <= 2 * common.BATCH_BYTES and sum(most) > 3000 * 4400
        spark.conf.set(common.ARROW_BYTES, "1000000")
        corpus_pipeline.secret_scan(spark, docs, SF)
        assert spark.conf.get(common.ARROW_BYTES) == "1000000"
    finally:
        spark.conf.unset(common.ARROW_BYTES) if before is None else spark.conf.set(common.ARROW_BYTES, before)


def test_make_room(spark, monkeypatch):
    """Near-dedup and language ID drop what packing kept in the worker that they get."""
    path = queries.tokenizer("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    made = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **b: made.append(run))
    neardup.sign(docs, "doc_id", "text", 5, 60)
    langid.identify(docs, model)
    assert len(made) == 2
    for run in made:
        assert tokens.encoder(path) and tokens._encoders
        list(run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])])))
        assert not tokens._encoders


def test_train_starts_no_plain_workers(spark, monkeypatch):
    """The labels' shares come without rows of Python objects, whatever the labels are."""
    odd = ['a"b', "a\\b", "a\nb", "漢 \U0001f600", "{}", ""]
    rows = [(i, f"some words of text {i} " * 5, i % len(odd)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, no int")
    named = F.array(*map(F.lit, odd))[F.col("no")]
    docs = common.saved(docs.select("doc_id", "text", named.alias("lang"), F.format_string("l%d", "no").alias("plain")), "labels")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("createDataFrame"))
    model, plain = langid.train(docs), langid.train(docs, lang_col="plain")
    assert model.languages == sorted(odd)
    for i, g in enumerate(odd):
        assert (model.scores[model.languages.index(g)] == plain.scores[i]).all()

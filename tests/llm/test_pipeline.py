"""The pipeline's stages: what each keeps, and the whole run."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import queries
from ledgerlight.llm.common import table

SF = "/root/testdata/sf0.001"
EDGE_ROWS = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "no id", "en", "a", 5), (4, "same words in both of these rows", "en", "a", 1), (5, "Same words, in both of these rows!", "en", "a", 1), (4, "same words in both of these rows", "en", "a", 1)]


def _plain(df):
    return Counter(map(tuple, df.collect()))


def test_stages_keep_clean_documents_and_columns(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    scored = {r.doc_id: r.predicted for r in queries.op7_line_crf(spark, SF).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality classifier":
            assert kept == {i for i, p in scored.items() if p}
            assert sum(labels.get(i) == 1 and i not in kept for i in scored) <= 1
        if name == "n-gram Jaccard join":
            classes = {r.doc_id: r.class_id for r in queries.jaccard.similar(docs).collect()}
            assert kept == set(classes.values())
        if name == "benchmark decontamination":
            leaks = {r.doc_id for r in queries.decontam.passages(docs, table(spark, SF, "benchmark")).select("doc_id").collect()}
            assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - leaks
        if name == "secret scans":
            assert after.count() == before
            found = queries.secrets.digest(after)
            assert found.filter("n_assign + n_access + n_hex > 0").count() == 0
        docs = queries.packing.written(after, "stage")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "sequence_id", "offset"}


def test_stages_on_edges(spark):
    docs = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(("score", "predicted", "_base", "_all", "_row", "_new", "class_id", "n", "k1", "part", "queue", "w"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.mixture_packing(spark, docs, SF).count() > 0
    kept = corpus_pipeline.jaccard_join(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]
    assert _plain(corpus_pipeline.benchmark_decontamination(spark, docs, SF)) == _plain(docs)
    assert _plain(corpus_pipeline.secret_scans(spark, docs, SF)) == _plain(docs)


def test_rows_are_known_by_id_and_text(spark):
    item = next(r.text for r in table(spark, SF, "benchmark").collect() if r.text and len(r.text.split()) > 20)
    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in "vw")
    rows = [
        (None, one, "en", "a", 1), (7, one, "en", "a", 1), (8, one + " more", "en", "a", 1),
        (20, two, "en", "a", 1), (21, two, "en", "a", 1), (21, "another text of the same id", "en", "a", 1),
        (None, item, "en", "a", 1), (30, "clean text of an id that leaks too", "en", "a", 1), (30, f"before it {item}", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, docs, SF).collect()}
    assert {(None, one), (20, two), (21, rows[5][1]), (30, rows[7][1])} <= kept
    assert not {(7, one), (8, one + " more"), (21, two)} & kept
    clean = Counter((r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect())
    assert clean == Counter((d, t) for d, t, *_ in rows if item not in t)


def test_queries_and_sql_are_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.oracle_sql()) <= names

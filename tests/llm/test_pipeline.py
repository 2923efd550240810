import corpus_pipeline
from braidmill.llm.common import materialize

from .helpers import alnum_words, components, documents, linked, odd_documents, shingles


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now, rows = docs.columns, docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, materialize(stage(spark, now, sf_dir))
        if k < 4:
            assert now.columns == columns
        rows.append((before.collect(), now.collect()))
    (a, b), (_, c), (_, d), (_, e), (_, f) = rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r for r in a if labels.get(r.doc_id) == 1]
    kept = {r.doc_id for r in b}
    assert sum(r.doc_id in kept for r in good) > 0.9 * len(good) and len(b) < len(a)
    sets = {r.doc_id: shingles(r.text) for r in b}
    ids = sorted(r.doc_id for r in c)
    assert not any(linked(sets[x], sets[y]) for i, x in enumerate(ids) for y in ids[:i])
    gone = set(sets) - set(ids)
    assert all(any(linked(sets[x], sets[y]) for y in sets if y != x) for x in gone)
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = alnum_words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    dirty = lambda t: any(tuple(alnum_words(t)[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(alnum_words(t)) - n + 1))
    assert {r.doc_id for r in d} == {r.doc_id for r in c if not dirty(r.text)}
    assert {r.doc_id for r in e} <= {r.doc_id for r in d}
    assert sorted((r.doc_id, r.text) for r in f) == sorted((r.doc_id, r.text) for r in e)


def _tables(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_tables(spark, tmp_path):
    """Nulls, blanks, a very long text, repeated rows, and columns called like those of the stages."""
    rows = odd_documents()
    docs = documents(spark, rows).selectExpr("*", "'a' as bm_score", "'b' as bm_source", "'c' as bm_row_hash", "'d' as bm_copy")
    item = " ".join(alnum_words(next(t for _, t in rows if t and len(alnum_words(t)) > 100))[:30])
    _tables(spark, str(tmp_path), docs, [(1, 1, 0)], [(1, item), (None, None), (2, "")])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before, now = now, materialize(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
        kept = {(r.doc_id, r.text) for r in now.collect()}
        assert kept <= {(r.doc_id, r.text) for r in before.collect()}
        if k == 0:
            assert now.count() == len(rows)  # one class of labels: nothing is rejected
        if k == 1:
            alone = {r for r, (_, _, _, links) in zip(rows, components(rows), strict=True) if not links}
            assert alone <= kept
        if k == 2:
            assert kept == {(r.doc_id, r.text) for r in before.collect() if item not in " ".join(alnum_words(r.text))}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"bm_score", "bm_source", "bm_row_hash", "bm_copy", "shard", "shard_", "size_", "lang", "n_chars", "text"} <= set(out.columns)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, ((r.doc_id, r.text) for r in now.collect())))


def test_empty_table_and_what_is_left_behind(spark, tmp_path):
    from braidmill import session

    _tables(spark, str(tmp_path), documents(spark, [(1, "x")]).limit(0), [(1, 1, 0)], [(1, "a b c")])
    before = session.bookmark()
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert session.bookmark() - before <= 2


def test_run_equals_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "shard", "slot", "text"} <= set(out.columns)

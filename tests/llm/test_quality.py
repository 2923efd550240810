import math
import zlib

import numpy as np

from braidmill.llm import quality as Q

from .helpers import documents, odd_documents


def test_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97
    assert np.mean([(s - y) ** 2 for s, y in held]) < 0.05  # calibrated
    assert np.mean([s >= 0.7 for s in good]) > 0.97


def test_only_the_text_counts_and_held_out_labels_are_not_read(spark):
    rows = odd_documents()
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    flipped = labels.rdd.map(lambda r: (r[0], 1 - r[1] if r[0] is not None and r[1] in (0, 1) and held(r[0]) else r[1], r[2]))
    a = {(r.doc_id, r.score) for r in Q.quality_scores(docs, labels).collect()}
    b = {(r.doc_id, r.score) for r in Q.quality_scores(docs, spark.createDataFrame(flipped, labels.schema)).collect()}
    assert a == b and all(0 <= s <= 1 for _, s in a)
    by_text = {}
    for (i, t), s in zip(sorted(rows, key=repr), [dict(a)[r[0]] for r in sorted(rows, key=repr)], strict=True):
        if i is not None:
            by_text.setdefault(t, set()).add(s)
    assert all(len(v) == 1 for v in by_text.values())


def test_labels_of_one_class_and_none(spark):
    docs = documents(spark, [(1, "a b"), (4, None), (None, "")])
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.quality_scores(docs, make([])).collect()} == {1.0}
    assert {r.score for r in Q.quality_scores(docs, make([(1, 0, 0), (4, 0, 0)])).collect()} == {0.0}
    assert Q.keep_quality(docs, make([(1, 1, 0)])).count() == 3
    assert Q.quality_scores(docs.limit(0), make([(1, 1, 0)])).collect() == []
    clash = spark.createDataFrame([(1, "a", 5.0, "z"), (2, "b", 6.0, "y")], "doc_id long, text string, bm_score double, bm_Score_ string")
    assert sorted(map(tuple, Q.keep_quality(clash, make([(1, 1, 0)])).collect())) == sorted(map(tuple, clash.collect()))


def test_word_vectors_are_sums_over_all_texts(spark):
    import pyarrow as pa

    from braidmill.llm.textops import string_buffers

    texts = ["ab cd ab", "cd ef", None, ""]
    got = Q.word_vectors(documents(spark, list(enumerate(texts))))
    sums = np.zeros((Q.WORD_CELLS, Q.WIDTH))
    for t in texts:
        cells = Q._cells(Q._tokens(*string_buffers(pa.array([t], pa.string())))[0])
        for x, y in zip(cells[:-1], cells[1:], strict=True):
            sums[x] += Q._INDEX[y]
            sums[y] += Q._INDEX[x]
    norm = np.sqrt((sums**2).sum(1, keepdims=True))
    assert np.allclose(got, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), atol=1e-6)


def plain_tokens(text):
    """Word hashes, byte by byte."""
    mask = 2**64 - 1
    mix = lambda h: int(Q._mix(np.array([h & mask], np.uint64))[0])
    kind = lambda b: 0 if b < 33 else 1 if b >= 128 or chr(b).isalnum() else 2
    out, run = [], []
    for b in [*(text or "").encode(), 32]:
        if run and kind(b) != kind(run[0]):
            if kind(run[0]):
                out.append(mix(sum(int(Q._VALUE[x]) * ((i & 15) * 0x9FB21C651E98DF25 & mask | 1) for i, x in enumerate(run))))
            run = []
        run.append(b)
    return out


def test_scores_by_plain_arithmetic(spark):
    """Every text's score, from its words, the word table and the network's weights, without arrays of texts."""
    rows = [r for r in odd_documents() if r[0] is not None and len(r[1] or "") < 5000]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    m = Q.train_quality(docs, labels)
    got = {}
    for r in Q.quality_scores(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    for i, text in rows:
        cells = [h >> 65 - Q.WORD_CELLS.bit_length() for h in plain_tokens(text)]
        x = np.zeros(3 * Q.WIDTH + 2)
        if cells:
            own, index = np.array([m.vectors[c] for c in cells], float), np.array([Q._INDEX[c] for c in cells], float)
            x = np.concatenate([own.mean(0), index.mean(0), own.std(0), [np.log1p(len(cells)), len(text.encode()) / len(cells) / 8]])
        hidden = [math.tanh(sum(((x[a] - m.center[a]) / m.scale[a]) * m.w1[a, h] for a in range(len(x))) + m.b1[h]) for h in range(Q.HIDDEN)]
        z = (sum(h * w for h, w in zip(hidden, m.w2, strict=True)) + m.b2) / m.temperature
        assert any(abs(s - 1 / (1 + math.exp(-z))) < 1e-3 for s in got[i])


def test_a_score_does_not_depend_on_the_rows_beside_it(spark):
    """Bitwise equal scores, whatever the number of rows that are scored at once."""
    import pyarrow as pa

    rows = [t for _, t in odd_documents() if len(t or "") < 5000]
    docs = documents(spark, list(enumerate(rows)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    m = Q.train_quality(docs, labels)
    assert m.constant is None
    texts = (rows * 30)[:1000]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["text"])
    whole = Q.probabilities(m, Q._pooled(batch(texts), m.vectors))
    for size in (1, 2, 3, 64):
        parts = [Q.probabilities(m, Q._pooled(batch(texts[lo : lo + size]), m.vectors)) for lo in range(0, 300, size)]
        assert np.concatenate(parts)[:300].tobytes() == whole[:300].tobytes()

import numpy as np

from treeloom.llm import neighbours as op


def brute(rows, queries, count):
    usable = {(k, tuple(v)) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for key, vector in queries:
        score = {}
        for other, values in usable:
            if other != key:
                score[other] = max(score.get(other, -np.inf), float((np.array(values) * np.array(vector)).sum()))
        out[key] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:count]
    return out


def test_small_table_is_exact(spark):
    random = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in random.standard_normal(8)]) for k in range(60)]
    rows += [(60 + k, rows[0][1]) for k in range(30)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [None] + [1.0] * 7), (104, [float("nan")] * 8), (105, [float("inf")] * 8), (None, rows[1][1]), (2, rows[2][1]), (106, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, part int, v double")
    asked = [r for r in rows[:60:7]]
    got = {}
    for r in op.search(frame, frame.where("vec_id < 60 and vec_id % 7 = 0"), count=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, asked, 20)
    assert set(got) == set(want)
    for key, found in got.items():
        assert [(n + 1, i) for n, (i, _) in enumerate(want[key])] == [(n, i) for n, i, _ in sorted(found)]
        assert np.allclose([s for _, _, s in sorted(found)], [s for _, s in want[key]], rtol=0, atol=1e-12)


def test_empty_and_few(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in op.search(frame, frame.where("vec_id = 1")).collect()] == [(1, 1, 2, 0.5)]
    assert op.search(frame.where("false"), frame).collect() == []
    assert op.search(frame, frame.where("false")).collect() == []
    assert op.search(frame.where("vec_id = 1"), frame.where("vec_id = 1")).collect() == []


def test_recall_over_many_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 100)
    monkeypatch.setattr(op, "QUERY_ROWS", 10)
    random = np.random.default_rng(2)
    centres = random.standard_normal((12, 16))
    vectors = centres[random.integers(0, 12, 1500)] + 0.6 * random.standard_normal((1500, 16))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in op.search(frame, frame.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for key in range(0, 1500, 20):
        score = vectors @ vectors[key]
        score[key] = -np.inf
        hits += len(got[key] & set(np.argsort(-score)[:20].tolist()))
        assert len(got[key]) == 20
    assert hits >= 0.9 * 20 * 75


def test_parts_are_balanced():
    random = np.random.default_rng(3)
    vectors = random.standard_normal((640, 8))
    label = op.balanced_parts(vectors, op.nearest(vectors, vectors, 8), 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 88 and sizes.min() > 0

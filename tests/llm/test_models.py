"""Held-out accuracy of the classifiers, and the pipeline as a whole."""

from pyspark.sql import functions as F

from siltstone.llm import registry

SF = "/root/testdata/sf0.01"


def accuracy(spark, name, label):
    got = registry.QUERIES[name](spark, SF)
    y = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.filter("score < 0 or score > 1 or score is null or (score >= 0.5) <> (predicted = 1)").count() == 0
    held = got.filter("held_out").join(y, "doc_id")
    return held.agg(F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]


def test_quality(spark):
    assert accuracy(spark, "op4_quality_qda", "quality") > 0.97


def test_toxicity(spark):
    assert accuracy(spark, "op10_toxicity_weak", "toxic") > 0.93


def test_label_model_trusts_what_agrees():
    import numpy as np

    from siltstone.llm.toxicity import features, label_model, linear_model

    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    good = np.where(y, rng.random(3000) < 0.8, rng.random(3000) < 0.01)
    votes = np.column_stack([good, good, np.where(y, rng.random(3000) < 0.6, rng.random(3000) < 0.02), rng.random(3000) < 0.1])
    start = np.array([[0.05] * 4, [0.3] * 4])
    r, rates, rho = label_model(votes, start, 0.2, y.astype(int))
    assert rho[0, 1] > 0.8 and rates[1, 0] > 0.6 and abs(rates[1, 3] - rates[0, 3]) < 0.1
    assert ((r > 0.5) == y).mean() > 0.95
    x = features(votes, votes.sum(1), np.full(3000, 50))
    w = linear_model(x, r)
    assert (((x @ w) > 0) == y).mean() > 0.9


def test_quality_scores_against_a_plain_computation(spark):
    """Every document's score, from means, covariances and inverse matrices worked out one text at a time."""
    import math
    import zlib

    import numpy as np

    from siltstone.llm.quality import statistics

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    x = {i: np.array(statistics(t)) for i, t in texts.items()}
    of = {y: np.array([x[i] for i, v in labels.items() if v == y and i in x]) for y in (0, 1)}
    n = {y: len(v) for y, v in of.items()}
    mean = {y: v.mean(axis=0) for y, v in of.items()}
    cov = {y: sum(np.outer(r - mean[y], r - mean[y]) for r in v) / n[y] for y, v in of.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    dims = len(scale)
    model = {}
    for y in (0, 1):
        c = (0.95 * cov[y] + 0.05 * pooled) / np.outer(scale, scale)
        c = 0.98 * c + 0.02 * max(1e-3, np.trace(c) / dims) * np.eye(dims)
        model[y] = mean[y] / scale, np.linalg.inv(c), -0.5 * math.log(np.linalg.det(c)) + math.log((n[y] + 1) / (n[0] + n[1] + 2))
    got = {r.doc_id: r.score for r in registry.QUERIES["op4_quality_qda"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, v in x.items():
        log = [b - 0.5 * (v / scale - m) @ inverse @ (v / scale - m) for m, inverse, b in (model[0], model[1])]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, (log[1] - log[0]) / (dims / 4)))))) < 1e-6


def test_label_model_against_plain_loops():
    """One text and one voter at a time."""
    import math

    import numpy as np

    from siltstone.llm.toxicity import label_model

    rng = np.random.default_rng(6)
    y = (rng.random(60) < 0.3).astype(int)
    votes = np.column_stack([rng.random(60) < np.where(y, 0.7, 0.1) for _ in range(4)])
    votes[:, 1] = votes[:, 0]
    start, prior, trust, strength = np.array([[0.1, 0.1, 0.2, 0.1], [0.6, 0.5, 0.6, 0.7]]), 0.3, 0.97, 50.0
    got, rates, rho = label_model(votes, start, prior, y, trust, 5, strength)
    n, k = votes.shape
    q, c = [list(r) for r in start], [[0.0] * k for _ in range(k)]
    for _ in range(5):
        r = []
        for i in range(n):
            cast = [j for j in range(k) if votes[i, j]]
            together = 1 + sum(c[a][b] for a in cast for b in cast) / max(1, len(cast))
            log = math.log(prior / (1 - prior)) + (1 if y[i] == 1 else -1) * math.log(trust / (1 - trust))
            log += sum(math.log(q[1][j] / q[0][j]) for j in cast) / together
            log += sum(math.log((1 - q[1][j]) / (1 - q[0][j])) / (1 + sum(c[j])) for j in range(k) if j not in cast)
            r.append(1 / (1 + math.exp(-log)))
        new = [[0.0] * k for _ in range(k)]
        for t in (0, 1):
            w = [x if t else 1 - x for x in r]
            total = sum(w)
            q[t] = [(sum(w[i] for i in range(n) if votes[i, j]) + strength * start[t, j]) / (total + strength) for j in range(k)]
            for a in range(k):
                for b in range(k):
                    cov = sum(w[i] * (votes[i, a] - q[t][a]) * (votes[i, b] - q[t][b]) for i in range(n)) / (total + strength)
                    sd = [math.sqrt(q[t][j] * (1 - q[t][j])) + 1e-9 for j in (a, b)]
                    new[a][b] = max(new[a][b], min(1.0, max(0.0, cov / (sd[0] * sd[1]))))
        c = [[new[a][b] if a != b and new[a][b] > 0.1 else 0.0 for b in range(k)] for a in range(k)]
    assert np.allclose(got, r, atol=1e-9) and np.allclose(rates, q, atol=1e-9) and np.allclose(rho, c, atol=1e-9) and rho[0, 1] > 0.1


def test_pipeline_runs_end_to_end(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).select("doc_id", "length").collect()
    kept = {r.doc_id for r in out}
    q = {r.doc_id: r.predicted for r in registry.QUERIES["op4_quality_qda"](spark, sf).collect()}
    hit = {r.doc_id for r in registry.QUERIES["op2_decontaminate"](spark, sf).filter("contaminated").collect()}
    assert kept and all(q[i] == 1 for i in kept) and not kept & hit


def test_marks_against_plain_counts(spark):
    """Words and beginnings that are told from toxic texts, counted one text at a time; short words vote too."""
    import math

    from siltstone.llm.toxicity import choose_marks, evidence

    texts = [(f"you vile zap {'vilest' if i % 2 else 'plain'} text {i}", 1) for i in range(30)] + [(f"a plain text {i} you {'vile' if i == 3 else 'kind'} zap{i}", 0) for i in range(70)]
    from siltstone.llm.toxicity import _COUNTS_DDL, _count

    rows = spark.createDataFrame([*texts, (None, 0)], "text string, label long").repartition(3)
    rows = rows.selectExpr("coalesce(text, '') as text", "label")
    counts = rows.mapInArrow(_count, _COUNTS_DDL).groupBy("mark").agg({"toxic": "sum", "clean": "sum"}).selectExpr("mark", "`sum(toxic)` as toxic", "`sum(clean)` as clean")
    got = {bytes(r.mark): r.weight for r in evidence(counts, 30, 71, 3.0).collect()}

    def marks(text):
        words = text.lower().split()
        return {w + "$" for w in words} | {w[:k] for w in words for k in range(4, min(9, len(w)) + 1)}

    want = {}
    for m in {m for t, _ in texts for m in marks(t)}:
        n, c = (sum(m in marks(t) for t, y in texts if y == label) for label in (1, 0))
        sure = (n - 2 * math.sqrt(n)) / 31 / ((c + 2 * math.sqrt(c) + 3) / 72)
        if sure >= 3:
            want[m.encode()] = n * math.log(sure)
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)
    assert b"zap$" in got and choose_marks(got, 1) == [b"zap$"] and not any(m.startswith(b"vile") and m != b"vile" for m in choose_marks(got, 99))

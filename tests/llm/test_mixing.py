"""The mix over thinned and unlisted domains."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import entries, source_mixing


def mixed_of(spark, thin):
    """Documents of sf0.01 and their mix; of languages but English, one document in `thin` stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where((F.col("lang") == "en") | (F.col("doc_id") % thin == 0))
    return docs, source_mixing.mixed(docs, docs.select("text", F.col("lang").alias("domain")).where("doc_id % 2 = 0"), source_mixing.WEIGHTS)


def test_mix_leaves_no_thin_domain_out(spark):
    """At one in 25, German has nine words, and the fit leaves some texts at a rate of 0; they stay as rows."""
    for thin, zeros in ((10, False), (25, True)):
        docs, out = mixed_of(spark, thin)
        rows = out.collect()
        assert len(rows) == docs.count()
        assert all((r["rate"] >= 1 and r["copies"] >= 1) or (zeros and r["rate"] == r["copies"] == 0) for r in rows if r["n_tokens"] > 0)


def test_mix_gives_unlisted_domains_their_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.when(F.col("lang") == "es", "it").otherwise(F.col("lang")))
    rows = source_mixing.mixed(docs, docs.select("text", F.col("lang").alias("domain")), source_mixing.WEIGHTS).collect()
    assert len(rows) == docs.count()
    assert min(r["copies"] for r in rows if r["n_tokens"] > 0) >= 1
    n = {d: sum(r["n_tokens"] for r in rows if r["domain"] == d) for d in ("it", "en", "fr", "de")}
    t = {d: sum(r["rate"] * r["n_tokens"] for r in rows if r["domain"] == d) for d in n}
    assert t["it"] / sum(t.values()) == pytest.approx(n["it"] / sum(n.values()), abs=0.03)
    assert t["en"] / t["fr"] == pytest.approx(0.55 / 0.16, rel=0.15)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with x >= 0 by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(1000):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if slope.max() <= 1e-10 * np.abs(a.T @ b).max():
            return x
        free[slope.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            low = free & (z <= 0)
            x = x + (x[low] / np.maximum(x[low] - z[low], 1e-300)).min() * (z - x)
            free &= x > 1e-14
    raise AssertionError("not settled")


@pytest.mark.parametrize("case", ["an unwanted domain", "less than at hand", "targets that no rates meet"])
def test_rates_where_the_projection_holds_match_nnls(spark, case):
    """The least loss and what the domains get are those of a nonnegative least squares solver, with rates at 0."""
    rng = np.random.default_rng(4)
    sure = rng.dirichlet([0.2, 0.2, 0.2], 60)
    p = np.vstack([sure, np.eye(3)[rng.integers(0, 3, 20)]]) if case != "targets that no rates meet" else 0.5 * rng.dirichlet([1, 1, 1], 60) + np.array([0.5, 0, 0])
    t = rng.integers(1, 400, len(p)).astype(float)
    weights = {"an unwanted domain": {"a": 0.7, "b": 0.3, "c": 0.0}, "less than at hand": {"a": 0.9, "b": 0.1}, "targets that no rates meet": {"a": 0.05, "b": 0.6, "c": 0.35}}[case]
    total = 0.4 * t.sum() if case == "less than at hand" else None
    df = spark.createDataFrame([(int(n), q.tolist()) for n, q in zip(t, p, strict=True)], "n_tokens long, p array<double>").repartition(3)
    steps, got = source_mixing.fit(df, ["a", "b", "c"], weights, total, settled=1e-6)
    rates = df.select("n_tokens", "p", source_mixing.folded(F.col("p"), steps).alias("r")).collect()
    have = t @ p
    target = np.array([got[k][1] for k in "abc"])
    best = nnls((p * t[:, None]).T / np.sqrt(have)[:, None], target / np.sqrt(have))
    loss = lambda s: float(((s - target) ** 2 / have).sum())
    want = (best * t) @ p
    now = sum(np.array(r["p"]) * r["r"] * r["n_tokens"] for r in rates)
    assert np.allclose(now, [got[k][0] for k in "abc"], rtol=1e-6) and min(r["r"] for r in rates) == 0.0
    assert loss(now) <= loss(want) + 1e-3 * loss(have) and np.allclose(now, want, atol=0.02 * target.sum())


def test_unsettled_rates_raise(spark):
    df = spark.createDataFrame([(100, [0.9, 0.1]), (50, [0.2, 0.8])], "n_tokens long, p array<double>")
    with pytest.raises(RuntimeError, match="not settled after 2 rounds"):
        source_mixing.fit(df, ["a", "b"], {"a": 0.1, "b": 0.9}, rounds=2, tolerance=1e-9)


def test_the_query_takes_low_quality_to_nothing(spark):
    rows = entries.op3_source_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    zero = [r for r in rows if r["rate"] == 0 and r["n_tokens"] > 0]
    assert len(zero) > 20 and all(r["domain"] == "low" and r["copies"] == 0 for r in zero)
    got = {d: sum(r["rate"] * r["n_tokens"] * r["p"][d] for r in rows) for d in source_mixing.WEIGHTS}
    assert all(got[d] / sum(got.values()) == pytest.approx(w, abs=0.02) for d, w in source_mixing.WEIGHTS.items())

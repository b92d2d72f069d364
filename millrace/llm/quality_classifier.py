"""Quality classifier: a weak-label model over overlapping heuristic labellers, whose posterior labels train a hashed linear scorer.

Labellers vote or abstain; EM over the counts of vote patterns of all rows estimates their accuracies. Posteriors of a bounded training set (at most
MOST_TRAINED rows, those first by digest of their text) are the soft labels of a logistic regression on hashed byte triples. The scorer sees the
text alone, so it also scores what all labellers abstain on. Weights are of fixed size.

Cases: a null text counts as empty; it is scored by the model's bias and the labellers' votes on an empty text. Repeated rows each get their score; a
null doc_id is returned as null. Of rows with equal digests one is trained on. An empty table gives an empty result. Extra
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import quality_rules, shared, weak_labels

DIMENSIONS, MOST_TRAINED = 1 << 12, 2000
COUNTS = quality_rules.COUNTS


def labellers(f: str) -> dict[str, Column]:
    """Votes over the counts in the struct column f: 1 good, 0 bad, null abstains. They overlap: several look at one kind of fault at other
    strengths."""
    c = {k: F.col(f"`{f}`.{k}") for k in COUNTS}
    n, chars, lines = c["n_words"], c["word_chars"], c["n_lines"]
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).cast("int")
    return {
        "many_symbols": vote(5 * c["n_symbols"] > n, 100 * c["n_symbols"] <= n),
        "some_symbols": vote(20 * c["n_symbols"] > n, c["n_symbols"] == 0),
        "other_chars": vote(5 * c["n_other"] > chars, 10 * c["n_other"] <= chars),
        "long_words": vote(chars > 12 * n, chars <= 9 * n),
        "repeats": vote(2 * c["n_repeat_words"] > n, 10 * c["n_repeat_words"] <= n),
        "some_repeats": vote(4 * c["n_repeat_words"] > n, F.lit(False)),
        "variety": vote((n <= 1000) & (6 * c["n_distinct"] < n), 3 * c["n_distinct"] >= n),
        "same_lines": vote((lines >= 3) & (2 * c["n_dup_lines"] > lines), (lines >= 3) & (c["n_dup_lines"] == 0)),
        "capitals": vote(2 * c["n_upper"] > c["n_ascii_letters"], 5 * c["n_upper"] <= c["n_ascii_letters"]),
        "too_short": vote(n < 5, n >= 60),
        "ended_lines": vote((lines > 0) & (10 * c["n_ended_lines"] < lines), 2 * c["n_ended_lines"] >= lines),
    }


def slots(text: bytes) -> np.ndarray:
    """Hashed counts of byte triples, square-rooted, of length 1; digits count as one digit. Two more hashed features, of the text's length and of its
    variety at that length (distinct triples a byte), tell repetition, which no single triple does."""
    b = np.frombuffer(text.translate(DIGITS), np.uint8)
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(b) - 2, 1 << 20):
        x = b[at : at + (1 << 20) + 2].astype(np.int64)
        out += np.bincount((x[:-2] * 40503 + x[1:-1] * 911 + x[2:] * 31) % DIMENSIONS, minlength=DIMENSIONS)
    distinct, size = int(np.count_nonzero(out)), len(b).bit_length()
    out = np.sqrt(out)
    out /= max(float(np.linalg.norm(out)), 1e-12)
    out[(size * 7919 + 13) % DIMENSIONS] += 0.5
    out[(16 * distinct // max(len(b), 1) * 104729 + size * 7919 + 77) % DIMENSIONS] += 1.0
    return out


DIGITS = bytes.maketrans(b"123456789", b"0" * 9)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 20.0, momentum: float = 0.9, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, bias) of logistic regression on soft labels y, the rarer class weighted up (by its share to the power -0.75), by gradient descent
    with momentum."""
    w, v, bias = np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0
    if not len(x):
        return w, 0.0
    share = y / max(y.sum(), 1e-9) ** 0.75 + (1 - y) / max((1 - y).sum(), 1e-9) ** 0.75
    share = (share / share.sum()).astype(np.float32)
    for _ in range(rounds):
        g = share * (1 / (1 + np.exp(-(x @ w + bias))) - y).astype(np.float32)
        v = momentum * v - rate * (g @ x + decay * w)
        w += v
        bias -= float(g.sum())
    return w, bias


def classify(docs: DataFrame, most: int = MOST_TRAINED, threshold: float = 0.5) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the linear scorer), kept (by the score), and each labeller's vote, of every row."""
    counts = quality_rules.features()
    named = labellers("f")
    judged = docs.select("text", counts.alias("f")).select("text", *[v.alias(k) for k, v in named.items()])
    keyed = shared.written(judged.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *named), "votes")
    model = weak_labels.fit(weak_labels.pattern_counts(keyed, list(named)), len(named))
    soft = keyed.select("h", model.column([F.col(k) for k in named]).alias("posterior"))
    taken = shared.bounded_sample(docs.select("text"), soft, most).select("h", "posterior", shared.per_text(lambda t: slots(t).astype("<f2").tobytes(), "binary", pa.binary()).alias("v"))
    rows = sorted(taken.collect())
    x = np.stack([np.frombuffer(r["v"], "<f2") for r in rows]).astype(np.float32) if rows else np.zeros((0, DIMENSIONS), np.float32)
    w, bias = train(x, np.array([r["posterior"] for r in rows]))

    def score(text: bytes) -> float:
        return float(1 / (1 + np.exp(-(float(slots(text) @ w) + bias))))

    out = docs.select("doc_id", counts.alias("f"), shared.per_text(score, "double", pa.float64()).alias("score"))
    posterior = model.column(list(named.values()))
    return out.select("doc_id", posterior.alias("posterior"), "score", (F.col("score") >= threshold).alias("kept"), *[v.alias(f"vote_{k}") for k, v in named.items()])

"""The pipeline on the smallest tables, stage by stage, against plain Python."""

from __future__ import annotations

import random
import re
import shutil
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import base_counts, leaks_brute, parts_brute, prose, redacted

from millrace.llm import shared, weak_labels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, the first being documents."""
    docs = [shared.table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(shared.written(stage(spark, docs[-1], SF), name))
    return docs


def judged(texts: list[str]) -> list[bool]:
    """Votes of the rules as plain conditions, EM over their patterns, and the verdicts."""
    votes, failed = [], []
    for t in texts:
        n, chars, symbols, dup, repeat, bad = base_counts(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        ended = sum(x.rstrip(" \t\r\x0b\x0c")[-1:] in '.!?:;"\')' for x in lines)
        upper, letters = len(re.findall(r"[A-Z]", t)), len(re.findall(r"[A-Za-z]", t))
        other = len(re.findall(r"[!-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]", t))
        pick = lambda b, g: 0 if b else 1 if g else None
        votes.append((
            pick(n < 50, n >= 100), pick(2 * repeat > n, 5 * repeat <= n), pick(10 * symbols > n, 50 * symbols <= n), pick(25 * symbols > chars, False), pick(len(lines) >= 3 and 2 * dup > len(lines), len(lines) >= 3 and dup == 0),
            pick(2 * chars < 5 * n or chars > 15 * n, 3 * n <= chars <= 12 * n), pick(4 * other > chars, 8 * other <= chars), pick(2 * upper > letters, 5 * upper <= letters), pick(lines and 10 * ended < len(lines), 2 * ended >= len(lines)),
        ))
        failed.append(bad)
    model = weak_labels.fit(sorted(Counter(votes).items(), key=lambda x: [2 if v is None else v for v in x[0]]), 9)
    return [not f and model.posterior(v) >= 0.5 for v, f in zip(votes, failed, strict=True)]


def test_quality_stage(stages, rows):
    keep = judged([r[1] for r in rows])
    assert sorted(tuple(r) for r in stages[1].collect()) == [r for r, k in zip(rows, keep, strict=True) if k]
    assert 0 < sum(keep) < len(rows)


def test_near_copy_stage(stages):
    """Of each component of texts with a similarity of 0.8 or more, by all pairs, the least doc_id stays."""
    rows = sorted(tuple(r) for r in stages[1].collect())
    roots = parts_brute(rows, [(i, j) for i in range(len(rows)) for j in range(i)])
    assert sorted(tuple(r) for r in stages[2].collect()) == [r for i, r in enumerate(rows) if roots[i] == i]
    assert len(set(roots)) < len(rows)


def test_decontamination_stage(stages):
    rows = sorted(tuple(r) for r in stages[2].collect())
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    held = {d for d, _ in leaks_brute([r[:2] for r in rows], [x for x in items if x[1]])}
    assert sorted(tuple(r) for r in stages[3].collect()) == [r for r in rows if r[0] not in held]


def test_secret_stage(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    for k, r in before.items():
        text = redacted(r["text"])
        assert (after[k]["text"], after[k]["n_chars"]) == (text, len(text) if text != r["text"] else r["n_chars"])


def test_mixing_stage(stages):
    before, after = stages[4].collect(), stages[5].collect()
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    assert all(abs(r["copies"] - r["rate"]) < 1 and (r["copies"] >= 1 or r["domain"] == "low") for r in after if r["n_tokens"] > 0)
    tokens = Counter()
    for r in after:
        tokens[r["domain"]] += r["rate"] * r["n_tokens"]
    total = sum(tokens.values())
    assert np.allclose([tokens[k] / total for k in ("en", "fr", "de", "es")], [0.55, 0.16, 0.16, 0.125], atol=0.05)


def test_stages_take_nulls_empties_repeats_and_other_columns(spark, tmp_path):
    """Documents with nulls in each column, empty and very long texts, repeated rows and columns named like those that stages add."""
    small = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.lit("x") for c in ("rate", "domain", "__m", "__f", "group")})
    odd = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "  \n", "fr", None, 4), (None, "word " * 80, "de", "s", 400), (9004, prose(random.Random(1), 100_000), "en", "s", 1)]
    rows = spark.createDataFrame([(*r, *["x"] * 5) for r in odd], small.schema)
    rows.unionByName(small).unionByName(small.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    docs = shared.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, docs, str(tmp_path)), name)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert out.count() <= docs.count(), name
        docs = out
    kept = [r["doc_id"] for r in docs.collect()]
    assert 9004 in kept and not {9001, 9002, 9003} & set(kept) and len(kept) == len(set(kept))
    assert {"rate_", "domain_", "copies", "n_tokens"} <= set(docs.columns)


def test_empty_documents_give_an_empty_result(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns(stages):
    for s in stages[:5]:
        assert s.columns == ["doc_id", "text", "lang", "source", "n_chars"]

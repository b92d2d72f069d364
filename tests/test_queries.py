"""Every query of the catalogue against its SQL, on the smallest tables."""

import __spark_entry__ as entry
import numpy as np
import pytest
from oracle import connect, difference

from millrace.plans import catalogue

SF = entry.SMALL


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    assert difference(spark, db, catalogue.queries()[name], catalogue.oracle_sql()[name], SF) == ""


def test_queries_without_sql_are_known():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"kmeans_fit", "library_tokens"}


def test_kmeans_fit_has_settled(spark):
    """Another step of plain Lloyd lowers the cost by no more than one in a hundred, and clusters agree with labels better than chance."""
    x = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = catalogue.queries()["kmeans_fit"](spark, SF).collect()
    v, k = np.array([x[r["vec_id"]] for r in rows], float), np.array([r["cluster_id"] for r in rows])
    assert len(rows) == len(x) and len(set(k.tolist())) == 10
    centres = np.stack([v[k == c].mean(axis=0) for c in range(10)])
    d = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
    assert d.min(axis=1).sum() >= 0.99 * d[np.arange(len(k)), k].sum()


def test_library_tokens_are_the_librarys(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalogue.queries()["library_tokens"](spark, SF).collect():
        ids = model.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert abs(r["n_tokens"] - len(ids)) <= 2 and r["same"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

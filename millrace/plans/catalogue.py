"""All queries of the reference's operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from millrace.plans import clusters, corpus, data, loading, storage, training
from millrace.plans.book import Book, Query

BOOKS: tuple[Book, ...] = (corpus.BOOK, clusters.BOOK, training.BOOK, data.BOOK, loading.BOOK, storage.BOOK)


def queries() -> dict[str, Query]:
    return {name: f for b in BOOKS for name, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for b in BOOKS for name, text in b.sql.items()}

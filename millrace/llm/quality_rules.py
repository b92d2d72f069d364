"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior replaces all-must-pass.

Cases: a null text counts as empty (no words, so base_failed and not kept). Rows are judged one by one: repeated rows and ties each get
the same verdict, a null doc_id is returned as null. An empty table gives an empty result. Extra columns are kept by filter_documents()
and ignored by judge(). A text is read whole, one at a time.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared, weak_labels

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
HIGH = bytes(range(128, 256))
LETTER_LIKE = UPPER + LOWER + HIGH
#: Ends of a line of prose.
ENDS = b'.!?:;"\')'

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_ascii_letters", "n_other", "n_distinct")
FEATURES = pa.struct([(c, pa.int64()) for c in COUNTS])
FEATURES_SQL = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    found = Counter(windows)
    covered, end = 0, 0
    for i, x in enumerate(windows):
        if found[x] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def count(text: bytes) -> dict[str, int]:
    """The counts that rules vote on, of one whole text."""
    words = text.split()  # of bytes: at x20 and x09-x0D
    bare = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = bare.translate(None, HIGH)
    plain = len(letters) - len(letters.translate(None, UPPER + LOWER))
    return {
        "n_words": len(words),
        "word_chars": len(bare.translate(None, bytes(range(128, 192)))),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": len(lines),
        "n_ended_lines": sum(x.rstrip()[-1:] in ENDS for x in lines),
        "n_upper": len(letters) - len(letters.translate(None, UPPER)),
        "n_ascii_letters": plain,
        "n_other": len(bare.translate(None, LETTER_LIKE)),
        "n_distinct": len(set(words)),
    }


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).cast("int")


def votes(f: str) -> dict[str, Column]:
    """Each rule's vote over the counts in the struct column f: 0 bad, 1 good, null abstains. The rules overlap on purpose: some see only
    junk and abstain on all else, some see both."""
    c = {k: F.col(f"`{f}`.{k}") for k in COUNTS}
    n, chars, lines = c["n_words"], c["word_chars"], c["n_lines"]
    return {
        "length": _vote(n < 50, n >= 100),
        "repetition": _vote(2 * c["n_repeat_words"] > n, 5 * c["n_repeat_words"] <= n),
        "symbols": _vote(10 * c["n_symbols"] > n, 50 * c["n_symbols"] <= n),
        "symbol_chars": _vote(25 * c["n_symbols"] > chars, F.lit(False)),
        "dup_lines": _vote((lines >= 3) & (2 * c["n_dup_lines"] > lines), (lines >= 3) & (c["n_dup_lines"] == 0)),
        "word_length": _vote((2 * chars < 5 * n) | (chars > 15 * n), (chars >= 3 * n) & (chars <= 12 * n)),
        "letters": _vote(4 * c["n_other"] > chars, 8 * c["n_other"] <= chars),
        "capitals": _vote(2 * c["n_upper"] > c["n_ascii_letters"], 5 * c["n_upper"] <= c["n_ascii_letters"]),
        "line_ends": _vote((lines > 0) & (10 * c["n_ended_lines"] < lines), 2 * c["n_ended_lines"] >= lines),
    }


def base_failed(f: str) -> Column:
    n = F.col(f"`{f}`.n_words")
    return (n < 50) | (100 * F.col(f"`{f}`.n_repeat_words") > 50 * n)


def features(text: str | Column = "text") -> Column:
    return shared.per_text(count, FEATURES_SQL, FEATURES, text)


def fit_votes(counted: DataFrame, f: str) -> tuple[weak_labels.VoteModel, list[Column]]:
    named = votes(f)
    patterns = weak_labels.pattern_counts(counted.select(*[v.alias(k) for k, v in named.items()]), list(named))
    return weak_labels.fit(patterns, len(named)), list(named.values())


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, posterior and the votes of every row. One pass over the texts; the counts are written to the
    shared folder, as both EM and the verdicts read them."""
    counted = shared.written(docs.select("doc_id", features().alias("f")), "quality")
    model, cast = fit_votes(counted, "f")
    out = counted.select("doc_id", *[F.col(f"f.{c}").alias(c) for c in COUNTS[:5]], base_failed("f").alias("base_failed"), model.column(cast).alias("posterior"), *[v.alias(f"vote_{k}") for k, v in votes("f").items()])
    kept = ~F.col("base_failed") & (F.col("posterior") >= threshold)
    return out.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "posterior", *[f"vote_{k}" for k in votes("f")])


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that are kept. The texts are counted twice: for the pattern counts, and for the verdicts; nothing is
    shuffled but the counts of patterns."""
    f = shared.unused(docs, "__f")
    counted = docs.withColumn(f, features())
    model, cast = fit_votes(counted.select(f), f)
    return counted.where(~base_failed(f) & (model.column(cast) >= threshold)).drop(f)

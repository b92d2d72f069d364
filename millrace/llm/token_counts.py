"""Token counts through a digest cache.

Content is normalised as far as no count can change (null is empty; white space that every tokenizer file here sees as one separator is made
one space, only if the tokenizer itself does that) and digested with SHA-256; the tokenizer's file and library are digested too. Digests are
joined with stored counts; only distinct contents that are not stored are encoded, and their counts are appended to the cache.

Within the encoder, a tokenizer that puts every white space run to one space and cuts words there gives a text as many tokens as its
space-separated pieces together, so pieces seen before are not encoded again (a bounded table per task); other tokenizers encode whole texts.

Cases: a null or empty text has 0 bytes and the count that the tokenizer gives the empty text. Repeated rows and copies are encoded once and
returned as often as they come; a null doc_id is returned as null. Copies are dropped within each task before the shuffle by digest, so a
group of copies that holds a third of all rows adds one row per task; when counts are joined back, its rows are dealt over salts. An empty table gives an empty result and appends nothing. Extra columns
are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared

CACHE_SCHEMA = "content string, tokenizer string, n_tokens bigint"
#: ASCII white space, all of which \s holds.
SPACES = r"[\x20\x09-\x0D]+"
#: Pieces that one task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 200_000, 64


def library_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def collapses_spaces(path: str) -> bool:
    """Does the tokenizer's own first work on white space put each run to one space, and its cutting never join what a space parts?"""
    if library_of(path) != "tokenizers":
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    flat = lambda x, inner: [y for z in x.get(inner, [x]) for y in flat(z, inner)] if inner in x else [x]
    normal = flat(spec["normalizer"] or {}, "normalizers")
    cuts = flat(spec["pre_tokenizer"] or {}, "pretokenizers")
    runs = [n for n in normal if n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " "]
    known = {"NFC", "Replace", "Lowercase"}
    first = cuts[0] if cuts else {}
    parts = first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed"
    # The pattern's pieces hold no space: letters, one digit, what is neither space nor letter nor number, and contractions.
    plain = first.get("pattern") == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
    whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and " " not in t["content"] for t in spec["added_tokens"])
    return bool(runs) and {n.get("type") for n in normal} <= known and len(runs) == sum(n.get("type") == "Replace" for n in normal) and parts and plain and whole


def tokenizer_digest(path: str) -> str:
    """Of the file's bytes and the library's version: a new version of either asks for new counts."""
    library = library_of(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def normalised(text: Column, collapse: bool) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(t, SPACES, " ")) if collapse else t


class Counter:
    """Counts tokens of texts with the library that the file is for, without special tokens added at the ends."""

    def __init__(self, path: str, collapse: bool) -> None:
        self.collapse, self.known = collapse, {}
        if library_of(path) == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(model.encode(x, add_special_tokens=False).ids) for x in texts]

    def count(self, text: str) -> int:
        if not self.collapse:
            return self.encode([text])[0]
        known, total = self.known, 0
        # Only at ASCII white space: pieces with other spaces are left to the library.
        for piece in text.encode().split():
            n = known.get(piece)
            if n is None:
                n = self.encode([piece.decode()])[0]
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = n
            total += n
        return total


def _once(batches):
    """Rows (content, text) without those whose content this task has had."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, x in enumerate(batch.column(0)):
            d = bytes.fromhex(x.as_py())[:16]
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int32()))


def _encoded(batches, path: str, collapse: bool):
    """Counts of rows (content, text), each content once."""
    counter = Counter(path, collapse)
    for batch in _once(batches):
        counts = pa.array([counter.count(x.as_py()) for x in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), counts], names=["content", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. path: of the tokenizer's file, on the driver and the executors. cache: a folder
    that they share; None starts an empty one. Misses are appended there before the result is returned."""
    spark = docs.sparkSession
    version, collapse = tokenizer_digest(path), collapses_spaces(path)
    cache = cache or shared.new_path(spark, "token-cache")
    # An empty first part makes the folder readable on any file system.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    content = F.sha2(normalised(F.col("text"), collapse), 256)
    keyed = shared.written(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content.alias("content")), "contents")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    texts = docs.select(content.alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    # Copies go within each task, then by digest over all; what is stored goes before anything is encoded.
    lone = texts.mapInArrow(_once, "content string, text string")
    misses = lone.join(stored, "content", "left_anti") if not stored.isEmpty() else lone
    made = misses.repartition("content").mapInArrow(lambda b: _encoded(b, path, collapse), "content string, n_tokens bigint")
    made.withColumn("tokenizer", F.lit(version)).select("content", "tokenizer", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    return shared.Dealt(keyed, ["content"]).join(counts).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

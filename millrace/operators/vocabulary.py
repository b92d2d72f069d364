"""Vocabularies in order of words, and texts as their ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import ordinal
from millrace.sources import scratch

#: Words that tasks look up by themselves, the most frequent ones of at most LONG characters; all others meet their ids in a shuffle.
FREQUENT, LONG = 1 << 17, 64


def ids(docs: DataFrame, key: str, words: str, frequent: int = FREQUENT) -> DataFrame:
    """(vocab_size, key, ids): the ids of each document's words in their order, where a word's id is its place among all distinct ones. Frequent words get
    their ids where the document is, so that only rare ones are shuffled."""
    spark = docs.sparkSession
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # The order of words in two phases: buckets are their first two bytes.
    start = F.conv(F.rpad(F.hex(F.substring(F.encode("word", "utf-8"), 1, 2)), 4, "0"), 16, 10).cast("bigint")
    path = scratch.new_path(spark, "vocabulary")
    ordinal(counted.withColumn("h", start), "h", "id", ties=["word"], span=1).select("word", "id", "n").write.parquet(path)
    vocab = spark.read.schema("word string, id bigint, n bigint").parquet(path)
    size = vocab.count()
    if size >> 32:
        raise ValueError("a vocabulary holds less than 1 << 32 words")
    top = vocab.where(F.length("word") <= LONG).orderBy(F.desc("n"), "word").limit(frequent).select("word", "id").toArrow()
    known, numbers = top["word"].combine_chunks(), top["id"].combine_chunks()

    @F.arrow_udf("array<bigint>")
    def looked_up(lists: pa.Array) -> pa.Array:
        found = numbers.take(pc.index_in(lists.flatten(), value_set=known))
        sizes = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)

    coded = docs.select(key, words, looked_up(words).alias("c"))
    rare = F.filter(F.transform("c", lambda x, i: F.when(x.isNull(), F.struct(i.alias("i"), F.try_element_at(words, i + 1).alias("word")))), lambda s: s.isNotNull())
    path = scratch.new_path(spark, "coded")
    coded = coded.select(key, "c", rare.alias("rare"))
    coded.write.parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    # A word's place and id in one number, by which they sort.
    at = lambda i, x: F.shiftleft(i.cast("bigint"), 32).bitwiseOR(x)
    local = coded.select(key, F.filter(F.transform("c", lambda x, i: at(i, x)), lambda p: p.isNotNull()).alias("p"))
    met = coded.select(key, F.explode("rare").alias("r")).select(key, "r.i", "r.word").join(vocab.select("word", "id"), "word")
    parts = local.unionByName(met.select(key, F.array(at(F.col("i"), F.col("id"))).alias("p")))
    whole = parts.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    return whole.select(F.lit(size).cast("bigint").alias("vocab_size"), key, F.transform("p", lambda p: p.bitwiseAND(F.lit((1 << 32) - 1))).alias("ids"))

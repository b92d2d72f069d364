"""Sequence packing: concat-and-chunk, greedy, scan-and-pick and sorted next-fit packers, window reads, collation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators.ordering import prefix_sum, prefix_sum_wide


def concat_and_chunk(docs: DataFrame, tokens: str | Column, key: str, length: int) -> DataFrame:
    """(window_id, tokens, positions, n_docs) of the full windows of length + 1 in the token stream of all documents in the order of key. Documents
    are sent once, as they are, to meet their place in the stream (so `tokens` may be a column of what they are made from). A window within
    one document is cut from it there; of the rest, slices are shuffled, two a document at most. A document that goes on from the window before has
    its positions start at 0 again."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    laid = prefix_sum_wide(docs, key, F.size(t).cast("bigint"), "__at", "__n").select(F.col("__at").alias("at"), F.col("__n").alias("n"), t.alias("t"))
    return _chunked(laid, length + 1, True)


def chunk_positions(docs: DataFrame, n: Column, key: str, length: int) -> DataFrame:
    """(window_id, positions, n_docs) of the same windows, from the documents' numbers of tokens alone."""
    laid = prefix_sum(docs.select(key, n.cast("bigint").alias("n")), key, F.col("n"), "at").select("at", "n")
    return _chunked(laid, length + 1, False)


def _chunked(laid: DataFrame, size: int, tokens: bool) -> DataFrame:
    """Windows of rows (at, n, and t with tokens) that lie end to end."""
    end = F.col("at") + F.col("n")
    rows = laid.where("n > 0")
    # Windows first .. last - 1 lie within the row.
    first, last = F.floor((F.col("at") + size - 1) / size), F.floor(end / size)
    start = (F.col("window_id") * size - F.col("at") + 1).cast("int")
    inner = rows.where(last > first).withColumn("window_id", F.explode(F.sequence(first, last - 1)))
    inner = inner.select("window_id", *[F.slice("t", start, F.lit(size)).alias("tokens")] * tokens, A.upto(F.lit(size)).alias("positions"), F.lit(1).alias("n_docs"))
    ends = F.filter(F.array_distinct(F.array(F.floor(F.col("at") / size), F.floor((end - 1) / size))), lambda w: (w < first) | (w >= last))
    cut = rows.withColumn("window_id", F.explode(ends))
    low, high = F.greatest(F.col("window_id") * size, F.col("at")), F.least((F.col("window_id") + 1) * size, end)
    pieces = cut.select("window_id", F.col("at"), (high - low).cast("int").alias("n"), *[F.slice("t", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("t")] * tokens)
    whole = pieces.groupBy("window_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *["t"] * tokens, "n"))).alias("parts")).where(F.col("n") == size)
    joined = [F.flatten(F.transform("parts", lambda p: p["t"])).alias("tokens")] * tokens
    return inner.unionByName(whole.select("window_id", *joined, F.flatten(F.transform("parts", lambda p: A.upto(p["n"]))).alias("positions"), F.size("parts").alias("n_docs")))


def batched(windows: DataFrame, key: str, size: int) -> DataFrame:
    """Consecutive windows in batches; the last may be smaller."""
    return windows.withColumn("batch_id", F.floor(F.col(key) / size)).withColumn("row", F.col(key) % size)


#: What a shard holds: keys, lengths. A rule takes them, how many of them it held before, and whether no more will come; it gives (bins of
#: keys, what it still holds).
Held = tuple[np.ndarray, np.ndarray]
Rule = Callable[[np.ndarray, np.ndarray, int, bool], tuple[list[np.ndarray], Held]]


def _packed(df: DataFrame, shard: str, key: str, n: Column, rule: Rule) -> DataFrame:
    """(shard, key, bin, place): `rule` over each shard's rows in order. Only keys and lengths are sent, and they are handled as arrays, batch
    by batch; a task goes through its shards one after the other and holds what one shard has open. Shards are to be a share of the data, so that their
    number grows with it."""
    rows = df.select(F.col(shard).cast("bigint").alias("shard"), F.col(key).cast("bigint").alias("key"), n.cast("bigint").alias("n"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, held = None, 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            shards, keys, lengths = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(shards):
                continue
            begins = np.r_[0, np.flatnonzero(np.diff(shards)) + 1]
            for a, z in zip(begins, np.r_[begins[1:], len(shards)], strict=True):
                if shards[a] != now:
                    if now is not None:
                        yield from _rows(now, bins, rule(*held, len(held[0]), True)[0])
                    now, bins, held = shards[a], 0, (keys[:0], lengths[:0])
                out, held = rule(np.r_[held[0], keys[a:z]], np.r_[held[1], lengths[a:z]], len(held[0]), False)
                yield from _rows(now, bins, out)
                bins += len(out)
        if now is not None:
            yield from _rows(now, bins, rule(*held, len(held[0]), True)[0])

    return dealt.mapInArrow(pack, "shard bigint, key bigint, bin bigint, place bigint")


def _rows(shard: int, first: int, bins: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if bins:
        sizes = [len(b) for b in bins]
        columns = [np.full(sum(sizes), shard), np.concatenate(bins), np.repeat(np.arange(first, first + len(bins)), sizes), np.concatenate([np.arange(k) for k in sizes])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "key", "bin", "place"])


def _cuts(lengths: np.ndarray, length: int, closed: bool) -> list[int]:
    """Where bins of consecutive samples begin, by search in the running sum; closed: a full bin takes nothing more, even of no length."""
    total, at, out = np.r_[0, np.cumsum(lengths)], 0, []
    while at < len(lengths):
        out.append(at)
        end = int(np.searchsorted(total, total[at] + length, "right")) - 1
        if closed and total[end] == total[at] + length:
            end = int(np.searchsorted(total, total[at] + length, "left"))
        at = max(end, at + 1)
    return out


def greedy(df: DataFrame, shard: str, key: str, n: Column, length: int) -> DataFrame:
    """Samples in order, never split: one that does not fit opens a new bin; a bin that is exactly full is closed."""

    def rule(keys, lengths, old, last):
        cuts = _cuts(lengths, length, True)
        if last or not cuts:
            return np.split(keys, cuts[1:]) if cuts else [], (keys[:0], lengths[:0])
        return np.split(keys[: cuts[-1]], cuts[1:-1]) if len(cuts) > 1 else [], (keys[cuts[-1] :], lengths[cuts[-1] :])

    return _packed(df, shard, key, n, rule)


def _fitting(lengths: np.ndarray, room: int) -> np.ndarray:
    """Which samples one look along the buffer takes: stretch by stretch, each from the next sample that fits for as long as the running sum does."""
    taken, at = np.zeros(len(lengths), bool), 0
    while (fits := np.flatnonzero(lengths[at:] <= room)).size:
        at += int(fits[0])
        total = np.cumsum(lengths[at:])
        end = at + int(np.searchsorted(total, room, "right"))
        taken[at:end] = True
        room, at = room - int(total[end - at - 1]), end
    return taken


def scan_and_pick(df: DataFrame, shard: str, key: str, n: Column, length: int, buffer: int) -> DataFrame:
    """A buffer of samples in order of arrival. Whenever one arrives and the buffer has `buffer` or more, a bin is what a look along it takes;
    full bins leave, one after the other, until one is not full. At the end those that are not full leave too. A buffer of which nothing fits a bin is
    given up."""

    def leave(keys, lengths, partial):
        out = []
        while len(keys) and ((taken := _fitting(lengths, length)).any() and (partial or lengths[taken].sum() == length)):
            out.append(keys[taken])
            keys, lengths = keys[~taken], lengths[~taken]
        usable = bool((lengths <= length).any())
        return out, (keys, lengths) if usable else (keys[:0], lengths[:0])

    def rule(keys, lengths, old, last):
        if last:
            return leave(keys, lengths, True)
        # A look follows an arrival: first as many as fill the buffer, then one at a time.
        bins, held, at = [], (keys[:old], lengths[:old]), old
        while at < len(keys):
            end = at + max(buffer - len(held[0]), 1)
            held = np.r_[held[0], keys[at:end]], np.r_[held[1], lengths[at:end]]
            at = end
            if len(held[0]) >= buffer:
                out, held = leave(*held, False)
                bins += out
        return bins, held

    return _packed(df, shard, key, n, rule)


def sorted_next_fit(df: DataFrame, shard: str, key: str, n: Column, length: int, buffer: int) -> DataFrame:
    """Each full buffer is sorted by length, longest first (then by arrival), and cut to bins in that order; what is longer than a bin is dropped."""

    def rule(keys, lengths, old, last):
        bins, whole = [], len(keys) if last else len(keys) // buffer * buffer
        for at in range(0, whole, buffer):
            k, m = keys[at : min(at + buffer, whole)], lengths[at : min(at + buffer, whole)]
            order = np.argsort(-m, kind="stable")
            order = order[m[order] <= length]
            if len(order):
                bins += np.split(k[order], _cuts(m[order], length, False)[1:])
        return bins, (keys[whole:], lengths[whole:])

    return _packed(df, shard, key, n, rule)


def filled(samples: DataFrame, bins: DataFrame, length: int, pad: Column, ignore: Column) -> DataFrame:
    """Bins as sequences: (shard, bin, inputs, labels, positions), padded to length with pad, `ignore` and positions from 0. samples: (shard,
    key, inputs, labels)."""
    parts = bins.join(samples, ["shard", "key"]).groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("place", "inputs", "labels"))).alias("p"))
    n = F.aggregate("p", F.lit(0), lambda s, x: s + F.size(x["inputs"]))
    joined = lambda c: F.flatten(F.transform("p", lambda x: x[c]))
    spare = F.greatest(F.lit(length) - n, F.lit(0))
    positions = F.concat(F.flatten(F.transform("p", lambda x: A.upto(F.size(x["inputs"])))), A.upto(spare))
    return parts.select("shard", "bin", F.concat(joined("inputs"), F.array_repeat(pad, spare)).alias("inputs"), F.concat(joined("labels"), F.array_repeat(ignore, spare)).alias("labels"), positions.alias("positions"), F.size("p").alias("n_samples"))


#: Tokens in one block of a cluster's stream, by which reads find the documents that they overlap.
BLOCK = 4096


def window_reads(docs: DataFrame, key: str, tokens: str, draws: DataFrame, length: int, empty: Column, block: int = BLOCK) -> DataFrame:
    """draws (cluster_id, offset, ...) with the window of length + 1 tokens at offset of their cluster's token stream, around its end; a cluster with
    fewer tokens is tiled from its start whatever the offset; one without tokens reads as `empty`. docs: (cluster_id, key, tokens), whose order of key makes
    the stream. A stream is never in one row: documents and reads are cut to blocks, and meet by cluster and block. Both are shuffled: reads that are
    exploded from few rows look small to the planner, which would send them all through the driver as a broadcast. What is broadcast is one number per cluster."""
    size, id_ = length + 1, "__draw"
    laid = prefix_sum(docs.select("cluster_id", key, F.col(tokens).alias("t")).where(F.size(tokens) > 0), key, F.size("t").cast("bigint"), "at", by=["cluster_id"])
    total = laid.groupBy("cluster_id").agg(F.max(F.col("at") + F.size("t")).alias("total"))
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.size("t") - 1) / block))))
    low = F.greatest(F.col("block") * block, F.col("at"))
    high = F.least((F.col("block") + 1) * block, F.col("at") + F.size("t"))
    pieces = pieces.select("cluster_id", "block", low.alias("low"), high.alias("high"), F.slice("t", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("t"))
    numbered = draws.withColumn(id_, F.struct(*draws.columns)).join(F.broadcast(total), "cluster_id", "left")
    start = F.when(F.col("total") >= size, F.pmod(F.col("offset"), F.col("total"))).otherwise(F.lit(0).cast("bigint"))
    # Turns around the stream: the part of the window in turn k is [k * total, (k + 1) * total).
    turns = F.sequence(F.lit(0).cast("bigint"), F.floor((start + size - 1) / F.col("total")))
    parts = numbered.where(F.col("total") > 0).select("cluster_id", id_, "total", start.alias("start"), F.explode(turns).alias("turn"))
    first = F.greatest(F.col("start"), F.col("turn") * F.col("total"))
    last = F.least(F.col("start") + size, (F.col("turn") + 1) * F.col("total"))
    parts = parts.select("cluster_id", id_, (first - F.col("start")).alias("place"), (first - F.col("turn") * F.col("total")).alias("a"), (last - F.col("turn") * F.col("total")).alias("b"))
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    met = parts.hint("merge").join(pieces.hint("merge"), ["cluster_id", "block"]).where((F.col("low") < F.col("b")) & (F.col("high") > F.col("a")))
    x, y = F.greatest("low", "a"), F.least("high", "b")
    cut = met.select(id_, (F.col("place") + x - F.col("a")).alias("place"), F.slice("t", (x - F.col("low") + 1).cast("int"), (y - x).cast("int")).alias("t"))
    read = cut.groupBy(id_).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda p: p["t"])).alias("window"))
    whole = draws.withColumn(id_, F.struct(*draws.columns)).hint("merge").join(read.hint("merge"), id_, "left")
    return whole.withColumn("window", F.coalesce("window", F.array_repeat(empty, size))).drop(id_)


def collated(batch: DataFrame, by: list[str], order: str, inputs: str, labels: str, length: int, rows: int, pad: Column, ignore: Column) -> DataFrame:
    """Batches of exactly `rows` rows of length + 1: sequences are padded or clipped, missing rows are filler; then the last input and the
    first label go."""
    size = length + 1
    have = batch.select(*by, F.col(order).alias("row"), A.fitted(F.col(inputs), size, pad).alias("i"), A.fitted(F.col(labels), size, ignore).alias("l"))
    n = have.groupBy(*by).agg(F.max("row").alias("m"))
    filler = n.where(F.col("m") < rows - 1).select(*by, F.explode(F.sequence(F.col("m") + 1, F.lit(rows - 1).cast("bigint"))).alias("row"))
    filler = filler.select(*by, "row", F.array_repeat(pad, size).alias("i"), F.array_repeat(ignore, size).alias("l"))
    return have.unionByName(filler).select(*by, "row", F.slice("i", 1, length).alias("inputs"), F.slice("l", 2, length).alias("labels"))

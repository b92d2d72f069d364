"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then exact weighted-shingle similarity.

Words are runs of letters and digits of the lower-cased text; shingles are five words (an item with fewer words is one shingle). A window has as
many shingles as the item it is compared with, or is the whole document if that is shorter. Its 64-bit SimHash is the majority of its shingles'
hashes, repeats included, from running sums of bits along the text. Fingerprints are cut into BLOCKS blocks; if two are within RADIUS bits,
some block differs in at most RADIUS // BLOCKS bits, so looking up every block in an index that holds each item's block with all its
changes of so few bits finds all items within the radius. What the blocks find, and nothing else, is a candidate; its exact similarity decides:
shingles are weighted with their number, and the sum of the lesser weights is divided by the sum of the greater ones.

A window without a shingle of any item has similarity 0 with all, so windows without one of an item of their size are not hashed; which item a
shingle is of plays no part. At a similarity of 0.8 two fingerprints differ in about 10 bits (standard deviation 3), so a radius of 19 misses
fewer than 1 in 1,000 there, and none that are closer to equal.

Items are read in blocks of a bounded number, one pass over the documents for each block: the driver holds one block's index at a time, and where
there are several blocks, each pass is written to the shared folder before the next begins.

Cases: a null or wordless text, or item, matches nothing. Repeated rows each get their result; a null doc_id is returned as null. Of windows with
the same similarity the one with fewer differing bits, then the first, is given. Items with the same text each get their rows. Empty tables
give an empty result. Extra columns are ignored by leaks() and kept by filter_documents(). Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared

SHINGLE, LEAST, RADIUS, BLOCKS = 5, 0.8, 19, 5
#: Items in one block, and bytes of their texts; an item alone may be longer.
MOST_ITEMS, MOST_BYTES = 2000, 8 << 20
SEED = 7
#: What parts words: all of ASCII but letters and digits.
PARTS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(PARTS).split()


def cuts() -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    ends = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words."""
    joined = b" ".join(words)
    starts = list(accumulate([len(w) + 1 for w in words], initial=0))
    return np.array([xxhash.xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[size:], strict=False)], np.uint64)


def simhashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all windows of n consecutive hashes, from running sums of each bit."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(2 * (sums[n:] - sums[:-n]) > n, axis=1, bitorder="little").view("<u8").ravel()


class _Class:
    """The items of one size (words in a shingle, shingles), and the blocks of their fingerprints."""

    def __init__(self, items: list[int], prints: list[int]) -> None:
        self.items, self.prints = np.array(items), np.array(prints, np.uint64)
        # (block, value) -> items whose block is so few bits from that value.
        keys, of = [], []
        for b, (low, width) in enumerate(cuts()):
            own = (self.prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
            keys.append((np.uint64(b << 16) | (own[:, None] ^ CHANGES[width][None, :])).ravel())
            of.append(np.repeat(np.arange(len(own)), len(CHANGES[width])))
        keys, of = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order].astype(np.uint32), of[order].astype(np.int32)

    def within(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, item, differing bits) of all items within RADIUS of the windows' fingerprints, found by blocks."""
        found = []
        for b, (low, width) in enumerate(cuts()):
            keys = (np.uint64(b << 16) | ((prints >> np.uint64(low)) & np.uint64((1 << width) - 1))).astype(np.uint32)
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            at = self.of[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            near = np.bitwise_count(prints[window] ^ self.prints[at]) <= RADIUS
            found.append(window[near] * len(self.prints) + at[near])
        pairs = np.unique(np.concatenate(found))
        window, at = pairs // len(self.prints), pairs % len(self.prints)
        differ = np.bitwise_count(prints[window] ^ self.prints[at])
        return list(zip(window.tolist(), self.items[at].tolist(), differ.tolist(), strict=True))


#: All changes of so few bits, by a block's width.
CHANGES = {w: np.array([sum(1 << j for j in c) for few in range(RADIUS // BLOCKS + 1) for c in combinations(range(w), few)], np.uint64) for w in {width for _, width in cuts()}}


class Index:
    """The items of one block: their words and shingles, and a class for each size."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids, self.count, self.shingles = [], [], []
        self.words: dict[bytes, int] = {}
        by_size: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        #: Sizes of the items that have a shingle, by its words, for each shingle size.
        holders: dict[int, dict[tuple, set[int]]] = {}
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            k = min(SHINGLE, len(w))
            n = len(w) - k + 1
            numbers = [self.words.setdefault(x, len(self.words) + 1) for x in w]
            shingles = Counter(tuple(numbers[i : i + k]) for i in range(n))
            own = by_size.setdefault((k, n), ([], []))
            own[0].append(len(self.ids))
            own[1].append(int(simhashes(hashes(w, k), n)[0]))
            self.ids.append(item_id)
            self.count.append(n)
            self.shingles.append(shingles)
            for x in shingles:
                holders.setdefault(k, {}).setdefault(x, set()).add(n)
        self.classes = {size: _Class(*own) for size, own in by_size.items()}
        self.holders = {k: {x: tuple(sorted(n)) for x, n in d.items()} for k, d in holders.items()}
        self.codes = {k: np.unique([self.code(np.array(x, np.uint64)) for x in d]) for k, d in holders.items()}

    @staticmethod
    def code(numbers: np.ndarray) -> np.ndarray:
        """One number for a run of word numbers (the last axis)."""
        out = np.zeros((1, *numbers.shape[:-1]), np.uint64)
        for j in range(numbers.shape[-1]):
            out = (out ^ numbers[..., j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out[0]

    def search(self, text: bytes) -> list[dict]:
        """The best window of each item that the text holds."""
        w = words_of(text)
        if not w or not self.ids:
            return []
        known = self.words
        numbers = np.fromiter(map(known.get, w, repeat(0)), np.uint64, len(w))
        best: dict[int, tuple] = {}
        for k, holders in self.holders.items():
            if len(w) < k:
                continue
            # Runs of k words that items have, then those that are shingles of items.
            run = np.cumsum(numbers > 0)
            run = np.flatnonzero(run[k - 1 :] - np.r_[0, run[:-k]] == k)
            if not len(run):
                continue
            code = self.code(numbers[run[:, None] + np.arange(k)])
            held = self.codes[k]
            places = run[held[np.minimum(np.searchsorted(held, code), len(held) - 1)] == code]
            at: dict[int, list[int]] = {}
            for p in places.tolist():
                for n in holders.get(tuple(numbers[p : p + k].tolist()), ()):
                    at.setdefault(n, []).append(p)
            whole = len(w) - k + 1
            for n, hits in at.items():
                m = min(n, whole)
                if m < LEAST * n:
                    continue  # the document is too short for items of that size
                # Windows that hold a hit, as stretches of starts.
                hit = np.array(hits)
                lo, hi = np.maximum(hit - m + 1, 0), np.minimum(hit, whole - m)
                cut = np.flatnonzero(lo[1:] > hi[:-1] + 1) + 1
                for a, b in zip(lo[np.r_[0, cut]], hi[np.r_[cut - 1, len(hi) - 1]], strict=True):
                    self._stretch(w, numbers, k, m, int(a), int(b), self.classes[k, n], best)
        return [
            {"item_id": self.ids[i], "start_word": s, "n_words": n + k - 1, "differing_bits": d, "similarity": sim}
            for i, (sim, d, s, k, n) in sorted(best.items(), key=lambda x: self.ids[x[0]])
        ]

    def _stretch(self, w, numbers, k, n, first, last, items: _Class, best) -> None:
        """Compares the windows of n shingles that start from first to last with the items that the blocks find."""
        for low in range(first, last + 1, 4096):
            end = min(low + 4095, last)
            prints = simhashes(hashes(w[low : end + n + k - 1], k), n)
            held, mine = -1, Counter()
            for window, i, differ in items.within(prints):
                if window != held:
                    held, s = window, low + window
                    mine = Counter(map(tuple, numbers[np.arange(s, s + n)[:, None] + np.arange(k)].tolist()))
                both = sum(min(c, mine[x]) for x, c in self.shingles[i].items() if x in mine)
                sim = both / (n + self.count[i] - both)
                if sim >= LEAST and (i not in best or (-sim, differ, s) < (-best[i][0], best[i][1], best[i][2])):
                    best[i] = (sim, differ, s, k, n)


FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("differing_bits", pa.int64()), ("similarity", pa.float64())]))
FOUND_SQL = "array<struct<item_id:bigint,start_word:bigint,n_words:bigint,differing_bits:bigint,similarity:double>>"


def blocks_of(benchmark: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES):
    """(items, whether there is one block only), block by block, each of bounded size: the table is counted first and dealt by a digest of its rows."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, -(-2 * size["n"] // most_items) if size["n"] > most_items else 1, -(-2 * size["b"] // most_bytes) if size["b"] > most_bytes else 1)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"].encode()) for r in part.collect()], n == 1


def found(index: Index, text: str | Column = "text") -> Column:
    """array of struct: the items that a text holds."""
    return shared.per_text(index.search, FOUND_SQL, FOUND, text)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, differing_bits, similarity of each benchmark item that a document holds."""
    out = None
    for items, only in blocks_of(benchmark):
        part = docs.select("doc_id", F.explode(found(Index(items))).alias("x")).select("doc_id", "x.*")
        part = part if only else shared.written(part, "leaks")
        out = part if out is None else out.unionAll(part)
    return out


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    for items, only in blocks_of(benchmark):
        docs = docs.where(F.size(found(Index(items))) == 0)
        docs = docs if only else shared.written(docs, "clean")
    return docs

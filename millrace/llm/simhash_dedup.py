"""SimHash near-dedup: 64-bit fingerprints of word shingles, links at a small Hamming distance found by pigeonring filtering, components.

Pigeonring: cut a fingerprint into m = radius + 1 segments on a ring. If two fingerprints differ in at most `radius` bits, then from some
segment on every chain of l consecutive segments differs in at most l * radius / m bits. So the first segment of that chain is equal, and
the first two differ in one bit at most. That gives the join key (start, first segment, second segment), with the second segment's one-bit
changes on the probing side; longer chains prune candidates, and the chain of all m segments is the full Hamming check.

near_copies() links fingerprints. filter_documents() links texts whose sets of shingles have a similarity of `similarity` or more: fingerprints
within the radius and texts that share a MinHash band and agree in enough places of a sketch are candidates, and the exact similarity of the sets
decides. Candidates are joined to groups first, so that a text is sent once to where it is compared, whatever the number of its partners.

Cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle make one shingle. Rows with the
same words have one fingerprint, of which one row takes part in the search, so groups of copies of any size cost nothing. A null doc_id gets the
component of its fingerprint; it is never a component's name unless the component has no other. An empty table gives an empty result.
Repeated rows are returned as often as they come; filter_documents() keeps one of them. Extra columns are ignored or, in
filter_documents(), kept.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shared

SEED = 42
BITS = 64
#: MinHash: permutations, of which BANDS times ROWS make bands, and places (of one byte) in which the sketches of candidates agree at least. Of
#: pairs at a similarity of 0.8, 99.8 in 100 share a band, and 99.7 in 100 agree in 90 places (102 on average, deviation 4.5).
HASHES, BANDS, ROWS, PLACES = 128, 12, 4, 90
#: Rows that a task holds of one group; rows and bytes where it holds their texts; hubs of a group that has more; and rows of a group that are looked
#: through one by one.
MOST, MOST_TEXTS, MOST_BYTES, HUBS, DENSE = 8192, 1024, 64 << 20, 16, 48
PERMUTATIONS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes (uint64), as a signed integer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of `size` words, space-joined, repeats included; fewer words: of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = list(accumulate([len(w) + 1 for w in words], initial=0))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[size:], strict=False)], np.uint64)


def fingerprint(text: bytes, size: int = 4) -> int:
    words = text.lower().split()  # of bytes: only A-Z, only at x20 and x09-x0D
    return majority(shingle_hashes(words, size)) if words else 0


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (signed 64 bits) of every row."""
    return docs.select("doc_id", shared.per_text(lambda t: fingerprint(t, size), "bigint", pa.int64()).alias("fp"))


def segments(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of radius + 1 segments."""
    m = radius + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def viable(diff: np.ndarray, start: int, radius: int) -> np.ndarray:
    """Of XORed fingerprints: does every chain of segments from `start` on keep to its budget? The last chain is the whole fingerprint."""
    parts = segments(radius)
    m, total, ok = len(parts), np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    for length in range(1, m + 1):
        low, width = parts[(start + length - 1) % m]
        total += np.bitwise_count((diff >> np.uint64(low)) & np.uint64((1 << width) - 1))
        ok &= total <= length * radius // m
    return ok


def key_bits(radius: int) -> int:
    """Bits of a key below the start segment's number."""
    return 2 * max(width for _, width in segments(radius))


def _keyed(reps: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, fp) to look up, and rows (key, fp) that look up. A pair that differs in one bit of the second segment is met from
    the side on which that bit is 0."""
    parts = segments(radius)
    field = lambda low, width: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
    index, probes = [], []
    for i, (a, first) in enumerate(parts):
        b, second = parts[(i + 1) % len(parts)]
        key = F.lit(i << key_bits(radius)) + F.shiftleft(field(a, first), second) + field(b, second)
        index.append(key)
        probes += [key] + [F.when(F.shiftrightunsigned("fp", b + j).bitwiseAND(F.lit(1)) == 0, key + F.lit(1 << j)) for j in range(second)]
    exploded = lambda keys: reps.select("fp", F.explode(F.array(*keys)).alias("key")).where(F.col("key").isNotNull())
    return exploded(index), exploded(probes)


def _matches(batches, radius: int, dense: int = DENSE):
    """Links (a, b) from rows (key, salt, probing, fp) sorted by these. Small groups give each of their links; in a group with over `dense`
    rows to look up, links that would join what this group has joined already are left out, so that it gives fewer links than it has rows."""
    shift, last, group = key_bits(radius), None, None
    held = np.zeros(0, np.uint64)
    for batch in batches:
        key, salt, probing, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        fp = fp.view(np.uint64)
        if not len(key):
            continue
        begins = np.r_[0, np.flatnonzero((np.diff(key) != 0) | (np.diff(salt) != 0)) + 1]
        ends = np.r_[begins[1:], len(key)]
        sizes = ends - begins
        looked = np.add.reduceat(1 - probing, begins)  # rows to look up, by group; they come first
        out: list[np.ndarray] = []
        # The first group may go on from the batch before, the last one into the next; those and the dense ones go one by one.
        alone = looked > dense
        alone[0] = alone[-1] = True
        asks = np.flatnonzero((probing == 1) & np.repeat(~alone & (looked > 0), sizes))
        if len(asks):
            of = np.repeat(np.arange(len(begins)), sizes)[asks]
            n = looked[of]
            x = np.repeat(fp[asks], n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            y, k = fp[np.repeat(begins[of], n) + within], np.repeat(key[asks] >> shift, n)
            for start in np.unique(k[x != y]):
                ok = (k == start) & (x != y)
                near = viable(x[ok] ^ y[ok], int(start), radius)
                out.append(np.stack([x[ok][near], y[ok][near]]))
        for g in np.flatnonzero(alone):
            this = (key[begins[g]], salt[begins[g]])
            if this != last:
                last, group, held = this, None, np.zeros(0, np.uint64)
            cut = begins[g] + looked[g]
            held = np.r_[held, fp[begins[g] : cut]]
            if cut < ends[g] and len(held):
                group = group or _Group(held)
                out += group.links(fp[cut : ends[g]], int(this[0]) >> shift, radius)
        if out:
            a, b = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


class _Group:
    """The rows that a large group looks up, with the parts that links have joined so far. Rows near a hub are joined to it first; what hubs leave in
    one part needs no more comparisons than with them."""

    def __init__(self, held: np.ndarray) -> None:
        self.held, self.part, self.hubs = held, np.arange(len(held)), None

    def near(self, x: np.ndarray, y: np.ndarray, start: int, radius: int) -> np.ndarray:
        return viable((x[:, None] ^ y[None, :]).ravel(), start, radius).reshape(len(x), len(y))

    def join(self, start: int, radius: int) -> list[np.ndarray]:
        """Chooses hubs, each the first row that no hub is near yet, and joins all rows near them."""
        out, self.hubs, lone = [], [], np.ones(len(self.held), bool)
        while lone.any() and len(self.hubs) < HUBS:
            hub = int(np.argmax(lone))
            self.hubs.append(hub)
            near = np.flatnonzero(self.near(self.held[hub : hub + 1], self.held, start, radius)[0])
            lone[near] = lone[hub] = False
            parts, first = np.unique(self.part[near], return_index=True)
            self.part[np.isin(self.part, parts)] = self.part[hub]
            ends = self.held[near[first]]
            ends = ends[ends != self.held[hub]]
            out.append(np.stack([np.full(len(ends), self.held[hub]), ends]))
        return out

    def links(self, asks: np.ndarray, start: int, radius: int) -> list[np.ndarray]:
        out = self.join(start, radius) if self.hubs is None else []
        if (self.part == self.part[0]).all():
            # One part: a row near a hub is in it. One that is held itself is too.
            near = self.near(asks, self.held[self.hubs], start, radius)
            met = near.any(axis=1)
            ends = self.held[np.array(self.hubs)[near[met].argmax(axis=1)]] if met.any() else asks[:0]
            other = asks[met] != ends
            out.append(np.stack([asks[met][other], ends[other]]))
            asks = asks[~met & ~np.isin(asks, self.held)]
        for x in asks:
            diff = self.held ^ x
            near = np.flatnonzero(viable(diff, start, radius))
            parts, first = np.unique(self.part[near], return_index=True)
            if len(parts) > 1:
                self.part[np.isin(self.part, parts)] = parts[0]
            elif not len(parts) or (diff == 0).any():
                continue  # no link, or x is in that part already
            ends = self.held[near[first]]
            ends = ends[ends != x]
            out.append(np.stack([np.full(len(ends), x), ends]))
        return out


def links(reps: DataFrame, radius: int = 4, most: int = MOST) -> DataFrame:
    """Links (a, b), a < b, that connect what pairs of distinct fingerprints within `radius` bits connect. reps: distinct fp. A key with over
    `most` rows to look up is dealt over as many salts as it needs; each probing row goes to all of these."""
    index, probes = _keyed(reps, radius)
    index = index.select("key", F.lit(0).cast("long").alias("salt"), F.lit(0).cast("int").alias("probing"), "fp")
    probes = probes.select("key", F.lit(0).cast("long").alias("salt"), F.lit(1).cast("int").alias("probing"), "fp")
    hot = shared.written(index.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).alias("salts")), "hot")
    if not hot.isEmpty():
        index = index.join(hot, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("salts")), F.lit(0)).cast("long").alias("salt"), "probing", "fp")
        probes = probes.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts"), F.lit(1)).cast("long") - 1)).alias("salt"), "probing", "fp")
    dealt = index.unionAll(probes).repartition("key", "salt").sortWithinPartitions("key", "salt", "probing")
    return dealt.mapInArrow(lambda batches: _matches(batches, radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node and the least node that it is connected with, for every node of edges (a, b). Each round a node, and its parent, take the least
    grandparent next to them; rounds needed grow with the logarithm of the size of a component, and go on until nothing changes; if
    that takes more than `rounds`, this raises. Tables are written between rounds."""
    both = shared.written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    dealt = shared.Dealt(both, ["b"])  # a node may have a large part of all links
    parents = shared.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p"), "parents")
    for _ in range(rounds):
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("g"))
        grand = shared.written(shared.Dealt(parents, ["p"]).join(up).select("node", "p", "g"), "grand")
        near = dealt.join(grand.select(F.col("node").alias("b"), "g")).groupBy("a").agg(F.min("g").alias("g"))
        mine = grand.join(near.select(F.col("a").alias("node"), F.col("g").alias("n")), "node").select("node", "p", F.least("g", "n").alias("g"))
        moved = mine.select("node", "g").unionAll(mine.select(F.col("p").alias("node"), "g"))
        new = shared.written(moved.groupBy("node").agg(F.min("g").alias("p")), "parents")
        settled = new.join(parents.withColumnRenamed("p", "old"), "node").where(F.col("p") != F.col("old")).isEmpty()
        flat = grand.where(F.col("p") != F.col("g")).isEmpty()
        shared.dropped(grand)
        shared.dropped(parents)
        parents = new
        if settled and flat:
            return parents.select("node", F.col("p").alias("component"))
    raise RuntimeError(f"components not settled after {rounds} rounds")


SIGNED = pa.struct([("text_id", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNED_SQL = "struct<text_id:bigint,fp:bigint,sketch:binary,bands:array<bigint>>"


def signature(text: bytes, size: int) -> dict:
    """A number for the words, the fingerprint, the least of each of HASHES permutations of the shingle hashes as one byte, and digests of each
    band's four. No words: no bands."""
    words = text.lower().split()
    own = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)).view(np.int64))
    if not words:
        return {"text_id": own, "fp": 0, "sketch": b"", "bands": []}
    h = shingle_hashes(words, size)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        least = np.minimum(least, (h[at : at + 512, None] * PERMUTATIONS[None, :]).min(axis=0))
    bands = [xxhash.xxh64_intdigest(least[ROWS * k : ROWS * (k + 1)].tobytes(), k) for k in range(BANDS)]
    sketch = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
    return {"text_id": own, "fp": majority(h), "sketch": sketch.tobytes(), "bands": np.array(bands, np.uint64).view(np.int64).tolist()}


class _Held:
    """Rows of one group that a task holds: their sketches and, to verify, their sets of shingles; the parts that links have joined; and how many
    candidates each has met."""

    def __init__(self, size: int | None, similarity: float) -> None:
        self.size, self.similarity, self.n = size, similarity, 0
        self.node, self.part, self.known, self.met = (np.zeros(16, np.int64) for _ in range(4))
        self.sketch, self.sets = np.zeros((16, HASHES), np.uint8), []

    def shingles(self, text: bytes | None) -> np.ndarray | None:
        return None if self.size is None else np.unique(shingle_hashes((text or b"").lower().split(), self.size))

    def links(self, node: int, known: int, sketch: bytes, own: np.ndarray | None) -> tuple[list[tuple[int, int]], np.ndarray, list[int]]:
        """Links of a row with what is held, one for each part that it is near; the candidates; and those parts. Rows of one known component are
        connected already."""
        if self.n == 0 or not sketch:
            return [], np.zeros(0, np.int64), []
        agree = (self.sketch[: self.n] == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= PLACES
        candidates = np.flatnonzero(agree & (self.known[: self.n] != known))
        out, parts = [], []
        for j in candidates:
            part = int(self.part[j])
            if part not in parts and (own is None or self.alike(own, self.sets[j])):
                out.append((node, int(self.node[j])))
                parts.append(part)
        return out, candidates, parts

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) < self.similarity * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= self.similarity * (len(a) + len(b) - both)

    def add(self, node: int, known: int, sketch: bytes, own: np.ndarray | None, candidates: np.ndarray, parts: list[int]) -> None:
        n = self.n
        if n == len(self.node):
            self.node, self.part, self.known, self.met = (np.resize(x, 2 * n) for x in (self.node, self.part, self.known, self.met))
            self.sketch = np.resize(self.sketch, (2 * n, HASHES))
        self.node[n], self.part[n], self.known[n], self.met[n] = node, n, known, len(candidates)
        self.sketch[n] = np.frombuffer(sketch, np.uint8) if sketch else 0
        self.sets.append(own)
        self.met[candidates] += 1
        if parts:
            self.part[: n + 1][np.isin(self.part[: n + 1], [*parts, n])] = parts[0]
        self.n += 1


CELLS = "group bigint, salt bigint, turn bigint, asked int, node bigint, known bigint, sketch binary, text string"
LINKS = "a bigint, b bigint, hub boolean, met bigint"


def _linked(batches, size: int | None, similarity: float, asked_only: bool):
    """Rows (a, b, hub, met) from rows of CELLS sorted by cell (group, salt, turn) and asked: the links of each cell; and as hub, the row a of group b that met
    most candidates. asked_only: rows that are asked (they come first) are compared with the others; else all are compared."""
    last, held = None, None

    def hub():
        if held is not None and held.n > 1 and not asked_only:
            at = int(np.argmax(held.met[: held.n]))
            yield int(held.node[at]), last[0], True, int(held.met[at])

    for batch in batches:
        group, salt, turn, asked, node, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if not len(group):
            continue
        begins = np.r_[0, np.flatnonzero((np.diff(group) != 0) | (np.diff(salt) != 0) | (np.diff(turn) != 0)) + 1]
        ends = np.r_[begins[1:], len(group)]
        out: list[tuple[int, int, bool, int]] = []
        # A cell of one row, not at a batch's ends, has no links.
        for g in np.flatnonzero((ends - begins > 1) | (begins == 0) | (ends == len(group))):
            this = (int(group[begins[g]]), int(salt[begins[g]]), int(turn[begins[g]]))
            if this != last:
                out += hub()
                last, held = this, _Held(size, similarity)
            for i in range(begins[g], ends[g]):
                sketch, own = batch.column(6)[i].as_py(), held.shingles(batch.column(7)[i].cast(pa.binary()).as_py())
                if asked_only and asked[i] == 1:
                    held.add(int(node[i]), int(known[i]), sketch, own, np.zeros(0, np.int64), [])
                    continue
                found, candidates, parts = held.links(int(node[i]), int(known[i]), sketch, own)
                out += [(a, b, False, 0) for a, b in found]
                if not asked_only:
                    held.add(int(node[i]), int(known[i]), sketch, own, candidates, parts)
        if out:
            yield _batch(out)
    out = list(hub())
    if out:
        yield _batch(out)


def _batch(out: list) -> pa.RecordBatch:
    a, b, hubs, met = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hubs, pa.bool_()), pa.array(met, pa.int64())], names=["a", "b", "hub", "met"])


def within_groups(rows: DataFrame, size: int | None, similarity: float, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Links (a, b) that connect what near pairs of one group connect. rows: (group, node, sketch, text); near: sketches agree in PLACES and, with a size of
    shingles, the sets' similarity is verified. A group with over `most` rows or bytes is dealt over salts. There, rows are linked within their
    salt; then with the group's hubs, rows that met most candidates, which are sent to all salts; what then is not in the group's largest component
    is compared with all salts' rows, in turns. So a dense group costs about its size, and no pair is left out that is not connected."""
    cells = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("bytes") / most_bytes)).cast("bigint")
    hot = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).select("group", cells.alias("salts")).where("salts > 1")
    hot = shared.written(hot, "hot")
    none = F.lit(0).cast("bigint")

    def linked(cells: DataFrame, asked_only: bool) -> DataFrame:
        named = cells.select(*[c.split()[0] for c in CELLS.split(", ")])
        dealt = named.repartition("group", "salt", "turn").sortWithinPartitions("group", "salt", "turn", F.desc("asked"), "node")
        return dealt.mapInArrow(lambda b: _linked(b, size, similarity, asked_only), LINKS)

    if hot.isEmpty():
        whole = rows.withColumns({"salt": none, "turn": none, "asked": F.lit(0), "known": F.col("node")})
        return linked(whole, False).where("NOT hub").select("a", "b")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), none)
    dealt = shared.written(rows.join(hot, "group", "left").withColumns({"salt": own, "turn": none, "asked": F.lit(0), "known": F.col("node")}), "dealt")
    first = shared.written(linked(dealt, False), "linked")
    large = dealt.where(F.col("salts").isNotNull())
    best = Window.partitionBy("b").orderBy(F.desc("met"), "a")  # a row for each salt of a hot group
    hubs = first.where("hub").withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS).select(F.col("b").alias("group"), F.col("a").alias("node"))
    asking = large.join(hubs, ["group", "node"]).withColumn("asked", F.lit(1))
    everywhere = F.explode(F.sequence(none, F.col("salts") - 1))
    second = shared.written(linked(asking.withColumn("salt", everywhere).unionByName(large), True).where("NOT hub"), "hubs")
    # Of hot groups, what is not in the group's largest component goes round.
    so_far = first.where("NOT hub").select("a", "b").unionAll(second.select("a", "b"))
    nodes = shared.written(components(so_far), "so_far")
    placed = large.drop("known").join(nodes.withColumnsRenamed({"component": "known"}), "node", "left").withColumn("known", F.coalesce("known", "node"))
    placed = shared.written(placed, "placed")
    main = placed.groupBy("group", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    rest = shared.written(placed.join(main, "group").where(F.col("known") != F.col("main")).drop("main"), "rest")
    turns = rest.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / most).cast("bigint").alias("turns"))
    asking = rest.join(turns, "group").withColumns({"asked": F.lit(1), "turn": F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns"))}).withColumn("salt", everywhere).drop("turns")
    asked = placed.join(turns, "group").withColumn("turn", F.explode(F.sequence(none, F.col("turns") - 1))).drop("turns")
    third = linked(asking.unionByName(asked), True).where("NOT hub").select("a", "b")
    return so_far.unionAll(third)


def _names(reps: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component, component_id): the component of each of reps (key, least) that edges (a, b) between keys make, and its least `least`."""
    nodes = shared.written(components(shared.written(edges, "edges")), "components")
    named = shared.written(reps.join(nodes.withColumnRenamed("node", key), key, "left").select(key, "least", F.coalesce("component", key).alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return shared.Dealt(named.select(key, "component"), ["component"]).join(least).select(key, "component", "component_id")


def near_copies(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = shared.written(fingerprints(docs, size), "fingerprints")
    reps = shared.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "representatives")
    of_print = _names(reps, links(reps.select("fp"), radius), "fp")
    return shared.Dealt(prints, ["fp"]).join(of_print).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidates(reps: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """Links (a, b) between texts that may be alike, which connect all pairs that may be. reps: (text_id, fp, sketch, bands)."""
    keyed = reps.select(F.explode("bands").alias("group"), F.col("text_id").alias("node"), "sketch", F.lit(None).cast("string").alias("text"))
    by_band = within_groups(keyed, None, 0.0, most)
    by_print = reps.groupBy("fp").agg(F.min("text_id").alias("first"))
    same = reps.join(by_print, "fp").where(F.col("text_id") != F.col("first")).select(F.col("text_id").alias("a"), F.col("first").alias("b"))
    near = links(reps.select("fp").distinct(), radius, most)
    end = lambda c: by_print.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_text"))
    near = near.join(end("a"), "a").join(end("b"), "b").select(F.col("a_text").alias("a"), F.col("b_text").alias("b"))
    return by_band.unionAll(same).unionAll(near).distinct()


def alike(docs: DataFrame, radius: int = 4, size: int = 5, similarity: float = 0.8, most: int = MOST, most_texts: int = MOST_TEXTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text_id, component and component_id (the component's least doc_id) of every row: texts whose sets of shingles are so similar are linked."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    sign = shared.per_text(lambda t: signature(t, size), SIGNED_SQL, SIGNED)
    signed = shared.written(docs.select("doc_id", digest.alias("digest"), sign.alias("s")).select("doc_id", "digest", "s.*"), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    reps = signed.groupBy("text_id").agg(F.min(row).alias("row"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    reps = shared.written(reps.select("text_id", F.col("row.doc_id").alias("least"), F.col("row.digest").alias("digest"), "fp", "sketch", "bands"), "representatives")
    grouped = shared.written(components(shared.written(candidates(reps, radius, most), "candidates")), "groups")
    # One text of each candidate goes to its group: that of the row which stands for all rows of these words.
    chosen = reps.join(grouped.withColumnsRenamed({"node": "text_id", "component": "group"}), "text_id").select("group", "text_id", "sketch", "least", "digest")
    own = docs.select("doc_id", "text", digest.alias("of_text"))
    met = own.join(chosen, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("of_text") == F.col("digest")))
    rows = shared.written(met.select("group", F.col("text_id").alias("node"), "sketch", "text"), "texts")
    if not rows.groupBy("node").count().where("count > 1").isEmpty():
        rows = shared.written(rows.dropDuplicates(["node"]), "texts")
    names = _names(reps.select("text_id", "least"), within_groups(rows, size, similarity, most_texts, most_bytes), "text_id")
    return shared.Dealt(signed.select("doc_id", "text_id"), ["text_id"]).join(names).select("doc_id", "text_id", "component", "component_id")


def filter_documents(docs: DataFrame, radius: int = 4, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, of which each component's least doc_id stays; rows without doc_id stay only if their component has no
    other (then one of them does), and of rows with one doc_id one stays. At a similarity of 0.8, fingerprints differ in about ten bits, where a search by
    Hamming distance is no longer selective; so here MinHash bands find candidates beside the fingerprints."""
    found = shared.written(alike(docs, radius, size, similarity), "near")
    stays = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    kept = docs.join(stays.select(F.col("component_id").alias("doc_id")), "doc_id", "left_semi")
    if not found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty():
        n = shared.unused(docs, "__n")
        kept = kept.withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).where(F.col(n) == 1).drop(n)
    nameless = found.where(F.col("component_id").isNull()).select("component").distinct()
    if not nameless.isEmpty():
        # Components all of whose rows lack a doc_id: one row of the text that names them stays.
        p, n = shared.unused(docs, "__p"), shared.unused(docs, "__n")
        own = shared.per_text(lambda t: signature(t, size)["text_id"], "bigint", pa.int64())
        bare = docs.where(F.col("doc_id").isNull()).withColumn(p, own).join(nameless.withColumnRenamed("component", p), p, "left_semi")
        kept = kept.unionByName(bare.withColumn(n, F.row_number().over(Window.partitionBy(p).orderBy(F.col("text").asc_nulls_last()))).where(F.col(n) == 1).drop(p, n))
    return kept.select(*docs.columns)

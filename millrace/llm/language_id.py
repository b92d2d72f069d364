"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point (lower-cased). An n-gram's vector binds its letters' vectors by
multiplication, each permuted (rotated) by its place; a text's profile is the bundle (sum) of its n-grams' vectors; a language's prototype is the
bundle of its training texts' profiles. A text gets the language whose prototype has the largest cosine with its profile. Bundling is linear, so a
task adds up its texts' n-gram counts by language and makes vectors once; the prototypes are sums over all training rows, of fixed size per
language.

Cases: a null text, or one without a letter, is `und` with score 0, and teaches nothing. Without any training row all are `und`. Of equal cosines
the first language in order wins. Repeated rows each count and each get their result. A null doc_id is never held out, and never learned
from. More languages than MOST_LANGUAGES raise, as prototypes go to every task. An empty table gives an empty result. Extra columns are ignored.
Texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared

DIMENSIONS, N, SEED = 1024, 3, 20240229
#: Languages that a task sums at once, and that there may be (8 kB each).
MOST_HELD, MOST_LANGUAGES = 32, 4096
#: Bits of a letter within an n-gram's code; 0 stands for all that is no letter.
WIDTH = 21
#: Codes that are read at once, and of one language that wait to be bundled.
CHUNK, WAITING = 1 << 20, 1 << 18
UNKNOWN = "und"


def _letter(point: int) -> int:
    """The lower-cased letter's code point; 0 for all that is no letter."""
    low = chr(point).lower()[:1]
    return ord(low) if low.isalpha() else 0


COMMON = np.array([_letter(c) for c in range(0x250)], np.int64)
_rare = lru_cache(maxsize=1 << 16)(_letter)


@lru_cache(maxsize=1 << 13)
def letter_vector(letter: int) -> np.ndarray:
    """DIMENSIONS of +1 and -1, the same everywhere; what is no letter has one too."""
    return np.random.Generator(np.random.PCG64([SEED, letter])).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def letters_of(text: str) -> np.ndarray:
    """The letters of a text, what is none between them as one 0, and a 0 at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    known = points < len(COMMON)
    s = COMMON[np.where(known, points, 0)]
    if not known.all():
        others, of = np.unique(points[~known], return_inverse=True)
        s[~known] = np.array([_rare(int(x)) for x in others], np.int64)[of]
    s = np.r_[0, s, 0]
    return s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, of = np.unique(codes, return_inverse=True)
    return out, np.bincount(of, counts).astype(np.int64)


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes, counts) of the letter n-grams of a text, words parted by one blank; None without a letter."""
    s = letters_of(text.decode("utf-8", "replace"))
    if len(s) < 3:
        return None
    codes = (s[:-2] << 2 * WIDTH) | (s[1:-1] << WIDTH) | s[2:]
    if len(codes) <= CHUNK:
        return np.unique(codes, return_counts=True)
    parts = [np.unique(codes[at : at + CHUNK], return_counts=True) for at in range(0, len(codes), CHUNK)]
    return _added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def profile(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bundle of n-grams, in whole numbers, so that sums do not depend on how rows are dealt to tasks."""
    out = np.zeros(DIMENSIONS, np.int64)
    mask = (1 << WIDTH) - 1
    for at in range(0, len(codes), 2048):
        c, n = codes[at : at + 2048], counts[at : at + 2048].astype(np.float64)
        letters, of = np.unique(np.concatenate([c >> 2 * WIDTH, (c >> WIDTH) & mask, c & mask]), return_inverse=True)
        v = np.stack([letter_vector(int(x)) for x in letters])
        first, second, third = of.reshape(3, -1)
        # Rotation by place: the first letter twice, the second once, the third not at all.
        bound = np.roll(v, 2, axis=1)[first] * np.roll(v, 1, axis=1)[second] * v[third]
        if n.max() < 1 << 12:
            out += (n.astype(np.float32) @ bound.astype(np.float32)).astype(np.int64)  # exact: sums are below 2 ** 24
        else:
            out += (n @ bound.astype(np.float64)).astype(np.int64)
    return out


def remainder(doc_id: str | Column = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(4))


class _Bundle:
    """The bundle of one language's n-grams in a task; counts wait until there are many, so that n-grams of many texts are bound once."""

    def __init__(self) -> None:
        self.whole, self.waiting, self.n = np.zeros(DIMENSIONS, np.int64), [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((codes, counts))
        self.n += len(codes)
        if self.n > WAITING:
            self.waiting = [_added(*map(np.concatenate, zip(*self.waiting, strict=True)))]
            self.n = len(self.waiting[0][0])
            if self.n > WAITING // 2:
                self.value()

    def value(self) -> np.ndarray:
        if self.waiting:
            self.whole += profile(*_added(*map(np.concatenate, zip(*self.waiting, strict=True))))
        self.waiting, self.n = [], 0
        return self.whole


def _sums(batches):
    """Rows (lang, dimension, value): this task's bundles by language, given out whenever MOST_HELD languages are held."""
    held: dict[str, _Bundle] = {}

    def bundles():
        for lang, bundle in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(bundle.value())], names=["lang", "dimension", "value"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), shared.texts_of(batch.column(1)), strict=True):
            grams = gram_counts(text)
            if grams is not None:
                held.setdefault(lang.as_py(), _Bundle()).add(*grams)
                if len(held) >= MOST_HELD:
                    yield from bundles()
    yield from bundles()


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of length 1) from all rows (lang, text). One row per language comes to the driver, MOST_LANGUAGES at most."""
    sums = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_sums, "lang string, dimension int, value bigint")
    by_dimension = sums.groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
    by_lang = by_dimension.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dimension", "value"))).alias("v"))
    rows = by_lang.select("lang", F.transform("v", lambda x: x["value"]).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    rows = sorted(rows)
    out = np.array([r["v"] for r in rows], float).reshape(len(rows), DIMENSIONS)
    return [r["lang"] for r in rows], out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict(text: bytes, langs: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    grams = gram_counts(text) if langs else None
    if grams is None:
        return UNKNOWN, 0.0
    p = profile(*grams).astype(float)
    cosine = prototypes @ p / max(float(np.linalg.norm(p)), 1e-12)
    best = int(np.argmax(cosine))
    return langs[best], float(np.clip(cosine[best], 0, 1))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out. score: the cosine, 0 at least."""
    held = F.coalesce(remainder() == 2, F.lit(False))
    langs, prototypes = learn(docs.where(remainder() != 2).select("lang", "text"))

    def one(text: bytes) -> dict:
        lang, score = predict(text, langs, prototypes)
        return {"lang_pred": lang, "score": score}

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    out = docs.select("doc_id", held.alias("held_out"), shared.per_text(one, "struct<lang_pred:string,score:double>", kind).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")

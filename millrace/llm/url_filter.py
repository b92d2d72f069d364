"""URL filters: rules by host and path, and logistic regression on hashed character n-grams of host and path for all other URLs.

The model is trained from a small labelled URL table (at most MOST_LABELLED rows of it come to the driver), and its weights, of fixed size, go to
the executors. All URLs are judged row by row: nothing is shuffled.

Cases: a null URL, or one without `://`, has an empty host and path, fits no rule, and is judged by the model without n-grams: by its
bias, which training leaves below 0 where most of the table is allowed, so it is allowed; so is all that no rule blocks without labelled rows. Repeated rows each get their verdict; a null page_id is returned as null. An empty table gives an empty
result. Of rules that fit, the longest wins; rules cannot tie, as two of one length that fit one URL are one rule. Extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host and path, verdict). Fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DIMENSIONS, SIZES, MOST_LABELLED = 1 << 14, (3, 4, 5), 10_000
#: The small labelled table: sites of public knowledge and made-up ones of their kinds, one label each.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(spark: SparkSession, path: Path = LABELLED) -> DataFrame:
    """(url, block, held_out) of a tab-separated table of url and block (1 or 0) on the driver. held_out: one host in four, by crc32 of the host, is
    kept from training so that the model can be measured."""
    lines = path.read_text(encoding="utf-8").splitlines()[1:]
    rows = [(url, int(block)) for url, block in (line.split("\t") for line in lines)]
    return spark.createDataFrame(rows, "url string, block int").withColumn("held_out", F.pmod(F.crc32(host_of(F.col("url"))), F.lit(4)) == 0)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict): of the rules that fit the host, or a domain it is under, and the path's beginning, the longest; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Slots of the character n-grams of host and path, which are told apart and have their ends marked."""
    out = set()
    for tag, s in ((0, f"^{host}$"), (1, f"^{path}$")):
        if len(s) > 2:
            out.update(xxhash.xxh64_intdigest(s[i : i + n], tag) % DIMENSIONS for n in SIZES for i in range(len(s) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


def train(labelled: DataFrame, most: int = MOST_LABELLED, rounds: int = 2000, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of logistic regression by gradient descent on at most `most` labelled rows (url, block; those first by digest), in the order of
    their URLs. The bias is trained too, and is not decayed: a URL without evidence is judged by how rare blocked ones are in the table."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("block").isNotNull()).select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.col("block").cast("int").alias("y"))
    rows = sorted(rows.orderBy(F.xxhash64("h", "p", "y"), "h", "p", "y").limit(most).collect())
    w, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return w, bias
    x = [grams(r["h"], r["p"]) for r in rows]
    y = np.array([r["y"] for r in rows], float)
    of, at = np.repeat(np.arange(len(x)), [len(g) for g in x]), np.concatenate(x)
    scale = 1 / np.sqrt(np.maximum([len(g) for g in x], 1))
    for _ in range(rounds):
        z = np.bincount(of, w[at], len(x)) * scale + bias
        g = (1 / (1 + np.exp(-z)) - y) / len(x)
        w -= rate * (np.bincount(at, (g * scale)[of], DIMENSIONS) + decay * w)
        bias -= rate * g.sum()
    return w, bias


def measured(labelled: DataFrame, w: np.ndarray, bias: float, threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall of the model alone on rows (url, block), at most MOST_LABELLED of them."""
    rows = labelled.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), "block").limit(MOST_LABELLED).collect()
    said = [(score(r["h"], r["p"], w, bias) > threshold, r["block"] == 1) for r in rows]
    both = sum(a and b for a, b in said)
    return {"rows": len(said), "precision": both / max(sum(a for a, _ in said), 1), "recall": both / max(sum(b for _, b in said), 1)}


def score(host: str, path: str, w: np.ndarray, bias: float) -> float:
    """Probability that the URL is to be blocked."""
    g = grams(host, path)
    return float(1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(len(g), 1)) + bias))))


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row."""
    w, bias = train(labelled)

    @F.arrow_udf("double")
    def p_block(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([score(h.as_py() or "", p.as_py() or "", w, bias) for h, p in zip(hosts, paths, strict=True)], pa.float64())

    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    out = cut.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), p_block("host", "path").alias("p_block"))
    verdict = F.coalesce("said", F.when(F.col("p_block") > threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")

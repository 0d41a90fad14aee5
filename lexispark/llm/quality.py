"""Quality of documents: a text classifier, shrunk towards its host and path by hierarchical empirical Bayes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.storage import stored
from lexispark.llm.textnum import word_hashes

#: Most labelled ids the classifier is fitted on; most words whose odds it learns, and the fewest documents these are in.
SAMPLE, TABLE, SEEN = 4_000, 20_000, 5
FEATURES = ["upper", "digit", "mark", "symbol", "space", "other", "length", "word", "fresh", "again", "top", "line", "same_lines", "bars", "words"]
_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = 6 if _c >= 128 else 0 if chr(_c).isupper() else 1 if chr(_c).isdigit() else 5 if chr(_c).islower() else 4 if chr(_c).isspace() else 2 if chr(_c) in ".,;:'\"-?()" else 3


class Odds:
    """Log odds of words by their hashes."""

    def __init__(self, words: list[str], odds: list[float]) -> None:
        hashes = np.array([word_hashes(w)[0] for w in words], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], np.array(odds, float)[order]

    def mean(self, hashes: np.ndarray) -> float:
        """The mean odds of different words, unknown ones counting 0."""
        if not len(self.hashes) or not len(hashes):
            return 0.0
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return float(np.where(self.hashes[at] == hashes, self.odds[at], 0.0).mean())


def features(text: str | None, odds: Odds) -> list[float]:
    """Shares of character classes, lengths, how much words and lines repeat, and the odds of the words, over the whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7) / len(data)
    words = word_hashes(text)
    n = max(1, len(words))
    different, counts = np.unique(words, return_counts=True)
    lines = text.split("\n")
    repeated = sum(v - 1 for v in Counter(lines).values())
    after = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    return [
        *(float(kinds[k]) for k in (0, 1, 2, 3, 4, 6)),
        float(np.log1p(len(data))),
        len(data) / n,
        len(counts) / n,
        after,
        float(counts.max(initial=0)) / n,
        float(np.log1p(n / len(lines))),
        repeated / len(lines),
        data.count(b" | ") / n,
        odds.mean(different),
    ]


def drawn(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, good, side) of the `sample` labelled ids with the smallest hashes: a top-k that each task keeps short.

    One half (side 0) teaches the odds of words, the other the classifier.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("good")).where("good is not null and doc_id is not null")
    return known.groupBy("doc_id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(sample).withColumn("side", F.pmod(F.xxhash64("doc_id", F.lit("side")), F.lit(2)))


def word_odds(docs: DataFrame, sample: DataFrame) -> Odds:
    """The log odds of good for the TABLE most frequent words of the sample's first half that are in SEEN documents or more."""
    half = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.where("side = 0")), "doc_id")
    words = half.select("good", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("good").alias("good"), F.count("*").alias("n")).where(F.col("n") >= SEEN)
    total = half.agg(F.sum("good").alias("good"), F.count("*").alias("n")).first()
    if not total.n:
        return Odds([], [])
    found = counts.orderBy(F.desc("n"), "word").limit(TABLE).collect()
    rate = (total.good + 1) / (total.n + 2)
    return Odds([r.word for r in found], [float(np.log((r.good + rate) / (r.n - r.good + 1 - rate)) - np.log(rate / (1 - rate))) for r in found])


def described(docs: DataFrame, host: str, path: str, odds: Odds) -> DataFrame:
    """(doc_id, host, path and the features), stored: the texts are read once."""
    held = docs.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t, held.value) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array(c) for c in rows.T], ["doc_id", "host", "path", *FEATURES])

    section = F.concat_ws("/", F.coalesce(F.col(host).cast("string"), F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), section.alias("path"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"{f} double" for f in FEATURES)), "features")


def fit(rows: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, means, scales) of a logistic regression by Newton steps."""
    mean, scale = rows.mean(0), rows.std(0) + 1e-9
    x = np.column_stack([(rows - mean) / scale, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + penalty, x.T @ (good - p) - penalty @ w)
    return w, mean, scale


def classifier(rows: DataFrame, sample: DataFrame) -> Column:
    """The chance that a document is good, as an expression over the features; fitted on the sample's second half, a row an id."""
    one = rows.join(F.broadcast(sample.where("side = 1")), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("f"), F.max("good").alias("good"))
    found = one.orderBy("doc_id").select("f.*", "good").collect()
    good = np.array([r.good for r in found])
    if len(set(good.tolist())) < 2:
        return F.lit(float((good.sum() + 1) / (len(good) + 2)))
    w, mean, scale = fit(np.array([list(r)[:-1] for r in found]), good)
    score = F.lit(float(w[-1]))
    for name, a, m, s in zip(FEATURES, w, mean, scale):
        score = score + (F.col(name) - F.lit(float(m))) * F.lit(float(a / s))
    return 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(30.0)), F.lit(-30.0))))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column) -> Column:
    """How many documents a prior is worth, from the spread of the groups' means around it (method of moments)."""
    n, total = F.col("n"), F.col("total")
    noise = F.sum(prior * (1 - prior))
    excess = F.sum(n * (total / n - prior) ** 2) - noise
    spread = excess / F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1.0))
    return F.least(F.greatest(F.avg(prior * (1 - prior)) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, host, path, p_doc, p_host, p_path, score, keep.

    p_doc is the classifier's chance that the text is good. A host's rate is its documents' chances (their label where
    there is one), shrunk towards the global mean by as many documents as the spread between hosts warrants; a
    path's rate is shrunk towards its host's in the same way; both leave out the document they judge. score adds
    the path's evidence to the text's: logit(p_doc) + logit(p_path) - logit(global mean). Sparse sites so follow the
    prior. Everything but the classifier's bounded sample is summed over all documents by partial aggregates.

    Null host is a host, and so is the empty one; a null path counts as an empty one. Null or empty text has all
    features 0; with labels of one kind or none p_doc is constant; of several labels of a document the best counts;
    repeated rows count each; an empty table gives no rows.
    """
    sample = drawn(labels)
    rows = described(docs, host, path, word_odds(docs, sample))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("quality").cast("double")).alias("label"))
    rows = rows.withColumn("p_doc", classifier(rows, sample)).select("doc_id", "host", "path", "p_doc")
    rows = rows.join(known, F.col("doc_id") == F.col("label_id"), "left")
    rows = stored(rows.select("doc_id", "host", "path", "p_doc", F.coalesce("label", "p_doc").alias("e")), "evidence")

    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("total"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    mean = hosts.agg((F.sum("total") / F.sum("n")).alias("mean")).first()["mean"]
    if mean is None:
        return rows.select("doc_id", "host", "path", "p_doc", F.col("p_doc").alias("p_host"), F.col("p_doc").alias("p_path"), F.col("p_doc").alias("score"), F.lit(True).alias("keep"))
    overall = F.lit(float(min(max(mean, 1e-6), 1 - 1e-6)))
    of_host = hosts.agg(_strength(hosts, overall).alias("k")).first()["k"]
    rated = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("total").alias("host_total"), ((F.lit(of_host) * overall + F.col("total")) / (F.lit(of_host) + F.col("n"))).alias("prior"))
    joined = paths.join(rated, F.col("host").eqNullSafe(F.col("h")))
    of_path = joined.agg(_strength(joined, F.col("prior")).alias("k")).first()["k"]
    sites = joined.select(F.col("h"), F.col("path").alias("p"), "host_n", "host_total", F.col("n").alias("path_n"), F.col("total").alias("path_total"))

    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")))
    out = out.withColumn("p_host", (F.lit(of_host) * overall + F.col("host_total") - F.col("e")) / (F.lit(of_host) + F.col("host_n") - 1))
    out = out.withColumn("p_path", (F.lit(of_path) * F.col("p_host") + F.col("path_total") - F.col("e")) / (F.lit(of_path) + F.col("path_n") - 1))
    out = out.withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("p_doc")) + _logit(F.col("p_path")) - _logit(overall)))))
    return out.select("doc_id", "host", "path", "p_doc", "p_host", "p_path", "score", (F.col("score") >= least).alias("keep"))

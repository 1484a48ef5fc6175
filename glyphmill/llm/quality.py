"""Quality classifier: document evidence combined with posteriors of its host and path.

Two logistic models, of quality and of not being toxic, over byte shares, repetition and hashed words and
word beginnings of the whole text are fitted on a bounded sample of labelled documents; the product of
their chances scores every document.  Grouped aggregation then estimates, by analysis of
variance, how much hosts differ from each other and paths from their hosts; each host's mean score is
shrunk towards the global mean and each path's towards its host's, the more so the fewer documents it
has.  A document's own score is left out of its site's.  Its log odds are its own plus what its path's
posterior adds to the global prior; documents below ``least`` are rejected.

Here a document is good if it is labelled as of quality and not as toxic.

Defined results: a null text is empty; a null host or path is a site of its own; labels without both
values count for nothing; without labels of both kinds every document has even odds and stays; repeated
rows each count for their site and are judged alike; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import pickle
import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged, table

#: Labelled documents that the model is fitted on, those of the smallest hashes.
SAMPLE = 8000
#: Buckets that words and word beginnings are hashed into, a power of two.
BUCKETS = 1 << 18
#: Lengths of word beginnings.
BEGINNINGS = range(3, 8)
#: Entries that the fit works on at a time.
BLOCK = 1 << 20
#: Documents whose entries the fit keeps in one array: large ones go back to the system when they are dropped.
TOGETHER = 256
#: Labelled documents that must hold a bucket for it to count: what one or two hold tells nothing of others.
LEAST_ROWS = 3
#: Share of odds below which a document is rejected.
LEAST = 0.5
#: Sites that are broadcast in the join back; more are shuffled.
MAX_BROADCAST_SITES = 100_000
SYMBOLS = b"|!%$&*#.,?:;-_\"'"


def _classes() -> np.ndarray:
    """256 x classes: which byte counts for which share."""
    groups = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" ", b"\n", bytes(range(128, 256)), *(bytes([s]) for s in SYMBOLS)]
    out = np.zeros((256, len(groups)))
    for j, g in enumerate(groups):
        out[list(g), j] = 1
    return out


CLASSES = _classes()


@functools.lru_cache(maxsize=100_000)
def openings(head: str) -> tuple[int, ...]:
    """Buckets of a word's beginnings, which its first letters give."""
    return tuple(crc32(b"^" + head[:k].encode()) & (BUCKETS - 1) for k in BEGINNINGS if len(head) >= k)


@functools.lru_cache(maxsize=100_000)
def buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word, of the word without outer punctuation, and of that one's beginnings."""
    bare = word.strip(string.punctuation)
    whole = (crc32(word.encode()) & (BUCKETS - 1),)
    if bare != word:
        whole = (*whole, crc32(b"=" + bare.encode()) & (BUCKETS - 1))
    return whole + openings(bare[: BEGINNINGS[-1]])


def marks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the words of a whole text fall into, and the logarithm of how often."""
    met = Counter(chain.from_iterable(map(buckets, (text or "").lower().split())))
    return np.fromiter(met.keys(), dtype=np.int32, count=len(met)), np.log2(1 + np.fromiter(met.values(), dtype=np.float32, count=len(met)))


def features(text: str | None) -> np.ndarray:
    """Byte shares, repetition and length."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n = max(1, len(words))
    shares = np.sqrt((np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ CLASSES) / max(1, len(raw)))
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    return np.concatenate([shares, [len(set(words)) / n, np.sqrt(again), np.log1p(n), len(raw) / n / 10]])


def logistic(at: np.ndarray, value: np.ndarray, row: np.ndarray, k: int, x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Weights of k buckets and of the columns of ``x``; entries (row, at, value) are scaled by how differently both kinds of rows hold a bucket."""
    blocks = [slice(i, i + BLOCK) for i in range(0, len(at), BLOCK)]  # entries at a time, as bincount copies what it is given
    held, held_1 = np.bincount(at, minlength=k), np.zeros(k)
    for s in blocks:
        held_1 += np.bincount(at[s], weights=y[row[s]], minlength=k)
    scale = np.abs(np.log((held_1 + 0.5) / (y.sum() + 1)) - np.log((held - held_1 + 0.5) / ((1 - y).sum() + 1)))

    def times(w):
        out, scaled = x @ w[k:], w[:k] * scale
        for s in blocks:
            out += np.bincount(row[s], weights=scaled[at[s]] * value[s], minlength=len(y))
        return out

    def back(r):
        out = np.zeros(k)
        for s in blocks:
            out += np.bincount(at[s], weights=r[row[s]] * value[s], minlength=k)
        return np.concatenate([out * scale, x.T @ r])

    w = np.zeros(k + x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[k:], penalty[-1] = 2.0, 1e-6
    before = 1 / (penalty + 1)
    for _ in range(rounds):  # Newton, each step by conjugate gradients
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        g = back(y - p) - penalty * w
        step, r = np.zeros_like(w), g.copy()
        q = r * before
        size = first = r @ q
        for _ in range(25):
            if size <= 1e-4 * first or size < 1e-12:
                break
            curved = back(np.maximum(p * (1 - p), 1e-6) * times(q)) + penalty * q
            by = size / (q @ curved)
            step += by * q
            r -= by * curved
            size, last = r @ (r * before), size
            q = r * before + size / last * q
        w += step
        if np.abs(step).max() < 1e-2:
            break
    return w[:k] * scale, w[k:]


class Model:
    """Log odds of quality and of not being toxic, each by its own weights; a label of one value only counts for nothing."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.centre, self.scale, self.parts = centre, scale, parts

    @classmethod
    def fit(cls, texts: list[str | None], quality: np.ndarray, toxic: np.ndarray, ridge: float = 3.0) -> Model:
        quality, harmless = np.asarray(quality, dtype=float), 1 - np.asarray(toxic, dtype=float)
        good = quality * harmless > 0
        if not len(good) or good.all() or not good.any():
            return cls(np.zeros(0), np.ones(0), [])
        x = np.array([features(t) for t in texts])
        centre, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        x = np.column_stack([np.clip((x - centre) / scale, -8, 8), np.ones(len(x))])
        chunks, sizes = [], []
        held = np.zeros(BUCKETS, dtype=np.int32)
        for i in range(0, len(texts), TOGETHER):
            some = [marks(t) for t in texts[i : i + TOGETHER]]
            for at, _ in some:
                held[at] += 1
            chunks.append(tuple(np.concatenate(m) for m in zip(*some, strict=True)))
            sizes += [len(m[0]) for m in some]
        buckets.cache_clear()
        openings.cache_clear()
        some = np.flatnonzero(held >= LEAST_ROWS)
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[some] = np.arange(len(some))
        at, value = np.empty(held[some].sum(), dtype=np.int32), np.empty(held[some].sum(), dtype=np.float32)
        row, n = np.empty(len(at), dtype=np.int32), 0
        for i, (found, much) in enumerate(chunks):
            use = place[found] >= 0
            mine = slice(n, n + int(use.sum()))
            at[mine], value[mine] = place[found[use]], much[use]
            own = sizes[i * TOGETHER : (i + 1) * TOGETHER]
            row[mine] = np.repeat(np.arange(i * TOGETHER, i * TOGETHER + len(own)), own)[use]
            n, chunks[i] = mine.stop, None
        del chunks, found, much, use
        parts = []
        for y in (quality, harmless):
            if 0 < y.sum() < len(y):
                learned = np.zeros(BUCKETS, dtype=np.float32)
                learned[some], dense = logistic(at, value, row, len(some), x, y, ridge)
                parts.append((learned, dense))
        return cls(centre, scale, parts)

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of both at once: of the product of the two chances."""
        if not self.parts:
            return np.zeros(len(texts))
        x = np.array([features(t) for t in texts]).reshape(len(texts), -1)
        x = np.column_stack([np.clip((x - self.centre) / self.scale, -8, 8), np.ones(len(x))])
        marked = [marks(t) for t in texts]
        chance = np.zeros(len(texts))
        for learned, dense in self.parts:
            odds = np.array([learned[at] @ value for at, value in marked]) + x @ dense
            chance -= np.logaddexp(0, -np.clip(odds, -30, 30))
        chance = np.minimum(chance, -1e-13)
        return np.clip(chance - np.log(-np.expm1(chance)), -30, 30)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    known = labels.where("quality is not null and toxic is not null").groupBy(F.col(key).alias("k")).agg(F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("quality"), F.max(F.when(F.col("toxic") == 0, 0).otherwise(1)).alias("toxic"))
    few = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k").select("k", "t", "quality", "toxic").orderBy("k", "t").limit(sample).coalesce(1)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b[["t", "quality", "toxic"]] for b in batches]
        if parts:
            whole = pd.concat(parts, ignore_index=True)
            yield pd.DataFrame({"model": [pickle.dumps(Model.fit(whole["t"].tolist(), whole["quality"].to_numpy(), whole["toxic"].to_numpy()))]})

    made = rows.mapInPandas(fitted, "model binary").collect()  # texts and entries stay in the task: the driver holds the weights only
    return pickle.loads(made[0]["model"]) if made else Model.fit([], np.zeros(0), np.zeros(0))


def toxic_recall(judged: DataFrame, labels: DataFrame, by: str = "lang", key: str = "doc_id") -> DataFrame:
    """Toxic documents of ``labels`` in what ``classify`` returns, and how many of them it rejects, by language."""
    toxic = labels.where("toxic = 1").select(key).distinct()
    return judged.join(toxic, key, "left_semi").groupBy(by).agg(F.count("*").alias("toxic"), F.count_if(~F.col("keep")).alias("rejected"))


def _spread(groups: DataFrame, mean: str = "mean_above") -> float:
    """Documents that the prior of a level is worth: variance within groups over that between them."""
    g = groups.where("n > 0").agg(
        F.count("*").alias("h"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)).alias("between"),
    ).first()
    if not g["h"] or g["h"] < 2 or g["n"] <= g["h"]:
        return 1e6
    within = max(g["within"] / (g["n"] - g["h"]), 1e-9)
    per = (g["n"] - g["nn"] / g["n"]) / (g["h"] - 1)
    between = max((g["between"] / (g["h"] - 1) - within) / per, within / 1e6)
    return max(1.0, within / between)


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text: str = "text", least: float = LEAST, keep_text: bool = True) -> DataFrame:
    """``docs`` with p_document, p_host, p_path, p_good and keep (they replace columns of those names); without ``text`` if so asked."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([sent.value.log_odds(list(texts.iloc[i : i + 500])) for i in range(0, len(texts), 500)]) if len(texts) else [], dtype=float)

    odds = free_name(docs, "odds")
    scored = docs.withColumn(odds, score(F.col(text)))
    scored = staged(scored if keep_text else scored.drop(text), "quality-odds")  # both uses below read one scoring
    p = 1 / (1 + F.exp(-F.col(odds)))
    paths = staged(scored.select(F.col(host).alias("host"), F.col(path).alias("path"), odds).groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = (total[1] or 0.0) / total[0] if total[0] else 0.5
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    worth_host = _spread(hosts.withColumn("mean_above", F.lit(mean)))
    above = hosts.select(F.col("host").alias("hh"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    sites = staged(paths.join(above, F.col("host").eqNullSafe(F.col("hh"))).withColumn("mean_above", (F.col("hs") + worth_host * mean) / (F.col("hn") + worth_host)), "quality-sites")
    worth_path = _spread(sites)
    at = {x: free_name(docs, "site_" + x) for x in ("hh", "pp", "hn", "hs", "pn", "ps")}
    known = sites.select(*(F.col(c).alias(at[x]) for x, c in (("hh", "hh"), ("pp", "path"), ("hn", "hn"), ("hs", "hs"), ("pn", "n"), ("ps", "s"))))
    if sites.count() <= MAX_BROADCAST_SITES:
        known = F.broadcast(known)
    joined = scored.join(known, scored[host].eqNullSafe(known[at["hh"]]) & scored[path].eqNullSafe(known[at["pp"]]), "left")
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    logit = lambda c: F.log(c / (1 - c))
    p_host = bound((F.col(at["hs"]) - p + worth_host * mean) / (F.col(at["hn"]) - 1 + worth_host))
    p_path = bound((F.col(at["ps"]) - p + worth_path * p_host) / (F.col(at["pn"]) - 1 + worth_path))
    p_good = 1 / (1 + F.exp(-(F.col(odds) + logit(p_path) - float(np.log(mean / (1 - mean))))))
    made = {"p_document": p, "p_host": p_host, "p_path": p_path, "p_good": p_good, "keep": p_good >= least}
    others = [scored[c] for c in scored.columns if c != odds and c.lower() not in made]
    return joined.select(*others, *(c.alias(k) for k, c in made.items()))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text", "lang", "source"), model, keep_text=False).select("doc_id", "source", "lang", "p_document", "p_host", "p_path", "p_good", "keep")


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}

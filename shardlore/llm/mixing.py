"""Mixing to target weights with soft domain membership, with DataFrame expressions only.

Domains are the classes of the labels table (DOMAINS). A naive Bayes classifier over hashed words, learnt from
labelled documents, gives each document a posterior for every domain. With t tokens and posterior p, a document
kept at rate r adds r * t * p[d] to the expected tokens of domain d. Rates minimise the squared relative
distance of the targeted domains' expected totals from their targets, over r >= the least rate, by projected gradient steps: in the metric of
tokens the gradient for a document's rate is its posterior times the domains' errors, so all steps so far have moved a rate by its posterior times
one vector of a number for each domain, and the rate is the projection of that. A step is one aggregation over all documents, of their totals and
of the Gram matrix of the posteriors whose rates aren't held at their bound, which scales the step; a few numbers come to the driver. The steps run until
every targeted domain's total is within CLOSE of its target, or until the squared distance can't be lowered further, which gives a warning.

The default token budget is the least at which no domain has to shrink on average, so scarce domains are
repeated and the rest stays. copies is the rate rounded up with the probability of its fraction, decided
by a hash of the document, so the result is the same in every run.

Training: at most TRAIN_ROWS labelled rows (the documented bound of the sample), in the order of a hash of doc_id; the
model is BUCKETS numbers for each domain. Its sums of evidence are calibrated on rows that it was
not learnt from. Statistics and rates cover all documents.

Defined results: null and empty texts have no tokens, little evidence and so near the class shares as posterior, and rate 1; a null label or
a doc_id with several labels counts as its largest values; without labels all posteriors are equal; a target of
a domain that no document is in cannot be met and changes nothing; repeated rows have one rate each; an empty table stays
empty. Other columns stay; `mix` replaces columns named n_tokens, posterior, rate or copies, `decide` keeps them.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm import common

#: Domain: quality and toxic in the labels table (toxic rows are one domain whatever their quality).
DOMAINS = ("good", "poor", "toxic")
#: Target shares of tokens.
TARGETS = {"good": 0.80, "poor": 0.12, "toxic": 0.08}
TRAIN_ROWS = 12_000
BUCKETS = 16384
#: Every domain begins with so many documents of the average kind; bounds of a sum of evidence.
AVERAGE, BOUND = 20.0, 30.0
#: A bucket is evidence if so many training documents have it.
SEEN = 20
#: Characters that prose has few of.
SYMBOLS = r"[!#$%&*+/<=>@\[\]^_{|}~\\]"
#: Buckets of words, and ten for each measure of a text's shape.
ALL_BUCKETS = BUCKETS + 30
#: A step is halved at most so often, and so many steps end the search.
HALVINGS, STEPS = 12, 60
#: Weight of the rates' own change against the errors, which gives one solution where targets can't be met or can be in many ways.
DAMPING = 1e-5
#: Columns that `mix` computes.
OWN = ("n_tokens", "posterior", "rate", "copies")
#: Relative error of every targeted domain's total at which the steps end.
CLOSE = 3e-3


def words(column: str = "text") -> Column:
    """Lower-case words: runs of letters, digits and characters above 0x7F."""
    return F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def shape(column: str = "text") -> Column:
    """Three buckets after the words' ones: tenths of capitals, of symbols, and of distinct words among all (needs __words and __buckets)."""
    value = F.coalesce(column, F.lit(""))
    size = F.greatest(F.length(value), F.lit(1))

    def tenth(share: Column) -> Column:
        return F.least(F.floor(share * 10), F.lit(9)).cast("int")

    capitals = tenth(F.regexp_count(value, F.lit("[A-Z]")) / size)
    symbols = tenth(F.least(F.lit(1.0), 3 * F.regexp_count(value, F.lit(SYMBOLS)) / size))
    distinct = tenth(F.size("__buckets") / F.greatest(F.size("__words"), F.lit(1)))
    return F.array(*(F.lit(BUCKETS + 10 * k) + x for k, x in enumerate((capitals, symbols, distinct))))


def features(docs: DataFrame) -> DataFrame:
    """docs with n_tokens, the distinct buckets of words as __buckets and those of shape as __shape."""
    out = docs.withColumn("__words", words()).withColumn("n_tokens", F.size("__words").cast("bigint"))
    out = out.withColumn("__buckets", F.array_distinct(F.transform("__words", bucket)))
    return out.withColumn("__shape", shape()).drop("__words")


def domain(labels: DataFrame) -> DataFrame:
    """doc_id and domain number of labelled documents."""
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    number = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 1)
    return one.select("doc_id", number.alias("domain")).filter(F.col("domain").isNotNull())


class Classifier(NamedTuple):
    """Log likelihood ratios of the buckets against the first domain, and the calibration of their sums: rows of (1, sums over words, sums over shape)."""

    ratios: list[list[float]]
    weights: list[list[float]]


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Bucket ratios from one half of the labelled sample; their calibration, a logistic regression on the sums, from the other half."""
    sample = domain(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(7)) % 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    first = rows.filter("half = 0")
    seen = {r["domain"]: r["n"] for r in first.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [seen.get(k, 0) for k in range(len(DOMAINS))]
    counts = [[0] * ALL_BUCKETS for _ in DOMAINS]
    # A word counts once in a document. At most ALL_BUCKETS rows for each domain come back.
    # (explode() would have the buckets of all documents computed before the join, to filter out empty arrays.)
    terms = features(first).select("domain", F.explode_outer(F.concat("__buckets", "__shape")).alias("bucket"))
    for r in terms.groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect():
        counts[r["domain"]][r["bucket"]] += r["n"]
    total = sum(n)
    average = [(sum(column) + 0.5) / (total + 1) for column in zip(*counts, strict=True)]
    logs = [[math.log((c + AVERAGE * a) / (k + AVERAGE)) for c, a in zip(row, average, strict=True)] for row, k in zip(counts, n, strict=True)]
    sure = [a * (total + 1) >= SEEN for a in average]
    ratios = [[x - y if k else 0.0 for x, y, k in zip(row, logs[0], sure, strict=True)] for row in logs[1:]]
    # TRAIN_ROWS rows of a few numbers at most.
    sums = features(rows.filter("half = 1")).select("domain", *(x.alias(f"s{i}") for i, x in enumerate(_sums(ratios)))).collect()
    return Classifier(ratios, _calibrate([r[0] for r in sums], [[1.0, *r[1:]] for r in sums]))


def _calibrate(domains: list[int], inputs: list[list[float]]) -> list[list[float]]:
    """Softmax regression by gradient steps on scaled inputs; the first domain's weights are zero."""
    if not domains:
        return [[0.0] * (2 * len(DOMAINS) - 1) for _ in DOMAINS[1:]]
    x, y = np.array(inputs), np.eye(len(DOMAINS))[domains]
    scale = np.maximum(np.sqrt((x * x).mean(axis=0)), 1e-6)
    x = x / scale
    w = np.zeros((x.shape[1], len(DOMAINS)))
    w[0] = np.log((y.sum(axis=0) + 1) / (len(y) + len(DOMAINS)))
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += 0.5 * (x.T @ (y - p) / len(y) - 1e-4 * w)
    w = (w - w[:, :1]) / scale[:, None]
    return w[:, 1:].T.tolist()


def _sums(ratios: list[list[float]]) -> list[Column]:
    """The evidence of a row's buckets for each domain but the first: over words, then over shape."""
    out = []
    for buckets in ("__buckets", "__shape"):
        for ratio in ratios:
            known = F.split(F.lit(",".join(f"{r:.4g}" for r in ratio)), ",").cast("array<double>")
            out.append(F.least(F.greatest(_evidence(buckets, known), F.lit(-BOUND)), F.lit(BOUND)))
    return out


def posteriors(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs with n_tokens and posterior, an array in the order of DOMAINS.

    labelled: the documents to learn from, if they aren't docs.
    """
    model = learn(labelled if labelled is not None else docs, labels)
    out = features(docs)
    sums = [F.lit(1.0), *_sums(model.ratios)]
    out = out.withColumn("__sums", F.array(*sums))
    logits = [F.lit(0.0), *(_plus([F.lit(w) * F.col("__sums")[i] for i, w in enumerate(row)]) for row in model.weights)]
    out = out.withColumn("__logits", F.array(*logits)).withColumn("__top", F.array_max("__logits"))
    odds = F.transform("__logits", lambda x: F.exp(x - F.col("__top")))
    out = out.withColumn("__odds", odds)
    total = _plus([F.col("__odds")[k] for k in range(len(DOMAINS))])
    out = out.withColumn("posterior", F.transform("__odds", lambda x: x / total))
    return out.drop("__buckets", "__shape", "__sums", "__logits", "__top", "__odds")


def _plus(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _evidence(buckets: str, ratio: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(ratio, b))


def rates(known: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, least: float = 0.0) -> DataFrame:
    """known (n_tokens, posterior) with each document's rate.

    budget: expected tokens in all; None takes the least with which no domain shrinks. least: lower bound of the rates.
    """
    weights = [(targets or TARGETS).get(d, 0.0) for d in DOMAINS]
    begin = max(1.0, least)
    p = [F.col("posterior")[k] for k in range(len(DOMAINS))]
    natural = [begin * (x or 0.0) for x in known.agg(*(F.sum(F.col("n_tokens") * x) for x in p)).first()]
    within = [k for k, w in enumerate(weights) if w > 0 and natural[k] > 0]
    if not within:
        return known.withColumn("rate", F.lit(begin))
    share = sum(weights[k] for k in within)
    budget = budget or max(natural[k] * share / weights[k] for k in within)
    goal = np.array([budget * weights[k] / share for k in within])

    def unbounded(moved: np.ndarray) -> Column:
        return _plus([F.lit(begin), *(F.lit(float(x)) * p[k] for x, k in zip(moved / goal, within, strict=True))])

    def look(moved: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The convex function whose gradient the errors are, the relative errors of the totals, and the Gram matrix in units of the goals."""
        raw, n, t = unbounded(moved), len(within), F.col("n_tokens")
        free, now = raw >= least, F.greatest(F.lit(float(least)), raw)
        sums = [F.sum(t * F.when(free, raw * raw / 2).otherwise(raw * least - least * least / 2))]
        sums += [F.sum(t * now * p[k]) for k in within]
        sums += [F.sum(F.when(free, t * p[j] * p[k]).otherwise(0.0)) for j in within for k in within]
        got = np.array(known.agg(*sums).first(), float)
        value = got[0] - moved.sum() + damping / 2 * (moved @ moved)
        return value, got[1 : n + 1] / goal - 1, got[n + 1 :].reshape(n, n) / np.outer(goal, goal)

    damping = DAMPING / goal.max()
    moved = np.zeros(len(within))
    value, error, gram = look(moved)
    for _ in range(STEPS):
        slope = error + damping * moved
        if min(np.abs(error).max(), 10 * np.abs(slope).max()) < CLOSE:
            break
        step = -np.linalg.solve(gram + damping * np.eye(len(within)), slope)
        for _ in range(HALVINGS):
            there = look(moved + step)
            if there[0] <= value + 1e-4 * (step @ slope):
                break
            step = step / 2
        else:
            break
        moved, (value, error, gram) = moved + step, there
    if np.abs(error).max() >= CLOSE:
        warnings.warn(f"mixing: targets missed by {', '.join(f'{DOMAINS[k]} {e:+.2%}' for k, e in zip(within, error, strict=True))}", stacklevel=2)
    return known.withColumn("rate", F.greatest(F.lit(float(least)), unbounded(moved)))


def mix(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, drop: tuple[str, ...] = (), **options) -> DataFrame:
    """docs with n_tokens, posterior, rate and copies, without the columns in drop; options as for `rates`."""
    chance = F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    docs, back = common.aside(docs.drop(*OWN), OWN)
    # Written once, so that the texts are split once.
    known = common.stage(posteriors(docs.withColumn("__chance", chance), labels, labelled).drop(*drop), "posteriors")
    out = rates(known, **options).withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("rate")).otherwise(1.0))
    return back(out.withColumn("copies", F.floor(F.col("rate") + F.col("__chance")).cast("int")).drop("__chance"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's tokens, domain posteriors, rate and copies."""
    done = mix(docs.select("doc_id", "text"), labels, drop=("text",))
    shares = [F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return done.select("doc_id", "n_tokens", *shares, "rate", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: rates of all documents for the default targets."""
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def decide(docs: DataFrame, labels: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of docs, as often as their copies say. No rate is below 1 here, so every document stays."""
    aside, back = common.aside(docs, OWN)
    done = mix(aside, labels, labelled, targets={"good": 0.85, "poor": 0.15}, least=1.0)
    copy = common.unused(done, "copy")
    return back(done.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*aside.columns))

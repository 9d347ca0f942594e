"""Mixing documents to target weights of domains with soft membership, in DataFrame operations only.

1. A labelled table names domains. A naive Bayes classifier is fitted on at most TRAIN_DOCS labelled documents: its
   features are the FEATURES words and shapes of the text (shares of capitals, of symbols, of distinct words) that
   tell most about the domain; the absence of those that few documents have counts too. It predicts each document's
   domain posteriors p_k.
2. Rates r_d >= 0 are fitted so that expected domain totals sum(r_d * tokens_d * p_dk) match target_k, by projected
   gradient descent on least squares: starting from 1, r_d <- max(0, r_d - sum_k p_dk g_k), where g = H^-1 (total -
   target) and H_jk = sum(tokens_d p_dj p_dk). Distances between rates are weighted by tokens, and so scaled by H,
   steps of 1 never overshoot, as the rates that are above 0 can only lessen H. Each step is one aggregation over all
   documents; the driver sees the domain totals only.

The steps' residuals are all a rate depends on besides its own posteriors, so rates are never stored or shuffled.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.llm.common import fresh, staged

TRAIN_DOCS, FEATURES = 10_000, 64
#: Features in at most this share of the documents also count where they lack.
RARE = 0.25
#: Steps stop within the tolerance, or with a warning after so many or where they move nothing; the rows are whole either way.
STEPS, TOLERANCE = 100, 1e-4
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.85, "low": 0.10, "toxic": 0.05}


def label_domain() -> F.Column:
    """The domain of a row of labels; null for a row without any."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "low")


def words_of(text: F.Column) -> F.Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bound(value: F.Column, use) -> F.Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def features_of(text_col: str) -> F.Column:
    """A text's words and its shapes, such as '\tcapitals=3'; no word holds a tab."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    capitals = F.least(F.lit(20), F.floor(50 * F.regexp_count(text, F.lit("[A-Z]")) / length))
    symbols = F.least(F.lit(9), F.floor(100 * F.regexp_count(text, F.lit("[#*$%&|<>!]")) / length))

    def with_shapes(words: F.Column) -> F.Column:
        distinct = F.floor(10 * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))
        shapes = {"capitals": capitals, "symbols": symbols, "distinct": distinct}
        return F.concat(words, F.array(*(F.concat(F.lit(f"\t{n}="), v.cast("string")) for n, v in shapes.items())))

    return bound(words_of(F.lower(text)), with_shapes)


class Classifier:
    """Naive Bayes on the presence of features: per domain its share, and how likely it holds each feature."""

    def __init__(self, domains: list[str], docs: dict[str, int], rows: list[tuple[str, dict[str, int]]]) -> None:
        self.domains = domains
        total = sum(docs.get(d, 0) for d in domains)
        self.words = [w for w, _ in rows]
        share = [[(n.get(d, 0) + 0.5) / (docs.get(d, 0) + 1) for d in domains] for _, n in rows]
        rare = [sum(n.values()) <= RARE * total for _, n in rows]
        lacks = [[math.log(1 - p) if r else 0.0 for p in ps] for ps, r in zip(share, rare, strict=True)]
        self.start = [math.log((docs.get(d, 0) + 0.5) / (total + 0.5 * len(domains))) + sum(x[k] for x in lacks) for k, d in enumerate(domains)]
        self.weight = [[math.log(p) - x for p, x in zip(ps, xs, strict=True)] for ps, xs in zip(share, lacks, strict=True)]

    def posteriors(self, features: F.Column) -> F.Column:
        """An array of one probability for each domain."""
        k = range(len(self.domains))
        start = F.array(*(F.lit(float(x)) for x in self.start))
        scores = start
        if self.words:
            names = F.array(*(F.lit(w) for w in self.words))
            table = F.from_json(F.lit(str(self.weight)), T.ArrayType(T.ArrayType(T.DoubleType())))
            present = F.transform(F.array_intersect(names, features), lambda w: F.element_at(table, F.array_position(names, w).cast("int")))
            scores = F.aggregate(present, start, lambda a, w: F.array(*(a[i] + w[i] for i in k)))

        def shares(s: F.Column) -> F.Column:
            powers = [F.exp(F.greatest(s[i] - F.array_max(s), F.lit(-700.0))) for i in k]
            return bound(F.array(*powers), lambda p: F.transform(p, lambda x: x / sum((p[i] for i in k), F.lit(0.0))))

        return bound(scores, shares)


def fit(docs: DataFrame, labels: DataFrame, domain: F.Column, domains: list[str], id_col: str, text_col: str, train_docs: int) -> Classifier:
    """From at most train_docs labelled documents, those with the smallest hashes of their ids; one label for each (the first by name)."""
    known = labels.filter(F.col(id_col).isNotNull()).select(id_col, domain.alias("__domain")).filter(F.col("__domain").isin(domains))
    chosen = known.groupBy(id_col).agg(F.min("__domain").alias("__domain")).orderBy(F.xxhash64(id_col), id_col).limit(train_docs)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    counted = rows.select("__domain", F.explode(F.array_append(F.array_distinct(features_of(text_col)), F.lit("\t"))).alias("w")).groupBy("w", "__domain").agg(F.count("*").alias("n"))
    wide = counted.groupBy("w").agg(*(F.coalesce(F.sum(F.when(F.col("__domain") == d, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(domains)))
    wide = staged(wide.withColumn("n", sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))), "features")
    docs_of = wide.filter(F.col("w") == "\t").first()
    sizes = {d: docs_of[f"n{i}"] if docs_of else 0 for i, d in enumerate(domains)}
    total = max(1, sum(sizes.values()))

    def part(joint, side: int, other) -> F.Column:
        """joint * log(joint / (side * other)) as shares of all documents; 0 where joint is."""
        return F.when(joint > 0, joint / total * F.log(joint * total / (F.lit(float(max(1, side))) * other))).otherwise(0.0)

    about = sum((part(F.col(f"n{i}"), sizes[d], F.col("n")) + part(sizes[d] - F.col(f"n{i}"), sizes[d], F.lit(total) - F.col("n")) for i, d in enumerate(domains)), F.lit(0.0))
    top = wide.filter(F.col("w") != "\t").filter(F.col("n") < total).orderBy(F.desc(F.round(about, 12)), "w").limit(FEATURES).collect()
    return Classifier(domains, sizes, [(r["w"], {d: r[f"n{i}"] for i, d in enumerate(domains)}) for r in top])


def rate_of(p: F.Column, steps: list[list[float]]) -> F.Column:
    """A document's rate after the steps so far, from its posteriors."""
    if not steps:
        return F.lit(1.0)
    k = range(len(steps[0]))
    table = F.from_json(F.lit(str(steps)), T.ArrayType(T.ArrayType(T.DoubleType())))
    return F.aggregate(table, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - sum((p[i] * g[i] for i in k), F.lit(0.0))))


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    targets: dict[str, float] | None = None,
    anchor: tuple[str, float] | None = None,
    domain: F.Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_docs: int = TRAIN_DOCS,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """The kept columns, n_tokens, p_<domain> for each domain, rate, copies.

    targets: each domain's share of the budget, which is the sum of all tokens. anchor (domain, factor) scales all rates
    so that a document which surely belongs to that domain gets the rate factor; shares stay as they are. copies: how often to take the document, rate rounded up or
    down by a hash of its id and text, so that its mean is the rate. A null text has no tokens and the posteriors of
    an empty one. A domain without any mass cannot meet its target and is left alone; no labels: equal posteriors.
    Totals that have not met their targets when steps move nothing more, or after STEPS steps, give a warning that states both.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    names = {n: (names or {}).get(n, n) for n in ["n_tokens", "rate", "copies", *(f"p_{d}" for d in domains)]}
    model = fit(docs, labels, label_domain() if domain is None else domain, domains, id_col, text_col, train_docs)
    p, tokens = fresh("mix_p", docs.columns), fresh("mix_tokens", docs.columns)
    coin = fresh("mix_coin", docs.columns)
    words = words_of(F.col(text_col))
    table = docs.select(*keep, F.size(words).cast("long").alias(tokens), model.posteriors(features_of(text_col)).alias(p), ((F.xxhash64(id_col, text_col) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000).alias(coin))
    table = staged(table, "posteriors")

    def totals(rate: F.Column) -> list[float]:
        row = table.agg(*(F.sum(F.col(tokens) * rate * F.col(p)[i]) for i in range(len(domains)))).first()
        return [x or 0.0 for x in row]

    k = range(len(domains))
    pairs = table.agg(*(F.sum(F.col(tokens) * F.col(p)[i] * F.col(p)[j]) for i in k for j in k)).first()
    curve = np.array([x or 0.0 for x in pairs]).reshape(len(domains), -1)
    curve += np.eye(len(domains)) * max(1e-9 * np.trace(curve), 1e-300)
    mass = totals(F.lit(1.0))
    budget = sum(mass)
    share = sum(targets.values())
    wanted = [budget * targets[d] / share for d in domains]
    steps: list[list[float]] = []
    now = mass
    last = None
    while budget:
        gap = np.array([n - w if m > 1e-9 * budget else 0.0 for n, w, m in zip(now, wanted, mass, strict=True)])
        if abs(gap).max() <= TOLERANCE * budget:
            break
        # a step that moves no total has reached the least squares that rates above 0 can give
        if len(steps) == STEPS or last is not None and np.abs(np.subtract(now, last)).max() <= 1e-3 * TOLERANCE * budget:
            warnings.warn(f"domain totals {now} after {len(steps)} steps, wanted {wanted}", stacklevel=2)
            break
        steps.append([float(x) for x in np.linalg.solve(curve, gap)])
        last, now = now, totals(rate_of(F.col(p), steps))
    scale = 1.0
    if anchor:
        pure = 1.0
        for g in steps:
            pure = max(0.0, pure - g[domains.index(anchor[0])])
        scale = anchor[1] / pure if pure > 0 else 1.0
    rate = rate_of(F.col(p), steps) * scale
    out = table.withColumn(names["rate"], rate)
    copies = F.floor(F.col(names["rate"])) + (F.col(coin) < F.col(names["rate"]) - F.floor(names["rate"])).cast("long")
    return out.select(*keep, F.col(tokens).alias(names["n_tokens"]), *(F.col(p)[i].alias(names[f"p_{d}"]) for i, d in enumerate(domains)), names["rate"], copies.cast("long").alias(names["copies"]))

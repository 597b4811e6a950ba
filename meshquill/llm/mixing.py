"""Mixing to target weights: soft domain membership and document rates.

Log ratios of document frequencies of words, from a bounded sample of the
labelled table, add up to evidence for each domain; calibrated on the part that
made no weights, it gives every document posteriors over the domains. With a(i, d) = tokens(i)
p(d | i), projected-gradient least squares seeks rates r(i) >= 0 near 1 with
sum_i r(i) a(i, d) = target(d):

    r(i) = max(0, 1 - p(i) s),    s <- s + h M (A r - T)

The steps s add up before the projection, so what is clipped in one round can
return in the next; deviations from 1 are weighted by tokens, so that a rate
follows a document's domains and not its length. M is the inverse of
sum_i tokens(i) p(i) p(i)' over the rows with a positive rate, or over all rows,
where a full step always lowers the value of the (dual) problem. A round is two
aggregations over the stored posteriors: their result is a few numbers a domain,
and a rate is a function of its document's posteriors and s.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, stored, words_col
from .training import bounded_ids

#: Bound of the labelled sample; likelihood ratio and documents from which a
#: feature has weight.
MAX_LABELLED, MIN_G2, MIN_DOCS = 4000, 10.0, 3
NEVER = -1e6
#: Error at which the fit ends and from which a domain counts as short, as shares
#: of the largest target; relative gain of a round at which the fit stands still.
TOLERANCE, SHORT, STILL = 1e-6, 1e-4, 1e-13
#: Weight that keeps steps finite for targets out of reach; lengths of a step.
EASE, LENGTHS = 1e-10, (64.0, 16.0, 4.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)
#: Production targets: shares of the expected tokens.
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def domain_col(quality: Column, toxic: Column) -> Column:
    """Domain of a label row; null where a label is missing."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) & (toxic == 0), "clean")


def _features(words: Column) -> Column:
    """Distinct words of a lower-cased text, their last two characters, and the
    empty feature, that every document has."""
    return let(F.array_distinct(words), lambda w: F.concat(w, F.array_distinct(F.transform(w, lambda x: F.concat(F.lit("-"), F.right(x, F.lit(2))))), F.array(F.lit(""))))


def _fold(first: bool) -> Column:
    """Two thirds of the sample make the weights, the rest calibrates."""
    other = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    return ~other if first else other


def fit_weights(docs: DataFrame, sample: DataFrame, names: list[str], id_col: str, text_col: str) -> tuple[np.ndarray, DataFrame]:
    """(documents of each domain, table of x and weights w).

    A feature's weight for a domain is the log ratio of its document frequency
    there to that in the other domains, where the likelihood ratio of the two
    is at least MIN_G2; else 0.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample.filter(_fold(True))), "doc_id")
    sizes = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = np.array([sizes.get(d, 0) for d in names], float)
    every = float(n.sum())
    seen = own.select("domain", F.explode(_features(words_col(F.lower("text")))).alias("x"))
    counts = seen.groupBy("x").agg(F.count("*").cast("double").alias("c"), *[F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"c{i}") for i, d in enumerate(names)])
    q = (F.col("c") + 0.5) / (every + 1)
    weights = []
    for i, size in enumerate(n.tolist()):
        have, rest = F.col(f"c{i}"), F.col("c") - F.col(f"c{i}")
        part = lambda o, of: F.when(o > 0, o * F.log(o * every / (F.col("c") * of))).otherwise(0.0)
        ratio = F.log((have + q) / (size + 1)) - F.log((rest + q) / (every - size + 1))
        weights.append(F.when(2 * (part(have, size) + part(rest, every - size)) >= MIN_G2, ratio).otherwise(0.0) if 0 < size < every else F.lit(0.0))
    told = counts.filter((F.col("c") >= MIN_DOCS) & (F.col("x") != "")).select("x", F.array(*weights).alias("w")).filter(F.exists("w", lambda v: v != 0))
    blank = docs.sparkSession.createDataFrame([("", [0.0] * len(names))], "x string, w array<double>")
    return n, stored(told.unionByName(blank), "weights")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(evidence: np.ndarray, domain: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, offsets) of softmax(evidence @ slopes + offsets), by penalised
    likelihood on labelled documents that made no weights."""
    k, offsets = len(prior), prior.copy()
    if len(domain) < 30 or len(set(domain.tolist())) < 2:
        return 0.1 * np.eye(k), offsets
    hot, alive = np.eye(k)[domain], prior > NEVER / 2
    scale = np.maximum(evidence.std(0), 1e-9)
    x, a = evidence / scale, np.zeros((k, k))
    for _ in range(3000):
        off = softmax(np.where(alive, x @ a + offsets, NEVER)) - hot
        a = a - 0.5 * (x.T @ off / len(x) + 1e-3 * a)
        offsets = np.where(alive, offsets - 0.5 * off.mean(0), NEVER)
    return a / scale[:, None], offsets


def posteriors(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text_key, n_tokens, p``: words of the whole text, and the
    calibrated posterior of each domain in the order of names."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_col(F.col("quality"), F.col("toxic")).alias("domain"))
    domains = own.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    sample = bounded_ids(domains, max_labelled)
    sizes, weights = fit_weights(docs, sample, names, id_col, text_col)
    # a domain without a sample has no members, unless no domain has one
    prior = np.where(sizes > 0, np.log(np.maximum(sizes, 1) / max(sizes.sum(), 1)), NEVER if sizes.sum() else 0.0)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), let(words_col(F.lower(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _features(w).alias("f"))).alias("t"))
    placed = texts.select("row", "doc_id", "text_key", F.col("t.n").alias("n_tokens"), F.explode("t.f").alias("x"))
    sums = placed.join(F.broadcast(weights), "x").groupBy("row", "doc_id", "text_key", "n_tokens").agg(*[F.sum(F.col("w")[d]).alias(f"s{d}") for d in range(len(names))])
    told = stored(sums.select("doc_id", "text_key", "n_tokens", F.array(*[f"s{d}" for d in range(len(names))]).alias("e")), "evidence")
    rows = told.join(F.broadcast(sample.filter(_fold(False))), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "e", "domain").collect()
    rows.sort(key=lambda r: r["doc_id"])
    slopes, offsets = calibrate(np.array([r["e"] for r in rows]).reshape(-1, len(names)), np.array([names.index(r["domain"]) for r in rows], int), prior)
    logits = F.array(*[sum((F.col("e")[i] * float(v) for i, v in enumerate(slopes[:, d])), F.lit(float(offsets[d]))) for d in range(len(names))])
    shifted = let(logits, lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))
    p = let(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))
    return told.select("doc_id", "text_key", "n_tokens", p.alias("p"))


def _rate(steps: np.ndarray, p: Column) -> Column:
    """The rate after steps that add up to the given ones."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((float(x) * p[d] for d, x in enumerate(steps)), F.lit(0.0)))


def fit_rates(members: DataFrame, targets: dict[str, float], tokens: float | None = None) -> tuple[DataFrame, dict]:
    """members with ``rate``, and a report of totals, targets and rounds.

    targets are shares by domain, in the order of members' p. tokens is the
    wanted total; by default as many as let the domain with the largest share
    keep all its tokens; a domain below its share of them is raised.
    A round tries several lengths of its step and takes the one of least value.
    Ends at the target, or where no step lowers the value by STILL of it: then
    targets are out of reach, and the report's ``short`` says by how much.
    """
    k = len(targets)
    share = np.array(list(targets.values()), float) / sum(targets.values())
    mass = [F.col("n_tokens") * F.col("p")[d] for d in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))

    def look(steps):
        """Totals by domain and Gram matrix of the rows with a positive rate."""
        row = members.withColumn("_r", _rate(steps, F.col("p"))).agg(*[total(F.col("_r") * a).alias(f"a{d}") for d, a in enumerate(mass)], *[total(F.when(F.col("_r") > 0, mass[i] * F.col("p")[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
        return np.array([row[f"a{d}"] for d in range(k)]), np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    steps, rounds = np.zeros(k), 0
    got, gram = look(steps)
    have, every = got, gram
    big = int(share.argmax())
    want = share * (have[big] / share[big] if tokens is None else tokens)
    solve = lambda m, x: np.linalg.pinv(m, rcond=1e-15, hermitian=True) @ x
    soft = EASE * every
    while np.abs(got - want).max() > TOLERANCE * max(want.max(), 1.0):
        slope = got - want - soft @ steps
        trials = [steps, steps + solve(every, slope), *[steps + h * solve(gram + soft, slope) for h in LENGTHS]]
        row = members.agg(*[total(F.col("n_tokens") * _rate(t, F.col("p")) ** 2).alias(f"v{i}") for i, t in enumerate(trials)]).first()
        value = [row[f"v{i}"] / 2 + want @ t + t @ soft @ t / 2 for i, t in enumerate(trials)]
        best = int(np.argmin(value))
        if value[0] - value[best] <= STILL * abs(value[0]):
            break
        steps, rounds = trials[best], rounds + 1
        got, gram = look(steps)
    report = {"have": have.tolist(), "want": want.tolist(), "got": got.tolist(), "rounds": rounds}
    report["short"] = {d: float(w - g) for d, w, g in zip(targets, want, got) if abs(w - g) > SHORT * max(want.max(), 1.0)}
    return members.withColumn("rate", _rate(steps, F.col("p"))), report


def copies_col(rate: Column, doc_id: Column, text_key: Column, seed: int = 1) -> Column:
    """Whole copies with the rate as expectation: the remainder is drawn by a hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), doc_id, text_key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + u).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text_key, n_tokens, p_<domain>..., rate, copies`` of every document.

    Labels teach only through at most ``max_labelled`` rows (least id hash),
    none of them held out. Null and empty texts have no tokens and keep rate 1.
    Labels with a null id or value do not count; of contradicting ones the last
    by name wins. A domain that cannot be met is left short, with a warning that
    says by how much; without any label all domains are equally likely. Repeated documents each give a row, with the same rate and copies.
    Other columns are ignored, whatever their names.
    """
    names = list(targets)
    members = stored(posteriors(docs, labels, names, id_col, text_col, max_labelled), "members")
    rated, report = fit_rates(members, targets, tokens)
    if report["short"]:
        warnings.warn(f"mixing: targets out of reach, tokens short by domain: {report['short']} of {dict(zip(names, report['want']))}", stacklevel=2)
    columns = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(names)]
    return rated.select("doc_id", "text_key", "n_tokens", *columns, "rate", copies_col(F.col("rate"), F.col("doc_id"), F.col("text_key")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every row as many times as its copies say."""
    plan = stored(mix(docs, labels, targets, tokens, id_col, text_col), "plan").filter("copies <> 1")
    d, k, n = fresh(docs, "d", "k", "n")
    plan = plan.select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("copies").alias(n)).dropDuplicates([d, k])
    joined = docs.join(plan, docs[id_col].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(k)), "left")
    times = F.array_repeat(F.lit(1), F.coalesce(F.col(n), F.lit(1)).cast("int"))
    return joined.withColumn(n, F.explode(times)).select(*docs.columns)

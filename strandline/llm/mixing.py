"""Mixing documents to target weights of soft domains, with DataFrame functions only.

A classifier learns domains from a labelled table and gives every document a
posterior for each. Then each document gets a nonnegative *rate*, the expected number of times it
is used, so that the expected tokens of every domain, rate x tokens x posterior
summed over all documents, match their targets.

Classifier: naive Bayes on hashed words, whole ones between white space. Its tables are one row of a written table that
plans refer to by a scalar subquery. A document's summed log-odds are scaled by a power
of its length and a factor, both picked by log-likelihood on labelled rows that the word
counts have not seen. It is a projection: no shuffle, whatever the text's length.

Rates: projected gradient steps for the least squares of relative misses. The gradient of
a row is the product of its posteriors with the domains' misses; it is scaled by the inverse of
the D x D Gram matrix of rows above the bound, which makes a step exact while no row meets
the bound. A step is one aggregate over the narrow table of tokens and posteriors, and sends
sums to the driver only; ``STEPS`` at most, and the largest relative miss that is left is reported as ``residual``. A row's rate follows from its posteriors and the D numbers of each step.

Defined cases: null and empty texts have no tokens, the prior as posterior, and a rate like others; labels with a
null id or domain are not used, of several for an id the greatest counts; without labels there is
one domain; a domain without mass can't be moved and keeps its miss; a null id is hashed like a value; repeated rows have
equal rates and copies; an empty table gives an empty result; extra columns are ignored (or
pass through, in :func:`mixed`). The classifier reads at most ``SAMPLE`` labelled rows,
those with the smallest hashed ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

SAMPLE, BUCKETS, STEPS, TOLERANCE = 8000, 8192, 25, 1e-6
#: Default share of tokens by domain.
WEIGHTS = {"0": 0.125, "1": 0.875}
_POWERS, _FACTORS = (0.0, 0.5, 1.0), (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


@dataclass
class Classifier:
    """Log priors of domains, the scale, and a table of one row: log-odds by bucket of each domain but the first against that (o1, ...)."""

    domains: list[str]
    priors: list[float]
    odds: DataFrame | None = None
    power: float = 0.0
    factor: float = 1.0


def _parts(text: Column) -> Column:
    """The words of a text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def token_count(text: Column) -> Column:
    """Runs of characters between white space; none in an empty text."""
    return F.size(_parts(text)).cast("long")


def _with_sums(docs: DataFrame, text_col: str, odds: DataFrame) -> DataFrame:
    """``docs`` with the words' summed log-odds of each domain but the first (__s1, ...)."""
    names = odds.columns
    held = docs.withColumns({"__words": _parts(F.col(text_col))} | {f"__{c}": odds.select(c).scalar() for c in names})

    def summed(name: str) -> Column:
        return F.aggregate("__words", F.lit(0.0), lambda total, word: total + F.get(F.col(f"__{name}"), _bucket(word)))

    sums = {f"__s{c[1:]}": summed(c) for c in names}
    return held.withColumns(sums).drop("__words", *(f"__{c}" for c in names))


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    weights = [F.exp(s - top) for s in scores]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return [w / total for w in weights]


def _scores(sums: list[Column], tokens: Column, priors: list[float], power: float, factor: float) -> list[Column]:
    scale = F.lit(factor) * F.pow(F.greatest(tokens, F.lit(1)).cast("double"), F.lit(power - 1.0))
    return [F.lit(priors[0]), *(F.lit(p) + s * scale for p, s in zip(priors[1:], sums, strict=True))]


def fit(docs: DataFrame, labels: DataFrame, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier of the domains that ``domain``, a column over ``labels``, names; the quality mark by default."""
    domain = F.col("quality") if domain is None else domain
    marks = labels.select(F.col(id_col).alias("id"), domain.cast("string").alias("domain")).where("id is not null and domain is not null")
    marks = marks.groupBy("id").agg(F.max("domain").alias("domain")).join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    some = common.table(marks.orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "marks")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = common.table(texts.join(F.broadcast(some), "id").withColumn("half", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2))), "labelled")
    share = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    if not share:
        return Classifier(["all"], [0.0])
    domains = sorted(share)
    total = sum(share.values())
    out = Classifier(domains, [math.log(share[d] / total) for d in domains])
    if len(domains) == 1:
        return out
    counts = rows.select("half", "domain", F.explode(_parts(F.col("text"))).alias("w")).groupBy("half", "domain", _bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))
    counts = common.table(counts, "counts", 1)  # at most 2 x domains x BUCKETS rows
    halves = [_odds(counts.where("half = 0"), domains), _odds(counts, domains)]
    tested = _with_sums(rows.where("half = 1"), "text", halves[0])
    tested = common.table(tested.select("domain", token_count(F.col("text")).alias("tokens"), *[F.col(f"__s{i}").alias(f"s{i}") for i in range(1, len(domains))]), "tested")
    sums = [F.col(f"s{i}") for i in range(1, len(domains))]
    likely = []
    for power in _POWERS:
        for factor in _FACTORS:
            posts = _softmax(_scores(sums, F.col("tokens"), out.priors, power, factor))
            own = posts[0]
            for d, p in zip(domains[1:], posts[1:], strict=True):
                own = F.when(F.col("domain") == d, p).otherwise(own)
            likely.append(F.sum(F.log(F.greatest(own, F.lit(1e-9)))))
    values = tested.agg(*[x.alias(f"l{i}") for i, x in enumerate(likely)]).first()
    best = max(range(len(likely)), key=lambda i: values[i] if values[i] is not None else -math.inf)
    out.power, out.factor = _POWERS[best // len(_FACTORS)], _FACTORS[best % len(_FACTORS)]
    out.odds = halves[1]
    return out


def _odds(counts: DataFrame, domains: list[str]) -> DataFrame:
    """The classifier's table from (domain, bucket, n): half a count more for each bucket."""
    spark = counts.sparkSession
    by_domain = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    all_buckets = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").groupBy("bucket").agg(*by_domain)
    wholes = [F.sum(f"n{i}").alias(f"t{i}") for i in range(len(domains))]
    row = all_buckets.agg(F.sort_array(F.collect_list(F.struct("bucket", *(f"n{i}" for i in range(len(domains)))))).alias("held"), *wholes)

    def log(x: Column, i: int) -> Column:
        return F.ln((x[f"n{i}"] + 0.5) / (F.col(f"t{i}") + 0.5 * BUCKETS))

    def against_first(i: int) -> Column:
        return F.transform("held", lambda x: log(x, i) - log(x, 0)).alias(f"o{i}")

    return common.table(row.select(*[against_first(i) for i in range(1, len(domains))]), "odds", 1)


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with a posterior for each domain (__p0, ...)."""
    if len(model.domains) == 1:
        return docs.withColumn("__p0", F.lit(1.0))
    found = _with_sums(docs, text_col, model.odds)
    sums = [f"__s{i}" for i in range(1, len(model.domains))]
    posts = _softmax(_scores([F.col(c) for c in sums], token_count(F.col(text_col)), model.priors, model.power, model.factor))
    return found.withColumns({f"__p{i}": p for i, p in enumerate(posts)}).drop(*sums)


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system; unknowns without a pivot are 0."""
    n = len(right)
    rows = [list(r) + [x] for r, x in zip(matrix, right, strict=True)]
    least = 1e-12 * max((abs(matrix[i][i]) for i in range(n)), default=0.0)
    done: list[int] = []
    for k in range(n):
        pivot = max((i for i in range(n) if i not in done), key=lambda i: abs(rows[i][k]))
        if abs(rows[pivot][k]) <= least:
            continue
        done.append(pivot)
        rows[pivot].append(k)
        for i in range(n):
            if i != pivot:
                f = rows[i][k] / rows[pivot][k]
                for j in range(n + 1):
                    rows[i][j] -= f * rows[pivot][j]
    out = [0.0] * n
    for i in done:
        k = rows[i][n + 1]
        out[k] = rows[i][n] / rows[i][k]
    return out


@dataclass
class Plan:
    """Targets, and the start and steps that a row's rate follows from."""

    targets: list[float]
    totals: list[float]
    start: float
    least: float
    steps: list[list[float]]
    residual: float = 0.0

    def rate(self, posts: list[Column]) -> Column:
        rate = F.lit(max(self.start, self.least))
        for step in self.steps:
            move = F.lit(0.0)
            for y, p in zip(step, posts, strict=True):
                move = move + F.lit(y) * p
            rate = F.greatest(F.lit(self.least), rate - move)
        return rate


def fit_rates(table: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, least: float = 0.0) -> Plan:
    """Rates for a written table (tokens, p0, p1, ...).

    ``total`` tokens are aimed at; by default the fewest with which no domain shrinks.
    """
    n = len(domains)
    posts = [F.col(f"p{i}") for i in range(n)]
    tokens = F.col("tokens").cast("double")
    now = table.agg(*[F.coalesce(F.sum(tokens * p), F.lit(0.0)).alias(f"n{i}") for i, p in enumerate(posts)]).first()
    now = [float(x) for x in now]
    share = [weights.get(d, 0.0) for d in domains]
    share = [w / sum(share) for w in share] if sum(share) > 0 else [1 / n] * n
    if total is None:
        total = max((x / w for x, w in zip(now, share, strict=True) if w > 0), default=0.0)
    targets = [w * total for w in share]
    whole = sum(now)
    plan = Plan(targets, now, total / whole if whole else 1.0, least, [])
    scale = [max(t, 1.0) for t in targets]
    best: tuple[float, int, list[float]] | None = None
    for _ in range(STEPS):
        rate = plan.rate(posts)
        free = F.when(rate > least, 1.0).otherwise(0.0)
        wanted = [F.sum(rate * tokens * p) for p in posts] + [F.sum(free * tokens * posts[i] * posts[j]) for i in range(n) for j in range(i, n)]
        got = [float(x or 0.0) for x in table.agg(*[x.alias(f"v{i}") for i, x in enumerate(wanted)]).first()]
        miss = [(x - t) / s for x, t, s in zip(got[:n], targets, scale, strict=True)]
        size = math.sqrt(sum(m * m for m in miss))
        if best is None or size < best[0]:
            best = (size, len(plan.steps), got[:n])
        if size < TOLERANCE or not whole:
            break
        if size > 4 * best[0] and len(plan.steps):
            plan.steps[-1] = [y / 2 for y in plan.steps[-1]]  # too far: half the step
            continue
        gram, at = [[0.0] * n for _ in range(n)], n
        for i in range(n):
            for j in range(i, n):
                gram[i][j] = gram[j][i] = got[at] / (scale[i] * scale[j])
                at += 1
        for i in range(n):
            gram[i][i] *= 1 + 1e-9
        step = _solved(gram, miss)
        plan.steps.append([y / s for y, s in zip(step, scale, strict=True)])
    del plan.steps[best[1] :]
    plan.totals = best[2]
    plan.residual = max((abs(x - t) / s for x, t, s in zip(best[2], targets, scale, strict=True)), default=0.0) if whole else 0.0
    return plan


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, tokens, domain, posterior, rate, copies, residual): the likeliest domain and its posterior, for each row; the fit's largest relative miss."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    table, plan, posts = _fitted(docs, model, weights or WEIGHTS, total, least, id_col, text_col)
    top = F.greatest(*posts) if len(posts) > 1 else posts[0]
    name = F.lit(model.domains[0])
    for d, p in list(zip(model.domains, posts, strict=True))[1:]:
        name = F.when(p == top, F.lit(d)).otherwise(name)
    return table.select(F.col("id").alias(id_col), "tokens", name.alias("domain"), top.alias("posterior"), plan.rate(posts).alias("rate"), F.floor(plan.rate(posts) + F.col("chance")).cast("long").alias("copies"), F.lit(plan.residual).alias("residual"))


def _fitted(docs: DataFrame, model: Classifier, weights: dict[str, float], total: float | None, least: float, id_col: str, text_col: str, carried: list[str] | None = None):
    """(written table of tokens, posteriors and the ``carried`` columns, as __own0, ..., plan, posterior columns)."""
    chance = F.pmod(F.xxhash64(id_col, text_col, F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    others = [F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(carried or [])]
    own = with_posteriors(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), chance.alias("chance"), *others), model, "__text")
    posts = [F.col(f"__p{i}").alias(f"p{i}") for i in range(len(model.domains))]
    table = common.table(own.select("id", token_count(F.col("__text")).alias("tokens"), "chance", *posts, *[f"__own{i}" for i in range(len(others))]), "posteriors")
    plan = fit_rates(table, model.domains, weights, total, least)
    return table, plan, [F.col(f"p{i}") for i in range(len(model.domains))]


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says, rounded by the hash of its id and text.

    Rows are written once beside their posteriors, so that the classifier runs once over the texts.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    table, plan, posts = _fitted(docs, model, weights or WEIGHTS, total, least, id_col, text_col, docs.columns)
    times = table.withColumn("__copies", F.floor(plan.rate(posts) + F.col("chance")).cast("long")).where("__copies > 0")
    copies = times.withColumn("__copy", F.explode(F.expr("sequence(1L, __copies, 1L)")))
    return copies.select(*[F.col(f"__own{i}").alias(c) for i, c in enumerate(docs.columns)])

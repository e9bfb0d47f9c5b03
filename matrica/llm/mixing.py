"""Mixing sources to target shares of tokens: soft domain membership, projected-gradient rates, whole copies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.llm.encoding import TOKENIZERS, load_codec
from matrica.session import cut_lineage

#: Hash buckets of token ids that the domain classifier counts.
BUCKETS = 8192
#: Regularisation and iterations of the classifier.
REGULAR, FITS = 0.003, 25
#: Labelled documents of a source that the classifier is fitted on, at most in expectation.
SAMPLE_PER_SOURCE = 300
#: Levels of a posterior's key: documents of one key share a rate, while their exact posteriors are summed.
LEVELS = 16
#: Steps of the projected gradient at most, the relative residual at which it stops, and the steps without a better one
#: (by that share of it) after which it does.
STEPS, CLOSE, STALLED = 30, 1e-3, 5
#: Bins of one pass of the rounding threshold; two passes resolve their square.
BINS = 4096


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


class DomainClassifier:
    """Logistic model over the hashed token ids that a text has, with the sources' shares of all documents as prior."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, prior: np.ndarray) -> None:
        self.weights = weights.T.astype(np.float32)
        self.bias = bias + np.log(np.maximum(prior, 1e-12))

    def posterior(self, ids: np.ndarray) -> np.ndarray:
        score = self.bias + self.weights[np.unique(ids % BUCKETS)].sum(0) if len(ids) else self.bias
        post = np.exp(score - score.max())
        return post / post.sum()


def fit_domains(df: DataFrame, row_id: str, text: str, source: str, names: Sequence[str], *, sample: int = SAMPLE_PER_SOURCE, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DomainClassifier:
    """A classifier fitted on at most ``sample`` documents of each source in expectation, drawn by a hash of row_id.

    Multinomial logistic regression on Spark, sources weighted equally; the prior comes from the counts of all
    labelled documents. A source without a sampled document has weight 0 and its prior; fewer than two sampled
    sources leave the prior alone.
    """
    labelled = df.select(F.col(text).alias("text"), F.col(source).alias("source"), F.xxhash64(row_id).alias("h")).where(F.col("source").isin(*names))
    known = {r["source"]: r["n"] for r in labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        raise ValueError("no labelled documents to learn the sources from")
    prior = np.array([known.get(n, 0) for n in names], dtype=float)
    rates = F.create_map(*[F.lit(x) for s, n in known.items() for x in (s, sample / n * 1_000_000)])
    chosen = labelled.where(F.pmod("h", F.lit(1_000_000)) < F.try_element_at(rates, "source")).where("text <> ''").select("text", "source")

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load_codec(tokenizer, folder)
        for pdf in batches:
            found = [np.unique(np.array(codec.encode(t), dtype=np.int64) % BUCKETS).astype(str) for t in pdf["text"]]
            yield pd.DataFrame({"source": pdf["source"], "buckets": found})

    rows = cut_lineage(chosen.mapInPandas(buckets, "source string, buckets array<string>"))
    drawn = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    here = [n for n in names if n in drawn]
    weights, bias = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    if len(here) > 1:
        number, weight = ({n: f(i, n) for i, n in enumerate(here)} for f in (lambda i, n: float(i), lambda i, n: sum(drawn.values()) / drawn[n] / len(here)))
        by_source = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])[F.col("source")]
        vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], inputCol="buckets", outputCol="features").transform(rows)
        data = cut_lineage(vectors.select("features", by_source(number).alias("label"), by_source(weight).alias("weight")).coalesce(4))  # a bounded sample
        model = LogisticRegression(family="multinomial", regParam=REGULAR, maxIter=FITS, weightCol="weight", standardization=False).fit(data)
        at = [names.index(n) for n in here]
        weights[at], bias[at] = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return DomainClassifier(weights, bias, prior / prior.sum())


def _levels(posts: np.ndarray) -> np.ndarray:
    """Posteriors as whole numbers that sum to LEVELS: the parts cut off go to the largest ones first."""
    scaled = posts * LEVELS
    low = np.floor(scaled)
    lacking = np.rint(LEVELS - low.sum(1)).astype(int)
    turn = np.argsort(np.argsort(low - scaled, axis=1, kind="stable"), axis=1, kind="stable")
    return (low + (turn < lacking[:, None])).astype(np.uint8)


def soft_membership(df: DataFrame, row_id: str, text: str, source: str, names: Sequence[str], classifier: DomainClassifier, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """row_id, source, n_tokens, domains, shares: each document's size in tokens and domain posteriors.

    shares (array) holds the posteriors; domains (binary) their levels, one byte per source that sum to LEVELS, which
    lets documents with nearly equal ones be summed and share a rate.
    """
    shared = df.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, model = load_codec(tokenizer, folder), shared.value
        for pdf in batches:
            sizes, posts = [], []
            for t in pdf["text"]:
                ids = np.fromiter(codec.stream(t), dtype=np.int32)
                sizes.append(len(ids))
                posts.append(model.posterior(ids))
            levels = _levels(np.array(posts)) if posts else []
            yield pd.DataFrame({row_id: pdf[row_id], "source": pdf["source"], "n_tokens": sizes, "domains": [x.tobytes() for x in levels], "shares": [p.astype(np.float32) for p in posts]})

    rows = df.select(row_id, F.col(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, source string, n_tokens bigint, domains binary, shares array<float>")


def _posteriors(stored: pd.Series) -> np.ndarray:
    """The levels of stored posteriors as rows that sum to 1."""
    return np.frombuffer(b"".join(stored), dtype=np.uint8).reshape(len(stored), -1) / LEVELS


def _rates(posts: np.ndarray, caps: np.ndarray, steps: Sequence[np.ndarray]) -> np.ndarray:
    """Rates after the given steps, each projected onto [0, cap]."""
    r = np.zeros(len(posts))
    for g in steps:
        r = np.clip(r + posts @ g, 0, caps)
    return r


def fit_rates(members: DataFrame, names: Sequence[str], caps: dict[str, int], goals: np.ndarray, totals: np.ndarray) -> tuple[list[np.ndarray], float]:
    """(steps, misfit): a projected gradient for the rates of documents whose expected domain totals meet ``goals``.

    Minimises the squared misfit of sum(rate * tokens * posterior) over rates in [0, max_repeats]. members: documents
    summed by source and levels, with the sums of tokens times exact posteriors. A pass sums the totals of the present
    rates on Spark; only one number per domain comes back. Each domain's step is scaled by its tokens, and a
    document's rate follows from its levels and the steps so far, so no state is stored. misfit: the largest
    difference between an expected total and its goal, as a share of the goal, that the best of STEPS steps leaves.
    """
    steps: list[np.ndarray] = [goals / np.maximum(totals, 1)]
    best, better = (np.inf, list(steps)), 0
    for turn in range(STEPS):
        reached = _sum_rates(members, names, caps, steps)
        misfit = goals - reached
        worst = float(np.max(np.abs(misfit) / np.maximum(goals, 1)))
        if worst < best[0] * (1 - CLOSE):
            better = turn
        if worst < best[0]:
            best = (worst, list(steps))
        if worst < CLOSE or turn - better >= STALLED:
            break
        steps.append(misfit / np.maximum(totals, 1))
    return best[1], best[0]


def _sum_rates(members: DataFrame, names: Sequence[str], caps: dict[str, int], steps: list[np.ndarray]) -> np.ndarray:
    width = len(names)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                r = _rates(_posteriors(pdf["domains"]), pdf["source"].map(caps).fillna(1).to_numpy(dtype=float), steps)
                out += r @ np.stack(pdf["expected"].to_numpy())
        yield pd.DataFrame({"d": np.arange(width, dtype=np.int32), "t": out})

    rows = members.mapInPandas(total, "d int, t double").groupBy("d").agg(F.sum("t").alias("t")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r["d"]] = r["t"]
    return out


def mix_sources(df: DataFrame, row_id: str, text: str, source: str, targets: Sequence[Target], *, size: int | None = None, sample: int = SAMPLE_PER_SOURCE, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The mixture: row_id, source, n_tokens, rate, copies (at least 1) of each document in it, and soft_misfit.

    Soft stage: a classifier fitted on labelled documents gives every document of a listed source domain posteriors; a
    distributed projected gradient fits rates in [0, max_repeats] whose expected domain totals meet the targets as
    nearly as these documents allow (soft_misfit, see fit_rates). Label stage: the rates of each source are shifted by
    one number, so that its capped total meets the target exactly; documents without a listed source are left out. Rounding:
    every document gets the whole part of its rate, and the fractions go to documents in a hash order up to a
    threshold found by two histograms, so each source's tokens meet its target to about one document.
    ``size``: tokens of the mixture; by default the most that the caps allow. A source without tokens gets none, and
    the others share its part. Null, empty and blank-free texts count by their tokens; those without any are never
    taken; repeated texts under other ids are documents of their own. No targets or no tokens: an empty mixture.
    """
    names = [t.source for t in targets]
    empty = df.select(row_id, F.lit("").alias("source"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies"), F.lit(0.0).alias("soft_misfit")).limit(0)
    if not names or df.where(F.col(source).isin(*names) & (F.col(text) != "")).isEmpty():
        return empty
    model = fit_domains(df, row_id, text, source, names, sample=sample, tokenizer=tokenizer, folder=folder)
    listed = df.where(F.col(source).isin(*names))  # only these can be given out
    members = cut_lineage(soft_membership(listed, row_id, text, source, names, model, tokenizer=tokenizer, folder=folder).where("n_tokens > 0"))

    stock = {r["source"]: int(r["n"]) for r in members.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    live = [t for t in targets if stock.get(t.source)]
    whole = sum(t.share for t in live)
    caps = {t.source: t.max_repeats for t in targets}
    if not whole:
        return empty
    most = min(t.max_repeats * stock[t.source] / (t.share / whole) for t in live if t.share)
    size = min(size or most, most)
    goal = {t.source: t.share / whole * size for t in live}
    goals = np.array([goal.get(n, 0.0) for n in names])

    labelled = members.where(F.col("source").isin([t.source for t in live]))
    expected = F.array(*[F.sum(F.col("n_tokens") * F.col("shares")[i].cast("double")) for i in range(len(names))])
    alike = cut_lineage(labelled.groupBy("source", "domains").agg(expected.alias("expected")))  # equal levels have equal rates
    domains = _sum_rates(alike, names, {}, [np.full(len(names), 1e9)])  # rate 1 for all: the domains' tokens
    steps, misfit = fit_rates(alike, names, caps, goals, domains)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = _rates(_posteriors(pdf["domains"]), pdf["source"].map(caps).to_numpy(dtype=float), steps) if len(pdf) else np.empty(0)
            yield pd.DataFrame({row_id: pdf[row_id], "source": pdf["source"], "n_tokens": pdf["n_tokens"], "soft": r})

    soft = cut_lineage(labelled.mapInPandas(rates, f"`{row_id}` {dict(members.dtypes)[row_id]}, source string, n_tokens bigint, soft double"))
    shifts = _label_shifts(cut_lineage(soft.groupBy("source", "soft").agg(F.sum("n_tokens").alias("n_tokens"))), caps, goal)
    by_source = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))]), "source")
    rate = F.least(F.greatest(F.col("soft") + by_source(shifts), F.lit(0.0)), by_source(caps))
    rated = soft.withColumn("rate", rate)
    # A document's turn for one more copy: a hash in (0, 1), earlier the larger the fraction of its rate.
    spin = (F.pmod(F.xxhash64(F.col(row_id), F.lit("turn")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    part = F.col("rate") - F.floor("rate")
    rated = rated.withColumn("turn", F.when(part > 1e-9, 1 - F.pow(1 - spin, 1 / part))).withColumn("base", F.floor(F.col("rate") + 1e-9))
    edges = _turn_edges(rated, goal)
    copies = F.col("base") + F.coalesce(F.col("turn") < by_source(edges), F.lit(False)).cast("int")
    return rated.withColumn("copies", copies.cast("int")).where("copies > 0").select(row_id, "source", "n_tokens", F.round("rate", 9).alias("rate"), "copies", F.lit(misfit).alias("soft_misfit"))


def holdout_accuracy(df: DataFrame, row_id: str, text: str, source: str, names: Sequence[str], *, sample: int = SAMPLE_PER_SOURCE, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """source, n, accuracy of the domain classifier on half of the documents, fitted on a sample of the other half."""
    half = F.pmod(F.xxhash64(F.col(row_id), F.lit("half")), F.lit(2))
    model = fit_domains(df.where(half == 0), row_id, text, source, names, sample=sample, tokenizer=tokenizer, folder=folder)
    held = df.where((half == 1) & F.col(source).isin(*names) & (F.col(text) != ""))
    scored = soft_membership(held, row_id, text, source, names, model, tokenizer=tokenizer, folder=folder)
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("shares", F.array_max("shares")).cast("int"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg((best == F.col("source")).cast("int")).alias("accuracy"))


def _label_shifts(soft: DataFrame, caps: dict[str, int], goal: dict[str, float]) -> dict[str, float]:
    """Per source the number to add to all soft rates so that the capped total meets the goal; each pass tries 33."""
    low, high = {s: -float(caps[s]) for s in goal}, {s: float(caps[s]) for s in goal}
    for _ in range(5):
        tried = {s: np.linspace(low[s], high[s], 33) for s in goal}
        shifts = F.create_map(*[F.lit(x) for s in goal for x in (s, F.array(*map(F.lit, tried[s].tolist())))])
        cap = F.create_map(*[F.lit(x) for s in goal for x in (s, float(caps[s]))])
        rows = soft.select("source", "n_tokens", "soft", cap[F.col("source")].alias("cap"), F.posexplode(shifts[F.col("source")]).alias("i", "d"))
        total = F.sum(F.col("n_tokens") * F.least(F.greatest(F.col("soft") + F.col("d"), F.lit(0.0)), F.col("cap")))
        sums = {(r["source"], r["i"]): r["t"] for r in rows.groupBy("source", "i").agg(total.alias("t")).collect()}
        for s in goal:
            at = max((i for i in range(33) if sums[s, i] <= goal[s]), default=0)
            low[s], high[s] = float(tried[s][at]), float(tried[s][min(at + 1, 32)])
    return {s: high[s] if goal[s] > 0 else -float(caps[s]) for s in goal}


def _turn_edges(rated: DataFrame, goal: dict[str, float]) -> dict[str, float]:
    """Per source the turn below which documents get one more copy, resolved to BINS * BINS."""
    base = {r["source"]: float(r["t"]) for r in rated.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("t")).collect()}
    need = {s: goal[s] - base.get(s, 0.0) for s in goal}
    low, width = dict.fromkeys(goal, 0.0), 1.0
    for _ in range(2):
        width /= BINS
        start = F.create_map(*[F.lit(x) for s in goal for x in (s, low[s])])[F.col("source")]
        bins = rated.where("turn is not null").withColumn("bin", F.floor((F.col("turn") - start) / width)).where(f"bin >= 0 and bin < {BINS}")
        rows = bins.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t")).toPandas().sort_values(["source", "bin"])
        for s in goal:
            own = rows[rows["source"] == s]
            upto = own["t"].cumsum().to_numpy()
            k = int(np.searchsorted(upto, need[s], "right"))
            if k < len(own):
                low[s] += float(own["bin"].iloc[k]) * width
                need[s] -= float(upto[k - 1]) if k else 0.0
            elif len(own):
                low[s] += float(own["bin"].iloc[-1] + 1) * width
                need[s] = 0.0
    return low


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_copies of every target source, and the fit's misfit.

    targets: source and target_share. A source that the mixture lacks has share 0.
    """
    per = mixture.groupBy("source").agg(F.max("soft_misfit").alias("soft_misfit"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    all_tokens = per.agg(F.sum("tokens").alias("all"), F.max("soft_misfit").alias("misfit"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.try_divide(F.col("tokens"), F.col("all")), F.lit(0.0))
    return targets.select("source", "target_share").join(per, "source", "left").crossJoin(F.broadcast(all_tokens)).select(
        "source", "target_share", F.round(share, 6).alias("actual_share"), zero("tokens"), zero("documents"), zero("most_copies"), F.round("misfit", 6).alias("soft_misfit")
    )

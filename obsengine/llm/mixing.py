"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table (softmax regression on hashed pieces of words) gives each document a posterior
over domains. The expected tokens of domain k under document rates r are E_k = sum of r_d * tokens_d * posterior_dk. The
rates that match targets T are fitted by projected gradient on the relative squares sum_k ((E_k - T_k) / T_k)^2: a step
moves r_d along posterior_d . g (the gradient scaled by 1 / tokens_d, so that length doesn't decide) and back to
r_d >= least_rate, 0 unless asked otherwise. Step sizes are Barzilai and Borwein's two in turn; the rates of the least sum
of squares are kept.

One iteration is one Spark aggregation of K sums over the table of tokens and posteriors. A document's rate is made anew
from the K-vectors of all steps so far, so no rates are stored, and the driver holds K numbers a step.

Cases: null and empty texts have no tokens and no pieces; their posterior is the classifier's for no evidence and their
rate follows from it without changing any total; repeated rows count one by one; a domain without target keeps its
tokens; targets of 0 are taken relative to the whole; labels that repeat count once, by the largest of each column; documents whose domain label is null aren't fitted on; without
labels there is one domain, "all"; an empty table gives no rows. Of columns that documents and labels both have, the labels' are meant;
other columns of documents are not read unless the domain names them, and apply_rates() passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.llm.common import by_value, id_and_text, per_batch, raw_texts, remove, stored
from obsengine.llm.substring_dedup import word_hashes


def pieces(raw: bytes | None, bits: int) -> np.ndarray:
    """Share of each hashed piece: the distinct words, and pairs of bytes."""
    out = np.zeros(1 << bits, np.float32)
    words = raw.lower().split() if raw else []
    if words:
        mask = (1 << bits) - 1
        w = np.unique(word_hashes([b" ".join(words)])) & np.uint64(mask)
        data = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint32)
        pairs = (data[:-1] * np.uint32(2654435761) ^ data[1:] * np.uint32(40503)) >> np.uint32(7) & np.uint32(mask)
        out += 0.5 * np.bincount(w.astype(np.int64), minlength=1 << bits) / len(w)
        if len(pairs):
            out += 0.5 * np.bincount(pairs, minlength=1 << bits) / len(pairs)
    return np.sqrt(out)


class Classifier:
    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray, bits: int):
        self.domains, self.weights, self.bias, self.bits = domains, weights, bias, bits

    def posteriors(self, texts: list[bytes | None]) -> np.ndarray:
        z = np.stack([pieces(t, self.bits) @ self.weights for t in texts]) + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_classifier(documents: DataFrame, labels: DataFrame, domain: Column, max_fit_rows: int = 4_000, bits: int = 11, rounds: int = 120) -> Classifier:
    """labels: doc_id; domain: a column of labels or, if labels have none of that name, of documents. At most max_fit_rows labelled documents, by a hash of
    doc_id, are fitted on; their features, max_fit_rows times 2**bits numbers, come to the driver."""
    own = [c for c in labels.columns if c != "doc_id"]
    once = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__labels"), *[F.max(c).alias(c) for c in own])
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows).drop("__labels")
    other = [c for c in documents.columns if c not in ("doc_id", *own)]
    rows = documents.select(F.col("doc_id").alias("__doc_id"), F.col("text").cast("string").alias("__text"), *other).join(F.broadcast(chosen), F.col("__doc_id") == F.col("doc_id"))
    rows = rows.select(F.col("__text").alias("text"), domain.cast("string").alias("domain")).filter("domain is not null")
    rows = stored(rows, "domains")

    def make():
        def f(batch):
            return {"domain": batch.column(1), "x": [pieces(t, bits).astype(np.float32).tobytes() for t in raw_texts(batch)]}

        return f

    got = per_batch(rows, "domain string, x binary", make).toPandas()
    remove(rows)
    domains = sorted(set(got["domain"])) or ["all"]
    weights, bias = np.zeros((1 << bits, len(domains))), np.zeros(len(domains))
    if len(domains) > 1:
        x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]])
        y = (got["domain"].to_numpy()[:, None] == np.array(domains)[None, :]).astype(float)
        m, s = [np.zeros_like(weights), np.zeros_like(bias)], [np.zeros_like(weights), np.zeros_like(bias)]
        for t in range(1, rounds + 1):
            z = x @ weights + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - y) / len(y)
            for j, (p, g) in enumerate(((weights, x.T @ d + 1e-5 * weights), (bias, d.sum(axis=0)))):
                m[j] = 0.9 * m[j] + 0.1 * g
                s[j] = 0.999 * s[j] + 0.001 * g * g
                p -= 0.5 * (1 - t / (rounds + 1)) * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
    return Classifier(domains, weights, bias, bits)


def memberships(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, tokens (runs without ASCII white space), posterior (in the order of classifier.domains)."""
    docs = id_and_text(documents)
    shared = by_value(documents.sparkSession, classifier)

    def make():
        own = shared()

        def f(batch):
            texts = raw_texts(batch)
            return {"doc_id": batch.column(0), "tokens": [len(t.split()) if t else 0 for t in texts], "posterior": pa.array(list(own.posteriors(texts)), pa.list_(pa.float64()))}

        return f

    schema = T.StructType([docs.schema["doc_id"], T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return per_batch(docs, schema, make)


def rate(steps: list[np.ndarray], least_rate: float, posterior: str = "posterior") -> Column:
    """The rate after the steps, from 1 on: each takes its share off and goes back to least_rate if below."""
    r = F.lit(1.0)
    for v in steps:
        r = F.greatest(F.lit(float(least_rate)), r - sum((F.get(posterior, F.lit(k)) * float(x) for k, x in enumerate(v)), F.lit(0.0)))
    return r


def rates_after(steps: list[np.ndarray], least_rate: float, posteriors: np.ndarray) -> np.ndarray:
    r = np.ones(len(posteriors))
    for v in steps:
        r = np.maximum(least_rate, r - posteriors @ v)
    return r


def fit_steps(members: DataFrame, targets: np.ndarray | None, n_domains: int, least_rate: float = 0.0, most_steps: int = 40, tolerance: float = 1e-4, temper: float | None = None, shares: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps, expected totals after them, and targets. members: stored table of tokens and posterior.

    targets: tokens by domain, null (nan) to keep a domain's. With shares instead, these parts of all tokens; if rates under 1
    aren't allowed, of so many tokens that no domain has to shrink. With temper, the shares found are raised to that power
    and scaled so that no domain has to shrink."""

    def totals(steps):
        def make():
            def f(batch):
                if not batch.num_rows:
                    return {"e": [], "gram": [], "moved": []}
                p = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, n_domains)[batch.column(1).offset :][: batch.num_rows]
                n = batch.column(0).to_numpy(zero_copy_only=False)
                before = rates_after(steps[:-1], least_rate, p)
                rates = np.maximum(least_rate, before - p @ steps[-1]) if steps else before
                gram = (p * n[:, None]).T @ p
                return {"e": [((rates * n) @ p).tolist()], "gram": [gram.ravel().tolist()], "moved": [float(np.sum(n * (rates - before) ** 2))]}

            return f

        sums = per_batch(members.select("tokens", "posterior"), "e array<double>, gram array<double>, moved double", make)
        row = sums.select([F.sum(F.get("e", F.lit(k))).alias(f"e{k}") for k in range(n_domains)] + [F.sum(F.get("gram", F.lit(k))).alias(f"g{k}") for k in range(n_domains**2)] + [F.sum("moved")]).first()
        got = np.array([x or 0.0 for x in row])
        return got[:n_domains], got[n_domains:-1].reshape(n_domains, n_domains), got[-1]

    now, gram, _ = totals([])
    whole = max(now.sum(), 1.0)
    if shares is not None:
        targets = shares / shares.sum() * now.sum()
        if least_rate >= 1 and (targets > 0).any():
            targets = targets * max(1.0, np.max(now[targets > 0] / targets[targets > 0]))
    elif temper is not None:
        found = np.maximum(now, 0) / whole
        raised = np.where(found > 0, np.maximum(found, 1e-12) ** temper, 0.0)
        targets = raised * max(now[k] / raised[k] for k in range(n_domains)) if raised.any() else now
    targets = np.where(np.isnan(targets), now, targets)
    scale = np.where(targets > 0, targets, whole) ** 2
    # The scaled gradient's largest curvature bounds the first step.
    size = 1 / max(np.abs(np.linalg.eigvals(gram / scale[:, None])).max(), 1e-30) if now.any() else 0.0
    steps: list[np.ndarray] = []
    residual = (now - targets) / scale
    best = (np.inf, [], now)
    for t in range(most_steps + 1):
        error = float(np.sum(residual * residual * scale))
        if error < best[0]:
            best = (error, list(steps), now)
        if t == most_steps or np.abs(residual * scale).max() / whole < tolerance:
            break
        steps.append(size * residual)
        after, _, moved = totals(steps)
        new = (after - targets) / scale
        along, curved = float((after - now) @ (new - residual)), float((new - residual) @ gram @ (new - residual))
        if along > 0 and curved > 0:
            size = moved / along if t % 2 else along / curved
        else:
            size /= 2
        residual, now = new, after
    return best[1], best[2], targets


def mix(documents: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float] | None = None, shares: dict[str, float] | None = None, temper: float | None = 0.7, least_rate: float = 0.0, max_fit_rows: int = 4_000) -> tuple[DataFrame, list[np.ndarray], Classifier, DataFrame]:
    """(doc_id, tokens, posterior, domain, rate), the steps, the classifier, and a report by domain.

    targets: tokens wanted by domain. shares: parts of all tokens wanted by domain, 0 for one that isn't named. Without
    either, the shares found are tempered."""
    classifier = fit_classifier(documents, labels, domain, max_fit_rows)
    members = stored(memberships(documents, classifier), "memberships")
    k = len(classifier.domains)
    asked = None if targets is None else np.array([targets.get(d, np.nan) for d in classifier.domains], float)
    parts = None if shares is None else np.array([shares.get(d, 0.0) for d in classifier.domains], float)
    steps, reached, wanted = fit_steps(members, asked, k, least_rate, temper=temper if targets is None else None, shares=parts if parts is not None and parts.any() else None)
    best = F.get(F.array(*map(F.lit, classifier.domains)), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    rated = members.withColumn("domain", best).withColumn("rate", rate(steps, least_rate))
    report = documents.sparkSession.createDataFrame([(d, float(w), float(e)) for d, w, e in zip(classifier.domains, wanted, reached, strict=True)], "domain string, target double, expected double")
    return rated, steps, classifier, report


def apply_rates(documents: DataFrame, classifier: Classifier, steps: list[np.ndarray], least_rate: float = 0.0) -> DataFrame:
    """Each row as often as its rate says: the whole part, and once more by a hash of its doc_id for the rest. Columns stay;
    nothing is shuffled."""
    import xxhash

    shared = by_value(documents.sparkSession, (classifier, steps))

    def make():
        own, own_steps = shared()

        def f(batch):
            texts = raw_texts(batch)
            rates = rates_after(own_steps, least_rate, own.posteriors(texts))
            at = batch.schema.get_field_index("doc_id")
            ids = batch.column(at).to_pylist()
            draw = np.array([xxhash.xxh64_intdigest(repr(i), 11) / 2**64 for i in ids])
            times = np.floor(rates + draw).astype(np.int64)
            return batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

        return f

    return per_batch(documents, documents.schema, make)

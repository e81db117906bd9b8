"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model also sees the
probabilities of the earlier ones.  In training these are out-of-fold: a
document's own fold had no part in the models that scored it, so later models
learn from probabilities as good as those they meet in use.

* Sample: about MAX_LABELLED labelled documents, one row per (id, text), chosen by
  a hash of the id (all, if there are fewer) and, where ids stand over more texts
  than that, by a hash of id and text.  The sample's ids are a relation of that
  bounded size and are broadcast; only the sample's texts are shuffled.
* Features: presence of words and of word beginnings of 4 and 5 bytes (a stem
  with unseen endings still shows).  The VOCAB features that tell most about
  each category are kept (two-proportion z-score).  A fold's models choose theirs
  without that fold's labels.
* Models: L2-regularised logistic regression, fitted by Newton steps, one task
  per fold and one for the whole sample, each over the bounded sample.
* Folds go by a hash of the text, so equal copies share a fold.
* Threshold: where the last category's out-of-fold F0.5 (precision counts twice)
  is highest.

Scoring is one pass over all documents with the fixed-size model.

Edge cases: null and wordless texts get the models' intercepts; without
labelled documents of both kinds every probability is the share of positive
labels (0 without labels) and nothing is rejected; null labels, and labels
without a document, are left out; several labels of a document count once
(largest); repeated rows and null ids are scored like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared, words

MAX_LABELLED = 12_000
VOCAB = 1024          # features kept per category, at most
MIN_DOCS = 4          # documents of the sample a feature must be in, and 1 in MIN_SHARE of them
MIN_SHARE = 1000
MIN_Z = 5.0           # its z-score at least
FOLDS = 4
L2 = 0.3
STEMS = (4, 5)


def _features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature hashes, document of each) per group of documents; 0 is no feature."""
    for w in words.words(col, words.ALNUM, STEMS):
        doc = w.first + np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
        yield (np.concatenate([w.hashes, *[w.prefixes[k] for k in STEMS]]), np.tile(doc, 1 + len(STEMS)))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def fit_logistic(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n_feat: int, l2: float = L2) -> np.ndarray:
    """Weights [features, extra columns, intercept] of binary sparse rows."""
    lens = np.array([len(r) for r in rows])
    idx = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), lens)
    m = extra.shape[1]

    def times(w):
        return np.bincount(of, weights=w[idx], minlength=len(rows)) + extra @ w[n_feat:n_feat + m] + w[-1]

    def back(r):
        return np.concatenate([np.bincount(idx, weights=r[of], minlength=n_feat)[:n_feat], extra.T @ r, [r.sum()]])

    reg = np.full(n_feat + m + 1, l2)
    reg[-1] = 1e-6
    w = np.zeros(n_feat + m + 1)
    loss = lambda w: float(np.sum(np.logaddexp(0, times(w)) - y * times(w)) + 0.5 * np.sum(reg * w * w))
    now = loss(w)
    for _ in range(25):
        p = sigmoid(times(w))
        g = back(p - y) + reg * w
        d = np.maximum(p * (1 - p), 1e-9)
        # conjugate gradients on the Hessian
        x, r = np.zeros_like(w), -g
        q, rr = r.copy(), float(r @ r)
        for _ in range(40):
            if rr < 1e-12 * (1 + float(g @ g)):
                break
            hq = back(d * times(q)) + reg * q
            a = rr / float(q @ hq)
            x += a * q
            r -= a * hq
            new = float(r @ r)
            q = r + (new / rr) * q
            rr = new
        step = 1.0
        while step > 1e-4 and (nxt := loss(w + step * x)) > now:
            step /= 2
        if step <= 1e-4:
            break
        w = w + step * x
        if now - nxt < 1e-7 * (1 + abs(now)):
            break
        now = nxt
    return w


@dataclass
class Chain:
    categories: list[str]
    vocab: np.ndarray            # sorted feature hashes
    weights: list[np.ndarray]    # per category: features, earlier probabilities, intercept
    threshold: float


def _sample(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, most: int) -> DataFrame:
    """(fold, y array<int>, feats array<bigint>) of the labelled sample, staged."""
    one = (labels.filter(" and ".join(f"`{c}` is not null" for c in [id_col, *categories]))
           .groupBy(F.col(id_col).alias("label_id")).agg(F.array(*[F.max(F.col(c).cast("int")) for c in categories]).alias("y")))
    n = one.count()
    share = int(min(1.0, most / max(n, 1)) * (1 << 30))
    # about ``most`` rows at any input size
    some = shared.staged(one.filter(F.pmod(F.xxhash64("label_id", F.lit(41)), F.lit(1 << 30)) < share))
    rows = (docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumn("h", F.xxhash64("text")).join(F.broadcast(some), "label_id"))
    # an id may stand over many rows: bound the rows, too
    n = rows.select("label_id", "h").distinct().count()
    if n > 2 * most:
        rows = rows.filter(F.pmod(F.xxhash64("label_id", "h", F.lit(43)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    rows = (rows.groupBy("label_id", "h").agg(F.first("y").alias("y"), F.first("text").alias("text"))
            .select(F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "y", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for h, doc in _features(batch.column("text")):
                order = np.argsort(doc, kind="stable")
                ds, cut = np.unique(doc[order], return_index=True)
                for d, part in zip(ds, np.split(h[order], cut[1:])):
                    u = np.unique(part)
                    per[d] = u[u != 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), pa.array(per, pa.list_(pa.int64()))],
                                             names=["fold", "y", "feats"])

    return shared.staged(shared.mapped(rows, run, "fold int, y array<int>, feats array<bigint>"))


def _vocabulary(sample: DataFrame, n_cat: int) -> dict[int, np.ndarray]:
    """Features by held-out fold, chosen on the rows of the other folds; -1: on all rows."""
    kinds = [F.count("*").alias("d"), *[F.sum(F.col("y")[k]).alias(f"d{k}") for k in range(n_cat)]]
    size = {r["fold"]: r for r in sample.groupBy("fold").agg(*kinds).collect()}       # a row a fold
    seen = shared.staged(sample.select("fold", "y", F.explode("feats").alias("f")).groupBy("f", "fold").agg(*kinds))
    out: dict[int, np.ndarray] = {}
    for held in range(-1, FOLDS):
        rows = [r for g, r in size.items() if g != held]
        n = sum(r["d"] for r in rows)
        mine = (seen.filter(F.col("fold") != held).groupBy("f").agg(*[F.sum(c).alias(c) for c in ("d", *[f"d{k}" for k in range(n_cat)])])
                .filter(F.col("d") >= max(MIN_DOCS, n // MIN_SHARE)))
        kept: set[int] = set()
        for k in range(n_cat):
            pos = sum(r[f"d{k}"] for r in rows)
            if pos in (0, n):
                continue
            rate = pos / n
            z = F.abs(F.col(f"d{k}") - F.col("d") * rate) / F.sqrt(F.col("d") * rate * (1 - rate))
            kept |= {r[0] for r in mine.filter(z >= MIN_Z).orderBy(z.desc(), "f").limit(VOCAB).select("f").collect()}     # at most VOCAB
        out[held] = np.sort(np.array(sorted(kept), np.int64).view(np.uint64))
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED) -> Chain:
    sample = _sample(docs, labels, categories, id_col, text_col, max_labelled)
    chosen = _vocabulary(sample, len(categories))
    vocab = np.unique(np.concatenate(list(chosen.values())))       # of all folds
    n_feat = len(vocab)
    used = {held: np.isin(vocab, v) for held, v in chosen.items()}
    voc = docs.sparkSession.sparkContext.broadcast(vocab)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voc.value
        for batch in batches:
            col = batch.column("feats")
            rows = []
            for x in col:
                f = x.values.to_numpy().view(np.uint64)
                i = np.minimum(np.searchsorted(v, f), max(len(v) - 1, 0))
                rows.append(i[v[i] == f].astype(np.int32) if len(v) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), pa.array(rows, pa.list_(pa.int32()))],
                                             names=["fold", "y", "x"])

    data = shared.staged(shared.mapped(sample, narrow, "fold int, y array<int>, x array<int>")
                         .withColumn("rid", F.monotonically_increasing_id()).withColumn("earlier", F.expr("cast(array() as array<double>)")))
    voc.unpersist()
    weights: list[np.ndarray] = []
    for k in range(len(categories)):
        # one group per fold, and group -1 with the whole sample; the sample is bounded
        groups = data.select("*", F.explode(F.array(*[F.lit(g) for g in range(-1, FOLDS)])).alias("held"))

        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            held = int(pdf["held"].iloc[0])
            pdf = pdf.sort_values("rid")
            rows = [np.asarray(x, dtype=np.int64) for x in pdf["x"]]
            rows = [x[used[held][x]] for x in rows]        # features of other folds' choice keep the weight 0
            extra = np.array([list(e) for e in pdf["earlier"]], dtype=float).reshape(len(pdf), k)
            y = np.array([v[k] for v in pdf["y"]], dtype=float)
            use = (pdf["fold"] != held).to_numpy()
            if use.sum() == 0 or y[use].min() == y[use].max():
                share = float(y[use].mean()) if use.sum() else 0.0
                w = np.zeros(n_feat + k + 1)
                w[-1] = 50.0 if share >= 1 else -50.0 if share <= 0 else np.log(share / (1 - share))
            else:
                w = fit_logistic([r for r, u in zip(rows, use) if u], extra[use], y[use], n_feat)
            if held < 0:
                return pd.DataFrame({"rid": [-1], "p": [0.0], "w": pd.Series([w.tolist()], dtype=object)})
            out = ~use
            score = [float(w[r].sum() + e @ w[n_feat:n_feat + k] + w[-1]) for r, e in zip([r for r, o in zip(rows, out) if o], extra[out])]
            return pd.DataFrame({"rid": pdf["rid"].to_numpy()[out], "p": sigmoid(np.array(score, dtype=float)),
                                 "w": pd.Series([[]] * int(out.sum()), dtype=object)})

        done = shared.staged(groups.groupBy("held").applyInPandas(train, "rid bigint, p double, w array<double>"))
        row = done.filter("rid = -1").first()
        weights.append(np.array(row["w"]) if row else np.concatenate([np.zeros(n_feat + k), [-50.0]]))
        data = shared.staged(data.join(done.filter("rid >= 0").select("rid", "p"), "rid")
                             .withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"))
    last = len(categories) - 1
    # thresholds at hundredths, F0.5 of the out-of-fold probabilities; cell c: those from c / 100 on
    p_last = F.col("earlier")[last]
    low = F.floor(p_last * 100).cast("int")
    cell = F.when(p_last >= (low + 1) / F.lit(100.0), low + 1).when(p_last < low / F.lit(100.0), low - 1).otherwise(low)
    cells = {r[0]: (r[1], r[2]) for r in data.groupBy(cell).agg(F.count("*"), F.sum(F.col("y")[last])).collect()}
    pos = sum(v[1] for v in cells.values())
    best, threshold = -1.0, 0.5
    for t in sorted(range(5, 96), key=lambda t: (abs(t - 50), t)):
        n = sum(v[0] for c, v in cells.items() if c >= t)
        hit = sum(v[1] for c, v in cells.items() if c >= t)
        f = 1.25 * hit / (n + 0.25 * pos) if n + pos else 0.0
        if f > best + 1e-12:
            best, threshold = f, t / 100
    mine = used[-1]
    return Chain(categories, vocab[mine], [np.concatenate([w[:n_feat][mine], w[n_feat:]]) for w in weights], threshold)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with p_<category> for each category and the boolean ``rejected``."""
    names = [shared.fresh(docs.columns, f"p_{c}") for c in chain.categories]
    rejected = shared.fresh([*docs.columns, *names], "rejected")
    model = docs.sparkSession.sparkContext.broadcast((chain.vocab, chain.weights, chain.threshold))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights, threshold = model.value
        n_feat = len(vocab)
        table = np.zeros(1 << 20, dtype=bool)
        table[(vocab >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            x = np.zeros((len(weights), batch.num_rows))
            for h, doc in _features(batch.column(text_col)):
                at = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
                if not n_feat or not len(at):
                    continue
                i = np.minimum(np.searchsorted(vocab, h[at]), n_feat - 1)
                ok = vocab[i] == h[at]
                pair = np.unique(doc[at[ok]] * n_feat + i[ok])
                d, i = pair // n_feat, pair % n_feat
                for k, w in enumerate(weights):
                    x[k] += np.bincount(d, weights=w[i], minlength=batch.num_rows)
            p: list[np.ndarray] = []
            for k, w in enumerate(weights):
                z = x[k] + w[-1]
                for j in range(k):
                    z = z + w[n_feat + j] * p[j]
                p.append(sigmoid(z))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in p], pa.array(p[-1] >= threshold)],
                                             names=[*cols, *names, rejected])

    return shared.mapped(docs, run, f"{types}{', '.join(f'`{n}` double' for n in names)}, `{rejected}` boolean")


def reject(docs: DataFrame, labels: DataFrame, categories: list[str], **names) -> DataFrame:
    """``docs`` without the rejected ones."""
    chain = fit(docs, labels, categories, **names)
    out = score(docs, chain, names.get("text_col", "text"))
    return out.filter(~F.col(out.columns[-1])).select(*docs.columns)

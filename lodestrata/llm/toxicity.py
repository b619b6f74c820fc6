"""Toxicity by a classifier chain: categories one after another, each linear model seeing the probabilities of those before it, trained with out-of-fold ones."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, table

#: The categories before the last are found in the rows labelled toxic: groups of features that occur together there. The last is the label itself.
KINDS = 3
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
_LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
FOLDS = 5


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings: stems carry over to forms that the labelled rows don't have."""
    parts = [f"{word}$"] + [word[:k] for k in PREFIXES if len(word) >= k]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts]


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def _sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = words_of(text)
            ids = np.unique(np.array([h for w in set(words) for h in word_features(w)], np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([len(words)]), pa.array([toxic], pa.int64())], ["ids", "n", "toxic"])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 150) -> np.ndarray:
    """Logistic regression for each column of weight (one model per fold), both classes weighing alike, with an L2 penalty on all but the last column of x, which is ones.

    Accelerated gradient descent with a step of its own for each feature, from the bound of the Hessian by its row sums: rare words
    converge as fast as frequent ones.
    """
    side = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w = weight * side[:, None]
    w = w / np.maximum(1e-12, w.sum(0))
    pen = np.full((x.shape[1], 1), ridge / len(x))
    pen[-1] = 1e-6
    bound = 0.25 * (np.abs(x) * np.abs(x).sum(1)[:, None]).T @ w + pen
    v = at = np.zeros((x.shape[1], weight.shape[1]))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at.astype(x.dtype), -30, 30)))
        new = at - (x.T @ (w * (p - y[:, None])).astype(x.dtype) + pen * at) / bound
        at, v = new + k / (k + 3) * (new - v), new
    return v


class Chain:
    """index: feature hash -> column; models: one column of weights per category, over the columns, the earlier probabilities, and ones."""

    def __init__(self, index: dict[int, int], models: list[np.ndarray]):
        self.index, self.models = index, models

    def predict(self, hits: list[int]) -> list[float]:
        out: list[float] = []
        for m in self.models:
            z = m[hits].sum() + (m[len(self.index) : -1] * out).sum() + m[-1]
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def select_features(ids: list[np.ndarray], toxic: np.ndarray, most: int) -> list[int]:
    """The features that tell toxic rows best from others: largest lower bound of the log odds ratio."""
    names, a = np.unique(np.concatenate([x for x, t in zip(ids, toxic) if t] or [np.empty(0, np.uint32)]), return_counts=True)
    others = np.concatenate([x for x, t in zip(ids, toxic) if not t] or [np.empty(0, np.uint32)])
    all_b, nb = np.unique(others, return_counts=True)
    at = np.searchsorted(all_b, names)
    b = np.where((at < len(all_b)) & (all_b[np.minimum(at, max(0, len(all_b) - 1))] == names), nb[np.minimum(at, max(0, len(nb) - 1))], 0) if len(all_b) else np.zeros(len(names))
    n, m = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((a + 0.5) / (n - a + 0.5)) - np.log((b + 0.5) / (m - b + 0.5))
    low = odds - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    good = np.flatnonzero((a >= 3) & (low > 1.0))
    return [int(h) for h in names[good[np.lexsort((names[good], -low[good]))][:most]]]


def kinds_of(x: np.ndarray, kinds: int = KINDS, rounds: int = 30) -> np.ndarray:
    """A group for each column of x (rows labelled toxic by features): spherical k-means of the columns, so features of the same rows share a group. -1 for a column that no row has. Starts at the most frequent column, then at the one least like those chosen; ties go to the first."""
    size = np.linalg.norm(x, axis=0)
    known = np.flatnonzero(size > 0)
    out = np.full(x.shape[1], -1)
    if not len(known):
        return out
    cols = (x[:, known] / size[known]).T
    centres = cols[[int(np.argmax(size[known]))]]
    while len(centres) < min(kinds, len(known)):
        centres = np.vstack([centres, cols[int(np.argmin((cols @ centres.T).max(1)))]])
    for _ in range(rounds):
        group = np.argmax(cols @ centres.T, 1)
        sums = np.array([cols[group == k].sum(0) if (group == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(1e-12, np.linalg.norm(sums, axis=1, keepdims=True))
    out[known] = np.argmax(cols @ centres.T, 1)
    return out


def targets(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """One column for each of CATEGORIES: a toxic row is of a kind if it has a feature of that group; the label comes last."""
    group = kinds_of(x[toxic > 0])
    return np.column_stack([*((x[:, group == k] > 0).any(1) & (toxic > 0) for k in range(KINDS)), toxic > 0]).astype(float)


def fit_chain(x: np.ndarray, truth: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The chain's models over x (features, and ones in the last column) and the out-of-fold probabilities that the later ones were trained with: a row's come from a model that has seen no row of its fold."""
    weight = np.column_stack([*((fold != k).astype(float) for k in range(FOLDS)), np.ones(len(x))])
    models, seen = [], np.empty((len(x), 0), np.float32)
    for y in truth.T:
        full = np.hstack([x[:, :-1], seen, x[:, -1:]])
        w = fit_logistic(full, y, weight)
        out_of_fold = (1 / (1 + np.exp(-np.clip(full @ w, -30, 30))))[np.arange(len(x)), fold]
        seen = np.hstack([seen, out_of_fold[:, None].astype(np.float32)])
        models.append(w[:, -1].astype(float))
    return models, seen


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 4000, most_features: int = 800) -> Chain | None:
    """Learn from a bounded sample of labelled rows: about most_toxic toxic and most_clean other ones, those with the smallest hash of doc_id.

    docs: doc_id, text; labels: doc_id, toxic. The categories before the last aren't given by any list: targets() finds them in the
    features of the toxic rows, in whatever language those are. None if either kind of row is missing. A doc_id labelled twice counts as
    toxic if any label says so; rows without label, id or text are left out; repeated equal rows count once.
    """
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    counts = {r[0]: r[1] for r in said.groupBy("_toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    share = F.when(F.col("_toxic") == 1, most_toxic / counts[1]).otherwise(most_clean / counts[0])
    drawn = said.where(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(2**31)) < share * 2**31)
    # the draw is bounded, so texts needn't be shuffled to meet it; a draw that isn't small (a bound set very high) is joined by shuffling
    drawn = F.broadcast(drawn) if drawn.count() <= 200_000 else drawn
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("_id")).groupBy("doc_id", F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"), F.max("_toxic").cast("long").alias("toxic"))
    rows = rows.select("text", "toxic").mapInArrow(_sample, "ids binary, n long, toxic long").collect()
    rows = sorted(rows, key=lambda r: (r.n, bytes(r.ids), r.toxic))
    toxic = np.array([r.toxic for r in rows])
    if not len(rows) or toxic.min() == toxic.max():
        return None
    ids = [np.frombuffer(r.ids, np.uint32) for r in rows]
    index = {h: i for i, h in enumerate(select_features(ids, toxic, most_features))}
    x = np.zeros((len(rows), len(index) + 1), np.float32)
    x[:, -1] = 1
    for i, own in enumerate(ids):
        x[i, [k for h in own.tolist() if (k := index.get(h)) is not None]] = 1
    models, _ = fit_chain(x, targets(x[:, :-1], toxic), np.arange(len(rows)) % FOLDS)  # rows are in the order of their content
    return Chain(index, models)


OUT = [*(f"p_{c}" for c in CATEGORIES), "toxic"]


def score(docs: DataFrame, chain: Chain | None, keep: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """The columns in keep with the probability of each category, and toxic where the last reaches `least`, from the whole text.

    Defined results: null or empty text is scored as a text without words; without a chain (nothing to learn from) every probability
    is 0; an empty table gives no rows; equal texts get equal results; columns in keep that are called like a result are replaced by it.
    """
    keep = others(keep, OUT)
    known = docs.sparkSession.sparkContext.broadcast(chain)  # most_features entries at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cache = known.value, {}
        for b in batches:
            found = []
            for t in b.column(b.num_columns - 1).to_pylist():
                if c is None:
                    found.append([0.0] * len(CATEGORIES))
                    continue
                hits: set[int] = set()
                for w in set(words_of(t)):
                    if (own := cache.get(w)) is None:
                        if len(cache) >= 400_000:
                            cache.clear()
                        own = cache[w] = [k for h in word_features(w) if (k := c.index.get(h)) is not None]
                    if own:
                        hits.update(own)
                found.append(c.predict(sorted(hits)))
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns, pa.array([f[-1] >= least for f in found], pa.bool_())], [*keep, *OUT])

    schema = docs.select(*keep).schema
    for name in OUT[:-1]:
        schema = schema.add(name, "double")
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema.add("toxic", "boolean"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")), ["doc_id"])

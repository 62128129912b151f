"""A quality classifier by co-training of two views.

One view sees the text alone (shares of hashed byte 3-grams), the other the page's metadata alone
(source, language, size). Both start from the same labels. In each round each view labels the
unlabelled documents of which it is surest, good and bad in the proportion of the labels, and
hands them to the other view as training rows; but only if, on the held-out labels beyond the same
margins, it is wrong at most ``WRONG`` times as often as guessing each class would be. A view that says little
hands over nothing, and the rounds end when neither does. At the end each view is calibrated on held-out labels
(a logistic curve through its margins, kept flat where they say little), and the log-odds of the views are added,
less the prior's, as for views that are independent given the class.

The classifiers are fitted on bounded samples, the smallest hashes of each class: ``LABELLED`` labelled
documents, shared out by class but with ``FLOOR`` of each at least (rows are weighted back to the classes' shares), a
quarter of them held out, and a pool of ``POOL`` unlabelled ones. Every document is scored, from its whole text.

Defined results: a null text is an empty one, null metadata are values of their own, a document with
several labels is good if all say so. Without labels of both classes every score is the share of good labels
(1 without any). Rows are documents; repeated or null ids stay. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkveil.functions.lineage import written

LABELLED = 3000
FLOOR = 500
WRONG = 0.5
POOL = 5000
ROUNDS = 5
SHARE = 0.04
BUCKETS = 1 << 10
META = 128
KEEP = 0.5
_PIECE = 1 << 20


def text_view(text: bytes) -> np.ndarray:
    """Shares of hashed byte 3-grams, the root of each so that rare ones count, of length 1."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(text), _PIECE):
        b = np.frombuffer(text[at : at + _PIECE + 2], dtype=np.uint8).astype(np.uint32)
        mixed = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1) if len(b) > 2 else b[:0]
        counts += np.bincount(mixed >> np.uint32(22), minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def meta_view(source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    """One mark each for the hashed source, the hashed language, and the size's power of two."""
    x = np.zeros(META, dtype=np.float32)
    x[zlib.crc32(f"s{source}".encode()) % 64] = 1
    x[64 + zlib.crc32(f"l{lang}".encode()) % 32] = 1
    x[96 + (0 if size is None else min(31, 1 + max(0, int(size)).bit_length()))] = 1
    return x


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, decay: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression (accelerated gradient steps); rows count by ``share``."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    share = (share / share.sum()).astype(np.float32)
    rate = 4.0 / (float((x * x).sum(axis=1).max()) + 1.0)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(steps):
        gradient = x.T @ ((_sigmoid(x @ ahead) - y) * share) + decay * ahead
        new = (ahead - rate * gradient).astype(np.float32)
        ahead, w = new + (k / (k + 3)) * (new - w), new
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _curve(margins: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out margins, with smoothed targets (Platt).

    Newton steps, halved until the loss falls. The loss holds the slope back, so margins without a word to say
    get a flat curve, which is the prior.
    """
    good, bad = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    centre, spread = float(np.average(margins, weights=share)), max(float(margins.std()), 1e-6)
    z, share = (margins - centre) / spread, share / share.mean()

    def loss(a: float, b: float) -> float:
        return float((share * (np.logaddexp(0, a * z + b) - target * (a * z + b))).sum() + 0.5 * a * a)

    a = b = 0.0
    for _ in range(100):
        p = _sigmoid(a * z + b)
        h = share * p * (1 - p)
        ga, gb = (share * (p - target) * z).sum() + a, (share * (p - target)).sum()
        haa, hab, hbb = (h * z * z).sum() + 1, (h * z).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        now, step = loss(a, b), 1.0
        while step > 1e-6 and not loss(a - step * da, b - step * db) <= now:
            step /= 2
        if step <= 1e-6 or step * (abs(da) + abs(db)) < 1e-9:
            break
        a, b = a - step * da, b - step * db
    if a <= 0:
        share_good = float(np.average(target, weights=share))
        return 0.0, float(np.log(share_good / (1 - share_good)))
    return a / spread, b - a * centre / spread


def _better(margins: np.ndarray, y: np.ndarray, share: np.ndarray, low: float, high: float, prior: float) -> bool:
    """Whether held-out rows below ``low`` are bad and those above ``high`` good much more often than by chance."""
    for beyond, wrong, chance in ((margins <= low, y > 0, prior), (margins >= high, y == 0, 1 - prior)):
        weight = share[beyond].sum()
        if not weight or share[beyond & wrong].sum() > WRONG * chance * weight:
            return False
    return True


@dataclass(frozen=True)
class Model:
    views: tuple[np.ndarray, np.ndarray] | None
    curves: tuple[tuple[float, float], tuple[float, float]] | None
    prior: float

    @staticmethod
    def fit(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, prior: float | None = None, rounds: int = ROUNDS) -> Model:
        """``y``: 1 good, 0 bad, -1 unlabelled; ``held`` marks the labelled rows to calibrate on.

        ``prior`` is the share of good ones among all labels, if the rows were drawn in other shares.
        """
        known = y >= 0
        drawn = float(y[known].mean()) if known.any() else 1.0
        prior = drawn if prior is None else prior
        train = np.flatnonzero(known & ~held)
        enough = all(len(set(y[rows].tolist())) == 2 for rows in (train, known & held))
        if not enough:
            return Model(None, None, prior)
        # Rows of a class that was drawn too often count less.
        share = np.where(y > 0, prior / drawn, np.where(y == 0, (1 - prior) / (1 - drawn), 1.0))
        test = np.flatnonzero(known & held)
        # What each view learns from, and with which labels.
        rows, said = [train, train], [y[train].astype(np.float32)] * 2
        pool = np.flatnonzero(~known)
        weights = [_fit(x[train], y[train], share[train]) for x in views]
        for _ in range(rounds):
            if not len(pool):
                break
            n = max(1, int(len(pool) * SHARE))
            n_good = min(max(1, round(n * prior)), len(pool) // 2)
            n_bad = min(max(1, n - n_good), len(pool) // 2)
            taken = []
            for view in (0, 1):
                margins = _margin(weights[view], views[view][pool])
                order = np.argsort(margins, kind="stable")
                low, high = margins[order[n_bad - 1]], margins[order[len(order) - n_good]]
                if low >= high or not _better(_margin(weights[view], views[view][test]), y[test], share[test], low, high, prior):
                    continue
                sure = pool[np.concatenate([order[:n_bad], order[len(order) - n_good :]])]
                labels = np.concatenate([np.zeros(n_bad), np.ones(n_good)]).astype(np.float32)
                other = 1 - view
                rows[other], said[other] = np.concatenate([rows[other], sure]), np.concatenate([said[other], labels])
                taken.append(sure)
            if not taken:
                break
            pool = np.setdiff1d(pool, np.concatenate(taken))
            weights = [_fit(x[r], s, share[r]) for x, r, s in zip(views, rows, said, strict=True)]
        curves = tuple(_curve(_margin(w, x[test]), y[test], share[test]) for w, x in zip(weights, views, strict=True))
        return Model(tuple(weights), curves, min(max(prior, 1e-4), 1 - 1e-4))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of being good, by text, by metadata, and by both."""
        if self.views is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        odds = [a * _margin(w, x).astype(np.float64) + b for w, x, (a, b) in zip(self.views, (text, meta), self.curves, strict=True)]
        both = odds[0] + odds[1] - np.log(self.prior / (1 - self.prior))
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(both)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text"))
    meta = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "size")), strict=True)
    n = batch.num_rows
    return np.array([text_view(t) for t in texts]).reshape(n, BUCKETS), np.array([meta_view(*m) for m in meta]).reshape(n, META)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = _views(batch)
        x = [pa.array([row.tobytes() for row in v], pa.binary()) for v in (text, meta)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("held"), *x], names=["y", "held", "text", "meta"])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = [pa.array(s, pa.float64()) for s in model.scores(*_views(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *found], names=["id", "text_score", "meta_score", "score"])

    return run


def _smallest(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes, written."""
    return written(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n))


def fit(rows: DataFrame, labels: DataFrame, doc: str = "doc_id", quality: str = "quality") -> Model:
    """``rows`` has ``id``, ``text``, ``source``, ``lang`` and ``size``."""
    said = written(labels.groupBy(F.col(doc).alias("id")).agg(F.min(quality).cast("int").alias("y")).where("y in (0, 1)"))
    sizes = {r.y: r["count"] for r in said.groupBy("y").count().collect()}
    total = max(1, sum(sizes.values()))
    held = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0
    quotas = {y: max(FLOOR, round(LABELLED * n / total)) for y, n in sizes.items()}
    some = [_smallest(said.where(F.col("y") == y), n, 1) for y, n in sorted(quotas.items())]
    # Both samples are bounded by the parameters, so they may be broadcast; rows that share an id are cut in the order of their texts.
    columns = ["text", "source", "lang", "size", "y", "held"]
    first = [F.xxhash64("id", F.lit(1)), F.xxhash64("text")]
    labelled = [rows.join(F.broadcast(part), "id").withColumn("held", held).orderBy(*first).limit(n).select(*columns) for part, n in zip(some, (quotas[y] for y in sorted(quotas)), strict=True)]
    drawn = _smallest(rows.select("id").where("id is not null").distinct().join(said, "id", "left_anti"), POOL, 2)
    pool = rows.join(F.broadcast(drawn), "id").withColumn("y", F.lit(-1)).withColumn("held", F.lit(False)).orderBy(*first).limit(POOL).select(*columns)
    for part in labelled:
        pool = pool.unionByName(part)
    got = sorted((r.y, r.held, bytes(r.text), bytes(r.meta)) for r in pool.mapInArrow(_features, "y int, held boolean, text binary, meta binary").collect())
    texts = np.array([np.frombuffer(g[2], dtype=np.float32) for g in got]).reshape(len(got), BUCKETS)
    metas = np.array([np.frombuffer(g[3], dtype=np.float32) for g in got]).reshape(len(got), META)
    known = np.array([g[0] for g in got], dtype=np.int64), np.array([g[1] for g in got], dtype=bool)
    return Model.fit((texts, metas), *known, prior=sizes.get(1, 0) / total if sizes else None)


def scored(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars"
) -> DataFrame:
    """Per document the chance that it is good by text, by metadata and by both, and whether it is kept."""
    rows = docs.select(
        F.col(doc).cast("bigint").alias("id"),
        *(F.col(c).cast("string").alias(n) for c, n in ((text, "text"), (source, "source"), (lang, "lang"))),
        F.col(size).cast("bigint").alias("size"),
    )
    model = fit(rows, labels, doc)
    found = rows.mapInArrow(_score(model), "id bigint, text_score double, meta_score double, score double")
    return found.withColumnRenamed("id", doc).withColumn("kept", F.col("score") >= KEEP)

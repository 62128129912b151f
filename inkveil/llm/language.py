"""Language identification in two steps: the family first, then the language within it.

Features are the shares of hashed letter 1-, 2- and 3-grams of the lower-cased text, words apart.
The family is picked by one-versus-rest linear support vector machines, the language within a family
by one-versus-one machines for each pair of its languages, whose votes (then margins) decide.

The machines are fitted on a bounded sample: of every label the ``SAMPLE`` distinct texts with the smallest
hashes, or all if there are fewer; whole texts. Everything is predicted, from the text alone. The sample is held by
the driver, so labels are not capped but cost memory and time there.

Defined results: ``und`` with score 0 for null texts and texts without a letter. Without any label to
learn from, all others are ``und`` too. Rows are documents; repeated or null ids are kept (a null
id is not held out). Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkveil.functions.lineage import written
from inkveil.llm.workers import frugal

SAMPLE = 400
BUCKETS = 1 << 13
PIECE = 1 << 20
UNKNOWN = "und"

#: Families by ISO 639-1 code, fixed values; any other label is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "indic": "bn gu hi mr ne pa sa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms tl",
    "dravidian": "kn ml ta te",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _grams(text: str) -> tuple[np.ndarray, int]:
    """How often each bucket's n-grams occur, and the number of letters."""
    counts, letters = np.zeros(BUCKETS, dtype=np.int64), 0
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = _letters()[points]
        letters += int(is_letter.sum())
        c = np.where(is_letter, points, 32).astype(np.uint32)
        c = np.concatenate([[32], c[(c != 32) | np.append(True, c[:-1] != 32)], [32]]).astype(np.uint32)
        two = c[:-1] * np.uint32(31) + c[1:]
        three = two[:-1] * np.uint32(31) + c[2:] + np.uint32(7)
        for mixed in (c * np.uint32(0x85EBCA6B), two * np.uint32(0x9E3779B1), three * np.uint32(0xC2B2AE35)):
            counts += np.bincount(mixed >> np.uint32(19), minlength=BUCKETS)
    return counts, letters


def _shares(counts: np.ndarray) -> np.ndarray:
    """Shares scaled so that a usual text has a length near 1."""
    return (counts * (8.0 / max(1, counts.sum()))).astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Weights and, last, the bias of a linear machine (squared hinge, dual coordinate descent); ``y`` is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    cost = c * len(y) / (2.0 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    size, alpha, w = (x * x).sum(axis=1) + 0.5 / cost, np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            step = (y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost[i]) / size[i]
            new = max(alpha[i] - step, 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    family_machines: np.ndarray  # one column for each family
    members: tuple[tuple[str, ...], ...]
    pair_machines: tuple[np.ndarray, ...]  # per family, one column for each pair of members

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> Model:
        langs = np.array(langs)
        known = sorted(set(langs.tolist()))
        of = np.array([_FAMILY.get(lang, lang) for lang in langs.tolist()])
        families = tuple(sorted(set(of.tolist())))
        none = np.zeros((BUCKETS + 1, 0), dtype=np.float32)
        first = [_machine(x, np.where(of == f, 1, -1)) for f in families] if len(families) > 1 else []
        members = tuple(tuple(lang for lang in known if _FAMILY.get(lang, lang) == f) for f in families)
        pairs = []
        for group in members:
            machines = []
            for a, b in combinations(group, 2):
                rows = (langs == a) | (langs == b)
                machines.append(_machine(x[rows], np.where(langs[rows] == a, 1, -1)))
            pairs.append(np.stack(machines, axis=1) if machines else none)
        return Model(families, np.stack(first, axis=1) if first else none, members, tuple(pairs))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x, score, f = np.append(x, np.float32(1)), 1.0, 0
        if len(self.families) > 1:
            margins = 4.0 * (x @ self.family_machines)
            shares = np.exp(margins - margins.max())
            f = int(margins.argmax())
            score = float(shares[f] / shares.sum())
        group = self.members[f]
        if len(group) == 1:
            return group[0], score
        margins = x @ self.pair_machines[f]
        votes, sums, chances = np.zeros(len(group)), np.zeros(len(group)), np.zeros(len(group))
        for m, (a, b) in zip(margins.tolist(), combinations(range(len(group)), 2), strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            chance = 1 / (1 + np.exp(-min(max(4 * m, -50), 50)))
            chances[a], chances[b] = chances[a] + chance, chances[b] + 1 - chance
        best = max(range(len(group)), key=lambda i: (votes[i], sums[i], -i))
        return group[best], score * float(chances[best]) / (len(group) - 1)


def held_out(doc: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [_shares(_grams(t)[0]).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from rows with a non-null label and a text; None if there are none."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    # Hashes below a label's bound are about two samples of distinct texts, so no task ranks more of them.
    share = 2.0 * SAMPLE / F.approx_count_distinct("h")
    bounds = written(hashed.groupBy("lang").agg(F.when(share < 1, (share * 2.0**63).cast("bigint")).alias("bound")))
    low = hashed.join(F.broadcast(bounds), "lang").where("bound is null or h < bound")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = written(low.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "h"))
    # Any one of the copies of a text.
    sample = low.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    got = sorted((r["lang"], bytes(r["x"])) for r in sample.mapInArrow(frugal(_features), "lang string, x binary").collect())
    if not got:
        return None
    return Model.fit(np.stack([np.frombuffer(x, dtype=np.float32) for _, x in got]), [lang for lang, _ in got])


def _predict(model: Model | None, text: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(text):
                counts, letters = _grams(value.as_py() or "")
                found.append(model.predict(_shares(counts)) if letters and model else (UNKNOWN, 0.0))
            said = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *said], names=[str(i) for i in range(len(keep) + 2)])

    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the language and the score of every row."""
    names = [f"c{i}" for i in range(len(keep))]
    wanted = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col(text).cast("string").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    # A kept text goes to the workers once.
    at = keep.index(text) if text in keep and dict(docs.dtypes)[text] == "string" else len(keep)
    wanted = wanted if at == len(keep) else wanted.drop("t")
    said = wanted.mapInArrow(frugal(_predict(model, at, list(range(len(keep))))), f"{schema}{', ' if keep else ''}l string, s double")
    return said.toDF(*keep, *out)


def identify(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the documents that are not held out and predict all."""
    model = fit(docs.where(~held_out(doc)), text, lang)
    said = predict(docs, model, [doc], text)
    return said.select(doc, held_out(doc).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of the documents that have a language, so that have a letter."""
    model = fit(docs.where(~held_out(doc)), text, lang)
    if model is None:
        return docs.where(F.col(text).cast("string").rlike(r"\p{L}"))
    # Names that no column of the documents has.
    lang_pred, score = (max(docs.columns, key=len) + suffix for suffix in ("_l", "_s"))
    said = predict(docs, model, docs.columns, text, out=(lang_pred, score))
    return said.where(F.col(lang_pred) != UNKNOWN).select(*docs.columns)

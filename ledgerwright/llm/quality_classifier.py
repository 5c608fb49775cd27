"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The votes of
all documents are counted by vote pattern (at most 3 to the number of labellers rows), and
expectation-maximisation on those counts estimates how often each labeller votes bad on
good documents and on each kind of bad ones, and with that each pattern's posterior.
Labellers come in groups that look at the same fault in different ways; there is a kind of
bad documents for each group, so that the votes of one kind's labellers are not held
against another kind. Nothing fixes a pattern's verdict beforehand: one labeller's alarm
that the others of its group do not share is weighed by what such alarms are worth.
Posteriors then train a linear scorer over hashed features (word shapes, signals), fitted
on a bounded number of rows, ``train_rows``; everything else covers all rows.

Each text is read once: votes and hashed features of all rows are written, and counting,
sampling and scoring read that table.

Cases: null and empty texts have no words, and every labeller votes bad on them; repeated
rows get equal scores; with fewer than two different vote patterns the scorer gives the
posterior; an empty table gives no rows; extra columns are not carried, so their names
cannot clash.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, chunks

#: Labellers by the fault they look for.
GROUPS = {"symbols": ("symbols", "marked_words", "plain_words"), "repeats": ("triples", "variety", "packed", "lines", "doubled"), "capitals": ("capital_words", "capital_letters", "capital_lines")}
LABELLERS = tuple(x for group in GROUPS.values() for x in group)
BAD, GOOD, NONE = 0, 1, -1
#: (limit of bad, limit of good, least number of words): a signal beyond the first is voted bad, beyond the second good.
LIMITS = {
    "symbols": (0.1, 0.02, 1), "marked_words": (0.1, 0.02, 1), "plain_words": (-0.4, -0.6, 5),
    "triples": (0.3, 0.1, 25), "variety": (-2.0, -4.0, 25), "packed": (-0.2, -0.3, 40), "lines": (0.5, 0.1, 25), "doubled": (0.2, 0.05, 8),
    "capital_words": (0.25, 0.05, 5), "capital_letters": (0.3, 0.1, 5), "capital_lines": (0.5, 0.1, 5),
}
_SYMBOL, _CAPITAL, _SMALL = re.compile(r"[#*$%&|<>]"), re.compile("[A-Z]"), re.compile("[a-z]")
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


def text_signals(text: str | None, words: list[str]) -> dict[str, float]:
    """What the labellers look at; signals of which less is worse come negative. Empty for a text without words."""
    n = len(words)
    if not n:
        return {}
    symbols = len(_SYMBOL.findall(text))
    big, small = len(_CAPITAL.findall(text)), len(_SMALL.findall(text))
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    raw = text.encode("utf-8", "surrogatepass")
    return {
        "symbols": symbols / n,
        "marked_words": len([w for w in words if _SYMBOL.search(w)]) / n if symbols else 0.0,
        "plain_words": -sum(map(str.isalpha, words)) / n,
        "triples": 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0.0,
        "variety": -len(set(words)) / math.sqrt(n),
        "packed": -len(zlib.compress(raw, 1)) / len(raw),
        "lines": 1 - len(set(lines)) / len(lines),
        "doubled": sum(map(str.__eq__, words, words[1:])) / n,
        "capital_words": sum(map(str.isupper, words)) / n,
        "capital_letters": big / (big + small) if big + small else 0.0,
        "capital_lines": sum(map(str.isupper, lines)) / len(lines),
    }


def votes(signals: dict[str, float], n: int) -> tuple[int, ...]:
    """One vote per labeller, in the order of LABELLERS; a text without words is bad to all."""
    if not n:
        return (BAD,) * len(LABELLERS)
    out = []
    for name in LABELLERS:
        bad, good, least = LIMITS[name]
        x = signals[name]
        out.append(NONE if n < least else BAD if x > bad else GOOD if x < good else NONE)
    return tuple(out)


def em(patterns: list[tuple[int, ...]], counts: np.ndarray, groups: list[list[int]], rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good per pattern, table p[labeller, class] of a bad vote where it votes, and the classes' shares.

    Class 0 is good, class 1 + g the bad documents of group g. A pattern's first belief in
    class 1 + g is the square of the share of bad votes among the group's, against the
    product of what the groups leave; no vote is no evidence. Rates and shares are
    smoothed by one document.
    """
    v = np.array(patterns)
    share = np.stack([(v[:, g] == BAD).sum(axis=1) / np.maximum(1, (v[:, g] != NONE).sum(axis=1)) for g in groups], axis=1)
    belief = np.c_[(1 - share).prod(axis=1) + 1e-3, share**2]
    belief /= belief.sum(axis=1, keepdims=True)
    bad, voted = (v == BAD).astype(float), (v != NONE).astype(float)
    good = voted - bad
    for _ in range(rounds):
        weight = belief * counts[:, None]
        rate = (bad.T @ weight + 0.5) / (voted.T @ weight + 1)
        prior = (weight.sum(axis=0) + 1) / (counts.sum() + belief.shape[1])
        log = np.log(prior) + bad @ np.log(rate) + good @ np.log(1 - rate)
        now = np.exp(log - log.max(axis=1, keepdims=True))
        now /= now.sum(axis=1, keepdims=True)
        done = np.abs(now - belief).max() < 1e-9
        belief = now
        if done:
            break
    return belief[:, 0], rate, prior


def labeller_groups() -> list[list[int]]:
    return [[LABELLERS.index(x) for x in group] for group in GROUPS.values()]


def _shape(word: str) -> str:
    upper = "A" if word.isupper() else ""
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return upper + word[:8]


def hashed_features(words: list[str], signals: dict[str, float], dim: int, memo) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values (to unit length) of a text's features."""
    at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    index, count = np.unique(at, return_counts=True)
    value = np.sqrt(count / max(1, len(words)))
    extra = [f"{k}:{min(20, int(10 * abs(v)))}" for k, v in signals.items()] + [f"n:{len(words).bit_length()}"]
    index = np.r_[index, [xxhash.xxh32_intdigest(k) % dim for k in extra]]
    value = np.r_[value, np.full(len(extra), 0.5)]
    return index.astype("<u2"), (value / np.linalg.norm(value)).astype("<f2")


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dim: int, rounds: int = 300, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by accelerated full gradient steps on soft targets."""
    doc = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    w, bias = np.zeros(dim), 0.0
    step, step_b = np.zeros(dim), 0.0
    for _ in range(rounds):
        z = np.bincount(doc, weights=w[index] * value, minlength=len(rows)) + bias
        err = 1 / (1 + np.exp(-z.clip(-50, 50))) - target
        step = 0.9 * step - rate * (np.bincount(index, weights=err[doc] * value, minlength=dim) / len(rows) + decay * w)
        step_b = 0.9 * step_b - rate * err.mean()
        w, bias = w + step, bias + step_b
    return w, bias


def pattern_code(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def pattern_of(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        code, x = divmod(code, 3)
        out.append(x - 1)
    return tuple(reversed(out))


def measured(docs: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """``id_col``, ``pattern`` int and ``at``, ``weight`` (packed feature indexes and values) of every row."""

    def run(batches):
        memo = Memo(lambda w: xxhash.xxh32_intdigest(_shape(w)) % dim, 300_000)
        for batch in chunks(batches, 500):
            codes, at, weight = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split() if text else []
                s = text_signals(text, words)
                index, value = hashed_features(words, s, dim, memo)
                codes.append(pattern_code(votes(s, len(words))))
                at.append(index.tobytes())
                weight.append(value.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32()), pa.array(at, pa.binary()), pa.array(weight, pa.binary())], names=[id_col, "pattern", "at", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, pattern int, at binary, weight binary")


def classify_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000, dim: int = 1 << 14) -> DataFrame:
    """``id_col``, ``weak_label`` (posterior of good), ``score`` (the scorer's), ``kept`` boolean of every row.

    The scorer's rows are the ``train_rows`` smallest by a hash of their features, whatever
    the size of the table. The result is a written table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    with Scratch(df.sparkSession) as tables:
        rows = tables.written(measured(df, id_col, text_col, dim), "quality-signals")
        found = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
        posterior: dict[int, float] = {}
        if found:
            good = em([pattern_of(r["pattern"]) for r in found], np.array([r["n"] for r in found], float), labeller_groups())[0]
            posterior = dict(zip((r["pattern"] for r in found), good.tolist(), strict=True))
        weights, bias = None, 0.0
        if len(posterior) > 1:
            place = F.xxhash64("pattern", "at", "weight", id_col)
            few = rows.select("pattern", "at", "weight", place.alias("place")).orderBy("place").limit(train_rows).collect()
            features = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["weight"], "<f2").astype(np.float64)) for r in few]
            weights, bias = fit_scorer(features, np.array([posterior[r["pattern"]] for r in few]), dim)

        def scored(batches):
            for batch in chunks(batches, 1000):
                weak = [posterior[p] for p in batch.column(1).to_pylist()]
                score = weak
                if weights is not None:
                    z = [float(weights[np.frombuffer(a, "<u2")] @ np.frombuffer(v, "<f2").astype(np.float64)) + bias for a, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                    score = [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in z]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array([x >= 0.5 for x in score], pa.bool_())], names=[id_col, "weak_label", "score", "kept"])

        return tables.written(rows.mapInArrow(scored, f"`{id_col}` {kind}, weak_label double, score double, kept boolean"), "quality-scores", keep=True)

"""Choosing among expanded features: ranks and searches by explained variance, and sigmoid features that adapt.

A search reads the samples once: every choice is weighed on one matrix of
moments of all candidates and what they are to explain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.expansions import expand
from driftline.functions.vectors import gather
from driftline.operators.estimators import Linear, map_vectors, slow_features
from driftline.operators.moments import Moments, dimension, merge, train, unlabelled


@dataclass(frozen=True)
class Ranked:
    """A chosen candidate, what it adds, and the share of variance explained with it and those before."""

    place: int
    gain: float
    explained: float


def joint_moments(samples: DataFrame, wide: Column, target: Column) -> tuple[Moments, int]:
    """Moments of the candidates with the target after them, and how many candidates there are."""
    candidates = dimension(samples.select(wide.alias("features")))
    both = samples.select(F.concat(wide, target).alias("features"))
    size = dimension(both)
    return merge(unlabelled(both, size), size), candidates


def explained_by_each(joint: Moments, candidates: int) -> np.ndarray:
    """The share of the target's variance that each candidate explains by itself; 0 for a constant one."""
    _, cov, _ = joint.fix()
    own = np.diag(cov)[:candidates]
    cross = (cov[:candidates, candidates:] ** 2).sum(axis=1)
    return np.where(own > 1e-12, cross / np.maximum(own, 1e-12), 0) / np.trace(cov[candidates:, candidates:])


def rank_linearly(joint: Moments, candidates: int, outputs: int | None = None, least_gain: float = 1e-12) -> list[Ranked]:
    """Candidates one by one, each the one that with those before explains most of the target by regression; the first of equals.

    What is chosen is swept out of the covariance of the others, so a step
    costs candidates squared. It stops when nothing gains more than least_gain.
    """
    _, cov, _ = joint.fix()
    own, cross = cov[:candidates, :candidates].copy(), cov[:candidates, candidates:].copy()
    whole, start = np.trace(cov[candidates:, candidates:]), np.diag(own).copy()
    out: list[Ranked] = []
    total = 0.0
    for _ in range(min(outputs or candidates, candidates)):
        left = np.diag(own)
        fresh = left > 1e-9 * np.maximum(start, 1e-300)
        gains = np.where(fresh, (cross**2).sum(axis=1) / np.where(fresh, left, 1), 0) / whole
        best = int(gains.argmax())
        if gains[best] <= least_gain:
            break
        total += float(gains[best])
        out.append(Ranked(best, float(gains[best]), total))
        share = own[:, best] / own[best, best]
        cross = cross - np.outer(share, cross[best])
        own = own - np.outer(share, own[best])
    return out


def rank_expansion(samples: DataFrame, names: tuple[str, ...], outputs: int | None = None, target: Column | None = None) -> list[Ranked]:
    """The components of an expansion of features, ranked by what they explain of the target (or of features)."""
    size = dimension(samples)
    joint, candidates = joint_moments(samples, expand(F.col("features"), size, *names), F.col("features") if target is None else target)
    return rank_linearly(joint, candidates, outputs)


def with_ranked(samples: DataFrame, names: tuple[str, ...], ranked: list[Ranked]) -> DataFrame:
    """samples whose features are the chosen components, the best first."""
    return samples.withColumn("features", gather(expand(F.col("features"), dimension(samples), *names), [r.place for r in ranked]))


def search_expansions(samples: DataFrame, choices: dict[str, tuple[str, ...]], target: Column, ridge: float = 1e-9) -> list[tuple[str, int, float]]:
    """(choice, size, explained) of each expansion, the best first: the share of the target's variance that regression on it explains.

    All are read at once: each name that is in some choice is expanded once.
    """
    size = dimension(samples)
    names = sorted({n for c in choices.values() for n in c})
    sizes = samples.select(*[F.size(expand(F.col("features"), size, n)).alias(f"n{k}") for k, n in enumerate(names)]).first()
    ends = np.cumsum([0, *sizes])
    places = {n: range(ends[k], ends[k + 1]) for k, n in enumerate(names)}
    joint, candidates = joint_moments(samples, expand(F.col("features"), size, *names), target)
    _, cov, _ = joint.fix()
    whole = np.trace(cov[candidates:, candidates:])
    out = []
    for choice, parts in choices.items():
        at = [p for n in parts for p in places[n]]
        cross = cov[np.ix_(at, range(candidates, len(cov)))]
        own = cov[np.ix_(at, at)]
        fitted = np.linalg.lstsq(own + ridge * np.diag(np.diag(own)), cross, rcond=1e-12)[0]
        out.append((choice, len(at), float((fitted * cross).sum() / whole)))
    return sorted(out, key=lambda r: (-r[2], r[0]))


def sigmoid_weights(rng: np.random.Generator, inputs: int, count: int, most: float = 4.0) -> np.ndarray:
    """Signed powers 1.5 of normal numbers, the largest scaled to most."""
    g = rng.normal(size=(inputs, count))
    w = np.sign(g) * np.abs(g) ** 1.5
    return w * (most / np.abs(w).max()) if w.size else w


def sigmoids(x: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """tanh(x W + l); an offset of 0.8 stands for the absolute power 0.8, one of 1.0 for x W itself."""
    y = x @ weights
    return np.where(offsets == 0.8, np.abs(y) ** 0.8, np.where(offsets == 1.0, y, np.tanh(y + offsets)))


def relevance(model: Linear) -> np.ndarray:
    """How much each input counts: the absolute weights, those of each output half as much as those of the one before."""
    return np.abs(model.weights) @ 0.5 ** np.arange(model.weights.shape[1])


@dataclass(frozen=True)
class AdaptedSigmoids:
    weights: np.ndarray
    offsets: np.ndarray
    slow: Linear

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.slow(sigmoids(x, self.weights, self.offsets))


def adapt_sigmoids(samples: DataFrame, mode: str, count: int, outputs: int, rounds: int = 3, keep: float = 0.5, seed: int = 0, ridge: float = 1e-6, **graph) -> AdaptedSigmoids:
    """Slow features of the inputs and sigmoids of them; each round the least relevant sigmoids give way to new ones. The best round's are returned.

    The inputs themselves always stay, so the result is never less slow than
    linear slow features. count: of all features, the inputs included.
    """
    size = dimension(samples)
    if count < size:
        raise ValueError(f"{count} features do not hold the {size} inputs")
    rng = np.random.default_rng(seed)
    weights = np.concatenate([np.eye(size), sigmoid_weights(rng, size, count - size)], axis=1)
    offsets = np.concatenate([np.ones(size), rng.normal(size=count - size)])
    best: AdaptedSigmoids | None = None
    for k in range(rounds):
        made = map_vectors(samples, lambda x, w=weights, o=offsets: sigmoids(x, w, o))
        tried = AdaptedSigmoids(weights, offsets, slow_features(train(made, mode, size=count, **graph), outputs, ridge))
        if best is None or tried.slow.values.sum() < best.slow.values.sum():
            best = tried
        if k < rounds - 1:
            order = np.argsort(-relevance(tried.slow)[size:], kind="stable") + size
            kept = [*range(size), *order[: round(keep * (count - size))]]
            fresh = count - len(kept)
            weights = np.concatenate([weights[:, kept], sigmoid_weights(rng, size, fresh)], axis=1)
            offsets = np.concatenate([offsets[kept], rng.normal(size=fresh)])
    return best

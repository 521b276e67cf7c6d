"""Non-linear expansions: vectors to longer vectors, by name.

An expansion is a function of a Column. Names follow a grammar rather than a
list: ``identity``; ``QT``, ``CT``, ``P4`` to ``P9`` (all monomials of a
degree); ``<u|s><power>`` (absolute or signed power, 08 is 0.8); ``adjK`` and
``mixK`` (a pair function at index distances 0 to K - 1, or 1 to K); ``selN_<name>``
(of the first N components); ``chC_oO_sS_<name>`` (a slice of each of C equal
channels); ``<QT|CT>_<n>_AP<power>`` and ``<Q|C>_<AN|N|E|AE|AP>`` (monomials
with normalised input or output); with ``_exp`` also the lower degrees, as in
``S_exp``, ``Q_exp`` and ``C_exp`` without a normaliser; ``cosD`` (cosines of
sums of D components).
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.vectors import dot, root_mean_square, signed_power

Expansion = Callable[[Column, int], Column]  # of a vector and its size
Pair = Callable[[Column, Column], Column]

PAIRS: dict[str, Pair] = {
    "product": lambda a, b: a * b,
    "abs_dif": lambda a, b: F.abs(a - b),
    "abs_sum": lambda a, b: F.abs(a + b),
    "sqrt_abs_sum": lambda a, b: F.sqrt(F.abs(a + b)),
    "sqrt_abs_dif": lambda a, b: F.sqrt(F.abs(a - b)),
    "signed_sqrt": lambda a, b: signed_power(a * b, 0.5),
    "unsigned_sqrt": lambda a, b: F.sqrt(F.abs(a * b)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "folded_gauss": lambda a, b: folded_gauss(a * b),
} | {f"signed_{p:02d}": (lambda a, b, p=p: signed_power(a * b, p / 10)) for p in (2, 3, 4, 6, 8)}


def _terms(places: Sequence[Sequence[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(p) for p in t]) for t in places])


def once(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a vector, which is held in an array of one element: what makes it is worked out once and not for each component."""
    return F.flatten(F.transform(F.array(x), fn))


def multisets(degree: int, combine: Pair) -> Expansion:
    """combine of degree components, each multiset of places once, in order of the places."""

    def made(x: Column, size: int) -> Column:
        def of(y: Column, start: Column, depth: int) -> Column:
            if depth == 1:
                return F.slice(y, start + 1, F.lit(size) - start)
            return F.flatten(F.transform(F.sequence(start, F.lit(size - 1)), lambda i: F.transform(of(y, i, depth - 1), lambda v: combine(F.get(y, i), v))))

        return once(x, lambda y: of(y, F.lit(0), degree))

    return made


def monomials(degree: int) -> Expansion:
    """All products of degree components."""
    return multisets(degree, lambda a, b: a * b)


def pairs_at(fn: Pair, distances: Sequence[int], anchors: int | None = None) -> Expansion:
    """fn of the components at each anchor and at each distance after it, anchor by anchor."""

    def made(x: Column, size: int) -> Column:
        last = size - max(distances) if anchors is None else anchors
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda i: F.array(*[fn(F.get(x, i), F.get(x, i + d)) for d in distances])))

    return made


def halves(fn: Pair) -> Expansion:
    """fn of each component of the first half with each of the second."""

    def made(x: Column, size: int) -> Column:
        a, b = F.slice(x, 1, size // 2), F.slice(x, size // 2 + 1, size - size // 2)
        return F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: fn(p, q))))

    return made


def each(fn: Callable[[Column], Column]) -> Expansion:
    return lambda x, size: F.transform(x, fn)


def first(n: int, inner: Expansion) -> Expansion:
    return lambda x, size: inner(F.slice(x, 1, n), min(n, size))


def parts_of(count: int, n: int, inner: Expansion) -> Expansion:
    """inner of the first n components of each of count equal parts."""

    def made(x: Column, size: int) -> Column:
        width = size // count
        return F.concat(*[inner(F.slice(x, k * width + 1, min(n, width)), min(n, width)) for k in range(count)])

    return made


def channels(count: int, offset: int, n: int, inner: Expansion, whole_if_short: bool = False) -> Expansion:
    """inner of a slice of each of count equal channels put together; too short channels raise, or give the whole vector."""

    def made(x: Column, size: int) -> Column:
        width = size // count
        if offset + n > width:
            if whole_if_short:
                return inner(x, size)
            raise ValueError(f"channels of {width} components have no {n} after {offset}")
        return inner(F.concat(*[F.slice(x, k * width + offset + 1, n) for k in range(count)]), count * n)

    return made


def control(n: int, inner: Expansion) -> Expansion:
    """Each of the first n components times the inner expansion of the others."""

    def made(x: Column, size: int) -> Column:
        made_of = inner(F.slice(x, n + 1, size - n), size - n)
        return F.flatten(F.transform(F.slice(x, 1, n), lambda c: F.transform(made_of, lambda v: c * v)))

    return made


def put_together(*inner: Expansion) -> Expansion:
    return lambda x, size: F.concat(*[e(x, size) for e in inner])


#: Exponents of the normalisers: fixed values, by the name of the expansion. The constant that is added is 1 in all.
EXPONENTS = {
    "Q_AN": 0.6, "Q_N": 0.6, "Q_E": 0.6, "Q_AE": 0.6, "Q_AP": 0.4,
    "C_AN": 0.73, "C_N": 0.73, "C_E": 0.73, "C_AE": 0.73, "C_AP": 0.3,
    "Q_AN_exp": 0.6, "Q_N_exp": 0.6, "Q_E_exp": 1.0, "Q_AE_exp": 1.0, "Q_AP_exp": 1.0,
    "C_AN_exp": 0.7333, "C_N_exp": 0.7333, "C_E_exp": 1.0, "C_AE_exp": 1.0, "C_AP_exp": 1.0,
    "S_exp": 0.8, "Q_exp": 2.0, "C_exp": 3.0,
}


def by_component(kind: str, x: Column, d: float, k: float = 1.0) -> Column:
    """x with each component normalised: AN by its power, AE by its exponential; AP its signed power."""
    if kind == "AP":
        return F.transform(x, lambda v: signed_power(v, d))
    size = (lambda v: F.pow(F.abs(v), F.lit(d))) if kind == "AN" else (lambda v: F.exp(d * F.abs(v)))
    return F.transform(x, lambda v: v / (k + size(v)))


def by_vector(kind: str, x: Column, y: Column, d: float, k: float = 1.0) -> Column:
    """y divided by what the root mean square of x gives, nulls counted as 0: N its power, E its exponential."""
    size = root_mean_square(F.transform(x, lambda v: F.coalesce(v, F.lit(0.0))))
    factor = 1 / (k + (F.pow(size, F.lit(d)) if kind == "N" else F.exp(d * size)))
    return once(factor, lambda f: F.transform(y, lambda v: v * f))


def normalised(kind: str, degree: int, d: float, k: float = 1.0) -> Expansion:
    """The monomials of a degree: of the normalised components, or themselves normalised by the vector."""
    inner = monomials(degree)
    if kind in ("N", "E"):
        return lambda x, size: by_vector(kind, x, inner(x, size), d, k)
    return lambda x, size: inner(by_component(kind, x, d, k), size)


def with_lower(kind: str, degree: int, d: float, k: float = 1.0) -> Expansion:
    """The normalised vector, then the monomials from degree 2 to this one, normalised too; those of C_AN_exp are of the vector as it is."""
    if kind in ("N", "E"):
        first_of = lambda x, size: by_vector(kind, x, x, d, k)
    else:
        first_of = lambda x, size: by_component(kind, x, d, k)
    plain = kind == "AN" and degree == 3
    return put_together(first_of, *[monomials(g) if plain else normalised(kind, g, d, k) for g in range(2, degree + 1)])


def powers_to(degree: int, d: float) -> Expansion:
    """The signed power d / degree of each component, then its monomials from degree 2 on; of degree 1, the vector and its absolute power d."""
    if degree == 1:
        return lambda x, size: F.concat(x, F.transform(x, lambda v: F.pow(F.abs(v), F.lit(d))))
    return with_lower("AP", degree, d / degree)


def cosines(degree: int, most_variables: int | None = None) -> Expansion:
    """cos(pi * sum) of each multiset of degree components of at most so many different ones."""

    def made(x: Column, size: int) -> Column:
        if most_variables is None or most_variables >= degree:
            return F.transform(multisets(degree, lambda a, b: a + b)(x, size), lambda v: F.cos(math.pi * v))
        places = [t for t in itertools.combinations_with_replacement(range(size), degree) if len(set(t)) <= most_variables]
        return F.transform(_terms(places), lambda t: F.cos(math.pi * F.aggregate(t, F.lit(0.0), lambda s, p: s + F.get(x, p))))

    return made


def smart_cosines(x: Column, size: int) -> Column:
    """The vector and its cosines up to a degree that falls with the size."""
    degree = 1 if size > 30 else 2 if size > 10 else 3 if size > 7 else 4 if size > 4 else 5
    return F.concat(x, *[cosines(d)(x, size) for d in range(1, degree + 1)])


def cosine_mix(blocks: Sequence[tuple[int, int, int]]) -> Expansion:
    """The vector, then blocks (first n components, degree, most variables) of cosines."""
    return put_together(lambda x, size: x, *[first(n, cosines(degree, most)) for n, degree, most in blocks])


def pair_with_next(fn: Pair) -> Expansion:
    """fn of each component and the next."""
    return lambda x, size: F.zip_with(F.slice(x, 1, size - 1), F.slice(x, 2, size - 1), fn)


def of_three(fn: Callable[[Column], Column]) -> Expansion:
    """fn of each component and the two after it, as a sorted vector; under three components there are none."""

    def made(x: Column, size: int) -> Column:
        if size < 3:
            return F.array().cast("array<double>")
        return F.transform(F.sequence(F.lit(0), F.lit(size - 3)), lambda k: fn(F.sort_array(F.slice(x, k + 1, 3))))

    return made


def folded_gauss(v: Column, width: float = 1.0) -> Column:
    """exp(-(v / width)^2), and 2 less that for negative values: a falling sigmoid."""
    bell = F.exp(-(v / width) * (v / width))
    return F.when(v < 0, 2 - bell).otherwise(bell)


def piecewise_power(v: Column, inside: float, outside: float) -> Column:
    """A signed power, with another exponent for values of 1 and more."""
    return F.when(F.abs(v) < 1, signed_power(v, inside)).otherwise(signed_power(v, outside))


def sigmoid_features(weights: Sequence[Sequence[float]], offsets: Sequence[float]) -> Expansion:
    """tanh(x W + l); an offset of 0.8 stands for the absolute power 0.8 of x W, one of 1.0 for x W itself."""

    def made(x: Column, size: int) -> Column:
        out = []
        for j, offset in enumerate(offsets):
            y = dot(x, F.array(*[F.lit(float(row[j])) for row in weights]))
            out.append(F.pow(F.abs(y), F.lit(0.8)) if offset == 0.8 else y if offset == 1.0 else F.tanh(y + offset))
        return F.array(*out)

    return made


SIMPLE: dict[str, Expansion] = {
    "identity": lambda x, size: x,
    "QT": monomials(2),
    "CT": monomials(3),
    **{f"P{d}": monomials(d) for d in range(4, 10)},
    "gauss": each(lambda v: F.exp(-v * v)),
    "neighbour_max": pair_with_next(PAIRS["max"]),
    "neighbour_sign": pair_with_next(lambda a, b: F.signum(a) * b),
    "median3": of_three(lambda t: F.get(t, 1)),
    "max3": of_three(lambda t: F.get(t, 2)),
    "midrange3": of_three(lambda t: (F.get(t, 0) + F.get(t, 2)) / 2),
    "piecewise_2_08": each(lambda v: piecewise_power(v, 2.0, 0.8)),
    "abs_piecewise_2_08": each(lambda v: F.abs(piecewise_power(v, 2.0, 0.8))),
    "folded_gauss": each(lambda v: folded_gauss(v)),
    "folded_gauss_wide": each(lambda v: folded_gauss(v, 2.0)),
    "tanh_s15_05": each(lambda v: F.tanh(0.5 * signed_power(v, 1.5)) / 0.5),
    "tanh_s15_0125": each(lambda v: F.tanh(0.125 * signed_power(v, 1.5)) / 0.125),
    "modulate_sign_08": pair_with_next(lambda a, b: F.signum(a) * signed_power(b, 0.8)),
    "modulate_02_07": pair_with_next(lambda a, b: signed_power(a, 0.2) * signed_power(b, 0.7)),
    "halves_product": halves(PAIRS["product"]),
    "pair_abs_sum": lambda x, size: F.concat(x, pairs_at(PAIRS["abs_sum"], range(1, size), size - 1)(x, size) if size < 2 else F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(F.slice(x, i + 1, size - i), lambda v: F.abs(F.get(x, i) + v))))),
    "norm_scaled": lambda x, size: F.transform(x, lambda v: v / root_mean_square(x)),
    "smart_cos": smart_cosines,
}


def _power(text: str) -> float:
    return int(text) / 10 ** (len(text) - 1) if text.startswith("0") or len(text) > 1 else float(text)


def expansion(name: str) -> Expansion:
    """The expansion of a name; an unknown one raises ValueError."""
    if name in SIMPLE:
        return SIMPLE[name]
    if m := re.fullmatch(r"([us])(\d+)", name):
        p = _power(m[2])
        return each(lambda v: F.pow(F.abs(v), F.lit(p))) if m[1] == "u" else each(lambda v: signed_power(v, p))
    if m := re.fullmatch(r"([us])(\d+)_([pm])(\d+)", name):
        p, shift = _power(m[2]), (1 if m[3] == "p" else -1) * int(m[4]) / 10
        return each(lambda v: F.pow(F.abs(v + shift), F.lit(p))) if m[1] == "u" else each(lambda v: signed_power(v + shift, p))
    if m := re.fullmatch(r"(\w+?)_(adj|mix)(\d+)", name):
        if m[1] in PAIRS:
            k = int(m[3])
            return pairs_at(PAIRS[m[1]], range(k) if m[2] == "adj" else range(1, k + 1))
    if m := re.fullmatch(r"sel(\d+)_(\w+)", name):
        return first(int(m[1]), expansion(m[2]))
    if m := re.fullmatch(r"div(\d+)_sel(\d+)_(\w+)", name):
        return parts_of(int(m[1]), int(m[2]), expansion(m[3]))
    if m := re.fullmatch(r"ch(\d+)_o(\d+)_s(\d+)_(\w+)", name):
        return channels(int(m[1]), int(m[2]), int(m[3]), expansion(m[4]), m[4] not in ("QT", "CT", "P4"))
    if m := re.fullmatch(r"([QC])T_(\d+)_AP(\d+)", name):
        return first(int(m[2]), normalised("AP", 2 if m[1] == "Q" else 3, _power(m[3])))
    if m := re.fullmatch(r"([SQC])(?:_(AN|N|E|AE|AP))?(_exp)?", name):
        degree = "SQC".index(m[1]) + 1
        if name in EXPONENTS:
            made = with_lower if m[3] else normalised
            return made(m[2], degree, EXPONENTS[name]) if m[2] else powers_to(degree, EXPONENTS[name])
    if name == "I_exp":
        return SIMPLE["identity"]
    if m := re.fullmatch(r"cos(\d+)(?:_v(\d+))?", name):
        return cosines(int(m[1]), int(m[2]) if m[2] else None)
    if m := re.fullmatch(r"control(\d+)_(\w+)", name):
        return control(int(m[1]), expansion(m[2]))
    raise ValueError(f"no expansion is called {name}")


def expand(x: Column, size: int, *names: str) -> Column:
    """The named expansions of a vector of known size, one after another."""
    return once(x, lambda y: F.concat(*[expansion(n)(y, size) for n in names]))

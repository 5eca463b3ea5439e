"""Whether a found tree is the law that made the data: the three notions that result rows report.

Trees are compared as functions, on the points of the problem, after their constants were
rounded; nothing is rewritten symbolically. Equal as functions up to rounding errors, the differences and
ratios that a symbolic comparison asks for are equal, constant or neither on the points too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ops import significant, small_to_zero
from ..sources.shared import kept, shuffled
from . import arrays

#: Digits that constants are rounded to, and the tolerance of the numeric proxy.
DIGITS, PROXY = 3, 1e-4
#: What counts as a rounding error, of the largest value or 1.
ROUNDING = 1e-9

#: How constants are read for each notion.
FORMS = {"digits": lambda v: significant(v, DIGITS), "decimals": small_to_zero, "given": lambda v: v}


#: Candidates that meet a block of points at once, about.
CHUNK = 32
#: Sums that leave rounding errors of this share at most say for sure that a fit by one factor is poor.
CLEAR = 1e-9

#: Of a pair over a block: points where both are finite, and one alone; the sums of y * y, y * f, f * f and y - f, the extremes of y - f, the largest |y|.
_STATS = ("n", "split", "yy", "yf", "ff", "d", "low", "high", "top")


def paired(candidates: DataFrame, truths: DataFrame) -> DataFrame:
    """tree_id, problem_id, and both trees of each candidate and its law, their constants in each form."""
    own = "law" if "law" in candidates.columns else "problem_id"
    laws = truths.select((F.col("tree_id") if own == "law" else F.col("problem_id")).alias("__law"), F.col("nodes").alias("law_nodes"), F.col("c").alias("law_c"))
    pairs = candidates.select("tree_id", "problem_id", F.col(own).alias("__law"), "nodes", "c").join(shuffled(laws), "__law")
    forms = lambda c: F.array(*(F.transform(c, form) for form in FORMS.values()))
    return pairs.select("tree_id", "problem_id", "nodes", "law_nodes", forms("c").alias("c"), forms("law_c").alias("law_c"))


def _met(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """ids, pairs and block: the pairs of each problem in chunks, beside each block of its points."""
    arrays.small_batches(pairs)
    some = pairs.groupBy("problem_id").agg(F.ceil(F.count("*") / CHUNK).alias("__chunks"))
    placed = pairs.join(shuffled(some), "problem_id")
    one = F.struct(*(c for c in pairs.columns if c != "problem_id"))
    chunks = placed.groupBy("problem_id", F.pmod(F.xxhash64("tree_id"), F.col("__chunks")).alias("__chunk")).agg(F.collect_list(one).alias("pairs"))
    return chunks.join(shuffled(blocks), "problem_id").select(F.col("pairs.tree_id").alias("ids"), "pairs", "block")


def _structures(lists: pa.Array, known: dict[tuple, tuple[int, list[dict]]]) -> list[tuple[int, list[dict]]]:
    """The number among the known ones and the nodes of each tree's structure, without Python objects for those seen before."""
    cuts = lists.offsets.to_numpy()
    cuts = cuts - cuts[0]
    fields = [lists.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("nt", "nv", "ci")]
    out = []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        key = tuple(v[low:high].tobytes() for v in fields)
        if key not in known:
            known[key] = len(known), lists[i].as_py()
        out.append(known[key])
    return out


def _constants(lists: pa.Array) -> list[tuple[float, ...]]:
    """The constants of each tree in each form, in a row."""
    forms = lists.flatten()
    cuts = forms.offsets.to_numpy()
    values = forms.flatten().to_numpy(zero_copy_only=False).tolist()
    return [tuple(values[low:high]) for low, high in zip((cuts - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist())]


def _values(pairs: pa.Array, x: np.ndarray, asked: list[bool], known: dict) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The values of different functions over the points, a row each, and for each pair and form asked for, the rows
    of the law and the find. Functions of one structure are evaluated together."""
    places: dict[tuple, int] = {}
    together: dict[int, tuple[list[dict], list[tuple[float, ...]], list[int]]] = {}
    sides = []
    for nodes, constants in (("law_nodes", "law_c"), ("nodes", "c")):
        rows, structures = [], _structures(pairs.field(nodes), known)
        for i, (c, wanted) in enumerate(zip(_constants(pairs.field(constants)), asked)):
            if wanted:
                number, tree = structures[i // len(FORMS)]
                at = places.setdefault((number, c), len(places))
                _, cs, ats = together.setdefault(number, (tree, [], []))
                if not ats or at > ats[-1]:
                    cs.append(c)
                    ats.append(at)
                rows.append(at)
        sides.append(rows)
    values = np.empty((len(places), len(x)))
    for tree, cs, ats in together.values():
        c = np.repeat(np.array(cs, dtype=float).reshape(len(ats), -1).T, len(x), axis=1)
        values[ats] = arrays.value(tree, np.tile(x, (len(ats), 1)), c).reshape(len(ats), len(x))
    return values, list(zip(*sides))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(name, T.DoubleType()) for name in _STATS])))
def _compared(pairs: pa.Array, block: pa.Array) -> pa.Array:
    """For each pair and form, in their order, the block's _STATS."""
    found, known = [], {}
    with np.errstate(all="ignore"):
        for some, b in zip(pairs, block):
            values, rows = _values(some.values, arrays.points_of(b.values)[0], [True] * len(FORMS) * len(some.values), known)
            different, at = np.unique(np.array(rows), axis=0, return_inverse=True)
            finite = np.isfinite(values)
            y, f = values[different[:, 0]], values[different[:, 1]]
            fine = finite[different[:, 0]] & finite[different[:, 1]]
            split = (finite[different[:, 0]] != finite[different[:, 1]]).sum(axis=1)
            y[~fine], f[~fine] = 0.0, 0.0
            d = y - f
            sums = [np.einsum("ij,ij->i", u, v) for u, v in ((y, y), (y, f), (f, f))]
            ends = [d.min(axis=1, where=fine, initial=np.inf), d.max(axis=1, where=fine, initial=-np.inf)]
            found.append(np.array([fine.sum(axis=1), split, *sums, d.sum(axis=1), *ends, np.abs(y).max(axis=1)])[:, at.ravel()])
    cuts = np.cumsum([0, *(v.shape[1] for v in found)])
    each = pa.StructArray.from_arrays([pa.array(v) for v in np.concatenate(found, axis=1)] if found else [pa.array([], pa.float64())] * len(_STATS), names=list(_STATS))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _scaled(pairs: pa.Array, block: pa.Array) -> pa.Array:
    """For each pair and form with a factor, the largest |y - factor * f| of the block; null for others and without a point where both are finite."""
    out, known = [], {}
    with np.errstate(all="ignore"):
        for some, b in zip(pairs, block):
            factors = some.values.field("factors").flatten().to_pylist()
            values, rows = _values(some.values, arrays.points_of(b.values)[0], [a is not None for a in factors], known)
            places, left = iter(rows), []
            for a in factors:
                y, f = (values[i] for i in next(places)) if a is not None else (None, None)
                fine = None if a is None else np.isfinite(y) & np.isfinite(f)
                left.append(float(np.abs(y - a * f)[fine].max()) if fine is not None and fine.any() else None)
            out.append(left)
    return pa.array(out, pa.list_(pa.float64()))


def judged(candidates: DataFrame, truths: DataFrame, points: DataFrame) -> DataFrame:
    """tree_id, strict, lenient and srbench of each candidate (tree_id, problem_id, nodes, c).

    strict: the law itself, constants to DIGITS digits. lenient: up to one factor or one added constant,
    not both; or so by the numeric proxy, constants as they are. srbench: up to either, constants to three
    decimals. truths: a law for each problem_id, or, where candidates have a column law, for each law, its tree_id. Points where both are not finite say
    nothing; one where a single side is finite says no. A candidate without a point that says something is no law.

    Blocks of points meet the pairs of their problem at once, so that what is shuffled is points once and sums by pair. The
    sums and extremes of a first pass settle all but whether a factor fits everywhere; the second is for pairs of which they don't say that it fails.
    """
    pairs = kept(paired(candidates, truths))
    blocks = kept(arrays.blocked(points.select("problem_id", "x", F.lit(0.0).alias("y"))))
    place = F.col("__at")
    of = (F.element_at("ids", (F.floor(place / len(FORMS)) + 1).cast("int")).alias("tree_id"), (place % len(FORMS)).alias("form"))
    keys = ["tree_id", "form"]
    each = _met(pairs, blocks).select("ids", F.posexplode(_compared("pairs", "block")).alias("__at", "__s")).select(*of, "__s.*")
    ends = {"low": F.min, "high": F.max, "top": F.max}
    sums = each.groupBy(*keys).agg(*(ends.get(name, F.sum)(name).alias(name) for name in _STATS)).where("n > 0")  # without a point that says something, no pair
    a, b = F.try_divide("yf", "ff"), F.col("d") / F.col("n")
    limit = F.element_at(F.array(*(F.lit(PROXY if form == "given" else ROUNDING) for form in FORMS)), F.col("form") + 1) * F.greatest(F.lit(1.0), F.col("top"))
    first = sums.select(
        *keys, "n", "split", "yy", "yf", "top", a.alias("a"), limit.alias("limit"), F.greatest(F.abs("low"), F.abs("high")).alias("far"), F.greatest(F.abs(F.col("low") - b), F.abs(F.col("high") - b)).alias("moved")
    )
    first = kept(first.withColumn("same", F.col("far") <= ROUNDING * F.greatest(F.lit(1.0), F.col("top"))))
    left = F.col("yy") - F.col("a") * F.col("yf")
    fails = (left > F.col("n") * F.col("limit") * F.col("limit") + CLEAR * F.col("yy")) & ~F.isnan(left)  # the squares of what the factor leaves are more than if each were within the limit
    open_ = first.where((F.col("split") == 0) & ~F.col("same") & ~(F.col("moved") < F.col("limit")) & (F.abs("a") >= 1e-9) & ~fails)
    factors = open_.groupBy("tree_id").agg(F.array(*(F.max(F.when(F.col("form") == i, F.col("a"))) for i in range(len(FORMS)))).alias("factors"))
    again = _met(kept(pairs.join(shuffled(factors), "tree_id")), blocks)
    scaled = again.select("ids", F.posexplode(_scaled("pairs", "block")).alias("__at", "scaled")).select(*of, "scaled").groupBy(*keys).agg(F.max("scaled").alias("scaled"))
    met = first.join(shuffled(scaled), keys, "left")
    within = F.coalesce(F.col("scaled") < F.col("limit"), F.lit(False)) | (F.col("moved") < F.col("limit"))
    number = {name: i for i, name in enumerate(FORMS)}
    says = lambda form, test: F.coalesce(F.bool_or((F.col("form") == number[form]) & (F.col("split") == 0) & test), F.lit(False))
    found = met.groupBy("tree_id").agg(
        says("digits", F.col("same")).alias("strict"), (says("digits", F.col("same") | within) | says("given", within)).alias("lenient"), says("decimals", F.col("same") | within).alias("srbench")
    )
    no: Column = F.lit(False)
    return candidates.select("tree_id").join(found, "tree_id", "left").select("tree_id", *(F.coalesce(x, no).alias(x) for x in ("strict", "lenient", "srbench")))

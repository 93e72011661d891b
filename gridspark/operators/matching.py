"""Which axes and constructs of two fields are the same."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Cells, Construct, Field
from .equality import EPSILON
from .reduce import allclose


@dataclass(frozen=True)
class Print:
    """What of an array can be told without a partner: counts that must agree, and hashes of all cells in an order of its axes."""

    cells: int
    missing: int
    nans: int
    hashes: tuple[int, int]


@dataclass(frozen=True)
class Match:
    """axes and keys of a field by those of the other."""

    axes: dict[str, str]
    keys: dict[str, str]


def _contents(c: Construct) -> list[Cells]:
    """The arrays of a construct: its data and its bounds, these with one axis more."""
    out = [c.data]
    if c.bounds is not None:
        flat = c.bounds.select(*c.axes, F.posexplode("bounds").alias("_corner", "value")).withColumn("_corner", F.col("_corner").cast("long"))
        out.append(Cells(flat, (*c.axes, "_corner"), (*c.data.shape, -1)))
    return out


def _orders(c: Construct) -> list[tuple[str, ...]]:
    return list(permutations(c.axes))


def _kind(c: Cells) -> str:
    return c.df.schema[c.value].dataType.simpleString()


def _hashed(c: Cells, order: tuple[str, ...], number: int) -> DataFrame:
    rest = [a for a in c.axes if a not in order]
    v = c.v
    if _kind(c) in ("float", "double"):
        v = F.when(v == 0, F.lit(0).cast(_kind(c))).otherwise(v)
        nans = F.count_if(F.isnan(c.v))
    else:
        nans = F.lit(0)
    place = [F.col(a) for a in (*order, *rest)]
    h = lambda seed: F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), *place, v, v.isNull())), F.lit(0))
    return c.df.agg(F.lit(number).alias("number"), F.count("*").alias("cells"), F.count_if(c.v.isNull()).alias("missing"), nans.cast("long").alias("nans"), h(1).alias("h1"), h(2).alias("h2"))


def prints(asked: list[tuple[Cells, tuple[str, ...]]]) -> list[Print]:
    """Of each array with an order of its axes, its print; one job for all, a row of partial sums a task."""
    if not asked:
        return []
    out = None
    for k, (c, order) in enumerate(asked):
        one = _hashed(c, order, k)
        out = one if out is None else out.unionByName(one)
    rows = {r["number"]: r for r in out.collect()}
    return [Print(r["cells"], r["missing"], r["nans"], (r["h1"], r["h2"])) for _, r in sorted(rows.items())]


def _close(pairs: list[tuple[Cells, Cells, tuple[str, ...]]], rtol: float, atol: float) -> list[bool]:
    """Whether arrays are equal within tolerances, cell by cell, where axis k of the first is order[k] of the second; one job for all."""
    out = None
    for k, (a, b, order) in enumerate(pairs):
        rest = [x for x in a.axes if x not in a.axes[: len(order)]]
        left = a.df.select(*(F.col(x).alias(f"_{d}") for d, x in enumerate(a.axes)), a.v.alias("x"), F.lit(True).alias("in_x"))
        right = b.df.select(*(F.col(x).alias(f"_{d}") for d, x in enumerate((*order, *rest))), b.v.alias("y"), F.lit(True).alias("in_y"))
        both = left.join(right, [f"_{d}" for d in range(len(a.axes))], "full_outer")
        numbers = {_kind(a), _kind(b)}.isdisjoint({"string", "boolean"})
        near = allclose(both, "x", "y", rtol, atol) if numbers else F.coalesce(F.bool_and(F.col("x").eqNullSafe(F.col("y"))), F.lit(True))
        one = both.agg(F.lit(k).alias("number"), (near & F.coalesce(F.bool_and(F.col("x").isNull() == F.col("y").isNull()), F.lit(True)) & F.coalesce(F.bool_and(F.col("in_x") & F.col("in_y")), F.lit(True))).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return [r["ok"] for r in sorted(out.collect())] if pairs else []


def _alike(a: Construct, b: Construct, ignore_type: bool) -> bool:
    """What needs no job: kind, properties, units, bounds there or not, and sizes in some order."""
    same = (a.type, a.properties, a.measure, a.cell, a.connectivity) == (b.type, b.properties, b.measure, b.cell, b.connectivity)
    return same and (a.bounds is None) == (b.bounds is None) and (a.data.units, a.data.calendar) == (b.data.units, b.data.calendar) and sorted(a.data.shape) == sorted(b.data.shape) and (ignore_type or _kind(a.data) == _kind(b.data))


def pairs(a: Field, b: Field, rtol: float = EPSILON, atol: float = EPSILON, ignore_type: bool = False) -> dict[tuple[str, str], list[tuple[str, ...]]]:
    """For constructs of a and b that are equal, the orders of b's axes in which they are.

    Two jobs at most, whatever the number of constructs: one takes the prints of all arrays, in all orders of axes; where
    prints are equal no more is compared. Where only hashes differ, cells are compared within the tolerances in the
    second. Arrays with NaN are equal to none."""
    left, right = ([c for c in f.constructs if c.data is not None] for f in (a, b))
    asked = [(x, c.axes) for c in left for x in _contents(c)]
    asked += [(x, o) for c in right for o in _orders(c) for x in _contents(c)]
    found = iter(prints(asked))
    mine = {c.key: [next(found) for _ in _contents(c)] for c in left}
    theirs = {(c.key, o): [next(found) for _ in _contents(c)] for c in right for o in _orders(c)}
    out: dict[tuple[str, str], list[tuple[str, ...]]] = {}
    open_: list[tuple[str, str, tuple[str, ...], int]] = []
    compared: list[tuple[Cells, Cells, tuple[str, ...]]] = []
    for c in left:
        for d in right:
            if not _alike(c, d, ignore_type):
                continue
            for order in _orders(d):
                sizes = d.data.sizes
                if tuple(sizes[x] for x in order) != c.data.shape:
                    continue
                x, y = mine[c.key], theirs[d.key, order]
                if any(p.cells != q.cells or p.missing != q.missing or p.nans or q.nans for p, q in zip(x, y)):
                    continue
                if [p.hashes for p in x] == [q.hashes for q in y]:
                    out.setdefault((c.key, d.key), []).append(order)
                else:
                    open_.append((c.key, d.key, order, len(x)))
                    compared += [(p, q, order) for p, q in zip(_contents(c), _contents(d))]
    if (rtol or atol) and compared:
        ok = iter(_close(compared, rtol, atol))
        for x, y, order, n in open_:
            if all([next(ok) for _ in range(n)]):
                out.setdefault((x, y), []).append(order)
    return out


def matched(a: Field, b: Field, rtol: float = EPSILON, atol: float = EPSILON, ignore_type: bool = False) -> Match | None:
    """How the axes and constructs of one field map to the other's so that all are equal; None if there is no way.

    After pairs() no data are read. Axes have signatures, their sizes and what spans them at which place, refined until they
    tell no more apart; the search takes the construct with the fewest partners first and goes back where a choice
    contradicts the axes, which happens only among constructs that are equal in themselves. Axes that no construct with
    data spans are paired by size. Cell methods must be the same in their order on the axes found."""
    left, right = ([c for c in f.constructs if c.data is not None] for f in (a, b))
    sizes = [{**f.data.sizes, **{c.key: c.size for c in f.constructs if c.type == "domain_axis"}} for f in (a, b)]
    if len(left) != len(right) or sorted(sizes[0].values()) != sorted(sizes[1].values()):
        return None
    equal = pairs(a, b, rtol, atol, ignore_type)
    marks = _signatures(left, right, equal, sizes)
    choices = {c.key: [(d.key, order) for d in right for order in equal.get((c.key, d.key), []) if all(marks[0][p] == marks[1][q] for p, q in zip(c.axes, order))] for c in left}
    axes_of = {c.key: c.axes for c in left}
    methods = [[c for c in f.constructs if c.type == "cell_method"] for f in (a, b)]
    references = [[c for c in f.constructs if c.type == "coordinate_reference"] for f in (a, b)]
    others = [sorted((c.type, str(sorted(c.properties.items())), c.ncvar or "") for c in f.constructs if c.data is None and c.type not in ("domain_axis", "cell_method", "coordinate_reference")) for f in (a, b)]
    if others[0] != others[1] or len(methods[0]) != len(methods[1]):
        return None

    def same_references(keys: dict[str, str]) -> bool:
        """Whether coordinate references agree in parameters, and in coordinates and terms as they are matched."""
        said = lambda c, to: (str(sorted(c.properties.items())), sorted(to.get(k, k) for k in c.coordinates), sorted((t, to.get(k, k)) for t, k in c.terms.items()))
        return sorted(said(c, keys) for c in references[0]) == sorted(said(c, {}) for c in references[1])

    def rest(axes: dict[str, str]) -> dict[str, str] | None:
        """Axes without constructs: those of the data by their place, the others by size."""
        out = dict(axes)
        for p, q in zip(a.data.axes, b.data.axes):
            if p not in out and q not in out.values() and sizes[0][p] == sizes[1][q]:
                out[p] = q
        for p, n in sizes[0].items():
            if p not in out:
                q = next((q for q, m in sizes[1].items() if m == n and q not in out.values()), None)
                if q is None:
                    return None
                out[p] = q
        named = lambda c, to: ([to.get(x, x) for x in c.axes], c.method, c.properties)
        return out if all(named(c, out) == named(d, {}) for c, d in zip(*methods)) else None

    def search(todo: list[str], axes: dict[str, str], keys: dict[str, str]) -> Match | None:
        if not todo:
            whole = rest(axes)
            return Match(whole, keys) if whole is not None and same_references(keys) else None
        used = set(keys.values())
        back = {q: p for p, q in axes.items()}

        def fits(key: str) -> list[tuple[str, tuple[str, ...]]]:
            return [(d, order) for d, order in choices[key] if d not in used and all(axes.get(p, q) == q and back.get(q, p) == p for p, q in zip(axes_of[key], order))]

        options = {key: fits(key) for key in todo}
        key = min(todo, key=lambda k: len(options[k]))
        for d, order in options[key]:
            got = search([k for k in todo if k != key], {**axes, **dict(zip(axes_of[key], order))}, {**keys, key: d})
            if got:
                return got
        return None

    return search([c.key for c in left], {}, {})


def _signatures(left: list[Construct], right: list[Construct], equal: dict, sizes: list[dict[str, int]]) -> list[dict[str, str]]:
    """A mark for each axis of both fields, such that axes with different marks cannot be the same."""
    # Constructs that are equal, in whatever order of axes and by whatever chain, get one number.
    number = {(side, c.key): k for k, (side, c) in enumerate([*((0, c) for c in left), *((1, d) for d in right)])}
    for x, y in equal:
        old, new = number[1, y], number[0, x]
        number = {k: new if n == old else n for k, n in number.items()}
    marks = [{x: str(n) for x, n in s.items()} for s in sizes]
    for _ in range(max(map(len, marks), default=0)):
        new: list[dict[str, str]] = []
        for side, own in enumerate((left, right)):
            spans: dict[str, list] = {x: [] for x in marks[side]}
            for c in own:
                for x in c.axes:
                    spans[x].append((number[side, c.key], sorted(marks[side][y] for y in c.axes if y != x)))
            new.append({x: f"{marks[side][x]}:{sorted(spans[x])}" for x in spans})
        # Marks grow; numbers in their place say as much.
        names = {m: str(k) for k, m in enumerate(sorted({m for s in new for m in s.values()}))}
        new = [{x: names[m] for x, m in s.items()} for s in new]
        if all(len(set(n.values())) == len(set(o.values())) for n, o in zip(new, marks)):
            return new
        marks = new
    return marks


def renamed(c: Cells, axes: dict[str, str]) -> Cells:
    """Cells of the second field with the axis names of the first."""
    back = {q: p for p, q in axes.items()}
    new = tuple(back.get(x, x) for x in c.axes)
    return Cells(c.df.select(*(F.col(x).alias(y) for x, y in zip(c.axes, new)), c.v.alias(c.value)), new, c.shape, c.value, c.units, c.calendar, c.fill, c.hardmask)

"""Exact selection of rows by rank, without sorting the table.

``NTILE(k)`` and interpolated quantiles need only the few rows at the bucket
boundaries; every other row is then placed by comparing its order key with
those. The rows are found by narrowing (Floyd and Rivest): a hashed sample of
the rows between two known bounds gives tighter bounds around each rank, one
aggregate counts exactly how many rows lie below and between them, and once
few enough rows are left between the bounds they are looked at themselves.
Each pass is a scan with a partial aggregate; nothing is shuffled but one row
of counts per task, and a value that a third of the rows share is told apart
by the key behind it like any other.

Order keys are structs, compared field by field (a null comes first). They
must be unique, as must any total order: end them with the row's key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows between two bounds that may be collected, and the size of a sample.
FEW, SAMPLE = 20_000, 4_000


@dataclass
class _Target:
    """A rank looked for among the rows above ``lo`` and up to ``hi``."""

    rank: int
    lo: tuple | None = None
    hi: tuple | None = None
    below: int = 0
    inside: int = 0
    found: tuple | None = None


def _ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r))


@dataclass
class OrderKey:
    """A named struct of columns to order by, ascending."""

    columns: Sequence[Column]
    types: list[str] = field(default_factory=list)

    def struct(self) -> Column:
        return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self.columns)])

    def literal(self, row: tuple) -> Column:
        return F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(row, self.types))])

    def within(self, lo: tuple | None, hi: tuple | None) -> Column:
        out = F.lit(True)
        if lo is not None:
            out = out & (self.struct() > self.literal(lo))
        return out & (self.struct() <= self.literal(hi)) if hi is not None else out


def rows_at_ranks(df: DataFrame, key: OrderKey, ranks: Sequence[int], total: int, few: int = FEW, sample: int = SAMPLE) -> list[tuple | None]:
    """The order keys of the rows at 1-based ``ranks`` of ``df`` (``total``
    rows, stored: it is scanned several times); None outside 1..total."""
    key.types = [f.dataType.simpleString() for f in df.select(key.struct().alias("k")).schema["k"].dataType.fields]
    # a span no larger than its sample would not get any narrower
    few, sample = max(few, sample), max(sample, 100)
    targets = {r: _Target(r, inside=total) for r in set(ranks) if 1 <= r <= total}
    turn = 0
    while any(t.found is None for t in targets.values()):
        open_ = [t for t in targets.values() if t.found is None]
        spans = {(t.lo, t.hi): t.inside for t in open_}
        drawn = _draw(df, key, spans, few, sample, turn)
        for t in open_:
            rows = drawn[t.lo, t.hi]
            if t.inside <= few:
                t.found = rows[t.rank - t.below - 1]
        open_ = [t for t in open_ if t.found is None]
        if open_:
            _narrow(df, key, open_, drawn)
        turn += 1
    return [targets[r].found if r in targets else None for r in ranks]


def _draw(df: DataFrame, key: OrderKey, spans: dict[tuple, int], few: int, sample: int, turn: int) -> dict[tuple, list[tuple]]:
    """Per span its rows if few, a hashed sample of about ``sample`` of them
    otherwise; in order. One scan for all spans."""
    span_of, taken = list(spans), []
    spot = F.pmod(F.xxhash64(key.struct(), F.lit(turn)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    for lo, hi in span_of:
        n = spans[lo, hi]
        taken.append(key.within(lo, hi) & (F.lit(True) if n <= few else spot < sample / n))
    each = df.select(key.struct().alias("k"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(taken)]))).alias("i"))
    out = {s: [] for s in span_of}
    for r in each.collect():
        out[span_of[r["i"]]].append(tuple(r["k"]))
    return {s: _ordered(rows) for s, rows in out.items()}


def _narrow(df: DataFrame, key: OrderKey, targets: list[_Target], drawn: dict[tuple, list[tuple]]) -> None:
    """Tighter bounds for every target, by exact counts in one aggregate."""
    marks, counts = [], []
    for i, t in enumerate(targets):
        rows = drawn[t.lo, t.hi]
        p = (t.rank - t.below) / t.inside
        margin = 3 * (len(rows) * p * (1 - p)) ** 0.5 + 1
        a, b = int(p * len(rows) - margin), int(p * len(rows) + margin) + 1
        lo = rows[a] if rows and a >= 0 else t.lo
        hi = rows[b] if rows and b < len(rows) else t.hi
        marks.append((lo, hi))
        counts += [F.count_if(key.within(t.lo, lo) if lo != t.lo else F.lit(False)).alias(f"a{i}"), F.count_if(key.within(lo, hi)).alias(f"b{i}")]
    row = df.agg(*counts).first()
    for i, (t, (lo, hi)) in enumerate(zip(targets, marks)):
        under, between = row[f"a{i}"], row[f"b{i}"]
        place = t.rank - t.below
        if place <= under:
            t.hi, t.inside = lo, under
        elif place <= under + between:
            t.lo, t.hi, t.below, t.inside = lo, hi, t.below + under, between
        else:
            t.lo, t.below, t.inside = hi, t.below + under + between, t.inside - under - between


def above(key: OrderKey, bounds: Sequence[tuple | None]) -> Column:
    """How many of the given order keys lie strictly below the row's own."""
    out = F.lit(0)
    for b in bounds:
        if b is not None:
            out = out + (key.struct() > key.literal(b)).cast("int")
    return out


def ntile_bounds(total: int, k: int) -> list[int]:
    """Ranks of the last rows of the first k - 1 buckets of NTILE(k)."""
    q, m = divmod(total, k)
    return [i * q + min(i, m) for i in range(1, k)]


def ntile_column(df: DataFrame, key: OrderKey, k: int, total: int) -> Column:
    """``NTILE(k) OVER (ORDER BY key)`` as a column over a stored ``df``."""
    bounds = rows_at_ranks(df, key, ntile_bounds(total, k), total)
    return (1 + above(key, bounds)).cast("int")


def quantile_values(df: DataFrame, key: OrderKey, probs: Sequence[float], total: int) -> list[float]:
    """Quantiles of the key's first column, linearly interpolated between
    neighbouring rows (which must not be null)."""
    places = [(p * (total - 1)) for p in probs]
    lows = [int(x) + 1 for x in places]
    rows = rows_at_ranks(df, key, [r for low in lows for r in (low, min(low + 1, total))], total)
    values = [float(r[0]) for r in rows]
    return [values[2 * i] + (x - int(x)) * (values[2 * i + 1] - values[2 * i]) for i, x in enumerate(places)]

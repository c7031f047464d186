"""G1: ranks and running sums that never put an unbounded group in one task.

A window with no PARTITION BY, or partitioned by a key that may hold a third of
all rows, sorts that whole group in a single task. ``prefix_scan`` is one plan
for all of them, whatever the sizes: the caller names *levels*, expressions that
cut each key's order into segments fixed by the data (a date, the first digits
of a hash, the exponent and leading bits of a score), coarse to fine.

1. One aggregation, combined map-side, gives each segment's sums and count.
2. Per level, a window over the siblings of a segment carries what comes before
   it; a segment has only as many children as its level has values.
3. The rows are shuffled once, by key and segment, joined with their segment's
   carry on that same partitioning, and summed inside the segment.

No job runs while the plan is built, nothing is sampled and nothing is
checkpointed: the segments depend on each row alone, so recomputed tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str],
                   broadcast: bool = False) -> DataFrame:
    """Inner join on ``keys`` where NULL matches NULL (a NULL key is a group
    of its own and its rows are kept); ``right``'s key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k)
                             for k in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    other = F.broadcast(renamed) if broadcast else renamed
    return left.join(other, cond).drop(*[f"_r_{k}" for k in keys])


def hash_key(salt: str, id_col: str) -> Column:
    """``md5(salt || id)`` as hex text (identical in Spark and DuckDB)."""
    return F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string")))


def carried(before: Column, own: Column) -> Column:
    """A running sum continued: NULL only while no value has been seen."""
    return F.coalesce(before + own, before, own)


def _grouping(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that stand for ``cols`` and are never NULL: a value, and where needed a flag.

    Joins and windows over the same plain columns share one shuffle; a null-safe
    comparison would be planned as an expression that no window matches.
    """
    made, names = {}, []
    for c in cols:
        field = df.schema[c]
        kind = field.dataType
        zero = F.lit("") if isinstance(kind, StringType) else F.lit(0).cast("timestamp").cast(kind) \
            if isinstance(kind, DateType | TimestampType | TimestampNTZType) else F.lit(0).cast(kind)
        made[f"_v{c}"] = F.coalesce(F.col(c), zero) if field.nullable else F.col(c)
        names.append(f"_v{c}")
        made[f"_z{c}"] = F.col(c).isNull()
        names.append(f"_z{c}")
    return df.withColumns(made), names


def _along(names: list[str], descending: bool) -> list[Column]:
    """Window order over ``_grouping`` columns of one level: NULL first, or last if descending."""
    value, flag = (F.col(n) for n in names)
    return [flag.asc(), value.desc()] if descending else [flag.desc(), value.asc()]


def _carries(df: DataFrame, keys: list[str], seg: list[list[str]], values: list[str], descending: bool) -> DataFrame:
    """Per finest segment: rows and sums before it (``_b_*``) and of its whole key (``_t_*``).

    ``keys`` and ``seg`` (by level) are ``_grouping`` columns.
    """
    cols = ["_n", *[f"_s_{v}" for v in values]]
    upto = [[*keys, *[c for level in seg[:d] for c in level]] for d in range(len(seg) + 1)]
    sums = df.groupBy(*upto[-1]).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    by_level = [sums]
    for depth in range(len(seg) - 1, 0, -1):
        by_level.insert(0, by_level[0].groupBy(*upto[depth]).agg(*[F.sum(c).alias(c) for c in cols]))
    out = None
    for depth, part in enumerate(by_level):
        parent = upto[depth]
        siblings = Window.partitionBy(*parent).orderBy(*_along(seg[depth], descending)).rowsBetween(Window.unboundedPreceding, -1)
        own = part.select(*upto[depth + 1], *[F.sum(c).over(siblings).alias(f"_o{c}") for c in cols], *(
            [F.sum(c).over(Window.partitionBy(*parent)).alias(f"_t{c}") for c in cols] if depth == 0 else []))
        if out is None:
            out = own.withColumnsRenamed({f"_o{c}": f"_b{c}" for c in cols})
        else:
            out = own.join(out, parent).withColumns(
                {f"_b{c}": carried(F.col(f"_b{c}"), F.col(f"_o{c}")) for c in cols}).drop(*[f"_o{c}" for c in cols])
    return out


def prefix_scan(df: DataFrame, keys: list[str], levels: dict[str, Column], order: list[str], *,
                extra: DataFrame | None = None, descending: bool = False,
                rank_col: str | None = None, running: dict[str, str] | None = None, inclusive: bool = True,
                totals: dict[str, str] | None = None, counts: str | None = None) -> DataFrame:
    """Row numbers, running sums (ROWS frame), key totals and counts of ``df``.

    ``levels`` maps segment columns, coarse to fine, to expressions that never
    decrease along ``order`` (never increase, if ``descending``) within a key.
    The rows of one finest segment are summed in one task, so its size is the
    caller's bound. ``running`` and ``totals`` map output to input columns;
    without ``inclusive`` the current row is left out. NULL keys and segments
    are groups of their own. ``extra`` holds a row per key whose columns are
    added beside the sums, where a key has few rows; keys it doesn't know, and
    NULL keys, drop out.
    """
    running, totals = running or {}, totals or {}
    values = sorted(set(running.values()) | set(totals.values()))
    rows, by_key = _grouping(df, keys)
    rows = rows.withColumns(levels)
    seg = []
    for name in levels:
        rows, own = _grouping(rows, [name])
        seg.append(own)
    carry = _carries(rows, by_key, seg, values, descending)
    if extra is not None:
        known, same = _grouping(extra.dropna(subset=keys), keys)
        carry = carry.join(known.select(*same, *[c for c in extra.columns if c not in keys]), same)
    group = [*by_key, *[c for level in seg for c in level]]
    local = Window.partitionBy(*group).orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])
    frame = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.join(carry, group)
    if rank_col:
        out = out.withColumn(rank_col, (F.coalesce("_b_n", F.lit(0)) + F.row_number().over(local)).cast("long"))
    for name, c in running.items():
        out = out.withColumn(name, carried(F.col(f"_b_s_{c}"), F.sum(c).over(frame)))
    for name, c in totals.items():
        out = out.withColumn(name, F.col(f"_t_s_{c}"))
    if counts:
        out = out.withColumn(counts, F.col("_t_n").cast("long"))
    helpers = [f"{side}{c}" for side in ("_b", "_t") for c in ("_n", *[f"_s_{v}" for v in values])]
    return out.drop(*group, *levels, *helpers)


def rank_by_hash(df: DataFrame, id_col: str, salt: str, by: list[str] | None = None,
                 rank_col: str = "rank", size_col: str | None = None,
                 digits: tuple[int, ...] = (3, 2)) -> DataFrame:
    """Dense 1-based rank of rows ordered by ``md5(salt || id)`` (ties by id)
    within each ``by`` group; optionally the group size.

    ``by`` may have any number of values; the levels are runs of hex ``digits``
    of the hash, uniform by construction (a million segments by default).
    """
    by = list(by or [])
    keyed = df.withColumn("_h", hash_key(salt, id_col))
    at, levels = 1, {}
    for i, n in enumerate(digits):
        levels[f"_d{i}"] = F.substring("_h", at, n)
        at += n
    if not by:  # one key for all rows
        keyed, by = keyed.withColumn("_all", F.lit(0)), ["_all"]
    out = prefix_scan(keyed, by, levels, ["_h", id_col], rank_col=rank_col, counts=size_col)
    return out.drop("_h", "_all")


def number_levels(value: Column, bits: int = 20) -> dict[str, Column]:
    """Two levels that grow with a number: its signed exponent, then the leading ``bits`` of the rest.

    A level-one segment has at most 2**(bits + 1) children, and scores that
    crowd into one exponent are split again by the second level. NULL is a
    segment of its own; NaN is not ordered and has to be excluded.
    """
    x = value.cast("double")
    size = F.abs(x)
    limit = F.lit(float("inf"))
    exponent = F.when(size == limit, F.lit(2000)).otherwise(F.floor(F.log2(F.when((size > 0) & (size < limit), size))).cast("int"))
    signed = F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * (exponent + 3000))
    rest = F.when((size > 0) & (size < limit), x / F.pow(F.lit(2.0), exponent.cast("double"))).otherwise(F.lit(0.0))
    return {"_e": signed, "_m": F.when(x.isNotNull(), F.floor(rest * F.lit(float(1 << bits))).cast("long"))}


def ordered_prefix(df: DataFrame, order_col: str, sums: dict[str, str],
                   descending: bool = True, inclusive: bool = True,
                   totals: dict[str, str] | None = None) -> DataFrame:
    """Running sums over a numeric ``order_col`` (one row per distinct value expected).

    ``sums`` maps output to input columns. With ``inclusive`` the current row
    counts, otherwise strictly earlier rows only; an empty sum is 0.
    """
    out = prefix_scan(df.withColumn("_all", F.lit(0)), ["_all"], number_levels(F.col(order_col)), [order_col],
                      descending=descending, running=sums, inclusive=inclusive, totals=totals)
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in sums}).drop("_all")

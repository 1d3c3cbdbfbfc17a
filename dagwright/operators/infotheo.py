"""Discretisation, entropy, mutual information and link strength.

One scan finds the cut points of all columns, one aggregation counts the cells;
everything after that works on the table of counts, whose size depends on the
number of cells, not of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Dist, Schema, with_levels

#: Rules for the number of bins of a numeric column.
METHODS = ("sturges", "doane", "sqrt", "rice", "scott", "fd", "terrell-scott", "cencov", "scott_range", "fd_range")


def quantiles(df: DataFrame, column: str, at: Sequence[float], small: int = 1_000_000) -> list[float]:
    """Exact quantiles (linear between order statistics) of a column of any size.

    An order statistic is closed in on by counting in 1,024 equal intervals of
    the interval that holds it, until that holds ``small`` rows at most; these are
    then sorted. Each step is one scan with a bounded aggregation.
    """
    return column_quantiles(df, [column], at, small)[column]


def column_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], small: int = 1_000_000) -> dict[str, list[float]]:
    """Exact quantiles of some columns: all order statistics of all columns close in
    together, one scan a step."""
    x = {c: F.col(c).cast("double") for c in columns}
    first = df.agg(*[f for c in columns for f in (F.count(x[c]).alias(f"n {c}"), F.min(x[c]).alias(f"lo {c}"), F.max(x[c]).alias(f"hi {c}"))]).first()
    # (column, rank) -> interval [a, b] that holds it, rows below a, rows within
    open_: dict[tuple[str, int], tuple] = {}
    for c in columns:
        n = first[f"n {c}"]
        for q in at if n else ():
            k = math.floor((n - 1) * q)
            for r in {k, min(k + 1, n - 1)}:
                open_[c, r] = first[f"lo {c}"], first[f"hi {c}"], 0, n
    found = {at_: v[0] for at_, v in open_.items() if v[0] == v[1]}
    while todo := {k: v for k, v in open_.items() if k not in found}:
        # What is small enough is sorted; all else is counted in equal intervals.
        spans = sorted({(c, a, b, below, left) for (c, _), (a, b, below, left) in todo.items()})
        last = {s for s in spans if s[4] <= small or (s[2] - s[1]) / 1024 <= 0 or s[1] + (s[2] - s[1]) / 1024 == s[1]}
        cells = []
        for i, (c, a, b, below, _) in enumerate(spans):
            v = x[c]
            if spans[i] in last:
                # As many values as a span has rows at most, each with its number.
                cell = F.when(v.between(a, b), F.struct(F.lit(i).alias("i"), F.lit(0).alias("c"), v.alias("x")))
            else:
                step = (b - a) / 1024
                cell = F.when(v.between(a, b), F.struct(F.lit(i).alias("i"), F.least(F.lit(1023), F.floor((v - F.lit(a)) / F.lit(step))).cast("int").alias("c"), F.lit(None).cast("double").alias("x")))
            cells.append(cell)
        rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("s"), F.array(*[x[c] for c in columns]).alias("v"))
        value = F.element_at("v", F.element_at(F.array(*[F.lit(columns.index(s[0]) + 1) for s in spans]), F.col("s.i") + 1))
        counted = rows.select("s", value.alias("y")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
        # Running counts within each span: a window over its few cells or values.
        order = Window.partitionBy("s.i").orderBy("s.c", "s.x").rowsBetween(Window.unboundedPreceding, -1)
        run = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        want = [(i, k - s[3]) for i, s in enumerate(spans) for (c, k), v in todo.items() if (c, *v) == s]
        asked = df.sparkSession.createDataFrame(want, "i int, k long")
        hits = run.join(F.broadcast(asked), (F.col("s.i") == F.col("i")) & (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n"))).select("i", "k", "lo", "hi", "before", "n").collect()
        for h in hits:
            c, _, _, below, _ = spans[h["i"]]
            rank = h["k"] + below
            open_[c, rank] = h["lo"], h["hi"], below + h["before"], h["n"]
            if h["lo"] == h["hi"]:
                found[c, rank] = h["lo"]
    out = {}
    for c in columns:
        n, out[c] = first[f"n {c}"], []
        for q in at:
            h = (n - 1) * q
            k = math.floor(h)
            out[c].append(float("nan") if not n else found[c, k] if h == k else found[c, k] + (h - k) * (found[c, k + 1] - found[c, k]))
    return out


def bin_counts(df: DataFrame, schema: Schema, method: str | int = "sturges") -> dict[str, tuple[float, float, int]]:
    """(smallest, largest, number of bins) of each numeric column.

    A rule gives a number of cut points, rounded up; one less is the number of
    bins. ``fd`` and ``scott`` ignore the range of the values, as established;
    ``fd_range`` and ``scott_range`` divide it by the rule's width.
    """
    cols = [c for c, d in schema.dists.items() if not d.discrete]
    if not cols:
        return {}
    if not isinstance(method, int) and method not in METHODS:
        raise ValueError(f"method is a number of bins or one of {METHODS}")
    x = {c: F.col(c).cast("double") for c in cols}
    s = df.agg(*[f for c in cols for f in (F.count(x[c]).alias(f"n {c}"), F.min(x[c]).alias(f"lo {c}"), F.max(x[c]).alias(f"hi {c}"), F.stddev_samp(x[c]).alias(f"sd {c}"), F.skewness(x[c]).alias(f"g {c}"))]).first()
    rule = isinstance(method, str) and method.startswith("fd")
    quarters = column_quantiles(df, cols, (0.25, 0.75)) if rule else {}
    out = {}
    for c in cols:
        n, lo, hi, sd, g = (s[f"{k} {c}"] for k in ("n", "lo", "hi", "sd", "g"))
        if isinstance(method, int):
            cuts = method + 1
        elif method == "sturges":
            cuts = math.log2(n) + 2
        elif method == "doane":
            sigma = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
            cuts = 1 + math.log2(n) + math.log2(1 + abs(g) / sigma)
        elif method == "sqrt":
            cuts = math.sqrt(n) + 1
        elif method == "rice":
            cuts = 2 * n ** (1 / 3) + 1
        elif method == "terrell-scott":
            cuts = (2 * n) ** (1 / 3)
        elif method == "cencov":
            cuts = n ** (1 / 3)
        else:
            if method.startswith("scott"):
                width = 3.5 * sd / n ** (1 / 3)
            else:
                q1, q3 = quarters[c]
                width = 2 * (q3 - q1) / n ** (1 / 3)
            cuts = ((hi - lo) if method.endswith("_range") else 1.0) / width + 1 if width > 0 else 2
        # Rounded first: a whole number must not fall either way by the last bit.
        out[c] = lo, hi, max(1, math.ceil(round(cuts, 9)) - 1)
    return out


def bin_column(c: Column, lo: float, hi: float, bins: int) -> Column:
    """Number of the bin, from 1: intervals closed above, the lowest also below."""
    if not hi > lo:
        return F.lit(1)
    width = (hi - lo) / bins
    return F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((c.cast("double") - F.lit(lo)) / F.lit(width)).cast("int")))


def discretise(df: DataFrame, schema: Schema, method: str | int = "sturges") -> DataFrame:
    """The schema's columns as bin numbers; discrete ones by their sorted levels."""
    bins = bin_counts(df, schema, method)
    if any(d.discrete and c not in (schema.levels or {}) for c, d in schema.dists.items()):
        schema = with_levels(df, schema)
    out = []
    for c, d in schema.dists.items():
        if d.discrete:
            code = F.array_position(F.array(*[F.lit(x) for x in schema.levels[c]]), F.col(c)).cast("int")
        else:
            code = bin_column(F.col(c), *bins[c])
        out.append(code.alias(c))
    return df.select(*out)


def contingency(binned: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``(columns..., n)``: the cells that occur."""
    return binned.groupBy(*(columns or binned.columns)).agg(F.count(F.lit(1)).alias("n"))


def entropies(counts: DataFrame, subsets: Mapping[str, Sequence[str]], base: float = 2.0) -> DataFrame:
    """``(name, h)``: entropy of each subset of the columns of a table of counts
    (columns..., n); the empty subset has entropy 0."""
    names, sets = list(subsets), list(subsets.values())
    cells = _rolled(counts.withColumn("top", F.lit(0)), [c for c in counts.columns if c != "n"], sets, [list(range(len(sets)))])
    # H = ln N - sum(n ln n) / N
    h = F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("id") + 1)
    return cells.groupBy("id").agg((h / math.log(base)).alias("h")).select(name.alias("name"), "h")


def _rolled(cells: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], under: Sequence[Sequence[int]]) -> DataFrame:
    """``(id, n)``: cells (columns..., n, top) merged to those of the sets of columns
    whose places ``under[top]`` lists."""
    mine = F.coalesce(*[F.when(F.col("top") == i, F.array(*map(F.lit, ks))) for i, ks in enumerate(under)])
    # A column outside the set is null in all its rows, so a null inside it stays a level of its own.
    kept = [F.when(F.col("id").isin([k for k, s in enumerate(sets) if c in s]), F.col(c)).alias(c) for c in columns]
    return cells.select("n", *columns, F.explode(mine).alias("id")).select("id", "n", *kept).groupBy("id", *columns).agg(F.sum("n").alias("n")).select("id", "n")


def entropy(counts: DataFrame) -> DataFrame:
    """One row ``(entropy)`` in bits of a table of counts."""
    columns = [c for c in counts.columns if c != "n"]
    return entropies(counts, {"all": columns}).select(F.col("h").alias("entropy"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """One row ``(mi, mi_pc, mi_pc_compat)`` of two or more columns: the joint
    distribution against the product of its margins, in nats; as a percentage of
    the first column's entropy; and the established percentage, whose divisor is
    the sum of n * log2(1 / n) over the first column's counts."""
    columns = [c for c in counts.columns if c != "n"]
    h = entropies(counts, {"all": columns, **{f"m{i}": [c] for i, c in enumerate(columns)}}, math.e)
    mi = F.sum(F.when(F.col("name") == "all", -F.col("h")).otherwise(F.col("h")))
    first = F.max(F.when(F.col("name") == "m0", F.col("h")))
    raw = counts.groupBy(columns[0]).agg(F.sum("n").alias("n")).agg(F.sum(-F.col("n") * F.log2("n")).alias("raw"))
    # Two tables of one row each.
    return h.agg(mi.alias("mi"), first.alias("first")).join(raw, F.lit(True)).select(
        "mi", F.when(F.col("first") > 0, 100 * F.col("mi") / F.col("first")).alias("mi_pc"), F.when(F.col("raw") != 0, -100 * F.col("mi") / F.col("raw")).alias("mi_pc_compat")
    )


LINK_METHODS = ("mi.raw", "mi.raw.pc", "mi.corr", "ls", "ls.pc", "stat.dist")


def link_strength(df: DataFrame, schema: Schema, arcs: Iterable[tuple[str, str]], method: str = "mi.raw", bins: str | int = "doane", compat: bool = False) -> DataFrame:
    """``(parent, child, strength)`` of each arc.

    mi.raw: mutual information in nats; mi.raw.pc: as a percentage of the child's
    entropy; mi.corr: -ln(1 - r^2) / 2; ls: H(child | others) - H(child | parent,
    others), others being the child's other parents, in bits; ls.pc: ls over
    H(child | others); stat.dist: 1 - I / max(H(parent), H(child)). ``compat``
    gives the established variants of mi.raw.pc, ls and stat.dist.
    """
    arcs = list(arcs)
    if method not in LINK_METHODS:
        raise ValueError(f"method is one of {LINK_METHODS}")
    spark = df.sparkSession
    schema_out = "parent string, child string, strength double"
    if not arcs:
        return spark.createDataFrame([], schema_out)
    if method == "mi.corr":
        row = df.agg(*[F.corr(F.col(p).cast("double"), F.col(c).cast("double")).alias(f"{i}") for i, (p, c) in enumerate(arcs)])
        entry = [F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"), (-0.5 * F.ln(1 - F.col(f"`{i}`") * F.col(f"`{i}`"))).alias("strength")) for i, (p, c) in enumerate(arcs)]
        return row.select(F.explode(F.array(*entry)).alias("x")).select("x.*")
    used = [c for c in schema.nodes if any(c in a for a in arcs)]
    binned = discretise(df, schema.only(used), bins)
    parents = {c: [p for p, x in arcs if x == c] for _, c in arcs}

    def sets(p, c):
        others = [x for x in parents[c] if x != p]
        return {"x": {p}, "y": {c}, "xy": {p, c}, "z": set(others), "xz": {p, *others}, "yz": {c, *others}, "xyz": {p, c, *others}}

    # One scan counts every set of columns that some arc asks for; equal sets count once.
    wanted = {tuple(u for u in used if u in s) for p, c in arcs for s in sets(p, c).values()}
    known = set_entropies(binned, sorted(wanted))
    out = None
    for p, c in arcs:
        x, y, xy, z, xz, yz, xyz = (F.col(_set_name(tuple(u for u in used if u in s))) for s in sets(p, c).values())
        row = known
        mi = x + y - xy
        ls = xz + yz - xyz - z
        value = {
            "mi.raw": mi * math.log(2),
            "mi.raw.pc": F.when(y > 0, 100 * mi / y),
            "ls": xz + yz - z if compat else ls,
            "ls.pc": F.when(F.abs(yz - z) > 1e-12, ls / (yz - z)).otherwise(ls),
            "stat.dist": mi * math.log(2) if compat else F.when(F.greatest(x, y) > 0, 1 - mi / F.greatest(x, y)),
        }[method]
        if method == "mi.raw.pc" and compat:
            one = mutual_information(contingency(binned, [p, c])).select(F.lit(p).alias("parent"), F.lit(c).alias("child"), F.col("mi_pc_compat").alias("strength"))
        else:
            one = row.select(F.lit(p).alias("parent"), F.lit(c).alias("child"), value.cast("double").alias("strength"))
        out = one if out is None else out.unionByName(one)
    return out


def _set_name(columns: Sequence[str]) -> str:
    return "h_" + "_".join(columns)


def set_counts(binned: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``(id, n)``: the cells of each set of columns, by the set's place in ``sets``.

    Rows are counted by the sets alone that no other one contains; all others are
    rolled up from the cells of the first of these that contains them. So a row
    becomes as many as there are largest sets (one of them: a plain groupBy), and
    cells, not rows, become as many as there are smaller sets."""
    columns = [c for c in binned.columns if any(c in s for s in sets)]
    largest = [s for s in sets if not any(set(s) < set(t) for t in sets)]
    if not largest:
        return binned.sparkSession.createDataFrame([], "id int, n long")
    if len(largest) == 1:
        cells = binned.groupBy(*largest[0]).agg(F.count(F.lit(1)).alias("n")).withColumn("top", F.lit(0).cast("long"))
    else:
        # Bit i of the id, from the last column on, is set where the column is not in the set.
        ids = [sum(1 << i for i, c in enumerate(reversed(columns)) if c not in s) for s in largest]
        cells = binned.groupingSets([[F.col(c) for c in s] for s in largest], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("id"), F.count(F.lit(1)).alias("n"))
        cells = cells.withColumn("top", F.coalesce(*[F.when(F.col("id") == k, F.lit(i)) for i, k in enumerate(ids)]).cast("long"))
    under = [[k for k, s in enumerate(sets) if next(i for i, t in enumerate(largest) if set(s) <= set(t)) == top] for top in range(len(largest))]
    return _rolled(cells, columns, sets, under)


def set_entropies(binned: DataFrame, sets: Sequence[Sequence[str]], base: float = 2.0) -> DataFrame:
    """One row with the entropy of each set of columns (``h_<a>_<b>``), from one
    scan (:func:`set_counts`); the empty set has entropy 0."""
    full = [s for s in sets if s]
    h = F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")
    by = set_counts(binned, full).groupBy("id").agg((h / math.log(base)).alias("h"))
    row = by.agg(*[F.max(F.when(F.col("id") == k, F.col("h"))).alias(_set_name(s)) for k, s in enumerate(full)])
    return row.withColumn(_set_name(()), F.lit(0.0))


def odds_ratio(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(odds_ratio)`` of two 0/1 columns: n00 * n11 / (n01 * n10), an
    off-diagonal 0 counting as one half. Any other value is an error."""
    other = df.filter(~(F.col(x).isin(0, 1) & F.col(y).isin(0, 1)) | F.col(x).isNull() | F.col(y).isNull())
    if not other.isEmpty():
        raise ValueError(f"{x} and {y} are no 0/1 columns")
    return odds_ratio_of_counts(df.select(x, y), x, y)


def odds_ratio_of_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    n = lambda a, b: F.count_if((F.col(x) == a) & (F.col(y) == b)).cast("double")
    half = lambda v: F.when(v == 0, 0.5).otherwise(v)
    return df.agg(n(0, 0).alias("a"), n(0, 1).alias("b"), n(1, 0).alias("c"), n(1, 1).alias("d")).select((F.col("a") * F.col("d") / (half(F.col("b")) * half(F.col("c")))).alias("odds_ratio"))

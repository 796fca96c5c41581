"""Samples that match target category proportions (problem 2).

A plan asks for a share of the corpus; its strata are (family, form) cells or
whole rows or columns of that table, with a share and a minimum each. A maximum
flow strata -> cells says how much every stratum can have, overlapping ones
together. The plan's fractional family x form table is made integer by
controlled rounding: a maximum flow with lower and upper bounds keeps the
margins of both families and forms, and every cell, within one record of their
fractions. A last flow hands the cells' records to the strata, whose totals stay
exact. Then each cell gives exactly its quota of records with the least random keys.
"""

from __future__ import annotations

import re
from collections import deque
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, table

#: Key ranges in which a cell's random keys are counted; only the range that holds the quota's end is sorted.
RANGES = 4096
#: Other category: a family or form that no stratum names.
OTHER = "*"


def letters(c: str) -> F.Column:
    """Lower-case letters only; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def _letters(s: str | None) -> str | None:
    return None if s is None else re.sub(r"[\W\d_]", "", s.lower())


class Flow:
    """Maximum flow by shortest augmenting paths on a small network with integer capacities."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: dict[int, list[int]] = {}

    def add(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            came: dict[int, int] = {s: -1}
            queue = deque([s])
            while queue and t not in came:
                a = queue.popleft()
                for e in self.out.get(a, ()):
                    if self.cap[e] and self.to[e] not in came:
                        came[self.to[e]] = e
                        queue.append(self.to[e])
            if t not in came:
                return total
            path, node = [], t
            while node != s:
                path.append(came[node])
                node = self.to[came[node] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def controlled_rounding(table_: list[list[Fraction]], caps: list[int]) -> list[list[int]]:
    """Integers within one of the entries of ``table_`` whose row sums are the
    (integer) row sums and whose column sums are within one of the column sums
    and within ``caps``. Such a table always exists when the fractional one
    respects ``caps``.
    """
    return _bounded_rounding(table_, None, caps)


def _bounded_rounding(table_: list[list[Fraction]], most: list[list[int]] | None = None, caps: list[int] | None = None) -> list[list[int]]:
    """A maximum flow with lower bounds: entries, row sums, column sums and the
    sum of all are each rounded up or down, entries within ``most`` and column
    sums within ``caps``. ValueError where no such table exists."""
    rows, cols = len(table_), len(table_[0]) if table_ else 0
    s, t, ss, tt = 0, 1, 2, 3
    row, col = (lambda i: 4 + i), (lambda j: 4 + rows + j)
    flow, need, arcs = Flow(), {}, {}

    def bounded(a: int, b: int, low: int, high: int) -> int:
        need[b] = need.get(b, 0) + low
        need[a] = need.get(a, 0) - low
        return flow.add(a, b, max(0, high - low))

    for i in range(rows):
        total = sum(table_[i])
        bounded(s, row(i), floor(total), ceil(total))
        for j in range(cols):
            x = table_[i][j]
            if x:
                arcs[i, j] = (bounded(row(i), col(j), floor(x), min(ceil(x), most[i][j]) if most else ceil(x)), floor(x))
    for j in range(cols):
        total = sum(table_[i][j] for i in range(rows))
        cap = caps[j] if caps else ceil(total)
        bounded(col(j), t, min(floor(total), cap), min(ceil(total), cap))
    everything = sum(map(sum, table_))
    bounded(t, s, floor(everything), ceil(everything))
    wanted = 0
    for node, d in need.items():
        if d > 0:
            flow.add(ss, node, d)
            wanted += d
        elif d < 0:
            flow.add(node, tt, -d)
    got = flow.run(ss, tt)
    if got != wanted:
        raise ValueError("the table can't be rounded within these margins")
    out = [[0] * cols for _ in range(rows)]
    for (i, j), (e, low) in arcs.items():
        out[i][j] = low + flow.cap[e ^ 1]
    return out


class Allotment:
    """Records of strata out of cells, as a flow source -> stratum -> cell -> sink.

    Augmenting never takes from a stratum what it has; it may move records of
    strata that overlap from one cell to another.
    """

    def __init__(self, belongs: list[list[int]], sizes: list[int]):
        self.flow, rows = Flow(), len(belongs)
        self.s, self.t = 0, 1
        self.row = [self.flow.add(self.s, 2 + i, 0) for i in range(rows)]
        self.arc = {(i, j): self.flow.add(2 + i, 2 + rows + j, 1 << 60) for i, cells_ in enumerate(belongs) for j in cells_}
        self.cell = [self.flow.add(2 + rows + j, self.t, n) for j, n in enumerate(sizes)]

    def place(self, i: int, j: int, n: int) -> None:
        """``n`` records of cell ``j`` for stratum ``i``, before anything is raised."""
        for e in (self.row[i], self.arc[i, j], self.cell[j]):
            self.flow.cap[e] -= n
            self.flow.cap[e ^ 1] += n

    def raise_to(self, totals: list[int]) -> list[int]:
        """What the strata have when each may have up to ``totals``."""
        for e, total in zip(self.row, totals, strict=True):
            self.flow.cap[e] = total - self.flow.cap[e ^ 1]
        self.flow.run(self.s, self.t)
        return [self.flow.cap[e ^ 1] for e in self.row]

    def table(self) -> dict[tuple[int, int], int]:
        return {k: n for k, e in self.arc.items() if (n := self.flow.cap[e ^ 1])}


#: Steps in which the strata of a plan are filled together, so that those which compete fall short alike.
STEPS = 16


def feasible(least: list[int], totals: list[int], belongs: list[list[int]], sizes: list[int]) -> list[int]:
    """How many records each stratum can have when all are served: minimums first, then in steps up to ``totals``."""
    a = Allotment(belongs, sizes)
    low = [min(m, n) for m, n in zip(least, totals, strict=True)]
    got = a.raise_to(low)
    for step in range(1, STEPS + 1):
        got = a.raise_to([max(g, m + (n - m) * step // STEPS) for g, m, n in zip(got, low, totals, strict=True)])
    return got


def spread(totals: list[int], belongs: list[list[int]], sizes: list[int]) -> list[list[Fraction]]:
    """Fractional quotas: each row's total over its cells in proportion to what is
    left in them; rows with the fewest cells first. What a row can't have this way
    because another took it comes by augmenting flow. Totals must be feasible."""
    left = [Fraction(x) for x in sizes]
    out = [[Fraction(0)] * len(sizes) for _ in totals]
    for i in sorted(range(len(totals)), key=lambda i: (len(belongs[i]), i)):
        room = sum(left[j] for j in belongs[i])
        give = min(Fraction(totals[i]), Fraction(floor(room)))
        if room:
            for j in belongs[i]:
                part = give * left[j] / room
                out[i][j] += part
            for j in belongs[i]:
                left[j] -= out[i][j]
    if [sum(row) for row in out] != totals:
        whole = controlled_rounding(out, sizes)
        a = Allotment(belongs, sizes)
        for (i, j), n in {(i, j): whole[i][j] for i in range(len(totals)) for j in belongs[i]}.items():
            a.flow.cap[a.row[i]] += n
            a.place(i, j, n)
        a.raise_to(totals)
        out = [[Fraction(0)] * len(sizes) for _ in totals]
        for (i, j), n in a.table().items():
            out[i][j] = Fraction(n)
    return out


def rounded(fractional: list[list[Fraction]], names: list[tuple[str, str]], belongs: list[list[int]], sizes: list[int]) -> list[list[int]]:
    """The integer table strata x cells of a fractional one.

    The plan's family x form table is rounded with both margins kept; then the
    strata, their totals exact, share its cells by a flow. Where strata overlap
    so that no such share exists, strata x cells is rounded instead: totals
    stay exact and cells within one record, margins needn't.
    """
    totals = [int(sum(row)) for row in fractional]
    families, forms = sorted({a for a, _ in names}), sorted({b for _, b in names})
    at = {(families.index(a), forms.index(b)): j for j, (a, b) in enumerate(names)}
    quota = [sum(row[j] for row in fractional) for j in range(len(names))]
    plan = [[quota[at[f, g]] if (f, g) in at else Fraction(0) for g in range(len(forms))] for f in range(len(families))]
    try:
        two_way = _bounded_rounding(plan, [[sizes[at[f, g]] if (f, g) in at else 0 for g in range(len(forms))] for f in range(len(families))])
    except ValueError:
        return controlled_rounding(fractional, sizes)
    a = Allotment(belongs, [two_way[f][g] for j in range(len(names)) for f, g in [next(k for k, v in at.items() if v == j)]])
    if a.raise_to(totals) != totals:
        return controlled_rounding(fractional, sizes)
    out = [[0] * len(names) for _ in totals]
    for (i, j), n in a.table().items():
        out[i][j] = n
    return out


def cells(corpus: DataFrame, targets: list) -> DataFrame:
    """``(doc_id, family, form)``: one row for each id, categories as letters, those no stratum names as ``*``."""
    named = {c: sorted({_letters(r[c]) for r in targets if r[c] is not None}) for c in ("family", "form")}
    keyed = [F.when(letters(c).isin(named[c]), letters(c)).otherwise(OTHER).alias(c) if named[c] else F.lit(OTHER).alias(c) for c in ("family", "form")]
    one = corpus.select("doc_id", *keyed).filter("doc_id is not null")
    return one.groupBy("doc_id").agg(F.min(F.struct("family", "form")).alias("c")).select("doc_id", "c.family", "c.form")


def allocate(counts: dict[tuple[str, str], int], targets: list) -> tuple[list[tuple], list[tuple]]:
    """(cell quotas ``(plan_id, family, form, quota)``, report rows).

    ``counts``: records by cell. Report: ``(plan_id, stratum_id, needed,
    fillable, allotted, unfilled, unmet)``: what the flow gives the stratum when
    no other is served and when all are, and whether that is less than needed.
    Where the floors of the shares leave records of the plan's size over, strata
    with the largest remainders get one more.
    """
    everything = sum(counts.values())
    names = sorted(counts)
    sizes = [counts[c] for c in names]
    quotas, report = [], []
    for plan in sorted({r["plan_id"] for r in targets}):
        rows = sorted((r for r in targets if r["plan_id"] == plan), key=lambda r: r["stratum_id"])
        belongs, least, needed, rest = [], [], [], []
        for r in rows:
            fam, form = _letters(r["family"]), _letters(r["form"])
            belongs.append([j for j, (a, b) in enumerate(names) if (fam is None or a == fam) and (form is None or b == form)])
            share = everything * (r["rate_permille"] or 0) // 1000 * (r["share_permille"] or 0)
            least.append(r["min_rows"] or 0)
            needed.append(max(least[-1], share // 1000))
            rest.append(share % 1000 if share // 1000 >= least[-1] else 0)
        largest = max((everything * (r["rate_permille"] or 0) // 1000 for r in rows), default=0)
        parts = sum(everything * (r["rate_permille"] or 0) // 1000 * (r["share_permille"] or 0) for r in rows) // 1000
        alone = [Allotment([b], sizes).raise_to([n])[0] for b, n in zip(belongs, needed, strict=True)]
        totals = feasible(least, needed, belongs, sizes)
        over = min(largest, parts) - sum(needed)
        for i in sorted(range(len(rows)), key=lambda i: (-rest[i], i)):
            if over > 0 and rest[i] and totals[i] == needed[i]:
                more = [n + (k == i) for k, n in enumerate(totals)]
                if Allotment(belongs, sizes).raise_to(more) == more:
                    totals = more
                    over -= 1
        fractional = spread(totals, belongs, sizes)
        integer = rounded(fractional, names, belongs, sizes) if names else [[] for _ in rows]
        for i, r in enumerate(rows):
            got = sum(integer[i])
            report.append((plan, r["stratum_id"], needed[i], alone[i], got, alone[i] < needed[i], got < needed[i]))
        for j, (a, b) in enumerate(names):
            if q := sum(integer[i][j] for i in range(len(rows))):
                quotas.append((plan, a, b, q))
    return quotas, report


def quota_tables(corpus: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records by cell, cell quotas, report). ``targets`` is a small table that does not grow.

    The driver gets one count for each pair of a named family (or ``*``) and a
    named form (or ``*``): bounded by the targets, not by the corpus.
    """
    spark = corpus.sparkSession
    plan = targets.collect()
    records = settle(cells(corpus, plan))
    counts = {(r["family"], r["form"]): r["n"] for r in records.groupBy("family", "form").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas, report = allocate(counts, plan)
    return (
        records,
        spark.createDataFrame(quotas, "plan_id bigint, family string, form string, quota bigint"),
        spark.createDataFrame(report, "plan_id bigint, stratum_id bigint, needed bigint, fillable bigint, allotted bigint, unfilled boolean, unmet boolean"),
    )


def sample(corpus: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``(plan_id, doc_id, family, form)``: exactly the quota of each cell, least random keys first.

    Keys are hashes of seed, plan and id: the same rows at any partitioning. A
    cell of any size is never sorted as a whole; keys are counted by range and
    only the range in which the quota ends is ranked.
    Null and repeated ids count once or not at all; null, empty and unknown
    categories belong to strata that name none; an empty corpus gives no row.
    """
    records, quotas, _ = quota_tables(corpus, targets)
    keyed = records.join(F.broadcast(quotas), ["family", "form"])  # quotas: cells x plans of the targets
    keyed = keyed.withColumn("key", F.xxhash64(F.lit(seed), "plan_id", "doc_id"))
    keyed = keyed.withColumn("slot", F.shiftrightunsigned("key", 52).cast("int"))  # one of RANGES
    keyed = keyed.withColumn("key", F.shiftrightunsigned("key", 1))  # the sign bit is in the slot
    cell = ["plan_id", "family", "form"]
    counts = keyed.groupBy(*cell, "quota", "slot").agg(F.count(F.lit(1)).alias("n"))
    upto = F.coalesce(F.sum("n").over(W.partitionBy(*cell).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("before", upto).filter("before < quota").select(*cell, "slot", "before", "n")
    inside = keyed.join(ends, [*cell, "slot"])
    whole = inside.filter("before + n <= quota")
    last = inside.filter("before + n > quota").withColumn("at", F.row_number().over(W.partitionBy(*cell).orderBy("key", "doc_id"))).filter("before + at <= quota").drop("at")
    return whole.unionByName(last).select("plan_id", "doc_id", "family", "form")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "corpus_clean", "doc_id", "family", "form"), table(spark, sf_dir, "sample_targets")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_tables(*_inputs(spark, sf_dir))[2]


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(*_inputs(spark, sf_dir))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that every plan's sample holds."""
    return p2_sample(spark, sf_dir).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata that the flow can't fill even when no other stratum is served."""
    return p2_report(spark, sf_dir).filter("unfilled").select("plan_id", "stratum_id")

"""Near-duplicate records by PartEnum signatures (problem 5).

A record is the set of its distinct 20-character substrings. The feature domain
(the 64-bit hash space of substrings) is cut into ``GROUPS x PARTS`` partitions;
what a record has in a partition is represented by its least feature there, so
two records agree on a partition with probability equal to their Jaccard
similarity. Within each group of ``PARTS`` partitions every subset of ``KEPT``
partitions gives one signature: records that differ in at most ``PARTS - KEPT``
partitions of *any* group share one. Signatures carry a size band; records
similar enough to pair lie in one band or in neighbouring ones, and a record
that could pair upwards signs for the next band too. Signature matches are
only candidates: sizes and sketches weed them, then the exact similarity of the
whole contents decides.

At similarity s the chance that a pair shares no signature is
``(1 - P[Bin(6, s) >= 4]) ** 8``: 0.2 % at 0.6, 0.002 % at 0.7, nothing above.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, spread, table

GROUPS, PARTS, KEPT = 8, 6, 4
CELLS = GROUPS * PARTS
SUBSETS = [list(c) for c in combinations(range(PARTS), KEPT)]
#: Cells of 48 that must agree for a candidate to be compared in full: at
#: similarity 0.6 fewer agree once in a million pairs.
LEAST_CELLS = 13
#: Pairs of one record that are compared in one run.
RUN = 512
#: Hubs of a signature before what is left of it is compared pair by pair.
ROUNDS = 4
_WHITE = re.compile(r"\s+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def content(title: str | None, text: str | None) -> str:
    """Title, line break, text in lower case with runs of white space made one space, trimmed."""
    return _WHITE.sub(" ", f"{title or ''}\n{text or ''}".lower()).strip()


def features(s: str, width: int = 20) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-character substrings."""
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(a) < width:
        return np.zeros(0, np.uint64)
    # windows of 1, 2, 4, ... characters, joined to ``width`` by its binary digits
    base, power, done, out = np.uint64(0x9E3779B97F4A7C15), 1, 0, None
    h = _mix(a + np.uint64(1))
    rest = width
    with np.errstate(over="ignore"):
        while True:
            if rest & 1:
                out = h if out is None else out[: len(h) - done] * base + h[done:] if done else h
                done += power
            rest >>= 1
            if not rest:
                break
            h = h[: len(h) - power] * (base ^ np.uint64(power * 2 + 1)) + h[power:]
            power *= 2
        out = _mix(out[: len(a) - width + 1])
    return np.unique(out)


def sketch(found: np.ndarray) -> np.ndarray:
    """The least feature in each of ``CELLS`` partitions of the domain; 0 where there is none."""
    edges = (np.arange(CELLS, dtype=np.float64) * (2.0**64 / CELLS)).astype(np.uint64)
    at = np.searchsorted(found, edges)
    ends = np.append(at[1:], len(found))
    out = np.zeros(CELLS, np.uint64)
    has = at < ends
    out[has] = found[at[has]]
    return out.astype(np.uint64)


def signatures(cells: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every record. ``cells``: rows x CELLS."""
    n = len(sizes)
    ratio = 1 / similarity
    width = 3 * log(ratio)  # a band spans the ratio three times
    place = np.log(np.maximum(sizes, 1)) / width
    band = np.floor(place + 1e-9).astype(np.uint64)
    upper = np.floor(place + 1 / 3 + 1e-6).astype(np.uint64)  # it may pair with the band above
    with np.errstate(over="ignore"):
        base = np.empty((n, GROUPS * len(SUBSETS)), np.uint64)
        k = 0
        for g in range(GROUPS):
            part = cells[:, g * PARTS : (g + 1) * PARTS]
            for subset in SUBSETS:
                h = np.full(n, k + 1, np.uint64)
                for p in subset:
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, p])
                base[:, k] = h
                k += 1
        own = _mix(base + (band[:, None] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        above = np.flatnonzero(upper > band)
        next_ = _mix(base[above] + (upper[above][:, None] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    rows = np.concatenate([np.repeat(np.arange(n), own.shape[1]), np.repeat(above, own.shape[1])])
    return rows, np.concatenate([own.ravel(), next_.ravel()]).view(np.int64)


def records(df: DataFrame, least_chars: int = 400) -> DataFrame:
    """``(doc_id, copy, n, cells)``: id, hash of the exact title and text, number of features, sketch.

    Records with null or short text take no part (``least_chars``).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, titles, texts = batch.columns
            sizes, cells = [], []
            for title, text in zip(titles, texts, strict=True):
                found = features(content(title.as_py(), text.as_py()))
                sizes.append(len(found))
                cells.append(sketch(found).tobytes())
            yield pa.RecordBatch.from_arrays([ids, copies, pa.array(sizes, pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "copy", "n", "cells"])

    # two seeds make 128 bits; null and empty titles are one content
    raw = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text"))
    copy = F.concat(F.hex(F.xxhash64(raw)), F.hex(F.xxhash64(F.lit(7), raw)))
    long_enough = df.filter(F.char_length("text") >= least_chars)
    return long_enough.select("doc_id", copy.alias("copy"), "title", "text").mapInArrow(run, "doc_id bigint, copy string, n bigint, cells binary")


def signed(reps: DataFrame, similarity: float) -> DataFrame:
    """``(sig, id)``: the PartEnum signatures of every record."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = 2000
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                cells = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(len(ids), CELLS)
                rows, sigs = signatures(cells, part.column(1).to_numpy(zero_copy_only=False), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(ids[rows])], names=["sig", "id"])

    return reps.select("doc_id", "n", "cells").mapInArrow(run, "sig bigint, id bigint")


def _agreeing(pairs: DataFrame, similarity: float) -> DataFrame:
    """Candidates whose sizes and sketches admit the similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, ca, cb = batch.columns
            x = np.frombuffer(b"".join(ca.to_pylist()), np.uint64).reshape(-1, CELLS)
            y = np.frombuffer(b"".join(cb.to_pylist()), np.uint64).reshape(-1, CELLS)
            na, nb = na.to_numpy(), nb.to_numpy()
            keep = ((x == y).sum(1) >= LEAST_CELLS) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of the pairs whose whole contents are similar enough, exactly.

    The text of ``a`` comes once for a run of ``RUN`` pairs, before those of the
    pairs' ``b``; a record with many pairs is spread over as many runs.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    of = lambda df, k: df.join(texts.withColumnRenamed("doc_id", k), k)
    first = of(runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run")), "a").select("a", "run", F.lit(None).cast("bigint").alias("b"), "title", "text")
    rest = of(pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), "runs").cast("int").alias("run"), "b"), "b").select("a", "run", "b", "title", "text")
    rows = first.unionByName(rest).repartition("a", "run").sortWithinPartitions("a", "run", F.asc_nulls_first("b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            out_a, out_b = [], []
            for a, _, b, title, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = features(content(title, text))
                if b is None:
                    mine = found
                    continue
                both = len(np.intersect1d(mine, found, assume_unique=True))
                either = len(mine) + len(found) - both
                if either and both >= similarity * either - 1e-9:
                    out_a.append(a), out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


class Search:
    """What a search for similar records rests on, written once.

    ``df``: doc_id, title, text; other columns are ignored. A representative is
    the least id of the records whose title and text are the same; repeated ids
    count once, so a group of exact copies of any size is one row in all that
    follows. ``members``: ``(doc_id, a)``, records and their representatives;
    ``shared``: ``(sig, id)``, signatures that several representatives have.
    """

    def __init__(self, df: DataFrame, similarity: float, least_chars: int):
        self.similarity = similarity
        found = settle(records(df.select("doc_id", "title", "text"), least_chars))
        members = found.groupBy("doc_id").agg(F.min("copy").alias("copy"))
        reps = found.groupBy("copy").agg(F.min_by(F.struct("doc_id", "n", "cells"), "doc_id").alias("r")).select("copy", "r.*")
        self.members = members.join(reps.select("copy", F.col("doc_id").alias("a")), "copy").select("doc_id", "a")
        self.reps = settle(reps.select("doc_id", "n", "cells"))
        sig = signed(spread(self.reps), similarity).repartition("sig")
        self.shared = settle(sig.withColumn("many", F.count(F.lit(1)).over(W.partitionBy("sig"))).filter("many > 1").select("sig", "id"))
        self.texts = df.select("doc_id", "title", "text").filter(F.char_length("text") >= least_chars)

    def verified(self, candidates: DataFrame) -> DataFrame:
        """``(a, b)`` of the distinct candidates ``(a, b)`` that are similar: by sizes and sketches, then exactly."""
        of = lambda s: self.reps.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("cells").alias(f"c{s}"))
        likely = settle(_agreeing(candidates.join(of("a"), "a").join(of("b"), "b"), self.similarity))
        wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = self.texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return settle(_verified(likely, texts, self.similarity))


def linked(df: DataFrame, similarity: float = 0.6, least_chars: int = 400) -> tuple[DataFrame, DataFrame]:
    """(all links ``(a, b)`` between representatives of exact copies, membership ``(doc_id, a)``).

    Hot signatures need no salt: a shuffled self-join whose skewed partitions
    AQE splits, on one row a representative.
    """
    s = Search(df, similarity, least_chars)
    x, y = s.shared.withColumnRenamed("id", "a"), s.shared.withColumnRenamed("id", "b")
    return s.verified(x.join(y, "sig").filter("a < b").select("a", "b").distinct()), s.members


def pairs(df: DataFrame, similarity: float = 0.6, least_chars: int = 400) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: every pair of different texts that are similar enough.

    Groups of exact copies (same title and text) are not multiplied: a link
    between two texts is given for every member of either group with the least
    id of the other, and within a group each member is paired with the least
    id. Rows grow with the size of the groups, and no link between different
    texts is lost.
    """
    links, members = linked(df, similarity, least_chars)
    copies = settle(members.filter("a < doc_id"))  # (doc_id, a) of those that are no representatives
    crossed = [links.select("a", "b")]
    for one, other in (("a", "b"), ("b", "a")):
        crossed.append(links.join(copies.withColumnRenamed("a", one), one).select(F.least("doc_id", other).alias("a"), F.greatest("doc_id", other).alias("b")))
    out = crossed[0].unionByName(crossed[1]).unionByName(crossed[2]).unionByName(copies.select("a", F.col("doc_id").alias("b")))
    return out.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def components(links: DataFrame) -> DataFrame:
    """``(u, root)``, u > root: connected ids of ``(a, b)`` with the least of their component.

    Alternating neighbour-minimum rounds (large-star, small-star) on written
    edge tables until no edge changes.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.filter("u > v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = settle(small.filter("u > v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select("u", F.col("v").alias("root"))
        before = state


def classes(df: DataFrame, similarity: float = 0.6, least_chars: int = 400) -> DataFrame:
    """``(doc_id, class_id, class_size)``: connected groups, named by their least id; one row per record.

    All pairs of a group are never compared. In a round every signature's least
    member is the hub to which those of other classes are compared, then it
    leaves; a signature whose members are of one class is done. So a group of
    texts that are all similar costs a comparison or few for each. What is
    still undecided after ``ROUNDS`` hubs is compared pair by pair between
    classes: the result is that of all pairs.
    """
    s = Search(df, similarity, least_chars)
    live = s.shared.withColumn("c", F.col("id"))
    links = tested = None
    for turn in range(ROUNDS + 1):
        hubs = settle(live.groupBy("sig").agg(F.min(F.struct("c", "id")).alias("h"), F.max("c").alias("top")).filter("h.c < top").select("sig", F.col("h.c").alias("hc"), F.col("h.id").alias("hub")))
        if turn and hubs.isEmpty():
            break
        if turn < ROUNDS:
            met = live.join(hubs, "sig").filter("c <> hc").select("hub", "id")
        else:
            met = live.join(live.select("sig", F.col("id").alias("hub"), F.col("c").alias("hc")), "sig").filter("hub < id and c <> hc").select("hub", "id")
        candidates = met.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        candidates = settle(candidates if tested is None else candidates.join(tested, ["a", "b"], "left_anti"))
        found = s.verified(candidates)
        links, tested = (found, candidates) if links is None else (links.unionByName(found), tested.unionByName(candidates))
        of = components(links)
        left = live.join(hubs, "sig").filter("id <> hub").select("sig", "id")
        live = settle(left.join(of, left["id"] == of["u"], "left").select("sig", "id", F.coalesce("root", "id").alias("c")))
    named = settle(s.members.join(of.withColumnRenamed("u", "a"), "a", "left").select("doc_id", F.coalesce("root", "a").alias("class_id")))
    return named.join(named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "class_id").select("doc_id", "class_id", "class_size")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "corpus_clean", "doc_id", "title", "text"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "corpus_clean", "doc_id", "title", "text"))

"""Knowledge graph of a document sample: nodes, entities, overlap edges, scenarios."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import structural_units


def entities(c: Column) -> Column:
    """Distinct capitalised words of five letters and more, the stand-in for a named-entity model."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]{4,}"), F.lit(0))))


def nodes(docs: DataFrame) -> DataFrame:
    """``(node_id, kind, words, entities, title)`` of every document."""
    return docs.select(F.col("doc_id").alias("node_id"), F.lit("DOCUMENT").alias("kind"), T.word_count(F.coalesce("text", F.lit(""))).alias("words"), entities(F.coalesce("text", F.lit(""))).alias("entities"), "title")


def splits_by_headline(nodes_: DataFrame, tokens: int = 500, share: float = 0.25) -> DataFrame:
    """One row: are at least ``share`` of the nodes longer than ``tokens``? Then they are split at headlines."""
    return nodes_.agg(F.round(F.avg((F.col("words") > tokens).cast("int")), 6).alias("long_share"), (F.avg((F.col("words") > tokens).cast("int")) >= share).alias("by_headline"))


_HEADLINE = re.compile(r"^(?=[A-Z][A-Za-z ]{3,40}$)", re.M)


def sized(pieces: list[str], least: int = 500, most: int = 1000) -> list[str]:
    """Pieces between headlines as chunks: those of more than ``most`` words are
    divided, those of fewer than ``least`` joined; every word is in one chunk."""
    out, now = [], []
    for piece in pieces:
        words = piece.split()
        if len(words) > most and now:
            out.append(now)
            now = []
        while len(words) > most:
            out.append(words[:most])
            words = words[most:]
        if len(words) >= least:
            out += [now, words] if now else [words]
            now = []
        else:
            now = now + words
            if len(now) >= least:
                out.append(now)
                now = []
    return [" ".join(w) for w in (*out, now) if w]


def headline_chunks(docs: DataFrame, tokens: int = 500) -> DataFrame:
    """``(doc_id, chunk_index, page_content)`` of the documents of more than ``tokens``
    words ``(doc_id, form, text)``. Short lines stand in for a model's headlines;
    where a text has none, its structural units do."""
    text = F.coalesce("text", F.lit(""))
    long = docs.filter(T.word_count(text) > tokens).select("doc_id", text.alias("text"), structural_units(text, F.coalesce("form", F.lit(""))).alias("units"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = [0, *(m.start() for m in _HEADLINE.finditer(r["text"])), len(r["text"])]
                pieces = [r["text"][a:b] for a, b in zip(at, at[1:])] if len(at) > 2 else r["units"]
                out += [{"doc_id": r["doc_id"], "chunk_index": i, "page_content": c} for i, c in enumerate(sized(pieces, tokens))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("page_content", pa.string())]))

    return long.mapInArrow(run, "doc_id bigint, chunk_index int, page_content string")


def branch_nodes(docs: DataFrame) -> DataFrame:
    """``(node_id, kind, doc_id, words, entities)`` of the branch that the lengths choose.

    Where ``splits_by_headline`` holds, long documents are split; only chunks
    have entities, so only chunks are linked. Otherwise documents have them.
    """
    whole = nodes(docs)
    named = whole.select(F.col("node_id").cast("string").alias("node_id"), "kind", F.col("node_id").alias("doc_id"), "words", "entities")
    if not splits_by_headline(whole).first()["by_headline"]:
        return named
    pieces = headline_chunks(docs)
    content = F.col("page_content")
    chunks = pieces.select(T.chunk_name(F.col("doc_id"), F.col("chunk_index")).alias("node_id"), F.lit("CHUNK").alias("kind"), "doc_id", T.word_count(content).alias("words"), entities(content).alias("entities"))
    return named.withColumn("entities", F.array().cast("array<string>")).unionByName(chunks)


def overlap_edges(nodes_: DataFrame, least: float = 0.01) -> DataFrame:
    """``(a, b, overlap)``: shared entities over those of the smaller node, a < b.

    Nodes are a sample whose size the strata bound; entities meet in an equi-join.
    """
    e = nodes_.select("node_id", F.size("entities").alias("n"), F.explode("entities").alias("e"))
    a, b = e.select(F.col("node_id").alias("a"), F.col("n").alias("na"), "e"), e.select(F.col("node_id").alias("b"), F.col("n").alias("nb"), "e")
    shared = a.join(b, "e").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("a", "b", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap")).filter(F.col("overlap") >= least)


def themes(text: Column, most: int = 3) -> Column:
    """The most frequent words of seven letters and more, ties by alphabet: the stand-in for a model's themes."""
    words = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{7,}"), F.lit(0)))
    start = F.struct(F.array().cast("array<struct<n:int,w:string>>").alias("done"), F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"))

    def step(acc: Column, w: Column) -> Column:
        same = acc["w"] == w
        closed = F.when(acc["w"].isNull() | same, acc["done"]).otherwise(F.array_append(acc["done"], F.struct((-acc["n"]).alias("n"), acc["w"].alias("w"))))
        return F.struct(closed.alias("done"), w.alias("w"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"))

    counted = F.aggregate(words, start, step, lambda a: F.when(a["w"].isNull(), a["done"]).otherwise(F.array_append(a["done"], F.struct((-a["n"]).alias("n"), a["w"].alias("w")))))
    return F.transform(F.slice(F.array_sort(counted), 1, most), lambda x: x["w"])


def telling(nodes_: DataFrame, least_words: int = 100, least_entities: int = 3) -> DataFrame:
    """Nodes that questions can be asked about: long enough, with entities enough. The stand-in for a model's grade."""
    return nodes_.filter((F.col("words") >= least_words) & (F.size("entities") >= least_entities))


def scenario_plan(weights: dict[str, float], size: int) -> dict[str, int]:
    """How many questions of each kind: rounded down, what is left to the largest remainders."""
    out = {k: int(w * size) for k, w in weights.items()}
    for k in sorted(weights, key=lambda k: -(weights[k] * size - out[k]))[: size - sum(out.values())]:
        out[k] += 1
    return out


#: Kinds of questions and their shares.
SCENARIOS = {"single_hop": 0.5, "multi_hop_abstract": 0.25, "multi_hop_specific": 0.25}
#: Who asks, in turn.
PERSONAS = ("practitioner", "student", "rights holder")


def scenarios(nodes_: DataFrame, edges: DataFrame, size: int, weights: dict[str, float] = SCENARIOS, personas: tuple[str, ...] = PERSONAS) -> DataFrame:
    """``(kind, place, persona, node_ids)``: what each question of a set of ``size`` is about.

    Single-hop questions take one node, least hash first; the others an edge,
    by overlap (abstract) or by shared hash order (specific). An edge of which
    only one end tells enough keeps both (``hop_nodes``). Kinds that the graph
    has too little for give fewer. Nodes and edges are those of a bounded sample.
    """
    plan = scenario_plan(weights, size)
    kept = nodes_.select("node_id")
    hash_of = lambda *c: F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in c]))
    single = nodes_.select(F.lit("single_hop").alias("kind"), F.array("node_id").alias("node_ids"), hash_of("node_id").alias("by"))
    ends = edges.join(kept.select(F.col("node_id").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(kept.select(F.col("node_id").alias("b"), F.lit(True).alias("has_b")), "b", "left").filter("has_a or has_b")
    chosen = F.filter(F.array(F.when(F.col("has_a"), F.col("a")), F.when(F.col("has_b"), F.col("b"))), lambda x: x.isNotNull())
    both = ends.withColumn("node_ids", hop_nodes(chosen, F.array("a", "b")))
    abstract = both.select(F.lit("multi_hop_abstract").alias("kind"), "node_ids", F.format_string("%.6f|%s", 1 - F.col("overlap"), hash_of("a", "b")).alias("by"))
    specific = both.select(F.lit("multi_hop_specific").alias("kind"), "node_ids", hash_of("a", "b").alias("by"))
    every = single.unionByName(abstract).unionByName(specific)
    quota = F.coalesce(F.create_map(*[x for k, n in plan.items() for x in (F.lit(k), F.lit(n))])[F.col("kind")], F.lit(0))
    placed = every.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy("by"))).filter((F.col("place") <= max(plan.values())) & (F.col("place") <= quota))
    return placed.select("kind", "place", F.element_at(F.array(*map(F.lit, personas)), (F.col("place") - 1) % len(personas) + 1).alias("persona"), "node_ids")


def hop_nodes(chosen: Column, original: Column) -> Column:
    """The nodes of a multi-hop question; the original ones where fewer than two are left."""
    return F.when(F.size(chosen) < 2, original).otherwise(chosen)


def complete_samples(samples: DataFrame) -> DataFrame:
    """Samples with question and reference; a persona or style that is missing gets a default."""
    kept = samples.filter("user_input is not null and reference is not null")
    defaults = {"persona_name": "reader", "query_style": "PERFECT_GRAMMAR", "query_length": "MEDIUM"}
    return kept.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})

"""Metrics over verdicts, winners and reports, and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import fusion, graph, metrics, selection
from ..session import settle, table
from .corpus import DOCS, _QUOTA, _STRATA
from .scalars import words_sql

WS = T.WS
ENTITY = "[A-Z][a-z]{4,}"

# Published runs by stage in the order they were declared: variant, strategy, k, recall, precision.
RUNS = [
    ("embedding", "baseline", None, None, 0.4527, 0.3037),
    ("embedding", "snowflake-arctic-l", None, None, 0.4627, 0.3123),
    ("embedding", "bge-m3", None, None, 0.5830, 0.4157),
    ("embedding", "qwen3-8b", None, None, 0.5023, 0.3865),
    ("chunking", "fixed 256", None, None, 0.5830, 0.4157),
    ("chunking", "fixed 512", None, None, 0.5800, 0.3332),
    ("chunking", "sentence", None, None, 0.6150, 0.3777),
    ("chunking", "structural", None, None, 0.4473, 0.2814),
    ("chunking", "structural+pc", None, None, 0.5903, 0.3675),
    ("chunking", "semantic", None, None, 0.5937, 0.2973),
    ("retrieval", "cosine k5", "cosine", 5, 0.5830, 0.4157),
    ("retrieval", "cosine k10", "cosine", 10, 0.6437, 0.4063),
    ("retrieval", "mmr k10", "mmr", 10, 0.7107, 0.3829),
    ("retrieval", "bm25 k10", "bm25", 10, 0.6560, 0.2580),
    ("retrieval", "hybrid k10", "hybrid", 10, 0.6140, 0.2718),
    ("rerank", "ce k5", None, 5, 0.7083, 0.4791),
    ("rerank", "ce k10", None, 10, 0.7563, 0.4466),
    ("rerank", "llm k5", None, 5, 0.6655, 0.4881),
    ("rerank", "llm k10", None, 10, 0.7210, 0.4627),
    ("rerank", "none", None, 10, 0.7107, 0.3829),
    ("expansion", "none", None, 10, 0.7107, 0.3829),
    ("expansion", "hyde", None, 10, 0.5983, 0.2473),
    ("expansion", "multiquery", None, 10, 0.6650, 0.3822),
    ("expansion", "rag_fusion", None, 10, 0.6500, 0.3646),
    ("expansion", "rewrite", None, 10, 0.6327, 0.3541),
    ("expansion", "stepback", None, 10, 0.6540, 0.3490),
    ("expansion", "decomposition", None, 10, 0.6597, 0.2826),
    ("expansion", "selfquery", None, 10, 0.4847, 0.3383),
]
# The published chain of decisions.
STEPS = [
    (0, "baseline", 0.7564166666493368),
    (1, "embedding bge-m3", 0.9986944444217776),
    (2, "chunking fixed 256", 0.9986944444217776),
    (3, "retrieval MMR k10", 1.0935226851596562),
    (4, "expansion none", 1.0935226851596562),
    (5, "cross-encoder rerank k10", 1.2029316578197735),
]


def _runs(spark):
    rows = [(s, v, t, k, r, p, i) for i, (s, v, t, k, r, p) in enumerate(RUNS)]
    return spark.createDataFrame(rows, "stage string, variant string, strategy string, top_k int, context_recall double, context_precision double, declared int")


_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in (*r, i)) + ")" for i, r in enumerate(RUNS))
_RUNS = f"(SELECT *, round(context_precision + context_recall, 9) AS p_plus_r FROM (VALUES {_VALUES}) t(stage, variant, strategy, top_k, context_recall, context_precision, declared))"


def _joined(spark, sf_dir):
    """Results with the contexts and reference of their question."""
    g = table(spark, sf_dir, "gold_dataset", "qa_id", "reference_contexts").dropDuplicates(["qa_id"])
    return table(spark, sf_dir, "rag_results", "result_id", "variant", "qa_id", "retrieved_contexts", "response", "reference").join(g, "qa_id")


def _arrays(c):
    return F.coalesce(c, F.array().cast("array<string>"))


def _claims(c):
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"(?<=[.!?])[{WS}]+", -1), lambda s: T.strip(s) != "")


def _said_in(c, s):
    return F.exists(_arrays(c), lambda x: F.contains(x, s))


def metric_context_precision(spark, sf_dir):
    v = _joined(spark, sf_dir).select(F.col("result_id").alias("qid"), _arrays("reference_contexts").alias("gold"), F.posexplode("retrieved_contexts").alias("rank0", "c"))
    return metrics.context_precision(v.select("qid", "rank0", F.coalesce(F.array_contains("gold", F.col("c")), F.lit(False)).cast("int").alias("v")))


def metric_context_recall(spark, sf_dir):
    j = _joined(spark, sf_dir)
    v = j.select(F.col("result_id").alias("qid"), F.explode(_claims(F.col("reference"))).alias("s"), "retrieved_contexts").select("qid", _said_in(F.col("retrieved_contexts"), F.col("s")).alias("v"))
    return metrics.share(v.select("qid", F.coalesce("v", F.lit(False)).alias("v")), "context_recall")


def metric_entity_recall(spark, sf_dir):
    j = _joined(spark, sf_dir)
    return j.select(F.col("result_id").alias("qid"), metrics.entity_recall(graph.entities(F.coalesce("reference", F.lit(""))), graph.entities(F.array_join(_arrays("retrieved_contexts"), " "))).alias("context_entity_recall"))


def metric_faithfulness(spark, sf_dir):
    j = _joined(spark, sf_dir)
    v = j.select(F.col("result_id").alias("qid"), F.explode(_claims(F.col("response"))).alias("s"), "retrieved_contexts").select("qid", F.coalesce(_said_in(F.col("retrieved_contexts"), F.col("s")), F.lit(False)).alias("v"))
    return metrics.share(v, "faithfulness")


def metric_noise_sensitivity(spark, sf_dir):
    j = _joined(spark, sf_dir)
    c = j.select(F.col("result_id").alias("qid"), F.explode(_claims(F.col("response"))).alias("s"), "retrieved_contexts", F.coalesce("reference", F.lit("")).alias("reference"))
    return metrics.noise_sensitivity(c.select("qid", F.contains("reference", F.col("s")).alias("correct"), F.coalesce(_said_in(F.col("retrieved_contexts"), F.col("s")), F.lit(False)).alias("attributable")))


def metric_answer_relevancy(spark, sf_dir):
    """Vectors of the embeddings table stand for questions; the next three ids for questions made from an answer."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("vec_id"), (F.col("vec_id") % 7 == 0).alias("evasive"))
    return metrics.answer_relevancy(q.join(e, "vec_id").select("qid", "q", F.col("embedding").alias("v"), "evasive"))


def metric_factual_correctness(spark, sf_dir):
    r = table(spark, sf_dir, "rag_results", "result_id", "response", "reference").select(F.col("result_id").alias("qid"), F.coalesce("response", F.lit("")).alias("response"), F.coalesce("reference", F.lit("")).alias("reference"))
    side = lambda i, of, within: r.select("qid", F.lit(i).alias("side"), F.explode(_claims(F.col(of))).alias("s"), within).select("qid", "side", F.contains(F.col(within), F.col("s")).alias("v"))
    return metrics.factual_correctness(side(0, "response", "reference").unionByName(side(1, "reference", "response")))


def metric_semantic_similarity(spark, sf_dir):
    r = table(spark, sf_dir, "rag_results", "result_id", "response", "reference")
    words = lambda c: T.words(F.lower(F.coalesce(c, F.lit(""))))
    return r.select(F.col("result_id").alias("qid"), F.round(metrics.word_counts_cosine(words("response"), words("reference")), 6).alias("semantic_similarity"))


def metrics_mean(spark, sf_dir):
    """Means by variant that leave NaN out; an answer without claims has NaN."""
    f, p = metric_faithfulness(spark, sf_dir), metric_context_precision(spark, sf_dir)
    r = table(spark, sf_dir, "rag_results", "result_id", "variant").withColumnRenamed("result_id", "qid")
    wide = r.join(p, "qid", "left").join(f, "qid", "left").withColumn("faithfulness", F.coalesce("faithfulness", F.lit(float("nan"))))
    return wide.groupBy("variant").agg(F.round(F.avg("context_precision"), 6).alias("context_precision"), F.round(metrics.mean_skipping_nan("faithfulness"), 6).alias("faithfulness"), F.count(F.lit(1)).alias("n"))


def prototype_summary(spark, sf_dir):
    """Mean, spread and extremes of the answer's word overlap with its reference, by variant."""
    r = table(spark, sf_dir, "rag_results", "variant", "response", "reference").select("variant", fusion.overlap_score(F.coalesce("reference", F.lit("")), F.coalesce("response", F.lit(""))).alias("x"))
    return r.groupBy("variant").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))


def merge_results(spark, sf_dir):
    """Results and questions by the question's text; a repeated text fans out."""
    r = table(spark, sf_dir, "rag_results", "result_id", "user_input")
    g = table(spark, sf_dir, "gold_dataset", "qa_id", "user_input", "synthesizer_name").dropDuplicates(["qa_id"])
    return r.join(g, "user_input").select("result_id", "qa_id", "synthesizer_name")


def summary_upsert(spark, sf_dir):
    r = table(spark, sf_dir, "rag_results", "variant", "result_id")
    old = r.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    new = r.filter("variant like '%k10%' or variant like 'exp0%'").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.max("result_id").alias("last"))
    return metrics.upsert(old, new, "variant")


def run_log(spark, sf_dir):
    """Metric names as a tracking store takes them, NaN left out, one row each."""
    m = metrics_mean(spark, sf_dir).unpivot(["variant"], ["context_precision", "faithfulness"], "metric", "value")
    return m.filter("value is not null and not isnan(value)").select("variant", T.metric_name(F.concat("metric", F.lit("(mode=relevant)"))).alias("metric"), "value")


def select_best(spark, sf_dir):
    """The winner of every stage; ties go to the run declared first."""
    return selection.best(_runs(spark)).select("stage", "variant", "p_plus_r")


def _best_of(stage):
    return lambda spark, sf_dir: selection.best(_runs(spark).filter(F.col("stage") == stage)).select("variant", "p_plus_r")


def select_best_retrieval(spark, sf_dir):
    return selection.best_strategy(_runs(spark).filter("stage = 'retrieval'"))


def master_table(spark, sf_dir):
    return selection.ranked(_runs(spark).withColumn("stage", F.lit("all"))).select("variant", "p_plus_r", "place", "declared")


def progression(spark, sf_dir):
    return selection.progression(spark.createDataFrame(STEPS, "step int, label string, p_plus_r double"))


# The seven published metrics of the chain of decisions.
DECISION_METRICS = ["p_plus_r", "context_recall", "context_precision", "context_entity_recall", "faithfulness", "answer_relevancy", "noise_sensitivity"]
DECISIONS = [
    (0, "baseline", 0.7564, 0.4527, 0.3037, 0.3237, 0.8333, 0.4226, 0.3900),
    (1, "embedding bge-m3", 0.9987, 0.5830, 0.4157, 0.3838, 0.8808, 0.5614, 0.4655),
    (2, "chunking fixed 256", 0.9987, 0.5830, 0.4157, 0.3838, 0.8808, 0.5614, 0.4655),
    (3, "retrieval MMR k10", 1.0935, 0.7107, 0.3829, 0.3766, 0.8985, 0.5898, 0.4294),
    (4, "expansion none", 1.0935, 0.7107, 0.3829, 0.3766, 0.8985, 0.5898, 0.4294),
    (5, "cross-encoder rerank k10", 1.2029, 0.7563, 0.4466, 0.3894, 0.9505, 0.6502, 0.4082),
]


def metrics_by_decision(spark, sf_dir):
    """All seven metrics of every decision, with the change from the one before."""
    steps = spark.createDataFrame(DECISIONS, "step int, label string, " + ", ".join(f"{m} double" for m in DECISION_METRICS))
    return selection.by_decision(steps, DECISION_METRICS)


def select_best_variant(spark, sf_dir):
    """The variant of rag_results with the best precision plus recall, by its own rows."""
    p, r = metric_context_precision(spark, sf_dir), metric_context_recall(spark, sf_dir)
    runs = table(spark, sf_dir, "rag_results", "result_id", "variant").filter("variant is not null").withColumnRenamed("result_id", "qid")
    means = runs.join(p, "qid", "left").join(r, "qid", "left").groupBy("variant").agg(F.round(F.avg("context_precision"), 6).alias("context_precision"), F.round(F.avg("context_recall"), 6).alias("context_recall"))
    return selection.best(means.filter("context_precision is not null and context_recall is not null").withColumns({"stage": F.lit("all"), "declared": F.col("variant")})).select("variant", "p_plus_r")


def _sampled(spark, sf_dir, *more):
    docs = C.latest(table(spark, sf_dir, "corpus_clean", "doc_id", "ingested_at", "text").select("doc_id", "ingested_at", T.word_count(F.col("text")).alias("w")))
    ids = C.stratified_sample(docs, words="w").select("doc_id")
    return table(spark, sf_dir, "corpus_clean", "doc_id", "title", "text", *more).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def kg_nodes(spark, sf_dir):
    return graph.nodes(_sampled(spark, sf_dir)).select("node_id", "kind", "words", F.size("entities").alias("n_entities"))


def _filtered(spark, sf_dir):
    return graph.telling(graph.nodes(_sampled(spark, sf_dir)))


def kg_filtered_nodes(spark, sf_dir):
    """Nodes that tell enough, with their themes."""
    docs = _sampled(spark, sf_dir)
    kept = graph.telling(graph.nodes(docs)).select("node_id", "words")
    return docs.select(F.col("doc_id").alias("node_id"), F.array_join(graph.themes(F.coalesce("text", F.lit(""))), ",").alias("themes")).join(kept, "node_id")


def kg_scenarios(spark, sf_dir):
    """A question set of 50 over the sample: nodes that tell enough, edges of all."""
    return graph.scenarios(settle(_filtered(spark, sf_dir)), settle(kg_edges(spark, sf_dir)), 50)


def kg_edges(spark, sf_dir):
    return graph.overlap_edges(graph.nodes(_sampled(spark, sf_dir)))


def kg_branch(spark, sf_dir):
    return graph.splits_by_headline(graph.nodes(_sampled(spark, sf_dir)))


def _branch(spark, sf_dir):
    return graph.branch_nodes(settle(_sampled(spark, sf_dir, "form")))


def kg_branch_nodes(spark, sf_dir):
    """Nodes of the branch that kg_branch tells; kg_nodes and kg_edges are those of whole documents."""
    return _branch(spark, sf_dir).select("node_id", "kind", "doc_id", "words", F.size("entities").alias("n_entities"))


def kg_branch_edges(spark, sf_dir):
    return graph.overlap_edges(_branch(spark, sf_dir))


def gold_complete(spark, sf_dir):
    g = table(spark, sf_dir, "gold_dataset", "qa_id", "user_input", "reference", "persona_name", "query_style", "query_length").dropDuplicates(["qa_id"])
    return graph.complete_samples(g).groupBy("persona_name", "query_style", "query_length").agg(F.count(F.lit(1)).alias("n"))


def mapped_styles(spark, sf_dir):
    g = table(spark, sf_dir, "gold_dataset", "qa_id", "query_style").dropDuplicates(["qa_id"])
    return g.select("qa_id", T.mapped(F.col("query_style"), {"PERFECT_GRAMMAR": "Perfect", "MISSPELLED": "Misspelled", "POOR_GRAMMAR": "Poor"}).alias("style"))


QUERIES = {
    f.__name__: f
    for f in (
        metric_context_precision, metric_context_recall, metric_entity_recall, metric_faithfulness, metric_noise_sensitivity, metric_answer_relevancy, metric_factual_correctness, metric_semantic_similarity, metrics_mean, prototype_summary, merge_results, summary_upsert, run_log,
        select_best, select_best_retrieval, master_table, progression, metrics_by_decision, select_best_variant, kg_nodes, kg_filtered_nodes, kg_scenarios, kg_edges, kg_branch, kg_branch_nodes, kg_branch_edges, gold_complete, mapped_styles,
    )
} | {f"select_best_{n}": _best_of(s) for n, s in (("embedding", "embedding"), ("chunking", "chunking"), ("rerank", "rerank"), ("query_transform", "expansion"))}

_GOLD = "(SELECT * FROM gold_dataset QUALIFY row_number() OVER (PARTITION BY qa_id) = 1)"
_J = f"(SELECT r.result_id AS qid, r.variant, r.retrieved_contexts, r.response, r.reference, g.reference_contexts FROM rag_results r JOIN {_GOLD} g USING (qa_id))"


def _claims_sql(c: str) -> str:
    from .scalars import strip_sql

    return f"list_filter(string_split(regexp_replace(coalesce({c}, ''), '([.!?])[{WS}]+', '\\1' || chr(31), 'g'), chr(31)), lambda x: {strip_sql('x')} <> '')"


_SAID = "len(list_filter(coalesce(retrieved_contexts, []), lambda x: contains(x, s))) > 0"
_PRECISION = f"""(SELECT qid, round(coalesce(sum(p * v) / nullif(sum(v), 0), 0), 6) AS context_precision FROM (SELECT qid, v, sum(v) OVER (PARTITION BY qid ORDER BY rank0) / (rank0 + 1) AS p FROM
   (SELECT qid, rank0, CAST(coalesce(list_contains(gold, c), false) AS INTEGER) AS v FROM (SELECT qid, coalesce(reference_contexts, []) AS gold, unnest(range(0, len(retrieved_contexts))) AS rank0, unnest(retrieved_contexts) AS c FROM {_J}))) GROUP BY qid)"""
_FAITH = f"(SELECT qid, round(avg(CAST({_SAID} AS DOUBLE)), 6) AS faithfulness FROM (SELECT qid, retrieved_contexts, unnest({_claims_sql('response')}) AS s FROM {_J}) GROUP BY qid)"
_ENT = lambda c: f"list_distinct(regexp_extract_all({c}, '{ENTITY}'))"
_TERMS = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[^{WS}]+')"
_MEANS = f"""(SELECT variant, round(avg(context_precision), 6) AS context_precision, round(avg(faithfulness), 6) AS faithfulness, count(*) AS n FROM (SELECT result_id AS qid, variant FROM rag_results) LEFT JOIN {_PRECISION} USING (qid) LEFT JOIN {_FAITH} USING (qid) GROUP BY variant)"""
_BEST = lambda where, keep: f"SELECT {keep} FROM {_RUNS} WHERE {where} QUALIFY row_number() OVER (PARTITION BY stage ORDER BY p_plus_r DESC, declared) = 1"
_SAMPLE = f"(SELECT doc_id FROM (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) AS pick FROM {_STRATA} WHERE stratum IS NOT NULL) WHERE pick <= {_QUOTA})"
_NODES = f"(SELECT doc_id AS node_id, {words_sql("coalesce(text, '')")} AS words, {_ENT("coalesce(text, '')")} AS e FROM {DOCS} WHERE doc_id IN {_SAMPLE})"

_RECALL = f"(SELECT qid, round(avg(CAST({_SAID} AS DOUBLE)), 6) AS context_recall FROM (SELECT qid, retrieved_contexts, unnest({_claims_sql('reference')}) AS s FROM {_J}) GROUP BY qid)"
_DECISIONS = ", ".join(f"({i}, '{n}', " + ", ".join(f"{x}::DOUBLE" for x in xs) + ")" for i, n, *xs in DECISIONS)

SQL = {
    "metric_context_precision": f"SELECT * FROM {_PRECISION}",
    "metric_context_recall": f"SELECT qid, round(avg(CAST({_SAID} AS DOUBLE)), 6) AS context_recall FROM (SELECT qid, retrieved_contexts, unnest({_claims_sql('reference')}) AS s FROM {_J}) GROUP BY qid",
    "metric_entity_recall": f"SELECT qid, round(len(list_intersect({_ENT("coalesce(reference, '')")}, {_ENT("coalesce(array_to_string(retrieved_contexts, ' '), '')")})) / nullif(len({_ENT("coalesce(reference, '')")}), 0), 6) AS context_entity_recall FROM {_J}",
    "metric_faithfulness": f"SELECT * FROM {_FAITH}",
    "metric_noise_sensitivity": f"SELECT qid, round(avg(CAST(NOT contains(coalesce(reference, ''), s) AND {_SAID} AS DOUBLE)), 6) AS noise_sensitivity FROM (SELECT qid, retrieved_contexts, reference, unnest({_claims_sql('response')}) AS s FROM {_J}) GROUP BY qid",
    "metric_answer_relevancy": "SELECT a.vec_id AS qid, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) * CASE WHEN a.vec_id % 7 = 0 THEN 0 ELSE 1 END, 6) AS answer_relevancy FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 GROUP BY a.vec_id",
    "metrics_mean": f"SELECT * FROM {_MEANS}",
    "prototype_summary": f"SELECT variant, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS least, max(x) AS most FROM (SELECT variant, coalesce(round(len(list_intersect(list_distinct({_TERMS('reference')}), {_TERMS('response')})) / nullif(len(list_distinct({_TERMS('reference')})), 0), 6), 0) AS x FROM rag_results) GROUP BY variant",
    "merge_results": f"SELECT r.result_id, g.qa_id, g.synthesizer_name FROM rag_results r JOIN {_GOLD} g USING (user_input)",
    "summary_upsert": "WITH n AS (SELECT variant, count(*) AS n, max(result_id) AS last FROM rag_results WHERE variant LIKE '%k10%' OR variant LIKE 'exp0%' GROUP BY 1) SELECT variant, count(*) AS n, NULL::BIGINT AS last FROM rag_results WHERE variant IS NULL OR variant NOT IN (SELECT variant FROM n WHERE variant IS NOT NULL) GROUP BY 1 UNION ALL SELECT * FROM n",
    "run_log": f"SELECT variant, 'context_precision_mode_relevant' AS metric, context_precision AS value FROM {_MEANS} WHERE context_precision IS NOT NULL UNION ALL SELECT variant, 'faithfulness_mode_relevant', faithfulness FROM {_MEANS} WHERE faithfulness IS NOT NULL",
    "select_best": _BEST("true", "stage, variant, p_plus_r"),
    "select_best_retrieval": f"SELECT strategy, max(top_k) AS top_k, round(avg(context_precision + context_recall), 9) AS mean_score FROM {_RUNS} WHERE stage = 'retrieval' AND top_k IN (5, 10) GROUP BY strategy ORDER BY mean_score DESC, min(declared) LIMIT 1",
    "master_table": f"SELECT variant, p_plus_r, row_number() OVER (ORDER BY p_plus_r DESC, declared) AS place, declared FROM {_RUNS}",
    "progression": f"SELECT step, label, p_plus_r, round(coalesce(p_plus_r - lag(p_plus_r) OVER (ORDER BY step), 0), 4) AS gain FROM (VALUES {', '.join(f"({i}, '{n}', {x}::DOUBLE)" for i, n, x in STEPS)}) t(step, label, p_plus_r)",
    "metrics_by_decision": f"""SELECT step, label, metric, value, round(coalesce(value - lag(value) OVER (PARTITION BY metric ORDER BY step), 0), 4) AS change FROM (
        SELECT step, label, unnest({DECISION_METRICS}) AS metric, unnest([{", ".join(DECISION_METRICS)}]) AS value FROM (VALUES {_DECISIONS}) t(step, label, {", ".join(DECISION_METRICS)}))""",
    "select_best_variant": f"""SELECT variant, round(p + r, 9) AS p_plus_r FROM (SELECT variant, round(avg(context_precision), 6) AS p, round(avg(context_recall), 6) AS r FROM (SELECT result_id AS qid, variant FROM rag_results WHERE variant IS NOT NULL)
        LEFT JOIN {_PRECISION} USING (qid) LEFT JOIN {_RECALL} USING (qid) GROUP BY variant) WHERE p IS NOT NULL AND r IS NOT NULL ORDER BY p_plus_r DESC, variant LIMIT 1""",
    "metric_factual_correctness": f"""SELECT qid, round(coalesce(2 * hit / nullif(2 * hit + bad + missed, 0), 0), 6) AS factual_correctness FROM (SELECT qid, count(*) FILTER (side = 0 AND v) AS hit, count(*) FILTER (side = 0 AND NOT v) AS bad, count(*) FILTER (side = 1 AND NOT v) AS missed FROM (
        SELECT qid, 0 AS side, contains(ref, s) AS v FROM (SELECT result_id AS qid, coalesce(reference, '') AS ref, unnest({_claims_sql('response')}) AS s FROM rag_results)
        UNION ALL SELECT qid, 1, contains(res, s) FROM (SELECT result_id AS qid, coalesce(response, '') AS res, unnest({_claims_sql('reference')}) AS s FROM rag_results)) GROUP BY qid)""",
    "metric_semantic_similarity": f"""WITH w AS (SELECT result_id AS qid, side, w, count(*) AS n FROM (SELECT result_id, 0 AS side, unnest({_TERMS('response')}) AS w FROM rag_results UNION ALL SELECT result_id, 1, unnest({_TERMS('reference')}) FROM rag_results) GROUP BY ALL),
        d AS (SELECT a.qid, sum(a.n * b.n) AS dot FROM w a JOIN w b ON a.qid = b.qid AND a.w = b.w AND a.side = 0 AND b.side = 1 GROUP BY 1),
        q AS (SELECT qid, sum(n * n) FILTER (side = 0) AS x, sum(n * n) FILTER (side = 1) AS y FROM w GROUP BY 1)
        SELECT result_id AS qid, round(coalesce(dot / nullif(sqrt(CAST(x AS DOUBLE) * y), 0), 0), 6) AS semantic_similarity FROM rag_results LEFT JOIN d ON d.qid = result_id LEFT JOIN q ON q.qid = result_id""",
    "kg_filtered_nodes": f"""WITH k AS MATERIALIZED (SELECT node_id, words FROM {_NODES} WHERE words >= 100 AND len(e) >= 3),
        c AS (SELECT doc_id AS node_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{7,}}')) AS w FROM {DOCS} WHERE doc_id IN (SELECT node_id FROM k)) GROUP BY ALL)
        SELECT k.node_id, k.words, coalesce(t.themes, '') AS themes FROM k LEFT JOIN (SELECT node_id, string_agg(w, ',' ORDER BY n DESC, w) AS themes FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, w) <= 3) GROUP BY 1) t ON t.node_id = k.node_id""",
    "kg_scenarios": f"""WITH n AS MATERIALIZED (SELECT * FROM {_NODES}), k AS (SELECT node_id FROM n WHERE words >= 100 AND len(e) >= 3),
        g AS MATERIALIZED (SELECT a.node_id AS a, b.node_id AS b, round(len(list_intersect(a.e, b.e)) / least(len(a.e), len(b.e)), 6) AS overlap FROM n a JOIN n b ON a.node_id < b.node_id WHERE len(list_intersect(a.e, b.e)) > 0),
        m AS (SELECT * FROM g WHERE overlap >= 0.01 AND (a IN (SELECT node_id FROM k) OR b IN (SELECT node_id FROM k))),
        s AS (SELECT 'single_hop' AS kind, [node_id] AS node_ids, md5(node_id::VARCHAR) AS by_, 25 AS quota FROM k
          UNION ALL SELECT 'multi_hop_abstract', [a, b], printf('%.6f', 1 - overlap) || '|' || md5(a::VARCHAR || '|' || b::VARCHAR), 13 FROM m
          UNION ALL SELECT 'multi_hop_specific', [a, b], md5(a::VARCHAR || '|' || b::VARCHAR), 12 FROM m)
        SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY by_) AS place, (['practitioner', 'student', 'rights holder'])[(place - 1) % 3 + 1] AS persona, node_ids FROM s QUALIFY place <= quota""",
    "kg_nodes": f"SELECT node_id, 'DOCUMENT' AS kind, words, len(e) AS n_entities FROM {_NODES}",
    "kg_edges": f"SELECT a.node_id AS a, b.node_id AS b, round(len(list_intersect(a.e, b.e)) / least(len(a.e), len(b.e)), 6) AS overlap FROM {_NODES} a JOIN {_NODES} b ON a.node_id < b.node_id WHERE len(list_intersect(a.e, b.e)) > 0 AND round(len(list_intersect(a.e, b.e)) / least(len(a.e), len(b.e)), 6) >= 0.01",
    "kg_branch": f"SELECT round(avg(CAST(words > 500 AS INTEGER)), 6) AS long_share, avg(CAST(words > 500 AS INTEGER)) >= 0.25 AS by_headline FROM {_NODES}",
    "gold_complete": f"SELECT coalesce(persona_name, 'reader') AS persona_name, coalesce(query_style, 'PERFECT_GRAMMAR') AS query_style, coalesce(query_length, 'MEDIUM') AS query_length, count(*) AS n FROM {_GOLD} WHERE user_input IS NOT NULL AND reference IS NOT NULL GROUP BY 1, 2, 3",
    "mapped_styles": f"SELECT qa_id, CASE query_style WHEN 'PERFECT_GRAMMAR' THEN 'Perfect' WHEN 'MISSPELLED' THEN 'Misspelled' WHEN 'POOR_GRAMMAR' THEN 'Poor' END AS style FROM {_GOLD}",
} | {f"select_best_{n}": _BEST(f"stage = '{s}'", "variant, p_plus_r") for n, s in (("embedding", "embedding"), ("chunking", "chunking"), ("rerank", "rerank"), ("query_transform", "expansion"))}

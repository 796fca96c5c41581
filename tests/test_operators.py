"""Properties and edge cases of the core operators."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.operators import bm25, chunking, corpus, dense, fusion, generation, graph, metrics, selection
from lexweave.operators.embedding import MODELS, PROVIDERS, Limited, embed, hashed, provider, with_retries
from lexweave.plans import variants
from lexweave.queries import plans
from lexweave.sources import io

C = chunking.ChunkConfig


def test_recursive_split_keeps_size_and_words():
    rng = random.Random(1)
    for _ in range(60):
        words = [f"w{i}" for i in range(rng.randint(0, 300))]
        text = "".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n"]) for w in words)
        cfg = C("fixed_size", rng.randint(3, 40), rng.randint(0, 2))
        out = chunking.recursive_split(text, cfg)
        assert all(len(c.split()) <= cfg.chunk_size for c in out)
        assert {w.strip(".") for c in out for w in c.split()} - {""} == set(words)
    assert chunking.recursive_split("", C()) == [] and chunking.recursive_split("abc" * 50, C(chunk_size=10, chunk_overlap=0, unit="chars")) == ["abcabcabca", "bcabcabcab", "cabcabcabc"] * 5


def test_parent_window_grows_right_first():
    assert chunking.parent_window(list("abcd"), [4, 3, 2, 5], 1, 9) == "a\n\nb\n\nc"
    assert chunking.parent_window(["a"], [99], 0, 9) == "a"


def test_sentence_packing(spark):
    df = spark.createDataFrame([(1, "", "a b. c d. e f g h. i."), (2, "", None), (3, "", "")], "doc_id bigint, form string, text string")
    got = chunking.chunk(df, C("sentence", 3)).orderBy("chunk_index").collect()
    assert [r.page_content for r in got] == ["a b.", "c d.", "e f g h.", "i."]


def test_structural_and_parents(spark):
    df = spark.createDataFrame([(1, "Judgment", "1. Foo\n2. Bar"), (2, "Order", "no marks\n\n \nsecond"), (3, "Directive", "Article 1\nx\nArticle 2\ny")], "doc_id bigint, form string, text string")
    got = {}
    for r in chunking.chunk(df, C("structural", 5, 0, parent_child=True, parent_size=50)).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.page_content, r.parent_text))
    assert [p for p, _ in got[1]] == ["1. Foo\n", "2. Bar"] and got[1][0][1] == "1. Foo\n\n\n2. Bar"
    assert [p for p, _ in got[2]] == ["no marks", "second"] and [p for p, _ in got[3]] == ["Article 1\nx\n", "Article 2\ny"]


def test_headings_and_semantics():
    s = chunking.heading_sections("intro\n# A\ntext\n## B\nmore\n# C\nend", 6)
    assert [(x["title"], x["level"], x["breadcrumb"]) for x in s] == [(None, None, None), ("A", 1, "A"), ("B", 2, "A > B"), ("C", 1, "C")]
    assert chunking.semantic_split("One.", C("semantic")) == ["One."]
    out = chunking.semantic_split("Cats purr. Cats sleep. Tax law rose. Tax law fell.", C("semantic", breakpoint_percentile=60))
    assert " ".join(out) == "Cats purr. Cats sleep. Tax law rose. Tax law fell."
    with pytest.raises(NotImplementedError):
        chunking.chunk(None, C("sliding"))


def _vectors(spark, n, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[min(3, n - 1)] = 0
    return v, spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "chunk_id bigint, embedding array<double>, label string")


def test_dense_topk_and_mmr_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "INDEX_BLOCK", 7)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    v, index = _vectors(spark, 40)
    q = index.filter("chunk_id < 5").withColumnRenamed("chunk_id", "qid")
    unit = v / np.where((n := np.sqrt((v * v).sum(1, keepdims=True))) == 0, 1, n)
    got = {(r.qid, r.rank0): r.chunk_id for r in dense.topk(q.drop("label"), index.drop("label"), 4).collect()}
    for i in range(5):
        s = np.round(unit @ unit[i], 6) + 0.0
        assert [got[i, r] for r in range(4)] == np.lexsort((np.arange(40), -s))[:4].tolist()
    filtered = dense.topk(q, index, 40, filters=["label"]).collect()
    assert all(r.qid % 2 == r.chunk_id % 2 for r in filtered) and len(filtered) == 100
    chosen = dense.mmr(q.drop("label"), index.drop("label"), 4, 10).filter("qid = 1").orderBy("rank0").collect()
    assert chosen[0].chunk_id == 1 and len({r.chunk_id for r in chosen}) == 4
    assert dense.mmr_order(unit[1], unit, 6, 1.0) == np.argsort(-(unit @ unit[1]), kind="stable")[:6].tolist()
    assert dense.topk(q.drop("label"), index.drop("label").filter("false"), 3).count() == 0


def test_cells_find_what_exact_search_finds(spark, monkeypatch):
    monkeypatch.setattr(dense, "INDEX_BLOCK", 150)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    v = np.concatenate([centres[rng.integers(0, 30, 1400)] + rng.normal(size=(1400, 16)) * 0.6, np.tile(centres[:1], (700, 1)) + rng.normal(size=(700, 16)) * 0.01])  # a hot cell
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "chunk_id bigint, embedding array<double>")
    q = index.filter("chunk_id % 40 = 0").withColumnRenamed("chunk_id", "qid")
    cells = dense.build_cells(index)
    exact = {(r.qid, r.chunk_id) for r in dense.topk(q, index, 10).collect()}
    near = {(r.qid, r.chunk_id) for r in dense.topk_cells(q, cells, 10).collect()}
    assert len(exact) == len(near) and len(exact & near) >= 0.95 * len(exact)
    assert {(r.qid, r.chunk_id) for r in dense.topk_cells(q, cells, 10, probes=len(cells.centroids)).collect()} == exact
    assert cells.blocks.count() > len(cells.centroids) - 10 and cells.blocks.groupBy("cell").count().filter("count > 3").count() >= 1
    empty = dense.build_cells(index.filter("false"))
    assert dense.topk_cells(q, empty, 3, probes=1).count() == 0


def test_bm25_gives_k_hits(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a a c", None, "", "d", "a e f"])], "chunk_id bigint, page_content string")
    q = spark.createDataFrame([(1, "A zz"), (2, "nothing"), (3, None)], "qid bigint, text string")
    got = bm25.search(q, chunks, 4).orderBy("qid", "rank0").collect()
    assert [r.rank0 for r in got] == [0, 1, 2, 3] * 3
    assert [r.chunk_id for r in got if r.qid == 2] == [0, 1, 2, 3] and all(r.score == 0 for r in got if r.qid != 1)


def _ranked(spark, rows):
    return spark.createDataFrame([(1, i, r, c) for i, lst in enumerate(rows) for r, c in enumerate(lst)], "qid bigint, list_id int, rank0 int, content string")


def test_fusion(spark):
    got = lambda df: [r.content for r in df.orderBy("rank0").collect()]
    assert got(fusion.rrf(_ranked(spark, ["AB", "BC"]), 2)) == ["B", "A"]
    assert got(fusion.rrf(_ranked(spark, ["A", "B"]), 5)) == ["A", "B"]
    assert got(fusion.interleave(_ranked(spark, ["AB", "AC"]), 3)) == ["A", "B", "C"]
    scores = [{r.content: r.score for r in fusion.rrf(_ranked(spark, p), 9).collect()} for p in itertools.permutations(["ABC", "BDA", "CAB"])]
    assert all(s == scores[0] for s in scores)
    assert [fusion.fetch_size(k) for k in (3, 5, 10)] == [20, 20, 40]


def test_listwise(spark):
    c = _ranked(spark, ["WXYZ"])
    for answer, expected in (("[3, 9, 3, 0]", "ZW"), ("none", "WX"), (None, "WX")):
        a = spark.createDataFrame([(1, answer)], "qid bigint, answer string")
        assert "".join(r.content for r in fusion.listwise(c, a, 2).orderBy("rank0").collect()) == expected


def test_variants(spark):
    a = spark.createDataFrame([(1, "q", "1. x\n2. y\n3. z"), (2, "q", None), (3, "q", '{"query": "s"}')], "qid bigint, question string, answer string")
    texts = lambda kind: {r.qid: r.t for r in fusion.variants(a, kind, 2).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("list_id", "text"))).getField("text").alias("t")).collect()}
    assert texts("multiquery")[1] == ["q", "x", "y"] and texts("decomposition")[2] == ["q"] and texts("selfquery") == {1: ["q"], 2: ["q"], 3: ["s"]}
    with pytest.raises(NotImplementedError):
        fusion.variants(a, "other")


def test_variants_build_their_index(spark, sf):
    corpus_ = spark.read.parquet(f"{sf}/corpus_clean.parquet")
    ids = {r[0] for r in corpus_.filter("text rlike '[a-zA-Z]'").select("doc_id").distinct().collect()}
    sizes = {}
    for v in ("exp0", "exp1__qwen3_8b", "exp2__structural_pc", "expSOTA"):
        c = plans._corpus(spark, sf, variants.resolved(v, *plans.WINNERS), variants.builds_index(v))
        got = [r.chunk_id for r in c.chunks.collect()]
        assert ids <= {i >> 20 for i in got} and len(got) == len(set(got)) == c.vectors.count()
        sizes[v] = len(got)
        one = c.embed(spark.createDataFrame([(1, "fees of a map")], "qid bigint, text string"), "qid", "text").first().embedding
        prefix = MODELS[variants.resolved(v, *plans.WINNERS)["embedding"]["model"]][2]
        assert np.allclose(one, provider(variants.resolved(v, *plans.WINNERS)["embedding"]["model"])()([prefix + "fees of a map"])[0])
    assert len({sizes["exp0"], sizes["exp2__structural_pc"], sizes["expSOTA"]}) == 3
    with pytest.raises(NotImplementedError):
        variants.chunk_config({"strategy": "semantic", "breakpoint_type": "gradient"})


def test_selfquery_restricts_hits(spark, sf):
    c = plans._corpus(spark, sf, variants.resolved("exp4g__selfquery", *plans.WINNERS), False)
    queries = spark.createDataFrame([(q, "fees of a map") for q in (0, 100, 200, 300)], "qid bigint, text string")
    hits = variants.plan(c, queries, variants.resolved("exp4g__selfquery", *plans.WINNERS)).join(c.chunks, "chunk_id").collect()
    of = {q: [(r.family, r.form) for r in hits if r.qid == q] for q in (0, 100, 200, 300)}
    assert {f for f, _ in of[0]} == {"LEGISLATIVE"} and set(of[100]) == {("JUDICIAL", "Judgment")}
    assert len(of[200]) == 10 and sorted(map(str, of[200])) == sorted(map(str, of[300])) and {f for f, _ in of[200]} != {"LEGISLATIVE"}


@pytest.mark.parametrize("strategy", ["markdown", "section"])
def test_parents_are_whole_sections(spark, strategy):
    text = "# Long\n" + "word goes on. " * 2000 + "the end"
    got = chunking.chunk(spark.createDataFrame([(1, "", text)], "doc_id bigint, form string, text string"), C(strategy, 450, 50)).orderBy("chunk_index").collect()
    assert len(got) > 1 and {r.parent_text for r in got} == {text} and got[-1].page_content.endswith("the end")


def test_graph_of_the_long_branch(spark):
    parts = ["Heading number\n" + f"{name} goes on. " * 200 for name in ("Brussels", "Brussels", "Lisbon")]
    docs = spark.createDataFrame([(1, "", "\n".join(parts), ""), (2, "", "Brussels " * 30, ""), (3, "", None, "")], "doc_id bigint, form string, text string, title string")
    got = graph.branch_nodes(docs)
    rows = {r.node_id: r for r in got.collect()}
    assert sorted(rows) == ["1", "1_chunk_000", "1_chunk_001", "1_chunk_002", "2", "3"] and rows["1_chunk_000"].kind == "CHUNK" and not rows["1"].entities
    assert [(r.a, r.b) for r in graph.overlap_edges(got).orderBy("a", "b").collect()] == [("1_chunk_000", "1_chunk_001"), ("1_chunk_000", "1_chunk_002"), ("1_chunk_001", "1_chunk_002")]
    short = graph.branch_nodes(docs.filter("doc_id = 2").union(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(4).cast("bigint"))))
    assert {r.kind for r in short.collect()} == {"DOCUMENT"} and graph.overlap_edges(short).count() == 1
    assert graph.branch_nodes(docs.filter("false")).count() == 0


def test_scenarios_keep_two_nodes(spark):
    nodes = spark.createDataFrame([(1, 200, ["A", "B", "C"]), (2, 200, ["A", "B", "D"]), (3, 5, ["A"])], "node_id bigint, words int, entities array<string>")
    got = graph.scenarios(graph.telling(nodes), graph.overlap_edges(nodes), 8, {"single_hop": 0.25, "multi_hop_abstract": 0.25, "multi_hop_specific": 0.5}).collect()
    assert {r.kind: sum(x.kind == r.kind for x in got) for r in got} == {"single_hop": 2, "multi_hop_abstract": 2, "multi_hop_specific": 3}
    assert all(len(r.node_ids) == (1 if r.kind == "single_hop" else 2) for r in got) and {r.persona for r in got if r.place == 1} == {"practitioner"}
    assert sorted(r.node_ids for r in got if r.kind == "multi_hop_abstract") == [[1, 3], [2, 3]]  # those that overlap most
    assert spark.range(1).select(graph.hop_nodes(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("x")).first().x == [1, 2]
    words = spark.createDataFrame([("Licences licences fishery fishery fishery anglers short",), (None,), ("",)], "t string")
    assert [r.x for r in words.select(graph.themes(F.coalesce("t", F.lit(""))).alias("x")).collect()] == [["fishery", "licences", "anglers"], [], []]


@given(st.lists(st.integers(0, 2600), max_size=8))
def test_headline_chunks_keep_all_words(sizes):
    words = [f"w{i}" for i in range(sum(sizes))]
    ends = list(itertools.accumulate(sizes))
    got = graph.sized([" ".join(words[e - n : e]) for e, n in zip(ends, sizes)])
    assert " ".join(got).split() == words and all(len(c.split()) <= 1000 for c in got)


def test_metrics(spark):
    v = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 0)], "qid bigint, rank0 int, v int")
    assert {r.qid: r.context_precision for r in metrics.context_precision(v).collect()} == {1: 0.833333, 2: 0.0}
    one = spark.range(1).select(metrics.entity_recall(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))).alias("x")).first().x
    assert one == 0.666667
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (0.0,)], "x double")
    assert nan.agg(metrics.mean_skipping_nan("x")).first()[0] == 0.5
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("b", 3, "x")], "k string, n int, m string")
    assert sorted((r.k, r.n, r.m) for r in metrics.upsert(old, new, "k").collect()) == [("a", 1, None), ("b", 3, "x")]


def test_selection(spark):
    tied = spark.createDataFrame([("s", "x", 0.5, 0.5, 0), ("s", "y", 0.4, 0.6, 1)], "stage string, variant string, context_precision double, context_recall double, declared int")
    assert selection.best(tied).first().variant == "x"
    w = ("M", {"strategy": "fixed_size"}, {"strategy": "mmr"})
    assert selection.resolve({"embedding": {}}, *w)["embedding"]["model"] == "M" and selection.resolve({"embedding": {"model": "E"}}, *w)["embedding"]["model"] == "E"
    given = {"chunking": {"strategy": "sentence"}}
    assert selection.resolve(given, *w)["chunking"] == {"strategy": "sentence"} and "embedding" not in given
    assert variants.inherits("exp3__mmr_k5") == ["embedding", "chunking"] and len(variants.VARIANTS) == 28
    assert graph.scenario_plan({"a": 0.5, "b": 0.5}, 5) == {"a": 3, "b": 2}


@pytest.mark.parametrize("ranges", [8, 64])
def test_numbers_have_no_gaps_at_size(spark, ranges):
    n = 3_000_000
    rows = spark.range(n).select((F.xxhash64("id") % (1 << 40) * 4_194_304 + F.col("id")).alias("p"))
    got = corpus.number_rows(rows.withColumn("q", F.col("p")), "p", "n", ranges)
    one = got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(one) == (n, 0, n - 1)
    sorted_ = got.select("n", "q", F.lag("q").over(W.partitionBy(F.floor(F.col("n") / 50_000)).orderBy("n")).alias("before"))
    assert sorted_.filter("before >= q").count() == 0


def test_samples_take_few_rows_of_a_task(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"))
    got = corpus.take_by_key(df, ["g"], F.col("g") * 2, "doc_id", 4)
    assert sorted(r["count"] for r in got.groupBy("g").count().collect()) == [2, 4]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_corpus(spark):
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate([299, 300, 999, 1000, 5000, 20000])], "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", corpus.stratum(F.size(F.split(F.trim("text"), " "))).alias("s")).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    seq = corpus.number_rows(spark.range(5, 105).withColumnRenamed("id", "p"), "p", "n", 7)
    assert sorted(r.n for r in seq.collect()) == list(range(100))
    empty = spark.createDataFrame([], "doc_id bigint, title string, family string, form string, text string")
    assert corpus.subtopics(empty).count() == len(corpus.TOPICS) and corpus.filter_scenarios(empty).count() == 6


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z")], "id bigint, text string, key string")
    got = {r.id: np.array(r.embedding) for r in embed(df, "id", "text", "BAAI/bge-m3").collect()}
    assert np.allclose(got[1], provider("BAAI/bge-m3")()(["a b"])[0]) and not got[2].any() and not got[3].any()
    with pytest.raises(NotImplementedError):
        provider("other")
    vectors = [provider(m)()(["fees of a map"])[0] for m in (*MODELS, "hashed")]
    assert all(not np.allclose(a, b) for a, b in itertools.combinations(vectors, 2)) and np.allclose(vectors[-1], hashed(["fees of a map"])[0])
    made = []

    def making():
        made.append(1)
        return hashed

    PROVIDERS["counted"] = making
    many = spark.range(10).select("id", F.col("id").cast("string").alias("text")).coalesce(1)
    assert embed(many, "id", "text", "counted", batch=1, reload=3, pause=0.001).count() == 10
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return 7

    assert with_retries(flaky, wait=0) == 7
    with pytest.raises(Limited):
        with_retries(lambda: (_ for _ in ()).throw(Limited()), tries=2, wait=0)


def test_generation(spark):
    df = spark.createDataFrame([(1, "Context:\nA b.\nmore\n\nQuestion: q"), (2, "Context:\n\n\nQuestion: q"), (3, None)], "qid bigint, prompt string")
    assert {r.qid: r.answer for r in generation.generate(df).collect()} == {1: "A b.", 2: "The context does not say.", 3: None}
    with pytest.raises(NotImplementedError):
        generation.generate(df, "other")


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(1, "é\n"), (2, None)], "doc_id bigint, text string")
    io.write_json_lines(df, f"{p}/a")
    assert sorted(r.doc_id for r in io.read_json_lines(spark, f"{p}/a", "doc_id bigint, text string").collect()) == [1, 2]
    (tmp_path / "bad.json").write_text('{"doc_id": 1}\n\n{bad\n')
    with pytest.raises(Exception):
        io.read_json_lines(spark, f"{p}/bad.json", "doc_id bigint").collect()
    io.write_scalar(spark, "winner", f"{p}/s")
    assert io.read_scalar(spark, f"{p}/s") == "winner"
    literal = spark.createDataFrame([("['a', \"b's\"]",), ("x",)], "c string").select(io.list_literal(F.col("c")).alias("l")).collect()
    assert [r.l for r in literal] == [["a", "b's"], None]
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id bigint, page_content string")
    first = io.build_index(chunks, p, {"x": 1})
    stamp = {f.name for f in (tmp_path / f"index-{io.config_hash({'x': 1})}").iterdir()}
    assert first.count() == 2 and io.build_index(chunks, p, {"x": 1}).count() == 2
    assert stamp == {f.name for f in (tmp_path / f"index-{io.config_hash({'x': 1})}").iterdir()}
    assert io.build_index(chunks.limit(1), p, {"x": 1}).count() == 1


def test_index_in_batches(spark, tmp_path):
    chunks = spark.range(40).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("page_content"))
    fails = [2]

    def unsteady(texts):
        if fails[0] and len(texts) > 1:
            fails[0] -= 1
            raise TimeoutError
        return hashed(texts)

    PROVIDERS["unsteady"] = lambda: unsteady
    cfg = {"embedding": {"model": "unsteady", "batch_size": 4}}
    assert io.probe("unsteady") == 64
    got = io.build_index(chunks, str(tmp_path), cfg, batches=3)
    assert got.columns == ["chunk_id", "page_content", "embedding"] and got.count() == got.select("chunk_id").distinct().count() == 40
    path = tmp_path / f"index-{io.config_hash(cfg)}"
    files = {str(f) for f in path.rglob("*.parquet")}
    (path / "_SUCCESS").unlink()  # an attempt that ended before its marker: complete batches stay
    assert io.build_index(chunks, str(tmp_path), cfg, batches=3).count() == 40 and files == {str(f) for f in path.rglob("*.parquet")}
    PROVIDERS["uneven"] = lambda: lambda texts: np.ones((len(texts), 3 if texts == ["probe"] else 2))
    with pytest.raises(Exception, match="another length"):
        io.build_index(chunks, str(tmp_path), {"embedding": {"model": "uneven"}})


def test_splitters_and_scorers_of_the_caller(spark):
    chunking.SPLITTERS["by_bar"] = lambda text, cfg: ({"page_content": p} for p in text.split("|") if p)
    df = spark.createDataFrame([(1, "", "a|b||c"), (2, "", None)], "doc_id bigint, form string, text string")
    assert [r.page_content for r in chunking.chunk(df, C("by_bar")).orderBy("chunk_index").collect()] == ["a", "b", "c"]
    del chunking.SPLITTERS["by_bar"]
    assert set(fusion.SCORERS) == {"overlap"}


def test_streaming(spark, tmp_path):
    from lexweave.streaming import ingest

    (tmp_path / "in").mkdir()
    line = '{"content": "A long enough first line of text.", "metadata": {"celex": "62008CJ0005", "date": "01/02/2003; x"}}\n'
    (tmp_path / "in" / "a.json").write_text(line * 3)
    ingest.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.family, r.date) for r in rows] == [("JUDICIAL", "01/02/2003")]


@given(st.lists(st.integers(1, 9), min_size=1, max_size=14), st.integers(1, 40))
def test_parent_windows_spread_while_they_fit(sizes, limit):
    for i, (low, high) in enumerate(chunking.windows(sizes, limit)):
        total = sum(sizes[low : high + 1])
        assert low <= i <= high and (total <= limit or low == high)
        # nothing more fits, and the right side is never behind the left one unless it can't go on
        assert high == len(sizes) - 1 or total + sizes[high + 1] > limit
        assert low == 0 or total + sizes[low - 1] > limit
        left, right = i - low, high - i
        if right < left:  # the right side stopped when it was next
            assert high == len(sizes) - 1 or sum(sizes[i - right : high + 2]) > limit
        if left < right - 1:
            assert low == 0 or sum(sizes[low - 1 : i + left + 2]) > limit


def test_chunks_in_tokens(spark):
    from lexweave.queries.chunks import TOKENIZER

    text = "Fees of 12,5 kroner are due. " * 60 + "終わり。\n\nThe end"
    df = spark.createDataFrame([(1, "", text), (2, "", None), (3, "", "")], "doc_id bigint, form string, text string")
    got = chunking.bpe_windows(df, TOKENIZER, 40, 10).orderBy("window").collect()
    n = len(chunking.tokenizer(TOKENIZER).encode(text, add_special_tokens=False).ids)
    assert {r.doc_id for r in got} == {1} and len(got) == -(-n // 30) and sum(min(30, n - 30 * r.window) for r in got) == n
    assert got[0].start == 0 and got[-1].end == len(text) and all(r.page_content == text[r.start : r.end] and r.n_tokens <= 40 for r in got)
    cfg = C("fixed_size", 40, 5, tokens=TOKENIZER)
    parts = chunking.chunk(df, cfg).collect()
    assert len(parts) > 3 and all(cfg.count(r.page_content) <= 42 for r in parts)

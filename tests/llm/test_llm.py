"""Training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import itertools
import pickle
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import oracle
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import bpe, neardup, packing, pairs, queries, quotas, reading, sentences, splitting

TEXTS = ["", " ", "a", "don't  stop\n\n\tit's 12,5 €​ x", "<|endoftext|> é \U0001f600\U0001f468‍\U0001f469 \x00\x1c\x85", "กำหนด नमस्ते 東京12か月 Ⅷ½", "x" * 3000, "ab" * 2000 + " " * 500, "\r\n \r\n"]


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary("byte_bpe_50k"))


# --- problem 6


def test_encoder_against_library_and_round_trip(enc, sf):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = TEXTS + [x or "" for x in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for text, ref in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = enc.encode(text)
        assert ids == ref.ids and enc.count(text) == len(ids)
        assert b"".join(enc.spelling[i] for i in ids).decode() == text
    assert enc.encode(None) == [] and enc.encode("") == []


def test_every_entry_merges_to_itself(enc):
    assert all(enc.merge(spelling) == (rank,) for spelling, rank in enc.ranks.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50_000), st.integers(0, 99))))
def test_rank_queue_is_a_priority_queue(entries):
    q, want = bpe.RankQueue(50_256), defaultdict(list)
    for rank, place in entries:
        q.push(rank, place)
        want[rank].append(place)
    got = []
    while (head := q.pop()) is not None:
        got.append(head)
    assert got == sorted(want.items())


def test_ids_of_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 8), (3, "a b", 9), (3, "a b", 9)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 2
    assert bpe.encode(df.filter("false")).count() == 0


# --- problem 7


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120), st.sampled_from(["norm", "dot"]), st.integers(1, 9))
def test_packing_respects_every_capacity(lengths, rule, max_docs):
    x = np.array(lengths, float)
    bins = packing.vector_best_fit(x, 50, max_docs, 1800.0 + 700, rule)
    for b in set(bins.tolist()):
        inside = x[bins == b]
        assert inside.sum() <= 50 and len(inside) <= max_docs and (inside**2).sum() <= 2500
    assert len(bins) == len(x) and set(bins.tolist()) == set(range(bins.max() + 1))


def _scan(lengths, capacity, max_docs, max_cost, rule):
    """Vector best-fit that looks at every container."""
    w = np.asarray(packing.WEIGHTS) / np.array([capacity, max_docs, max_cost], float) ** 2
    left, out = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        x = lengths[i]
        need = np.array([x, 1, x * x])
        fits = [(w @ (r - need) ** 2 if rule == "norm" else -(w @ (r * need)), k) for k, r in enumerate(left) if (r >= need).all()]
        k = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(np.array([capacity, max_docs, max_cost], float))
        left[k] = left[k] - need
        out[i] = k
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_indexed_best_fit_is_that_of_all_containers(rule):
    rng = np.random.default_rng(4)
    for _ in range(40):
        x = rng.integers(1, 64, rng.integers(1, 150)).astype(float)
        caps = (64, int(rng.integers(2, 20)), float(rng.integers(64 * 64, 2 * 64 * 64)))
        a, b = packing.vector_best_fit(x, *caps, rule).tolist(), _scan(x, *caps, rule)
        assert sum(p == q for p, q in zip(a, b, strict=True)) >= len(x) - (0 if rule == "norm" else 2)  # sums in another order may tie otherwise


def test_every_shard_has_a_task(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("n_tokens"))
    parts = packing.pack(df, 64, shard_items=500).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.shard for r in parts}) == 8 and len({r.p for r in parts}) >= 5 and len(parts) == 8


def test_pack_splits_only_what_must_be(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 5, 30, 64, 65, 300, 7])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    out = packing.pack(df, 64, shard_items=100).collect()
    size = dict(rows)
    parts = defaultdict(list)
    for r in out:
        parts[r.doc_id].append((r.piece, r.start, r.end))
        assert r.n_pieces == max(1, -(-(size[r.doc_id] or 0) // 64))
    for k, v in parts.items():
        v.sort()
        assert v[0][1] == 0 and v[-1][2] == (size[k] or 0) and all(a[2] == b[1] for a, b in zip(v, v[1:]))
    assert set(parts) == set(size)
    held = Counter((r.shard, r.bin) for r in packing.pack(df, 64, max_docs=3, shard_items=100).collect())
    assert max(held.values()) <= 3
    used = Counter()
    for r in out:
        used[r.shard, r.bin] += r.end - r.start
    assert max(used.values()) <= 64 and sum(used.values()) / (64 * len(used)) > 0.9
    assert packing.pack(df.filter("false"), 64).count() == 0


# --- problem 2


def test_controlled_rounding_keeps_margins():
    rng = random.Random(5)
    for _ in range(80):
        rows, cols = rng.randint(1, 5), rng.randint(1, 6)
        sizes = [rng.randint(0, 40) for _ in range(cols)]
        belongs = [sorted(rng.sample(range(cols), rng.randint(1, cols))) for _ in range(rows)]
        totals = quotas.feasible([rng.randint(0, 3) for _ in range(rows)], [rng.randint(0, 30) for _ in range(rows)], belongs, sizes)
        f = quotas.spread(totals, belongs, sizes)
        g = quotas.controlled_rounding(f, sizes)
        for i in range(rows):
            assert sum(g[i]) == sum(f[i])
            assert all(abs(g[i][j] - f[i][j]) < 1 for j in range(cols))
        for j in range(cols):
            c = sum(f[i][j] for i in range(rows))
            assert abs(sum(g[i][j] for i in range(rows)) - c) < 1 and sum(g[i][j] for i in range(rows)) <= sizes[j]
    assert quotas.controlled_rounding([[Fraction(1, 2), Fraction(1, 2)]], [1, 1]) in ([[1, 0]], [[0, 1]])


def test_both_margins_are_kept():
    rng = random.Random(8)
    for _ in range(60):
        names = [(a, b) for a in "abc" for b in "xyz" if rng.random() < 0.8] or [("a", "x")]
        sizes = [rng.randint(1, 60) for _ in names]
        belongs = [[j for j, (a, _) in enumerate(names) if a == f] for f in "abc"]  # whole families
        totals = quotas.feasible([0] * 3, [rng.randint(0, 40) for _ in range(3)], belongs, sizes)
        f = quotas.spread(totals, belongs, sizes)
        g = quotas.rounded(f, names, belongs, sizes)
        assert [sum(r) for r in g] == totals
        for pick in (0, 1):
            for v in {n[pick] for n in names}:
                inside = [j for j, n in enumerate(names) if n[pick] == v]
                want = sum(r[j] for r in f for j in inside)
                assert abs(sum(r[j] for r in g for j in inside) - want) < 1
        assert all(sum(r[j] for r in g) <= n for j, n in enumerate(sizes))


def test_overlapping_strata_share_by_flow(spark):
    target = lambda i, fam, form, share, least=0: {"plan_id": 1, "stratum_id": i, "family": fam, "form": form, "share_permille": share, "min_rows": least, "rate_permille": 1000}
    counts = {("a", "x"): 10, ("*", "*"): 10}
    quota, report = quotas.allocate(counts, [target(1, "a", None, 500), target(2, None, "x", 500)])
    assert [r[2:4] for r in report] == [(10, 10)] * 2 and sorted(r[4] for r in report) == [5, 5] and all(r[6] and not r[5] for r in report) and quota == [(1, "a", "x", 10)]
    # a stratum that can go elsewhere does, whatever the order
    counts = {("a", "x"): 10, ("a", "y"): 10}
    quota, report = quotas.allocate(counts, [target(1, "a", None, 500), target(2, None, "x", 500)])
    assert [r[4] for r in report] == [10, 10] and not any(r[6] for r in report) and sum(q[3] for q in quota) == 20
    assert quotas.allocate({}, [target(1, "a", None, 500, 2)]) == ([], [(1, 1, 2, 0, 0, True, True)])


def test_sample_is_exact_and_stable(spark):
    rows = [(i, ["Judicial", "JUDICIAL ", "policy", None, ""][i % 5], ["Order", "order.", "x"][i % 3]) for i in range(3000)] + [(1, "judicial", "order"), (None, "policy", "x")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, family string, form string")
    targets = spark.createDataFrame(
        [(1, 1, "JUDICIAL", None, 600, 5, 100), (1, 2, "Policy", "Order", 400, 5, 100), (2, 3, None, "X", 1000, 0, 50), (2, 4, "none such", None, 0, 3, 50)],
        "plan_id bigint, stratum_id bigint, family string, form string, share_permille bigint, min_rows bigint, rate_permille bigint",
    )
    a, b = quotas.sample(corpus, targets).collect(), quotas.sample(corpus.repartition(7), targets).collect()
    assert sorted(a) == sorted(b) and Counter(r.plan_id for r in a) == {1: 300, 2: 150}
    assert len({(r.plan_id, r.doc_id) for r in a}) == 450 and Counter(r.family for r in a if r.plan_id == 1) == {"judicial": 180, "policy": 120}
    report = {r.stratum_id: r for r in quotas.quota_tables(corpus, targets)[2].collect()}
    assert report[4].unmet and report[4].unfilled and report[4].fillable == 0 and report[4].needed == 3 and not report[1].unmet
    assert quotas.sample(corpus.filter("false"), targets).count() == 0


# --- problem 3


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n,!。 \r", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_the_text(text, limit, overlap):
    p = splitting.pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(b - a <= limit for a, b in p)
    assert all(y[0] == max(0, x[1] - overlap) and y[1] > x[1] for x, y in zip(p, p[1:]))


def test_pieces_cut_at_the_strongest_boundary():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    assert [text[a:b] for a, b in splitting.pieces(text, 40, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven."]
    assert [b - a for a, b in splitting.pieces("x" * 25, 10, 2)] == [10, 10, 9] or sum(b - a for a, b in splitting.pieces("x" * 25, 10, 2)) >= 25


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcde .\n,!。 \r", max_size=300), st.integers(8, 40), st.integers(0, 7))
def test_boundaries_are_those_of_the_text(text, limit, overlap):
    import re

    found, longest = splitting.cut(text, limit, overlap)
    if len(text) > limit:
        runs = max(map(len, re.split(rf"[\s{re.escape(splitting.MARKS)}]", text)))
        assert (longest > limit) == (runs > limit) and (longest == runs or runs <= limit - overlap)
    for _, b, s in found[:-1]:
        divides = re.match(rf"[\s{re.escape(splitting.MARKS)}]", text[b - 1])
        assert not divides if s == splitting.FORCED else divides or text[b - 1] == ","


def test_words_within_the_limit_may_be_forced():
    text = " ".join(c * 90 for c in "abcd")
    found, longest = splitting.cut(text, 100, 20)
    assert longest == 90 and any(s == splitting.FORCED for _, _, s in found) and all(b - a <= 100 for a, b, _ in found)


def test_split_rows(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "word " * 30, "c"), (4, "x" * 90, "c"), (4, "x" * 90, "c")], "doc_id bigint, text string, cut string")
    got = splitting.split(df, "doc_id", "text", 40, 5).collect()
    assert {(r.item_id, r.cut) for r in got} == {(3, "natural"), (4, "forced")} and all(len(r.text) <= 40 for r in got)


# --- problem 4


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Mr. A. Smith paid 3.5 crowns, cf. pp. 4–5, i.e. all. He left at 9.30 a.m. on Monday.", ["Mr. A. Smith paid 3.5 crowns, cf. pp. 4–5, i.e. all.", "He left at 9.30 a.m. on Monday."]),
        ("He said “it is late. Go home.” before noon. Then (see No. 4. and others) it ended.", ["He said “it is late. Go home.” before noon.", "Then (see No. 4. and others) it ended."]),
        ("She asked: “Who paid?” The court rose.", ["She asked: “Who paid?”", "The court rose."]),
        ("Legal context\n\n1. First point. Second point.\n2. Third.", ["Legal context", "1. First point.", "Second point.", "2. Third."]),
        ("It covers:\n(a) one thing;\n(b) another.", ["It covers:", "(a) one thing;", "(b) another."]),
        ("| a | b |\n| c | d |", ["| a | b |", "| c | d |"]),
        ("第1条は有効だ。「行くか？」と彼は尋ねた。終わり！次", ["第1条は有効だ。", "「行くか？」と彼は尋ねた。", "終わり！", "次"]),
        ("委员会（见第7页。）同意。他说：“好。”下一句。", ["委员会（见第7页。）同意。", "他说：“好。”", "下一句。"]),
        ("ठीक है। डॉ. राम गए| फिर आए।", ["ठीक है।", "डॉ. राम गए|", "फिर आए।"]),
        ("Είναι δωρεάν; Ναι, π.χ. εδώ· τέλος.", ["Είναι δωρεάν;", "Ναι, π.χ. εδώ· τέλος."]),
        ("หนึ่งสอง สามสี่ห้า “หก เจ็ด” ต่อหน้าศาล", ["หนึ่งสอง", "สามสี่ห้า “หก เจ็ด” ต่อหน้าศาล"]),
        ("Das Gericht tagte am 5. Mai vor der 9. Kammer. Es gilt z. B. Nr. 4 usw. Danach Ende.", ["Das Gericht tagte am 5. Mai vor der 9. Kammer.", "Es gilt z. B. Nr. 4 usw.", "Danach Ende."]),
        ("Lodged in Novburg.The next one", ["Lodged in Novburg.", "The next one"]),
        ("1. One\n   goes On here\n   a) Inner\n      text Of inner\n   b) Second\n2. Two", ["1. One\n   goes On here", "a) Inner\n      text Of inner", "b) Second", "2. Two"]),
        ("- Outer\n  - Inner\nAfter the list", ["- Outer", "- Inner", "After the list"]),
        ("It is “open. And on. Then “said. So” he. " + "Word goes. " * 200 + "Now “told. So” he.", ["It is “open.", "And on.", "Then “said. So” he."] + ["Word goes."] * 200 + ["Now “told. So” he."]),
        ("He “" + "said. So. " * 300 + "It” was.", ["He “" + "said. So. " * 300 + "It” was."]),
        ("See (the “first) part. It ended.", ["See (the “first) part.", "It ended."]),
        ("by Zim Yoodl! Group in 1990! See https://a.example/x.html now.", ["by Zim Yoodl! Group in 1990!", "See https://a.example/x.html now."]),
    ],
)
def test_sentences(text, parts):
    ends = sentences.boundaries(text)
    at, got = 0, []
    for e in ends:
        got.append(text[at:e].strip())
        at = e
    assert got == parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?“”()\n。、「」।|;;ก ", max_size=120))
def test_sentence_ends_are_sane(text):
    ends = sentences.boundaries(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) and not text[e - 1].isspace() for e in ends)
    assert (ends[-1] == len(text.rstrip())) if text.strip() else ends == []


def test_wrapped_lines_run_on():
    text = "The advisory committee found on 4 May 1990 that the\nprotected work of Dr.\nSmith had been copied in the course of a sale by\nthe society. It left.\nThe next paragraph begins on this line and goes on\nto its end here."
    assert len(sentences.boundaries(text)) == 3


def test_wrapped_lines_are_told_by_what_they_explain():
    import textwrap

    words = "The committee noted that No body had Asked for the Office of Records to act in May and so It did not".split()
    for width in (30, 75, 160, 260):
        rng = random.Random(width)
        body = " ".join(rng.choice(words) for _ in range(width * 2))
        wrapped = textwrap.fill(body, width, break_long_words=False)
        assert sentences._Layout(wrapped).width and sentences.boundaries(wrapped) == [len(wrapped)]
        address = "https://a.example/" + "x" * 300
        assert sentences._Layout(f"{address}\n{wrapped}\n{address}").width
        lines = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(20))
        assert not sentences._Layout(lines).width
    assert not sentences._Layout("one\ntwo").width and not sentences._Layout("").width


def test_sentences_are_those_of_p4_found(spark, tmp_path):
    rows = [(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, ""), (None, "E f."), (None, "E f."), (4, "X y."), (4, "Z. Q r s."), (5, "Ok. " * 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(f"{tmp_path}/corpus_clean.parquet")
    got = sorted((r.doc_id or 0, r.sentence_no, r.end_pos, r.sentence) for r in sentences.p4_sentences(spark, str(tmp_path)).collect())
    found = sorted((r.doc_id or 0, r.end_pos) for r in sentences.p4_found(spark, str(tmp_path)).collect())
    assert [(k, e) for k, _, e, _ in got] == found and len(got) == len(set(got))
    assert [x[3] for x in got if x[0] == 1] == ["A b.", "C d."] and {x[0] for x in got} == {0, 1, 4, 5}


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "A b. C d."), (4, "A b. C d.")], "doc_id bigint, text string")
    got = Counter((r.doc_id, tuple(r.ends)) for r in sentences.sentence_ends(df).collect())
    assert got == {(1, ()): 1, (2, ()): 1, (3, ()): 1, (4, (4, 9)): 2}


# --- problem 5


def _jaccard(a, b):
    x, y = ({s[i : i + 20] for i in range(len(s) - 19)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(80, 160))]
        for edits in (0, 1, 4, 8, 14, 30):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((k, "Title " + str(k % 3) if k % 4 else None, " ".join(w), "x"))
            k += 1
    rows += [(k, rows[0][1], rows[0][2], "x"), (k + 1, rows[1][1], rows[1][2].upper() + "  \n", "x"), (k + 2, "t", None, "x"), (k + 3, "t", "", "x"), rows[5]]
    df = spark.createDataFrame(rows, "doc_id bigint, title string, text string, copy string")
    texts = {i: neardup.content(t, x) for i, t, x, _ in rows if x and len(x) >= 400}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if _jaccard(texts[a], texts[b]) >= 0.6}
    got = [(r.doc_id_a, r.doc_id_b) for r in neardup.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.01 * len(want)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    classes = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert classes == {i: root(i) for i in texts}
    assert neardup.pairs(df.filter("false")).count() == 0


def test_hot_group_of_copies_stays_linear(spark):
    text = " ".join(f"word{i}" for i in range(120))
    df = spark.createDataFrame([(i, "t", text) for i in range(300)] + [(999, "t", text + " more")], "doc_id bigint, title string, text string")
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.pairs(df).collect()}
    assert got == {(0, i) for i in range(1, 300)} | {(i, 999) for i in range(300)}


def test_copies_of_linked_texts_stay_linear(spark):
    text = " ".join(f"word{i}" for i in range(120))
    df = spark.createDataFrame([(i, "t", text) for i in range(50)] + [(100 + i, "t", text + " more") for i in range(40)], "doc_id bigint, title string, text string")
    got = [(r.doc_id_a, r.doc_id_b) for r in neardup.pairs(df).collect()]
    assert len(got) == len(set(got)) == 49 + 39 + 50 + 39
    assert {(0, 100)} | {(i, 100) for i in range(50)} | {(0, 100 + i) for i in range(40)} <= set(got)
    assert {(r.doc_id, r.class_id, r.class_size) for r in neardup.classes(df).collect()} == {(k, 0, 90) for k in [*range(50), *range(100, 140)]}


def test_classes_of_similar_texts_compare_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    n = 400
    rows = [(i, None, " ".join(base[:80] + [f"x{i}y{j}" for j in range(6)])) for i in range(n)]  # all similar to one another
    rows += [(n + i, None, " ".join(f"z{rng.randrange(10**9)}" for _ in range(80))) for i in range(20)]
    compared = []
    plain = neardup.Search.verified
    monkeypatch.setattr(neardup.Search, "verified", lambda self, c: (compared.append(c.count()), plain(self, c))[1])
    df = spark.createDataFrame(rows, "doc_id bigint, title string, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == {i: 0 if i < n else i for i in range(n + 20)}
    assert sum(compared) < 20 * n < n * (n - 1) // 2


@pytest.mark.parametrize("similarity", [0.6, 0.65, 0.7])
def test_recall_of_signatures(similarity):
    rng = np.random.default_rng(1)
    n, size = 4000, 600
    common = int(2 * similarity * size / (1 + similarity))
    lost = 0
    for _ in range(n // 20):
        cells, sizes = [], []
        for _ in range(20):
            shared = rng.integers(0, 2**63, common, dtype=np.uint64) * np.uint64(2)
            for _ in range(2):
                cells.append(neardup.sketch(np.unique(np.append(shared, rng.integers(0, 2**63, size - common, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))))
                sizes.append(size)
        at, sig = neardup.signatures(np.array(cells), np.array(sizes), 0.6)
        of = defaultdict(set)
        for r, x in zip(at.tolist(), sig.tolist(), strict=True):
            of[r].add(x)
        lost += sum(not of[2 * i] & of[2 * i + 1] for i in range(20))
    assert lost <= {0.6: 20, 0.65: 8, 0.7: 2}[similarity]  # 0.2 %, 0.04 % and 0.002 % expected of 4,000


# --- problem 1


ROWS = [
    (1, "What did Mr Voss list?", None, ["Voss listed a map."], "empty"),
    (2, "What did Mr Voss list?", " ​", None, "empty"),
    (3, "What did Mr Voss list?", "[no answer]", [], "empty"),
    (4, "Is a fee due to Voss?", "No", [None], None),
    (5, "What does the tariff say about it?", "nothing", None, None),
    (6, "Who paid the fee to Voss?", "I'm sorry, but I can't help with that request. Please consult a lawyer.", None, "refusal"),
    (7, "Why did the court decline to rule?", "The court declined to rule because Voss was unable to produce the file.", None, None),
    (8, "Who paid the fee to Voss in 1990?", "> who  paid the fee to Vsos in 1990", None, "copies_question"),
    (9, "Who paid the fee to Voss in 1990?", "Who paid the fee to Voss in 1990? The society paid the fee.", None, None),
    (10, "Who paid the fee to the society?", "Das Gericht verwarf die Klage, weil die Gesellschaft nicht beteiligt war.", None, "other_language"),
    (11, "Give the German wording of the clause, in German.", "Die Abgabe wurde auf zwei Kronen festgesetzt und ist nicht bezahlt.", None, None),
    (12, "契約は何か月後に終了したか？", "27か月", None, None),
    (13, "Who paid the fee to the society?", "The court settled the dispute between the parties in the cou", ["The court settled the dispute between the parties in the county."], "truncated"),
    (14, "Who paid the fee to the society?", "The court settled the dispute in", None, "truncated"),
    (15, None, "The court ruled.", None, None),
]


def test_defects(spark):
    df = spark.createDataFrame([r[:4] + (0,) for r in ROWS] + [ROWS[0][:4] + (0,)], "qa_id bigint, user_input string, reference string, reference_contexts array<string>, defect int")
    got = {r.qa_id: r.defect for r in pairs.defects(df).collect()}
    assert got == {r[0]: r[4] for r in ROWS if r[4]}
    assert pairs.defects(df.filter("false")).count() == 0


def test_all_pairs_are_counted(spark):
    n = 12_500  # one word only in the pair that hashes last
    ids = spark.range(n).orderBy(F.xxhash64("id"), "id").collect()
    rare = ids[-1].id
    rows = [(i, "What did the court do?", "The court held that the zoning stands." if i != rare else "The court held that the zonula stands.", None) for i in range(n)]
    df = spark.createDataFrame(rows, "qa_id bigint, user_input string, reference string, reference_contexts array<string>")
    pairs_ = pairs.distinct_pairs(df.union(df.limit(100)))
    words = {(r.lang, r.word): r.n for r in pairs.word_counts(pairs_).collect()}
    assert words["", "zonula"] == words["en", "zonula"] == 1 and words["", "stands"] == n
    whole = pairs.Model(r[1:] for r in rows)
    packed = spark.sparkContext.broadcast(pickle.dumps(pairs.fit(pairs_)))
    counts = {r.key: (r.ends, r.inner) for r in pairs.context_counts(pairs_, packed).groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("inner").alias("inner")).collect()}
    every: Counter = Counter(x for r in rows for x in whole.contexts(r[2]))
    assert counts == {pairs.key_hash(k): (every[k, True], every[k, False]) for k, _ in every}
    assert whole.endings.items() <= {pairs.SEP.join(k): counts[pairs.key_hash(k)] for k, _ in every}.items()
    assert whole.endings["stands"] == (n, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab AB.?,0 終。<^*", max_size=40), max_size=6))
def test_contexts_in_arrays_are_those_told_one_by_one(texts):
    m = pairs.Model()
    want: Counter = Counter(x for t in texts for x in m.contexts(t))
    keys, ends, inner = pairs.hashed_contexts([m.tokens(pairs.visible(t)) for t in texts], {})
    got = {int(k): (int(e), int(i)) for k, e, i in zip(keys.view(np.int64), ends, inner, strict=True)}
    assert got == {pairs.key_hash(k): (want[k, True], want[k, False]) for k, _ in want}


def test_cut_thai_answers():
    shown = "ศาลตัดสินว่าสัญญาเช่าฉบับนี้สิ้นสุดลงแล้ว ผู้เช่าต้องคืนสำเนาทั้งหมดภายในสามสิบวัน"
    whole, cut = shown.split(" ")[0], shown[: shown.index("สิ้นสุด") + 4]
    m, q = pairs.Model(), "ศาลตัดสินว่าอย่างไร"
    assert m.truncated(q, cut, [shown]) and m.truncated(q, whole + " (ตามมาตรา", None) and m.truncated(q, whole + ",", None)
    assert not m.truncated(q, whole, [shown]) and not m.truncated(q, shown, [shown]) and not m.truncated(q, whole, None)


def test_novelty_of_copies():
    q = "Within how many days must the society delete every copy of the map under No. 948/1986?"
    assert pairs.novelty(q, q) < 0.1 < 0.8 < pairs.novelty(q, "Das Gericht verwarf die Klage von Voss, weil niemand beteiligt war.")


# --- problem 8


def test_levels_of_held_out_passages(sf):
    r = pq.read_table(f"{sf}/reading_reference.parquet").to_pylist()
    right = 0
    for f in range(4):
        m = reading.Model((x["text"], x["level"]) for i, x in enumerate(r) if i // 4 % 4 != f)
        right += sum(m.level(x["text"])[0] == x["level"] for i, x in enumerate(r) if i // 4 % 4 == f)
    assert right >= 0.9 * len(r)


def test_levels_rows(spark, sf):
    m = reading.fit(spark.read.parquet(f"{sf}/reading_reference.parquet"))
    easy, code = "We like the red map. You can sing at the zoo. " * 10, "x = y[3] + 4;\n" * 60
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, easy, 9), (3, easy, 9), (4, "Das Gericht verwarf die Klage von Voss. " * 20, 9), (5, code, 9), (6, "We like it.", 9)], "doc_id bigint, text string, level int")
    assert sorted((r.doc_id, r.level) for r in reading.levels(df, m).collect()) == [(3, 1), (3, 1)]
    assert np.all(np.diff(m.levels) > 0) and np.all(np.diff(m.knots) > 0)
    assert reading.Model([]).level("some text here")[0] == 1


def test_pairs_of_levels():
    y = np.array([2.0, 1.0, 3.0, 1.0])
    harder, easier = reading._pairs(y, 99)
    assert sorted(zip(harder.tolist(), easier.tolist())) == [(0, 1), (0, 3), (2, 0), (2, 1), (2, 3)]
    some = reading._pairs(np.repeat([1.0, 2.0], 500), 1000)
    assert len(some[0]) == 1000 and (some[0] >= 500).all() and (some[1] < 500).all()
    assert not len(reading._pairs(np.zeros(0), 9)[0]) and not len(reading._pairs(np.ones(3), 9)[0])


def test_every_document_has_a_level(spark, sf):
    m = reading.fit(spark.read.parquet(f"{sf}/reading_reference.parquet"))
    easy = "We like the red map. You can sing at the zoo. "
    rows = [(1, None), (2, ""), (3, " \n"), (4, easy * 10), (5, easy), (6, "Das Gericht verwarf die Klage von Voss. " * 20), (7, "x = y[3] + 4;\n" * 60), (8, "12 34\n" * 90), (4, easy * 10)]
    got = {r.doc_id: (r.level, r.basis) for r in reading.levels(spark.createDataFrame(rows, "doc_id bigint, text string"), m, every=True).collect()}
    assert {k: b for k, (_, b) in got.items()} == {1: "empty", 2: "empty", 3: "empty", 4: "prose", 5: "short", 6: "other", 7: "other", 8: "empty"}
    assert all((level is None) == (b == "empty") for level, b in got.values()) and got[4][0] == got[5][0] == 1
    assert reading.levels(spark.createDataFrame(rows, "doc_id bigint, text string"), m, every=True).count() == len(rows)


# --- queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    if name in queries.SQL:
        assert oracle.compare(spark, oracle.connect(sf), name, queries.QUERIES[name], queries.SQL[name], sf) == ""
    else:
        df = queries.QUERIES[name](spark, sf)
        assert df.count() == df.distinct().count()

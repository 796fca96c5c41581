"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, neardup, packing, pairs, quotas, reading, sentences, splitting

QUERIES = {
    "p1_found": pairs.p1_found,
    "p2_found": quotas.p2_found,
    "p2_report": quotas.p2_report,
    "p2_sample": quotas.p2_sample,
    "p2_counts": quotas.p2_counts,
    "p3_found": splitting.p3_found,
    "p3_pieces": splitting.p3_pieces,
    "p4_found": sentences.p4_found,
    "p4_sentences": sentences.p4_sentences,
    "p5_found": neardup.p5_found,
    "p5_classes": neardup.p5_classes,
    "p6_ids": bpe.p6_ids,
    "p7_found": packing.p7_found,
    "p7_bins": packing.p7_bins,
    "p7_fill": packing.p7_fill,
    "p8_found": reading.p8_found,
    "p8_levels": reading.p8_levels,
    "p8_profile": reading.p8_profile,
}

_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}]', '', 'g')"

_RUN = "[^\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}.!?…。！？؟।；]+"

# strata of one plan do not overlap in sample_targets; where they do, the allotment is a flow, which tests check
_REPORT = f"""
        WITH c AS (SELECT doc_id, min(coalesce({_LETTERS.format("family")}, '')) AS fam, min(coalesce({_LETTERS.format("form")}, '')) AS form
                   FROM corpus_clean WHERE doc_id IS NOT NULL GROUP BY doc_id),
             t AS (SELECT plan_id, stratum_id, {_LETTERS.format("family")} AS fam, {_LETTERS.format("form")} AS form, min_rows, n * rate_permille // 1000 AS size, share_permille
                   FROM sample_targets, (SELECT count(*) AS n FROM c)),
             a AS (SELECT plan_id, stratum_id, size, size * share_permille AS share, greatest(min_rows, size * share_permille // 1000) AS needed,
                          CASE WHEN size * share_permille // 1000 >= min_rows THEN size * share_permille % 1000 ELSE 0 END AS rest,
                          (SELECT count(*) FROM c WHERE (t.fam IS NULL OR t.fam = c.fam) AND (t.form IS NULL OR t.form = c.form)) AS available FROM t),
             o AS (SELECT plan_id, least(max(size), sum(share) // 1000) - sum(needed) AS over FROM a GROUP BY plan_id),
             r AS (SELECT *, CASE WHEN rest > 0 AND available > needed THEN count(*) FILTER (rest > 0 AND available > needed) OVER (PARTITION BY plan_id ORDER BY rest DESC, stratum_id) END AS turn FROM a JOIN o USING (plan_id)),
             report AS (SELECT plan_id, stratum_id, needed, least(needed, available) AS fillable, least(needed, available) + CASE WHEN turn <= over THEN 1 ELSE 0 END AS allotted, available < needed AS unfilled FROM r)"""

SQL = {
    "p2_report": f"{_REPORT} SELECT *, allotted < needed AS unmet FROM report",
    "p2_counts": f"{_REPORT} SELECT plan_id, CAST(sum(allotted) AS BIGINT) AS n, CAST(sum(allotted) AS BIGINT) AS documents FROM report GROUP BY plan_id HAVING sum(allotted) > 0",
    "p3_found": " UNION ".join(
        f"SELECT '{t}.{x}' AS item_field, {k} AS item_id, CASE WHEN list_max(list_transform(regexp_extract_all({x}, '{_RUN}'), lambda r: length(r))) > max_chars THEN 'forced' ELSE 'natural' END AS cut FROM {t}, size_limits WHERE item_field = '{t}.{x}' AND length({x}) > max_chars"
        for t, k, x in (("corpus_clean", "doc_id", "text"), ("chunks", "chunk_id", "page_content"), ("chunks", "chunk_id", "parent_text"))
    ),
    "p2_found": f"""
        WITH c AS (SELECT doc_id, min(coalesce({_LETTERS.format("family")}, '')) AS fam, min(coalesce({_LETTERS.format("form")}, '')) AS form
                   FROM corpus_clean WHERE doc_id IS NOT NULL GROUP BY doc_id),
             n AS (SELECT count(*) AS n FROM c),
             t AS (SELECT plan_id, stratum_id, {_LETTERS.format("family")} AS fam, {_LETTERS.format("form")} AS form,
                          greatest(min_rows, ((n.n * rate_permille) // 1000) * share_permille // 1000) AS needed
                   FROM sample_targets, n)
        SELECT t.plan_id, t.stratum_id
        FROM t LEFT JOIN c ON (t.fam IS NULL OR t.fam = c.fam) AND (t.form IS NULL OR t.form = c.form)
        GROUP BY t.plan_id, t.stratum_id, t.needed HAVING count(c.doc_id) < t.needed""",
}

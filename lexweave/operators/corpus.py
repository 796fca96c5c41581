"""Ingest, select, sample and count documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settle

# Defaults of the corpus selection.
KEYWORDS = ["copyright", "related right", "neighbouring right", "computer program", "software"]
FORMS = [
    "Judgment",
    "Opinion of the Advocate General",
    "Order",
    "Abstract",
    "Directive",
    "Consolidated text",
    "Decision",
    "Regulation",
    "Communication",
    "Impact assessment",
    "Green Paper",
    "Opinion",
    "Written question",
    "Proposal for a directive",
    "Proposal for a regulation",
    "Amended proposal for a directive",
]
# Forms that the filter scenarios keep besides.
SCENARIO_FORMS = [*FORMS, "Legislative acts", "Proposal for an act", "Proposal for a decision without addressee", "Information note"]
MIN_WORDS = 300
FAMILIES = ["JUDICIAL", "LEGISLATIVE", "POLICY", "OTHER"]
# Word-count strata (from, below; null = no bound) and how many documents each gives.
STRATA = [(300, 1000, 10), (1000, 5000, 25), (5000, 20000, 25), (20000, None, 15)]
# Subject topics and their title keywords.
TOPICS = {
    "trade mark": ["trade mark", "trademark"],
    "geographical indication": ["geographical indication", "appellation of origin", "protected designation"],
    "copyright": ["copyright", "related right", "neighbouring right", "computer program", "software"],
    "patent": ["patent"],
    "design (industrial)": ["community design", "industrial design", "registered design"],
    "plant variety": ["plant variety", "plant breeders"],
    "database right": ["database", "sui generis"],
    "trade secret": ["trade secret", "know-how"],
    "counterfeiting/piracy": ["counterfeit", "piracy", "pirated"],
    "parallel import": ["parallel import", "exhaustion"],
}


def latest(df: DataFrame, key: str = "doc_id", at: str = "ingested_at") -> DataFrame:
    """One row for each key, of the last delivery. Null keys are one key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at)).alias("r")).select(key, "r.*")


def clean_documents(raw: DataFrame) -> DataFrame:
    """Raw ``(content, metadata, file_pos)`` to clean documents, numbered from 0 without gaps in file order."""
    m = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(""))
    out = raw.select(
        "file_pos",
        m("celex").alias("celex"),
        F.replace(m("title"), F.lit("\u00a0"), F.lit(" ")).alias("title"),
        m("form").alias("form"),
        T.family(m("celex"), m("form")).alias("family"),
        m("author").alias("author"),
        T.date_part(m("date")).alias("date"),
        T.date_kind(m("date")).alias("date_type"),
        m("latest").alias("latest"),
        m("pages").alias("pages"),
        m("source").alias("url"),
        T.clean(F.coalesce("content", F.lit(""))).alias("text"),
    )
    return number_rows(out, "file_pos")


def number_rows(df: DataFrame, order: str, name: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """Numbers rows from 0 without gaps in the order of ``order`` (distinct values).

    Rows are range-partitioned and sorted within their partition, once: range
    bounds are sampled, so a second execution could draw others. The written
    table keeps each row's partition and place in it; counts come from that
    table too. One shuffle; no task sees all rows; the driver holds one count
    for each partition. Null order comes first; an empty table gives no row.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    rows = settle(placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before, start = [], 0
    for r in counts:
        before.append((r["_part"], start))
        start += r["n"]
    offsets = spark.createDataFrame(before, "_part bigint, _before bigint")  # one row for each partition
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before", order)


def select_documents(df: DataFrame, keywords: list[str] = KEYWORDS, forms: list[str] = FORMS, min_words: int = MIN_WORDS, words: str | None = None) -> DataFrame:
    """Rows whose title names a keyword, whose form is listed and whose text is long enough; rows pass unchanged.

    ``words``: a column that has the word count already; else it is taken from ``text``.
    """
    return df.filter(T.contains_any(F.col("title"), keywords) & F.col("form").isin(forms) & (_words(words) >= min_words))


def _words(column: str | None) -> Column:
    return F.col(column) if column else T.word_count(F.col("text"))


def stratum(words: Column, strata: list[tuple] = STRATA) -> Column:
    """Number of the first stratum ``low <= words < high``; a null or zero ``high`` is no bound."""
    out = F.lit(None).cast("int")
    for i, (low, high, _) in reversed(list(enumerate(strata))):
        inside = words >= low if not high else (words >= low) & (words < high)
        out = F.when(inside, i).otherwise(out)
    return out


def take_by_key(df: DataFrame, groups: list[str], quota: Column, key: str, most: int, seed: int = 42) -> DataFrame:
    """Exactly the quota of each group (or all of it), least ``md5(seed, key)`` first: the same rows at any partitioning.

    ``most`` is the largest quota. As a literal bound it makes every task keep
    no more than so many rows of a group before the shuffle, so that a group of
    any size arrives as ``tasks x most`` rows.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = W.partitionBy(*groups).orderBy(order, key)
    return df.withColumn("pick", F.row_number().over(w)).filter((F.col("pick") <= most) & (F.col("pick") <= quota))


def stratified_sample(df: DataFrame, strata: list[tuple] = STRATA, seed: int = 42, words: str | None = None) -> DataFrame:
    """``n`` documents of each word-count stratum, or all where it has fewer."""
    staged = df.withColumn("stratum", stratum(_words(words), strata)).filter("stratum is not null")
    quota = F.element_at(F.array(*[F.lit(n) for *_, n in strata]), F.col("stratum") + 1)
    return take_by_key(staged, ["stratum"], quota, "doc_id", max(n for *_, n in strata), seed)


def stratum_report(df: DataFrame, strata: list[tuple] = STRATA, words: str | None = None) -> DataFrame:
    """Pool and sample size of each stratum, empty ones too."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(i, n) for i, (_, _, n) in enumerate(strata)], "stratum int, n int")
    counts = df.select(stratum(_words(words), strata).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("pool"))
    pool = F.coalesce("pool", F.lit(0))
    return domain.join(counts, "stratum", "left").select("stratum", pool.alias("pool"), F.least(pool, "n").alias("sampled"))


def subtopics(df: DataFrame, topics: dict[str, list[str]] = TOPICS, families: list[str] = FAMILIES) -> DataFrame:
    """Documents of each topic in all and by family; one may have several. One pass, one row out of each task."""
    title = F.col("title")
    hits = df.select("family", *[T.contains_any(title, k).alias(f"t{i}") for i, k in enumerate(topics.values())])
    stats = [F.count_if(f"t{i}").alias(f"t{i}_total") for i in range(len(topics))]
    stats += [F.count_if(F.expr(f"t{i} and family = '{f}'")).alias(f"t{i}_{f}") for i in range(len(topics)) for f in families]
    one = hits.agg(F.count(F.lit(1)).alias("n"), *stats)
    rows = [F.struct(F.lit(t).alias("topic"), F.col(f"t{i}_total").alias("total"), *[F.col(f"t{i}_{f}").alias(f) for f in families], F.round(F.col(f"t{i}_total") / F.col("n") * 100, 1).alias("percent")) for i, t in enumerate(topics)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def filter_scenarios(df: DataFrame, forms: list[str] = SCENARIO_FORMS, families: list[str] = FAMILIES, words: str | None = None) -> DataFrame:
    """What six filters would keep, in all and by family; one pass."""
    listed, w = F.col("form").isin(forms), F.col("words")
    named = {
        "no filter": F.lit(True),
        "forms": listed,
        "forms, 100 words": listed & (w >= 100),
        "forms, 200 words": listed & (w >= 200),
        "forms, 300 words": listed & (w >= 300),
        "forms, 300 to 20000 words": listed & w.between(300, 20000),
    }
    rows = df.select("family", "form", _words(words).alias("words"))
    stats = [F.count_if(c if f is None else c & (F.col("family") == f)).alias(f"s{i}_{f}") for i, c in enumerate(named.values()) for f in (None, *families)]
    one = rows.agg(*stats)
    out = [F.struct(F.lit(k).alias("scenario"), F.col(f"s{i}_None").alias("total"), *[F.col(f"s{i}_{f}").alias(f) for f in families]) for i, k in enumerate(named)]
    return one.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows of each value and their share in percent; null is a value."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all_rows")))).select(c, "n", F.round(F.col("n") / F.col("all_rows") * 100, 2).alias("percent"))


def crosstab(df: DataFrame, row: str, column: str, domain: list[str]) -> DataFrame:
    """Rows of each pair of values; columns are a fixed domain, 0 where nothing is."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

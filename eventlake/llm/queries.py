"""Registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import ann, cuckoo, decontam, mixing, orderhash, phrases, pii, quality, runs, secrets, suffixes, toxicity, warc
from eventlake.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# score from which a document counts as good
QUALITY_CUT = 0.3


def count_of(kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, weights).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)
ORACLE["op1_decontaminate"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[i:i + 9] AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS w
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT len(w) AS n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, n, i, item FROM pos JOIN win USING (w)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS named
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def id_of(name: str) -> Column:
    """A page id out of an archive, where a null one stands as an empty string."""
    return F.nullif(F.col(name), F.lit("")).cast("long")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path).select(
        id_of("page_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        id_of("refers_to").alias("refers_to"),
    )


ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS origin FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM r"""


@query
def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scratch(spark)
    secrets.scan_unseen(docs, ledger)
    base = [r.name for r in secrets.BASE]
    own = F.filter("spans", lambda x: x.kind.isin(base))
    counts = [count_of(k).alias(f"n_{k}") for k in base]
    found = secrets.findings(docs, ledger)
    return found.select("doc_id", *counts, F.sha2(secrets.text_of(own), 256).alias("base_sha256"), secrets.text_of(F.col("spans")).alias("spans"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffixes.remove(docs, suffixes.LENGTH, keep_first=False, keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return orderhash.classes(docs).select("doc_id", "class_id")


@query
def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(table(spark, sf_dir, "embeddings"))
    return ann.search(index, F.col("vec_id") % 20 == 0)


@query
def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    s = toxicity.Settings()
    chain = toxicity.train(toxicity.sample_of(docs, labels, s), s)
    scored = toxicity.with_probabilities(docs, chain)
    return scored.select("doc_id", *(f"p_{c}" for c in toxicity.CATEGORIES), toxicity.is_toxic().alias("toxic"))


@query
def op4_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.mark(docs, pii.train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op13_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cuckoo.insert(None, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cuckoo.classes(index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op13_cuckoo_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""


PHRASES = 2_000


@query
def op12_fm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, totals = phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))
    ranked = phrases.top(phrases.collocations(found, totals), PHRASES)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE["op12_fm_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, ws[i:i + k - 1] AS ws FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, ws[i:i + m - 1] AS ws, max(f) AS held
           FROM (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 5) t(m) WHERE m < k) GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN inner_ USING (lang, ws) WHERE k > 1 AND NOT coalesce(100 * held >= 100 * f, false)),
cuts AS (SELECT lang, phrase, f AS a, c.k AS len_, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM c, range(1, 5) t(j) WHERE j < c.k),
s AS (SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
      FROM cuts JOIN total USING (lang) JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


def with_tails(docs: DataFrame) -> DataFrame:
    """docs whose texts, for one id in ten by its CRC-32, end in a repeated stretch: words i >= a become words a + (i - a) % p.

    A null id leaves its text as it is.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.mark(with_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    first = found.withColumn("first", longest)
    length = -F.col("first.less")
    return first.select(
        "doc_id",
        "n_runs",
        F.col("first.start").alias("start"),
        length.alias("length"),
        F.col("first.period").alias("period"),
        F.call_function("div", 1000 * length, F.col("first.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

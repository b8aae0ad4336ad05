"""The operators' queries: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    ann,
    fill_in_middle,
    host_rules,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    quality,
    reply_trees,
    sharding,
    suffix_tree,
    turn_repair,
    url_filters,
)
from .tables import dealt, table, written

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


WORD = r"[^\x20\x09-\x0D]+"

# the block list: hosts that have one of these words in a label
LISTED = "(^|[.-])(ads|adult|bets|casino)([.-]|$)"

URL_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    regexp_matches(host, '{LISTED}') AS listed
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM ruled
"""


@query("op1_url_filters", URL_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "url"))
    host, _ = url_filters.host_and_path(F.col("url"))
    blocked = pages.select(host.alias("host")).where(F.col("host").rlike(LISTED)).distinct()
    return url_filters.judge(pages, blocked)


def _moments(rule: str) -> str:
    """SQL for the mean and variance of the other hosts' rates, weighed by documents."""
    s, mean = f"s_{rule}", f"(t_{rule} - s_{rule}) / (docs - n)"
    return (
        f"CASE WHEN docs > n THEN {mean} ELSE {s} / n END AS m_{rule}, "
        f"CASE WHEN docs > n THEN (q_{rule} - {s} * {s} / n) / (docs - n) - ({mean}) * ({mean}) ELSE 0.0 END AS v_{rule}"
    )


def _prior(rule: str) -> str:
    """SQL for the beta prior of a host."""
    m, v = f"m_{rule}", f"v_{rule}"
    weight = f"CASE WHEN {v} > 0 AND {m} > 0 AND {m} < 1 THEN least(100.0, greatest(10.0, {m} * (1 - {m}) / {v} - 1)) ELSE 100.0 END"
    return f"{m} * ({weight}) + 0.5 AS a_{rule}, (1 - {m}) * ({weight}) + 0.5 AS b_{rule}"


def _rate(rule: str) -> str:
    """SQL: is the shrunk failure rate of a host within its prior?"""
    a, b = f"a_{rule}", f"b_{rule}"
    return f"(s_{rule} + {a}) / (n + {a} + {b}) <= {a} / ({a} + {b}) + 4 * sqrt({a} * {b} / ({a} + {b} + 1)) / ({a} + {b})"


_RULES = {"few": "n_words < 10", "rep": "n_repeat_words * 100 > n_words * 20", "sym": "n_symbols * 10 > n_words"}

HOST_SQL = rf"""
WITH read AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT *, regexp_extract_all(t, '{WORD}') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls
  FROM read
), windows AS (
  SELECT id, i, ws[i:i + 4] AS w FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM cut)
), twice AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY id
), measured AS (
  SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (id)
), hosts AS (
  SELECT source AS host, count(*) AS n, {", ".join(f"count(*) FILTER ({c}) AS s_{r}" for r, c in _RULES.items())}
  FROM measured GROUP BY source
), sums AS (
  SELECT sum(n)::BIGINT AS docs, {", ".join(f"sum(s_{r})::BIGINT AS t_{r}, sum(s_{r} * s_{r} / n) AS q_{r}" for r in _RULES)} FROM hosts
), others AS (
  SELECT host, n, {", ".join(f"s_{r}" for r in _RULES)}, {", ".join(_moments(r) for r in _RULES)} FROM hosts, sums
), prior AS (
  SELECT *, {", ".join(_prior(r) for r in _RULES)} FROM others
), judged AS (
  SELECT host, n AS host_docs, {" AND ".join(_rate(r) for r in _RULES)} AS host_kept FROM prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, host_docs, host_kept,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND host_kept AS kept
FROM measured JOIN judged ON source IS NOT DISTINCT FROM host
"""


@query("op2_host_rules", HOST_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "host_docs",
        "host_kept",
        "base_failed",
        "kept",
    )


@query("op3_source_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


@query("op5_hilbert_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        "lang",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
    )
    placed = sharding.shards(sized, ["source", "lang", "size"], 16, ("size", "text_crc32", "doc_id"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(dealt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("vec_id") % 50 == 0)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(packing.tokenize(docs, digest=True))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.classify(docs, table(spark, sf_dir, "labels"))


@query("op10_suffix_tree_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_fuzzy_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))


_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]|TURN\]))"

# The read-back must equal the input, so the SQL takes the input; only formatted_chars knows the template.
CHAT_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11
      ELSE 20 + length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g')) END AS n
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op11_reply_trees", CHAT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    said = rows.unionByName(more).withColumn("id", F.monotonically_increasing_id())  # a plain read: the same each time
    slim = said.select(F.col("conv_id").alias("tree"), "id", "turn", "role", F.xxhash64("text").alias("h"))
    before = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "h", "id")
    links = slim.select("tree", "id", F.lag("id").over(before).alias("parent"), F.lit(0.0).alias("score"))
    chats = reply_trees.conversations(links, said.select(F.col("conv_id").alias("tree"), "id", "role", "text"))
    return reply_trees.read_back(chats).withColumnRenamed("tree", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations after the damage that the contract of operator 12 fixes."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    return (
        rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


@query("op12_turn_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = damaged(rows)
    audited = written(turn_repair.audits(hurt, also=rows))
    sums = turn_repair.digests(hurt, audited)
    return audited.join(sums, audited.conv_id.eqNullSafe(sums.conv_id)).drop(sums.conv_id)


FIM_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:n], '') AS s
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
              ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", FIM_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))

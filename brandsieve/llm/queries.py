"""Registered queries of the operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve.llm import bpe, conversations, decontam, exact_dedup, langid, lexical, licenses, mixing, quality, secrets, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


@query("op1_decontamination")
def op1(table):
    return decontam.matches(table("documents"), table("benchmark"))


def tokenizer_path() -> str:
    """The byte-level vocabulary file that op2's contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_bpe_round_trip")
def op2(table):
    return bpe.digests(bpe.encode(table("documents"), tokenizer_path()))


@query("op3_toxicity")
def op3(table):
    docs = table("documents")
    return toxicity.score(docs, toxicity.train(docs, table("labels")))


@query("op4_language_id")
def op4(table):
    return langid.identify(table("documents"))


@query("op5_quality")
def op5(table):
    return quality.classify(table("documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op6(table):
    return exact_dedup.dedup_decisions(table("documents"))


@query("op7_simhash_near_dedup")
def op7(table):
    return simhash.near_duplicates(table("documents"))


@query("op8_license_scan")
def op8(table):
    return licenses.find(table("documents"))


SHARDS = 8


@query("op9_sharding")
def op9(table):
    plan = sharding.shard_plan(table("documents"), SHARDS)
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_secret_scan")
def op10(table):
    found = secrets.scan(table("documents"))
    masked = F.concat(F.left("value", F.lit(4)), F.lit("..."))
    return found.select("doc_id", "start", F.length("value").alias("length"), masked.alias("masked"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret")


@query("op11_conversation_repair")
def op11(table):
    return conversations.repair(table("conversations"))


@query("op12_lm_scoring")
def op12(table):
    return mixing.score(table("documents"))


TERMS = r"list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"


@query(
    "op13_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS d, doc_id, {TERMS} AS ts FROM documents WHERE text IS NOT NULL),
    sizes AS (SELECT d, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
    i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({TERMS}) AS ts FROM benchmark WHERE text IS NOT NULL),
    it AS (SELECT i, item_id, unnest(ts) AS t FROM i),
    tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM d) AS u WHERE t IN (SELECT t FROM it) GROUP BY ALL),
    w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t) AS c, total),
    scored AS (
        SELECT i, item_id, doc_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
        FROM it JOIN tf USING (t) JOIN w USING (t) JOIN sizes USING (d), total GROUP BY ALL
    ),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def op13(table):
    return lexical.search(table("documents"), table("benchmark"))

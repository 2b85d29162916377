"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact join.

A rule is (host, path, verdict) and stands for its host, all subdomains, and every path that starts
with its own. A url asks for all pairs of a host suffix and a path prefix that a rule could have. The
filter keeps four 64-bit words per block; a key sets one bit in each word of one block, so one lookup of
one block answers it. What passes is joined with the rules on the strings themselves, so false
positives end there, and the longest rule left decides. Urls that no rule fits get ``otherwise``.

Both joins are equi-joins: small lists are broadcast by Spark's size check, long ones are shuffled. Host
and path pairs are reduced before the lookup, so a url in a third of all rows is looked up once.

Defined cases: null url or no ``://`` gives an empty host and path, which no rule fits; rules with a null
host or path are left out; of equally long rules the one with the longer host decides, of equal rules
``block``; repeated pages stay rows of their own; an empty list gives ``otherwise`` for all. Other columns
of the pages are left out, so clashing names cannot matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import table

#: keys per block on average; a block has 256 bits
KEYS_PER_BLOCK = 16
WORDS = 4

#: fixed values of the registered query: host, path, verdict
RULES = """VALUES
    ('net', '/', 'block'),
    ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')
    AS rules(host, path, verdict)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path of a url as written."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def block_and_bits(host: Column, path: Column, blocks: Column) -> tuple[Column, list[Column]]:
    """Block of a key and the bit it sets in each word."""
    place = F.pmod(F.xxhash64(host, path), blocks)
    bits = F.xxhash64(F.lit("bits"), path, host)
    return place, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_blocks(rules: DataFrame, blocks: Column) -> DataFrame:
    """The filter as a table: block and its words."""
    place, bits = block_and_bits(F.col("host"), F.col("path"), blocks)
    rows = rules.select(place.alias("block"), *(b.alias(f"word{i}") for i, b in enumerate(bits)))
    return rows.groupBy("block").agg(*(F.bit_or(f"word{i}").alias(f"word{i}") for i in range(WORDS)))


def all_set(bits: list[Column]) -> Column:
    found = F.lit(True)
    for i, bit in enumerate(bits):
        found = found & (F.col(f"word{i}").bitwiseAND(bit) != 0)
    return found


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page; ``rules`` has host, path and verdict."""
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    sizes = rules.agg(
        F.array_sort(F.collect_set(F.length("path"))).alias("lengths"),
        (F.floor(F.count("*") / KEYS_PER_BLOCK) + 1).cast("long").alias("blocks"),
    )
    lengths, blocks = sizes.select("lengths").scalar(), sizes.select("blocks").scalar()
    host, path = host_and_path(F.col(url_col))
    asked = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    keys = (
        asked.select("host", "path").where("host <> '' and path <> ''").distinct()
        .withColumn("labels", F.split("host", r"\.", -1))
        .withColumn("at", F.explode(F.expr("sequence(1, size(labels))")))
        .withColumn("rule_host", F.expr("array_join(slice(labels, at, size(labels)), '.')"))
        .withColumn("known", lengths)
        .withColumn("long", F.explode(F.expr("filter(known, n -> n <= length(path))")))
        .withColumn("rule_path", F.expr("substring(path, 1, long)"))
        .select("host", "path", "rule_host", "rule_path")
    )
    place, bits = block_and_bits(F.col("rule_host"), F.col("rule_path"), blocks)
    possible = (
        keys.withColumn("block", place)
        .join(bloom_blocks(rules, blocks), "block")
        .where(all_set(bits))
        .select("host", "path", "rule_host", "rule_path")
    )
    exact = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    best = (
        possible.join(exact, ["rule_host", "rule_path"])
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), "verdict", "rule")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return asked.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), spark.sql(f"SELECT * FROM {RULES}"))


ORACLE_SQL = """
    WITH r(rule_host, rule_path, rule_verdict) AS (
      VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    ), u AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), h AS (
      SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
    ), p AS (
      SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
    ), f AS (
      SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT p.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
    FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1"""

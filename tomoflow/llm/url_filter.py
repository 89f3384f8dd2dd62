"""URL filter: a blocked Bloom filter in front of an exact hash join.

Each listed rule (host, path, verdict) has the canonical key host + path.  The keys
fill a blocked Bloom filter: one hash picks a block of eight 64-bit words, a second
hash sets one bit in each of them.  A url yields its candidate keys - every suffix of
its host at a label boundary with at most as many labels as a listed host has, joined
to every prefix of its path that is as long as a listed path - and only keys that hit
the filter go on to the hash join with the rules, which removes false positives.  Of
the rules that remain the longest wins.

All of it is DataFrame expressions.  The filter is a table, a row a block, built by one
aggregation, 16 bits or more a key; it has at most ``max_blocks`` blocks of 64 bytes (4 MiB;
two million rules), and that bound is why it is broadcast.  A longer list fills it, it
passes more false positives, and the join still removes them.  Host and path of the urls
are written once; only keys that hit go on to the join with the rules and are grouped,
and the few bytes of every url meet its own rule last.  The join side is left to Spark,
which broadcasts the rules only below its size threshold and splits hot keys of a
shuffled join (AQE).

Defined results
  * null urls, and urls without "://", have an empty host and an empty path.
  * rules with a null part are left out; rules listed twice: the verdict that blocks.
  * no rule fits: the rule is null and the verdict ``default`` (a url that isn't listed
    passes).
  * every row of ``pages`` gives one row, repeated ids and null ids included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.llm.common import column, stash

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "r_host string, r_path string, r_verdict string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(authority, UPPER, LOWER), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """Bit 0 to 63 that the key sets in a word of its block: six bits of a second hash."""
    return F.call_function("shiftrightunsigned", F.xxhash64(key, F.lit(2)), F.lit(6 * word)).bitwiseAND(F.lit(63)).cast("int")


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """block and its words w0 to w7, for the blocks that hold a key."""
    one = F.lit(1).cast("long")
    words = [F.bit_or(F.call_function("shiftleft", one, _bit(F.col(key), w))).alias(f"w{w}") for w in range(WORDS)]
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*words)


def maybe_listed(probes: DataFrame, key: str, filled: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``probes`` whose key may be listed; those left out certainly aren't."""
    here = _block(F.col(key), blocks) == F.col("block")
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.call_function("shiftrightunsigned", F.col(f"w{w}"), _bit(F.col(key), w)).bitwiseAND(F.lit(1)) == 1)
    # at most max_blocks rows
    return probes.join(F.broadcast(filled), here).where(hit).select(*probes.columns)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_blocks: int = 1 << 16,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    listed = rules.dropna().withColumn("r_key", F.concat("r_host", "r_path"))
    # keys that two rules share differ in where the host ends: the host's length is part of the key
    listed = listed.withColumn("r_key", F.concat(F.length("r_host").cast("string"), F.lit(":"), F.col("r_key")))
    listed = listed.groupBy("r_key", "r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    shape = listed.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    host, path = url_parts(column(pages, url_col, "string"))
    rows = pages.select(column(pages, id_col, "long").alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    if not shape["n"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    blocks = min(max_blocks, 1 << max(4, (shape["n"] // 32).bit_length()))  # 16 bits a key or more, up to the bound
    filled = bloom_blocks(listed, "r_key", blocks)
    rows = stash(rows, "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))),
        lambda i: F.array_join(F.slice(labels, -i, i), "."),
    )
    lengths = F.array(*[F.lit(x) for x in shape["lengths"]])
    prefixes = F.transform(
        F.filter(lengths, lambda x: x <= F.length("path")),
        lambda x: F.substring(F.col("path"), F.lit(1), x),
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(F.length(h).cast("string"), F.lit(":"), h, p))))
    hits = maybe_listed(rows.select(F.col("row").alias("h_row"), F.explode(keys).alias("key")), "key", filled, blocks)
    found = hits.join(listed, F.col("key") == F.col("r_key"))
    rule = F.concat("r_host", "r_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), rule.alias("rule"), F.col("r_verdict").alias("verdict")))
    judged = rows.join(found.groupBy("h_row").agg(best.alias("best")), F.col("row") == F.col("h_row"), "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle_sql(rules=RULES, default: str = "allow") -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {listed}),
rests AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
       coalesce(arg_max(r_verdict, length(r_host || r_path)), '{default}') AS verdict
FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY n, page_id, host, path"""

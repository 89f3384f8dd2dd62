"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's words are laid end to end, shard by shard, in a seeded order of its
documents, and cut into blocks of ``block_words`` words.  Whole blocks are then
apportioned twice by highest quotients w / (2j + 1): the blocks of the mix to the
sources by their targets, and the blocks of a source to its shards by their words.
A shard with quota k of n blocks takes every block k div n times and k mod n blocks,
chosen by the seed, once more: the documents are in an order that the seed shuffles, and
the chosen blocks are those from a seeded place on (an arc, which may wrap round).  A
choice of scattered blocks would take nearly every document in part; along the shuffled
order nearly every document is taken as a whole or left.

Targets: the sources in order of code points, null last, weigh 5, 2, 1, repeating,
and share ``share`` (150 %) of all words; a target stops at ``cap`` (2) times its
source's words, and the excess goes to the others by weight until none is above.

Everything is DataFrame expressions.  Only (id, source, size) is shuffled, by (source,
shard); a source has as many shards as keep each near ``shard_words`` words, so a source
with a third of all rows is spread like any other.  Texts stay where they are: how often
a document is taken changes a few times along a shard's order, and these places (a row a
shard, at most ``MOST_SHARDS`` and one a source) are broadcast to the documents.  Quotients are not listed seat by seat: a seat count lies within a few
seats of its proportional share, so about three candidates a party are ranked.
The order is by MD5 of seed and id, hence the same for every run and partitioning.

Defined results
  * null text has size 0; a null source is a source of its own and comes last.
  * rows that repeat an id are separate documents.
  * documents of size 0, and all documents of sources without words, take 0.
  * an empty table gives an empty result.
  * whole documents (``mixed_documents``): rows that agree in source, id and size are
    taken alike; documents of size 0 aren't taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomoflow.llm.common import column, stash, word_count

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
SHARD_WORDS = 200_000
MOST_SHARDS = 200_000
SEED = "mix-1"


def seeded(*parts: Column | str) -> Column:
    """A number from 0 to 2^60 - 1 made from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, place (from 1), source_size, weight, target.

    The fill level L with sum(min(cap * size, L * weight)) = share * total is found
    from prefix sums over the sources in order of cap * size / weight: it is the
    level left for the others once all sources before a place stop at their cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", cap * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("caps_before")) / F.col("weights_left"))
    )
    # the first source, in this order, whose cap the level doesn't reach sets the level for all
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("fill", F.first(open_level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("fill") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "place", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, weight: str, seats: str) -> DataFrame:
    """``parties`` with a column ``won``: the seats of each party by highest quotients.

    ``seats`` holds the number of seats of the party's group.  Ties go to the
    smaller ``party``.  With n parties and T seats, the common divisor that hands
    out T seats lies between those at which rounding hands out n/2 + 1 seats more or
    fewer, so each party's seats lie between the two rounded shares used below, and
    only the quotients between them compete.
    """
    keys = group or ["one"]
    rows = parties.withColumn("one", F.lit(1))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("w_all", F.sum(weight).over(whole)).withColumn("slack", F.count(F.lit(1)).over(whole) / 2.0 + 2)
    fair = F.when(F.col("w_all") > 0, F.col(weight) / F.col("w_all")).otherwise(0.0)
    sure = F.greatest(F.lit(0), F.floor(fair * (F.col(seats) - F.col("slack")) + 0.5) - 1).cast("long")
    most = (F.floor(fair * (F.col(seats) + F.col("slack")) + 0.5) + 1).cast("long")
    rows = rows.withColumn("sure", F.when(F.col(weight) > 0, sure).otherwise(F.lit(0).cast("long"))).withColumn("most", most)
    rows = rows.withColumn("left", F.col(seats) - F.sum("sure").over(whole))
    bids = rows.where(F.col(weight) > 0).select(
        *keys, party, "left", F.explode(F.sequence(F.col("sure"), F.col("most"))).alias("seat"), F.col(weight).alias("bid_weight")
    )
    bids = bids.withColumn("quotient", F.col("bid_weight") / (2 * F.col("seat") + 1))
    order = Window.partitionBy(*keys).orderBy(F.col("quotient").desc(), party, "seat")
    extra = (
        bids.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("left"))
        .groupBy(*keys, party)
        .agg(F.count(F.lit(1)).alias("extra"))
    )
    own = [*keys, party]
    joined = rows.join(extra.select(*[F.col(c).alias(f"x_{c}") for c in own], "extra"), [F.col(c) == F.col(f"x_{c}") for c in own], "left")
    won = F.col("sure") + F.coalesce("extra", F.lit(0))
    return joined.select(*parties.columns, won.cast("long").alias("won"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """doc_id, source, size and seeded order of each document, with further columns."""
    rows = docs.select(
        column(docs, id_col, "long").alias("doc_id"), column(docs, source_col, "string").alias("source"), word_count(column(docs, text_col, "string")).alias("size"), *more
    )
    return rows.withColumn("order", seeded(seed, F.col("doc_id"), F.col("size")))


def dealt(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """The rows with what is known of their source, and the shard they are in."""
    found = rows.join(quotas, F.col("source").eqNullSafe(F.col("q_source")))
    return found.withColumn("shard", F.col("order") % F.col("shards"))


def _laid_out(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, cap: int, block_words: int, shard_words: int, seed: str
) -> tuple[DataFrame, DataFrame]:
    """One row per document with its shard, its place there and what is taken of it; and the sources' quotas."""
    rows = stash(sized(docs, id_col, text_col, source_col, seed), "sizes")
    per_source = stash(source_targets(rows, weights, share, cap), "sources")
    blocks = F.col("target") / block_words
    totals = per_source.withColumn("all_blocks", F.round(F.sum(blocks).over(Window.partitionBy(F.lit(1)))).cast("long"))
    all_words = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    quotas = sainte_lague(totals, [], "place", "target", "all_blocks").select(
        F.col("source").alias("q_source"),
        "place",
        "source_size",
        "target",
        F.col("won").alias("source_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(shard_words), all_words / MOST_SHARDS))).cast("long").alias("shards"),
    )
    quotas = stash(quotas, "quotas")
    rows = dealt(rows, quotas)

    # words of each shard; its quota of the source's blocks, in proportion to them
    per_shard = rows.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    per_shard = sainte_lague(per_shard, ["place"], "shard", "shard_size", "source_blocks")
    per_shard = per_shard.select(F.col("place").alias("s_place"), F.col("shard").alias("s_shard"), "shard_size", F.col("won").alias("quota"))

    line = Window.partitionBy("place", "shard").orderBy("order", "doc_id", "size")
    rows = rows.withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(per_shard, (F.col("place") == F.col("s_place")) & (F.col("shard") == F.col("s_shard")))
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)).cast("long")
    quota = F.least(F.col("quota"), cap * n)
    start = seeded(seed, "arc", F.col("place"), F.col("shard")) % n
    rows = rows.withColumn("n", n).withColumn("every", F.floor(quota / n).cast("long")).withColumn("arc", quota % n).withColumn("first", start)

    def in_arc(words: Column) -> Column:
        """Words before place ``words`` that lie in the arc's blocks (it may wrap round)."""
        begin = F.col("first") * block_words
        end = (F.col("first") + F.col("arc")) * block_words
        wrapped = (F.col("first") + F.col("arc") - F.col("n")) * block_words
        inside = F.greatest(F.lit(0), F.least(words, end) - begin)
        return inside + F.greatest(F.lit(0), F.least(words, wrapped))

    taken = F.col("every") * F.col("size") + in_arc(F.col("stop")) - in_arc(F.col("stop") - F.col("size"))
    taken = F.least(taken, cap * F.col("size")).cast("long")
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return rows.withColumn("taken", taken).withColumn("whole_copies", copies), quotas


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, whole_copies (taken / size, rounded), source."""
    rows, _ = _laid_out(docs, id_col, text_col, source_col, weights, share, cap, block_words, shard_words, seed)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "whole_copies", "source")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows that agree in source, id and size are taken alike: as often as the last of them.
    """
    rows, quotas = _laid_out(docs, id_col, text_col, source_col, weights, share, cap, block_words, shard_words, seed)
    # where, along a shard's order, the number of copies changes
    line = Window.partitionBy("place", "shard").orderBy("order", "doc_id", "size")
    rows = rows.where("size > 0").groupBy("place", "shard", "order", "doc_id", "size").agg(F.max("whole_copies").alias("copies"))
    changes = rows.withColumn("before", F.lag("copies").over(line)).where("before is null or before <> copies")
    at = F.struct("order", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size", "copies")
    steps = changes.groupBy(F.col("place").alias("s_place"), F.col("shard").alias("s_shard")).agg(F.array_sort(F.collect_list(at)).alias("steps"))
    steps = stash(steps, "steps")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    placed = dealt(sized(docs, id_col, text_col, source_col, seed, whole).where("size > 0"), quotas)
    met = placed.join(F.broadcast(steps), (F.col("place") == F.col("s_place")) & (F.col("shard") == F.col("s_shard")))
    here = F.struct(F.col("order"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("size"))
    passed = F.filter("steps", lambda x: F.struct(x["order"].alias("order"), x["doc_id"].alias("doc_id"), x["size"].alias("size")) <= here)
    copies = F.element_at(passed, -1)["copies"]
    return met.withColumn("copies", copies).where("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def oracle_sql(share: float = 1.5, cap: int = 2, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> str:
    """The same rules in SQL for DuckDB, every quotient of every seat listed."""
    return f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE AS weight, ({cap} * source_size)::DOUBLE AS capped FROM per_source),
levels AS (
  SELECT *, ({share} * sum(source_size) OVER () - coalesce(sum(capped) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY capped / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fill AS (SELECT level AS fill FROM levels WHERE level * weight <= capped ORDER BY capped / weight, place LIMIT 1),
targets AS (SELECT source, place, source_size, coalesce(least(capped, (SELECT fill FROM fill) * weight), capped)::DOUBLE AS target FROM levels),
seats AS (SELECT *, round(sum(target / {block_words}) OVER ())::BIGINT AS all_blocks, greatest(1, ceil(source_size / greatest({shard_words}, sum(source_size) OVER () / {MOST_SHARDS}.0)))::BIGINT AS shards FROM targets),
source_bids AS (SELECT place, all_blocks, target / (2 * j + 1) AS quotient, j FROM (SELECT *, unnest(range(all_blocks)) AS j FROM seats WHERE target > 0)),
source_won AS (SELECT place, count(*) AS source_blocks FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, place, j) AS r FROM source_bids) WHERE r <= all_blocks GROUP BY place),
rows AS (
  SELECT d.doc_id, d.size, s.*, coalesce(w.source_blocks, 0) AS source_blocks,
         ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 15))::BIGINT AS ord
  FROM sizes d JOIN seats s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN source_won w ON w.place = s.place),
dealt AS (SELECT *, ord % shards AS shard FROM rows),
per_shard AS (SELECT place, shard, sum(size)::BIGINT AS shard_size, any_value(source_blocks) AS source_blocks FROM dealt GROUP BY place, shard),
shard_bids AS (SELECT place, shard, source_blocks, shard_size::DOUBLE / (2 * j + 1) AS quotient, j FROM (SELECT *, unnest(range(source_blocks)) AS j FROM per_shard WHERE shard_size > 0)),
shard_won AS (SELECT place, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard, j) AS r FROM shard_bids) WHERE r <= source_blocks GROUP BY place, shard),
arcs AS (
  SELECT p.place, p.shard, n, least(coalesce(quota, 0), {cap} * n) // n AS every, least(coalesce(quota, 0), {cap} * n) % n AS arc,
         ('0x' || substr(md5('{seed}:arc:' || p.place || ':' || p.shard), 1, 15))::BIGINT % n AS first
  FROM (SELECT *, greatest(1, ceil(shard_size / {block_words}))::BIGINT AS n FROM per_shard) p LEFT JOIN shard_won w ON w.place = p.place AND w.shard = p.shard),
lined AS (
  SELECT d.*, n, every, first * {block_words} AS b, (first + arc) * {block_words} AS e, (first + arc - n) * {block_words} AS wrapped,
         sum(size) OVER (PARTITION BY d.place, d.shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop
  FROM dealt d JOIN arcs a ON a.place = d.place AND a.shard = d.shard)
SELECT doc_id, size, source_size, target,
       least({cap} * size, every * size
         + greatest(0, least(stop, e) - b) + greatest(0, least(stop, wrapped))
         - greatest(0, least(stop - size, e) - b) - greatest(0, least(stop - size, wrapped)))::BIGINT AS taken
FROM lined"""

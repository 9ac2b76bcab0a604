"""Mix sources to target weights, with DataFrame functions only.

Word counts are summed per source, targets come from filling all sources to one
level, and each document is emitted ``floor(rate)`` times plus one copy drawn from
a hash with probability equal to the fraction.  Nothing is drawn from a generator,
so reruns and recomputed tasks agree.

Defined results: a null text has no words; a null source is a source of its own,
last in order; rows with equal id and text share one draw; a source without words
takes none; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import ranged, running, with_position
from .common import lookup, named, settled, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets per source from (``_source``, ``_size``) rows: source, source_size, weight, target.

    All sources rise together, each to level times weight but not above ``cap``
    times its own size, until the targets add up to all sizes.  That level is the
    largest (rest of the total) / (rest of the weights) over the prefixes of sources
    ordered by the level at which they are full.  Ranks and running sums go over
    range partitions, so the number of sources is not limited by a task.
    """
    sums = sizes.groupBy("_source").agg(F.sum("_size").alias("_sum"))
    order = F.col("_source").asc_nulls_last()
    placed = with_position(ranged(sums, [], [order]), [], [order], F.col("_rb"), "_rank").drop("_rb")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = placed.withColumn("_w", F.element_at(cycle, (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int")).cast("long")).withColumn("_full", F.col("_sum") * cap)
    weighed = ranged(weighed.withColumn("_at", F.col("_full") / F.col("_w")), [], ["_at", order])
    before = running(weighed, [], F.col("_rb"), ["_at", order], {"_bs": ("sum", F.col("_full")), "_bw": ("sum", F.col("_w"))}, inclusive=False)
    totals = weighed.agg(F.sum("_sum").alias("_ts"), F.sum("_w").alias("_tw"))
    rest = (F.col("_ts") - F.coalesce("_bs", F.lit(0))) / (F.col("_tw") - F.coalesce("_bw", F.lit(0)))
    level = before.crossJoin(F.broadcast(totals)).agg(F.max(rest).alias("_level"))  # both sides are one row
    found = weighed.crossJoin(F.broadcast(level))
    target = F.least(F.col("_full").cast("double"), F.col("_level") * F.col("_w"))
    return settled(found.select("_source", F.col("_sum").alias("source_size"), F.col("_w").alias("weight"), target.alias("target")), "mix")


def draw(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) from id, text and seed."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text_of(text))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(docs: DataFrame, keep: Sequence[str], weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED,
           doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Columns ``keep`` of each document as struct ``_row``, with size, source_size, target and the number of copies.

    Sizes are counted in one pass for the totals and again in the pass that emits:
    counting is cheaper than carrying texts through a shuffle.
    """
    plan = targets(docs.select(F.col(source).alias("_source"), word_count(text).alias("_size")), weights, cap)
    rows = docs.select(F.struct(*named(keep)).alias("_row"), F.col(source).alias("_source"), word_count(text).alias("size"), draw(doc_id, text, seed).alias("_u"))
    got = lookup(rows, plan, ["_source"], ["source_size", "target"], F.xxhash64("_u"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return got.select("_row", "size", "source_size", "target", (whole + F.when(F.col("_u") < rate - whole, 1).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the given columns, each document as often as it is taken."""
    got = copies(docs, docs.columns, **options)
    return got.where(F.col("copies") > 0).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_nth")).select("_row.*")


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words the mix takes."""
    got = copies(docs, ["doc_id"], **options)
    return got.select("_row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


TAKEN_SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / {float(2**52)} AS u FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
filled AS (SELECT *, ((SELECT sum(s) FROM sums) - coalesce(sum(s * {CAP}) OVER before, 0))::DOUBLE / ((SELECT sum(w) FROM sums) - coalesce(sum(w) OVER before, 0))::DOUBLE AS lev
    FROM sums WINDOW before AS (ORDER BY (s * {CAP})::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, s, least((s * {CAP})::DOUBLE, (SELECT max(lev) FROM filled) * w) AS target FROM sums),
rated AS (SELECT d.doc_id, d.size, d.u, p.s, p.target, CASE WHEN p.s > 0 THEN p.target / p.s ELSE 0 END AS rate
    FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""

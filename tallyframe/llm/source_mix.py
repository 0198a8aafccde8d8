"""Mixing sources to target weights.

Tokens are summed per source; targets follow the weights, and what a source cannot give is shared out again.
A source's repetition rate is target over size: every document is emitted ``floor(rate)`` times plus once
more with the probability of the fraction, decided by a hash of its id, so reruns agree.

Only one row per source is ever ordered or summed in one place; documents are summed where they lie and meet
their source's rate in one join (which adaptive execution broadcasts, or splits where one source is hot).

Missing texts and empty texts have size 0; a missing source is a source of its own, ranked last; an empty
table gives an empty mix; repeated rows are taken or left together, because they share their id; rows without an
id are told apart by their text. Sources whose documents have no words get target 0. The few windows over sources
have no partition: a row per source, in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyframe.llm.tables import WORD, free_name, hash_share
from tallyframe.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def _extra(rate: F.Column) -> F.Column:
    """One more copy with the probability of the rate's fraction, by the row's id or else its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return (hash_share(name) < rate - F.floor(rate)).cast("long")


def word_count(column) -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of ``sources`` (source, source_size): ``share`` of all sizes by weight, at most ``most`` times
    each size, the excess shared by weight among the rest until none is above.

    In order of size per weight, sources reach their limit one after another. Before each one, ``level`` is
    what one unit of weight would get if the ones before were at their limits; the first source that stays
    within its limit fixes the level of all that follow.
    """
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    filling = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    everything = W.partitionBy()
    rows = (
        sources.withColumn("w", F.element_at(kinds, ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")))
        .withColumn("place", F.row_number().over(filling))
        .withColumn("filled", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(most))
        .withColumn("gone", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(everything) * float(share) - F.col("filled"))
                    / (F.sum("w").over(everything) - F.col("gone")))
    )
    within = F.when(F.col("level") * F.col("w") <= F.col("source_size") * float(most), F.struct("place", "level"))
    first = F.min(within).over(everything)
    return rows.select("source", "source_size", F.when(
        F.col("place") < first["place"], F.col("source_size") * float(most)).otherwise(
        first["level"] * F.col("w")).alias("target"))


def _rates(sources: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``of_source, source_size, target, rate``, one row per source."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return source_targets(sources, weights, share, most).select(F.col("source").alias("of_source"), "source_size", "target", rate.alias("rate"))


def repetitions(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs``."""
    name = F.when(F.col("doc_id").isNull(), F.col("text")).alias("text")
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), name))
    rates = _rates(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    return sized.join(rates, sized["source"].eqNullSafe(rates["of_source"])).select(
        "doc_id", "source", "size", "source_size", "target", (F.floor("rate") + _extra(F.col("rate"))).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as taken, numbered by ``copy`` (``_copy`` if there is such a
    column already, and so on)."""
    number, of, rate = (free_name(docs, name) for name in ("copy", "__source", "__rate"))
    sources = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    # staged, so that its size is known when the join with the documents is planned
    rates = stage(_rates(sources, weights, share, most).select(F.col("of_source").alias(of), F.col("rate").alias(rate)))
    copies = (F.floor(rate) + _extra(F.col(rate))).cast("int")
    every = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    return docs.join(rates, docs["source"].eqNullSafe(rates[of])).withColumn(number, every).select(*[docs[c] for c in docs.columns], number)


def taken(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    return repetitions(docs).select("doc_id", "size", "source_size", "target",
                                    (F.col("size") * F.col("copies")).alias("taken"))


TAKEN_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as w
  from sources),
filling as (
  select *, row_number() over o as place,
    coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0)::double * 2.0::double as filled,
    coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0.0) as gone,
    sum(source_size) over ()::double * 1.5::double as total, sum(w) over () as weights
  from weighed window o as (order by source_size / w, source asc nulls last)),
levels as (select *, (total - filled) / (weights - gone) as level from filling),
chosen as (select place, level from levels where level * w <= source_size * 2.0::double order by place limit 1),
targets as (
  select l.source, l.source_size,
    case when l.place < c.place then l.source_size * 2.0::double else c.level * l.w end as target
  from levels l, chosen c),
rated as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0::double as u
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::bigint as taken
from rated
"""

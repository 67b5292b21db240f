"""Mixing sources to target weights by weighted fair queueing.

The words of all documents are shared among the sources by weight; a target stops at
``most`` times its source's words and what is over is shared again among the rest, which fills up to one common
level. Each document, shuffled within its source by a hash of its id, gets a virtual finish time: the
source's words so far divided by the source's target. A source whose target is above its words goes round
again, up to ``most`` times. All passes together are ranged by finish time and cut where
the words reach the budget. Only DataFrame functions are used; the text never leaves the scan.

Null texts have size 0 and are taken 0 words. A null source is a source of its own, in last
place. Null ids sort first. Rows that agree in source, id, size and text share one
fate. An empty table gives an empty result. Other columns are neither read nor returned by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondine.llm._common import WORD, prefix_sums, staged

#: Passes over one source, and so the most that a target can be of its source's words.
MOST = 3


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What the order within a source depends on: hash of the id, id, size, digest of the text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return {
        "__source": docs[source_col],
        "__key": F.struct(
            F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")).alias("h"),
            docs[id_col].alias("id"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
            F.md5(text.cast("binary")).alias("d"),
        ),
    }


def targets(rows: DataFrame, weights: int = 3, most: int = MOST) -> DataFrame:
    """Per source: ``source_size``, ``rank`` by code point (null last) and ``target``.

    ``rows`` has ``__source`` and ``size``. With the sources in order of cap over weight, the common
    level is that of the first source that needs no cap once all before it have theirs.
    """
    sizes = rows.groupBy("__source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(sizes.withColumn("one", F.lit(1).cast("bigint")), [F.col("__source").asc_nulls_last()], {"rank": "one"}, label="mix-rank")
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % weights + 1).withColumn("cap", most * F.col("source_size"))
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight"))
    summed = staged(prefix_sums(ranked, [F.col("fill"), F.col("rank")], {"caps": "cap", "heavy": "weight"}, label="mix-fill"), "mix-sources")
    all_of = summed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))
    level = (F.col("total") - F.col("caps") + F.col("cap")) / (F.col("all_weight") - F.col("heavy") + F.col("weight"))
    levels = summed.crossJoin(F.broadcast(all_of)).withColumn("level", level).where(F.col("level") <= F.col("fill"))
    one = levels.agg(F.min_by("level", F.struct("fill", "rank")).alias("level"), F.max("total").alias("total"))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return summed.crossJoin(F.broadcast(one)).select("__source", "source_size", "rank", target.alias("target"), "total")


def cuts(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Per source: its size and target, and the last pass and key that the mix takes (null: none)."""
    rows = rows.select("__source", "__key", F.col("__key.size").alias("size"))
    goal = staged(targets(rows, most=most), "mix-targets")
    order = [F.col("__source").asc_nulls_last(), F.col("__key")]
    summed = prefix_sums(rows, order, {"words": "size"}, within="__source", label="mix-words")
    plan = goal.withColumnRenamed("__source", "__of")
    queue = summed.join(plan, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(most))))
    finish = F.when(F.col("target") > 0, (F.col("words") + (F.col("pass") - 1) * F.col("source_size")) / F.col("target")).otherwise(0.0)
    queue = queue.select("rank", "pass", "__key", "size", "total", finish.alias("finish"))
    served = prefix_sums(queue, [F.col("finish"), F.col("rank"), F.col("pass"), F.col("__key")], {"served": "size"}, label="mix-queue")
    last = served.where(F.col("served") <= F.col("total")).groupBy("rank").agg(F.max(F.struct("pass", "__key")).alias("last"))
    return goal.join(last, "rank", "left").select(F.col("__source").alias("__of"), "source_size", "target", F.col("last.pass").alias("__pass"), F.col("last.__key").alias("__last"))


def copies() -> Column:
    """How often the mix takes a row that has its key and its source's cut."""
    times = F.col("__pass") - 1 + F.when(F.col("__key") <= F.col("__last"), 1).otherwise(0)
    return F.coalesce(times, F.lit(0)).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """Per document: id, ``size``, ``source_size``, ``target`` and ``taken`` words, repeats counted."""
    rows = staged(docs.select(*[c.alias(n) for n, c in keyed(docs, id_col, text_col, source_col).items()]), "mix-rows")
    joined = rows.join(cuts(rows, most), F.col("__source").eqNullSafe(F.col("__of")))
    return joined.select(F.col("__key.id").alias(id_col), F.col("__key.size").alias("size"), "source_size", "target", (copies() * F.col("__key.size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """The documents themselves, as often as the mix takes them, with the columns they came with.

    Two columns may share a name but for ``id_col``, ``text_col`` and ``source_col``.
    """
    keys = keyed(docs, id_col, text_col, source_col)
    rows = staged(docs.select(*[c.alias(n) for n, c in keys.items()]), "mix-rows")
    back = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), *[c.alias(n) for n, c in keys.items()])
    joined = back.join(cuts(rows, most), F.col("__source").eqNullSafe(F.col("__of"))).where(copies() > 0)
    return joined.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), copies()))).select("__row.*")


SQL = r"""
with d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
             md5(coalesce(doc_id::varchar, '')) as h, md5(coalesce(text, '')) as t from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rnk from d group by source),
w as (select *, (rnk - 1) % 3 + 1 as weight, 3 * source_size as cap, (3 * source_size)::double / ((rnk - 1) % 3 + 1) as fill from s),
f as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by fill, rnk rows between unbounded preceding and 1 preceding), 0))::double
             / (sum(weight) over () - coalesce(sum(weight) over (order by fill, rnk rows between unbounded preceding and 1 preceding), 0))::double as level from w),
g as (select f.*, least(cap::double, l.level * weight) as target, l.total
      from f, (select arg_min(level, (fill, rnk)) filter (level <= fill) as level, sum(source_size)::bigint as total from f) l),
c as (select d.*, g.source_size, g.target, g.total, g.rnk, sum(d.size) over (partition by d.source order by h, doc_id nulls first, d.size, t rows unbounded preceding) as words
      from d join g on d.source is not distinct from g.source),
q as (select c.*, p, case when target > 0 then (words + (p - 1) * source_size)::double / target else 0 end as finish from c, (values (1), (2), (3)) v(p)),
o as (select r, size, total, sum(size) over (order by finish, rnk, p, h, doc_id nulls first, size, t rows unbounded preceding) as served from q),
k as (select r, sum(size)::bigint as taken from o where served <= total group by r)
select c.doc_id, c.size::bigint as size, c.source_size, c.target, coalesce(k.taken, 0)::bigint as taken from c left join k using (r)
"""

"""Queries of the catalog of metrics over measured tracks."""

from __future__ import annotations

from ondine.operators import metrics as M
from ondine.plans.dynamics import rounded
from ondine.plans.registry import query
from ondine.plans.tracks import TRK, tracks


def _text(v) -> str:
    return "null" if v is None else "'" + v + "'" if isinstance(v, str) else f"{v!r}::double"


CATALOG = f"""ca as (select * from (values {', '.join('(' + ', '.join([str(i), *map(_text, m)]) + ')' for i, m in enumerate(M.METRICS))}) v(ordinal, metric, name, category, unit, description, low, high)),
  va as ({' union all '.join(f"select track, '{m.metric}' as metric, {m.metric}::double as value from tr" for m in M.METRICS)}),
  pl as (select *, case when value is null then 'missing' when value < low then 'low' when value > high then 'high' when low is null and high is null then 'unrated' else 'good' end as status from va join ca using (metric))"""


@query(f"with {TRK}, {CATALOG} select track, metric, name, category, unit, value, status from pl")
def q_metric_values(spark, d):
    return rounded(M.placed(tracks(spark, d)).select("track", "metric", "name", "category", "unit", "value", "status"))


@query(f"""with {TRK}, {CATALOG} select ordinal::int as ordinal, metric, category, unit, round(min(value), 5) as least, round(avg(value), 5) as mean, round(max(value), 5) as most, count(value) as tracks,
  count(*) filter (status = 'good') as good, count(*) filter (status = 'low') as low, count(*) filter (status = 'high') as high from pl group by ordinal, metric, category, unit""")
def q_metric_catalog(spark, d):
    return rounded(M.overview(tracks(spark, d)), 5)

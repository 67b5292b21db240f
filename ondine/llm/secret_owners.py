r"""Secret scans with corpus-wide ownership frequency.

Candidates of four kinds are found in every text: ``assign`` (a keyword with its value), ``access``
(key ids), ``hex`` (long runs of hexadecimal digits) and ``opaque`` (long tokens that mix cases and digits and
are found by no keyword). The values are hashed, and for each hash the distinct owners
and repositories that hold it are counted over the whole corpus. A value of ``widely`` or more owners is a copied
example, one below it live-looking. The base kinds are always reported; an opaque
token only where one owner alone holds it.

An owner is the source up to its first slash, a repository the whole source; a null source is an owner of its own.
Null and empty texts have no spans. Spans are in code points, end exclusive, one per match, leftmost first and without
overlap within a kind. Repeated rows give repeated rows, an empty table an empty result. Only DataFrame functions are used.

A text is cut at its matches and the lengths of the gaps are summed by a window over the text's matches, so the time grows in
proportion to them. Counting takes one row for each hash, owner and repository after the map-side sums, so a value that a third of all
documents hold is a few rows for each task; the answers of values that make up much of all spans are broadcast (there can
be few such), the others go back by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondine.llm._common import joined_by_count, staged

#: Owners from which on a value counts as a widely copied example.
WIDELY = 5
#: Code points of the chunks in which a text's spans are cut out.
CHUNK = 4096

#: The patterns of the base kinds, with the group that is the value and its least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_.=-])"
KINDS = ("assign", "access", "hex", "opaque")


def found(text: Column, kind: str, pattern: str, least: int = 0, value: int = 0) -> Column:
    """Array of (kind, i, gap, size, hash) in the order of the text: how many code points stand between the match and the one before, and
    the digest of its group ``value``; no digest if that is shorter than ``least``."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    none = F.from_json(F.lit("[]"), "array<struct<kind int, i int, gap int, size int, hash string>>")

    def one(pair: Column, i: Column) -> Column:
        match = pair["match"]
        held = F.regexp_extract(match, pattern, value) if value else match
        fine = F.length(held) >= least
        if kind == "opaque":
            fine = fine & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), pair["gap"].alias("gap"), F.length(match).alias("size"), F.when(fine, F.sha2(held, 256)).alias("hash"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(pairs, one)).otherwise(none)


def candidates(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per row: id, hash of the text, source, and the matches of all kinds."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    every = F.concat(found(text, "assign", ASSIGN, 12, 2), found(text, "access", ACCESS, 18), found(text, "hex", HEX), found(text, "opaque", OPAQUE))
    return docs.select(docs[id_col].alias("__id"), F.xxhash64(text).alias("__text"), docs[source_col].cast("string").alias("__source"), every.alias("__found"))


def spans(rows: DataFrame) -> DataFrame:
    """A row for each match that passes, with its place: the gaps and matches before it are summed up.

    Opaque tokens within what a keyword found go: assignments don't overlap, so the last one that begins before or with a token holds
    it if any does.
    """
    each = rows.select("__row", "__source", F.explode("__found").alias("s")).select("__row", "__source", "s.*").repartition("__row")
    before = Window.partitionBy("__row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    each = each.where("hash is not null").select("__row", "__source", (F.col("end") - F.col("size")).alias("at"), "kind", "end", "hash")
    so_far = Window.partitionBy("__row").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("__named", F.max(F.when(F.col("kind") == 0, F.col("end"))).over(so_far))
    return each.where((F.col("kind") < 3) | F.col("__named").isNull() | (F.col("__named") < F.col("end"))).drop("__named")


def owners(each: DataFrame) -> DataFrame:
    """Per hash: how many distinct owners and repositories hold it, and how many spans it has."""
    held = each.select("hash", F.substring_index("__source", "/", 1).alias("owner"), F.col("__source").alias("repo")).groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", widely: int = WIDELY) -> DataFrame:
    """Per row: ``__id``, ``__text``, ``__row``, and ``__spans`` with owners, repositories and ``live``; opaque ones of several owners are gone."""
    rows = staged(candidates(docs, id_col, text_col, source_col).withColumn("__row", F.monotonically_increasing_id()), "secret-spans")
    each = staged(spans(rows), "secret-places")
    known = joined_by_count(each, staged(owners(each), "secret-owners"), "hash", "n_spans", each.count())
    kept = known.where((F.col("kind") < 3) | (F.col("n_owners") == 1))
    one = F.struct("at", "kind", "end", "hash", "n_owners", "n_repos", (F.col("n_owners") < widely).alias("live"))
    back = kept.groupBy("__row").agg(F.array_sort(F.collect_list(one)).alias("__spans"))
    none = F.filter(F.array(F.lit(None).cast(back.schema["__spans"].dataType.elementType)), lambda x: F.lit(False))
    return rows.drop("__found").join(back, "__row", "left").withColumn("__spans", F.coalesce("__spans", none))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["at"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", widely: int = WIDELY) -> DataFrame:
    """Per row: counts of the base kinds, digest of their spans, all spans, and how many look live or copied."""
    of = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("__spans", lambda x: x["kind"] < 3)
    return judged(docs, id_col, text_col, source_col, widely).select(
        F.col("__id").alias(id_col), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"),
        F.size(F.filter("__spans", lambda x: x["live"])).cast("bigint").alias("n_live"), F.size(F.filter("__spans", lambda x: ~x["live"])).cast("bigint").alias("n_copied"),
    )


def cut_out(text: Column, cuts: Column, mark: str) -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``.

    ``cuts`` maps a chunk's number to its spans as (at, starts, end) within the chunk; ``starts`` is false where the
    span began in an earlier chunk. Only a chunk's own spans are gone through in it, so the time grows with the text.
    """

    def step(acc: Column, x: Column) -> Column:
        gap = F.when((x["at"] < acc["at"]) | ~x["starts"], F.lit("")).otherwise(F.concat(F.substr(acc["chunk"], acc["at"] + 1, x["at"] - acc["at"]), F.lit(mark)))
        cut = F.struct(x["end"].alias("at"), F.concat(acc["out"], gap).alias("out"), acc["chunk"].alias("chunk"))
        return F.when(x["end"] <= acc["at"], acc).otherwise(cut)

    def without(chunk: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), chunk.alias("chunk"))
        return F.aggregate(cuts[i], start, step, lambda acc: F.concat(acc["out"], F.substr(acc["chunk"], acc["at"] + 1)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.array_join(F.transform(chunks, lambda c, i: F.coalesce(without(c, i), c)), "")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", widely: int = WIDELY, mark: str = "<secret>") -> DataFrame:
    """The rows of ``docs`` with live-looking values out of their texts; copied examples stay.

    The spans come back to the rows by id and hash of the text; rows that agree in both have the same text.
    """
    live = judged(docs, id_col, text_col, source_col, widely).select("__id", "__text", F.explode(F.filter("__spans", lambda x: x["live"])).alias("s"))
    each = live.select("__id", "__text", F.col("s.at").alias("at"), F.col("s.end").alias("end"))
    each = each.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / CHUNK).cast("int"), F.floor((F.col("end") - 1) / CHUNK).cast("int"))))
    base = F.col("chunk") * CHUNK
    part = F.struct(F.greatest(F.col("at") - base, F.lit(0)).alias("at"), (F.col("at") >= base).alias("starts"), F.least(F.col("end") - base, F.lit(CHUNK)).alias("end"))
    per = each.groupBy("__id", "__text", "chunk").agg(F.sort_array(F.collect_set(part)).alias("parts"))
    per = per.groupBy("__id", "__text").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "parts"))).alias("__cut"))
    joined = docs.join(per, docs[id_col].eqNullSafe(per["__id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == per["__text"]), "left")
    text = docs[text_col]
    return joined.select(*[F.when(F.col("__cut").isNull(), text).otherwise(cut_out(text, F.col("__cut"), mark)).alias(c) if c == text_col else docs[c] for c in docs.columns])


SQL = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
p as (select * from (values (0, '{ASSIGN.replace("'", "''")}'), (1, '{ACCESS}'), (2, '{HEX}'), (3, '[A-Za-z0-9+/_.=-]+')) v(kind, rx)),
m as (select r, source, kind, regexp_extract_all(t, rx) as ms, string_split_regex(t, rx) as gaps from d, p where regexp_matches(t, rx)),
u as (select r, source, kind, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as i, ms, gaps from m),
s as (select r, source, kind, m, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int as b0 from u
      where case kind when 0 then length(regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2)) >= 12 when 1 then length(m) >= 18 when 2 then true
            else length(m) >= 24 and not regexp_matches(m, '[.=]') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') end),
h as (select *, b0 + length(m) as e, case kind when 0 then regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2) else m end as v from s
      where kind < 3 or not exists (select 1 from s a where a.kind = 0 and a.r = s.r and a.b0 <= s.b0 and a.b0 + length(a.m) >= s.b0 + length(s.m))),
o as (select v, count(distinct (split_part(source, '/', 1), source is null)) as n_owners from h group by v),
k as (select h.*, n_owners from h join o using (v) where kind < 3 or n_owners = 1),
g as (select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
             string_agg(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || b0 || ':' || e, ',' order by b0, kind) as l,
             string_agg(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || b0 || ':' || e, ',' order by b0, kind) filter (kind < 3) as bl,
             count(*) filter (n_owners < {WIDELY}) as live from k group by r)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(bl, '')) as base_sha256,
       coalesce(l, '') as spans, coalesce(live, 0)::bigint as n_live, coalesce(a + b + c + (select count(*) from k where k.r = d.r and kind = 3), 0)::bigint - coalesce(live, 0)::bigint as n_copied
from d left join g using (r)
"""

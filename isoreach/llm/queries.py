"""The queries of this subpackage, op1 to op10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import rotate_perspectives
from .html import extract_main_text
from .licenses import MIN_DICE, TEMPLATES, license_scan
from .mixing import poisson_mix
from .neardup import near_duplicates
from .neighbours import nearest_neighbours
from .pieces import encode, token_counts
from .quality import quality_rules
from .shared import table
from .substrings import repeated_substrings


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "n_target_chars", "text", mask.alias("mask"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "round_trip", "ids")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).drop("text", "lang", "source", "estimate")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_words", "n_tokens")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_perspectives, op2_html_extraction, op3_poisson_mix, op4_nearest_neighbours, op5_sentencepiece, op6_license_scan, op7_substring_dedup, op8_near_duplicates,
        op9_quality_rules, op10_token_counts,
    )
}

_templates = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in TEMPLATES.items())

ORACLE_SQL = {
    "op1_chat_perspectives": r"""
        with lines as (
          select conv_id, turn, case when trim(coalesce(role, '')) = '' then 'unknown' else trim(role) end as speaker,
                 coalesce(text, '') as text, cast(coalesce(floor(turn / 64), -1) as int) as part
          from conversations),
        views as (select distinct conv_id, speaker as perspective from lines where speaker <> 'system'),
        seen as (
          select l.*, v.perspective, (l.speaker = v.perspective) as own,
                 case when l.speaker = 'system' then '<|system|>' || chr(10)
                      when l.speaker = v.perspective then '<|assistant|>' || chr(10)
                      else '<|user name=' || l.speaker || '|>' || chr(10) end as head
          from lines l join views v on l.conv_id is not distinct from v.conv_id),
        said as (select *, head || text || '<|end|>' || chr(10) as message from seen),
        placed as (
          select *, row_number() over w as k, coalesce(sum(length(message)) over (w rows between unbounded preceding and 1 preceding), 0) as start
          from said window w as (partition by conv_id, perspective, part order by turn nulls first, speaker, text))
        select conv_id, perspective, part, count(*) as n_turns,
               cast(sum(case when own then length(message) - length(head) else 0 end) as bigint) as n_target_chars,
               string_agg(message, '' order by k) as text,
               coalesce(string_agg(case when own then cast(start + length(head) as bigint) || '-' || cast(start + length(message) as bigint) end, ',' order by k), '') as mask
        from placed group by conv_id, perspective, part""",
    "op3_poisson_mix": r"""
        with recursive counts as (select source, count(*) as n_docs from documents group by source),
        totals as (select sum(n_docs) as n_all, cast(count(*) as double) as n_sources from counts),
        rates as (select source, 1.0::double / n_sources * n_all / n_docs as rate from counts, totals),
        steps as (select source, cast(greatest(ceil(rate / 256.0), 1) as int) as n_steps, rate / greatest(ceil(rate / 256.0), 1) as step from rates),
        cdf as (
          select source, n_steps, step, 0 as k, exp(-step) as p, exp(-step) as c from steps
          union all
          select source, n_steps, step, k + 1, p * step / (k + 1), c + p * step / (k + 1) from cdf
          where k + 1 <= cast(floor(step + 12 * sqrt(step) + 24) as int)),
        draws as (
          select d.doc_id, d.source, d.rowid_, ('0x' || substr(md5('17:' || j || ':' || coalesce(cast(d.doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0::double as u
          from (select *, row_number() over () as rowid_ from documents) d join steps s on d.source is not distinct from s.source, unnest(range(1, s.n_steps + 1)) t(j)),
        n_copies as (
          select draws.rowid_, count(cdf.k) as n from draws join cdf on draws.source is not distinct from cdf.source and cdf.c <= draws.u group by draws.rowid_),
        numbered as (select *, row_number() over () as rowid_ from documents)
        select d.doc_id, d.text, d.lang, d.source, d.n_chars, cast(g.copy as int) as copy,
               ('0x' || substr(md5('17:order:' || g.copy || ':' || coalesce(cast(d.doc_id as varchar), '')), 1, 15))::bigint as shuffle_key
        from numbered d join n_copies using (rowid_), unnest(range(1, n + 1)) g(copy)""",
    "op6_license_scan": rf"""
        with templates(license, body) as (values {_templates}),
        tw as (select license, list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from templates),
        tb as (select license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from tw),
        base as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') as norm from documents),
        listed as (select doc_id, norm, string_split(norm, chr(10)) as ls, string_split(regexp_replace(norm, '\n(?: ?\n)+', chr(13), 'g'), chr(13)) as ps from base),
        units as (
          select doc_id, 'line' as unit, i - 1 as unit_no, ls[i] as body from listed, unnest(range(1, len(ls) + 1)) t(i)
          union all
          select doc_id, 'paragraph', i - 1, ps[i] from listed, unnest(range(1, len(ps) + 1)) t(i) where contains(trim(ps[i], ' '), chr(10))
          union all
          select doc_id, 'text', 0, norm from listed where len(ps) > 1),
        numbered as (select *, row_number() over () as rid from units),
        uw as (select rid, doc_id, unit, unit_no, list_filter(string_split(replace(body, chr(10), ' '), ' '), lambda x: x <> '') as w from numbered),
        ub as (select rid, doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as a from uw where len(w) > 1),
        met as (
          select rid, doc_id, unit, unit_no, license, len(a) as n, len(b) as m, len(list_intersect(a, b)) as shared
          from ub join tb on len(a) * {200 - MIN_DICE} >= {MIN_DICE} * len(b) and len(a) * {MIN_DICE} <= {200 - MIN_DICE} * len(b)),
        ranked as (
          select *, row_number() over (partition by rid order by 2.0::double * shared / (n + m) desc, license) as k
          from met where 200 * shared >= {MIN_DICE} * (n + m))
        select doc_id, unit, cast(unit_no as bigint) as unit_no, license, n as n_bigrams, shared as n_shared, 2.0::double * shared / (n + m) as dice
        from ranked where k = 1""",
}

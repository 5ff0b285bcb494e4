"""Queries of the general data-processing problems, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.instants import utc_instants
from quadloom.operators.changes import current_triples, triple_state
from quadloom.operators.intervals import periods_and_gaps
from quadloom.operators.pivot import company_table, filled_cells
from quadloom.operators.skew import page_figures
from quadloom.session import table
from quadloom.sources.lines import bad_lines, good_lines


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "app"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_figures(table(spark, sf_dir, "chunk_metas"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_lines(table(spark, sf_dir, "raw_lines")).select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good lines, objects as one text: they hold no comma."""
    return good_lines(table(spark, sf_dir, "raw_lines")).withColumn("objects", F.when(F.col("objects").isNotNull(), F.concat_ws(",", "objects")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc_instants(table(spark, sf_dir, "facts"), table(spark, sf_dir, "feeds"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_triples(table(spark, sf_dir, "change_log"))


def p5_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fold keeps of every key, tombstones included; p5_found has the present ones with their values."""
    state = triple_state(table(spark, sf_dir, "change_log"))
    present = F.coalesce(F.col("_last.in"), F.lit(False)).alias("present")
    return state.select("pid", "s", present, F.col("_last.q.log_count").alias("last_count"), F.col("_v_o.v").alias("last_o"), F.col("_v_t.v").alias("last_t"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(table(spark, sf_dir, "facts"), table(spark, sf_dir, "predicate_map"))


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company table itself, numbers and dates as texts so that every engine shows them alike."""
    wide, attributes = company_table(table(spark, sf_dir, "facts"), table(spark, sf_dir, "predicate_map"))
    return wide.select("s", *[F.col(f"`{a.name}`").cast("string").alias(a.name) for a in attributes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_loaded": p3_loaded,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_state": p5_state,
    "p6_found": p6_found,
    "p6_wide": p6_wide,
}

_DAY = "'[0-9]{4}-[0-9]{2}-[0-9]{2}'"

#: Lines with their terms or fields, and the reason why they are bad.
_LINES = r"""
        with l as (
          select line_id, file_no, trim(line_text, e' \t') as x from raw_lines where line_text is not null),
        m as (
          select line_id, file_no, x, regexp_replace(x, '<[^<>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>]*>)?', chr(1), 'g') as rest,
                 regexp_extract_all(x, '<[^<>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>]*>)?') as terms,
                 length(regexp_replace(regexp_replace(x, '\\.', '', 'g'), '[^"]', '', 'g')) % 2 = 1 as odd
          from l where x <> '' and x not like '#%'),
        t as (
          select line_id, file_no, terms, case
              when odd or regexp_matches(regexp_replace(rest, '[\x01 \t.]', '', 'g'), '[<>"{}\\]') then 'quoting'
              when not regexp_full_match(rest, '[ \t]*(?:\x01[ \t]*){3,4}\.?[ \t]*') then 'columns'
              when terms[1] like '"%' or terms[2] like '"%' or len(list_filter(terms, lambda y: regexp_full_match(y, '<[ \t]*>'))) > 0 then 'value'
              when len(terms) = 4 and not (terms[4] in ('<no>', '<null>') or (regexp_full_match(terms[4], '<[0-9]{4}-[0-9]{2}-[0-9]{2}>')
                   and try_cast(trim(terms[4], '<>') as date) is not null)) then 'value'
              when terms[3] like '%"^^<%' and not coalesce(case regexp_extract(terms[3], '\^\^<([^<>]*)>$', 1)
                  when 'xsd:integer' then regexp_full_match(v, '[+-]?[0-9]+')
                  when 'xsd:decimal' then regexp_full_match(v, '[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)')
                  when 'xsd:date' then regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(v as date) is not null
                  when 'xsd:boolean' then v in ('true', 'false', '1', '0') else false end, false) then 'value' end as reason
          from (select *, regexp_extract(terms[3], '^"(.*)"\^\^', 1) as v from m where x not like '{%')),
        h as (
          select line_id, file_no, x, string_split(regexp_extract(x, '^\{([^{}]*),[ \t]*\{', 1), ',') as f, regexp_extract(x, '\{[ \t]*([^{}]*)\}[ \t]*\}', 1) as objects
          from m where x like '{%'),
        g as (
          select line_id, file_no, f, objects, case
              when length(regexp_replace(x, '[^{]', '', 'g')) <> length(regexp_replace(x, '[^}]', '', 'g')) then 'quoting'
              when not regexp_full_match(x, '\{[^{}]*,[ \t]*\{[ \t]*[^{} \t][^{}]*\}[ \t]*\}[ \t]*\.?') or len(f) <> 4 then 'columns'
              when trim(f[1], e' \t') = '' or trim(f[2], e' \t') = '' or len(list_filter(string_split(objects, ','), lambda y: trim(y, e' \t') = '')) > 0
                   or len(list_filter([trim(f[3], e' \t'), trim(f[4], e' \t')], lambda y: not (y in ('no', 'null')
                        or (regexp_full_match(y, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(y as date) is not null)))) > 0 then 'value' end as reason
          from h)"""
_GOOD = _LINES + r""",
        good as (
          select line_id, file_no, 'triple' as kind, terms[1][2:-2] as s, terms[2][2:-2] as p,
                 case when terms[3] like '<%' then terms[3][2:-2] else regexp_replace(regexp_extract(terms[3], '^"((?:[^"\\]|\\.)*)"', 1), '\\(.)', '\1', 'g') end as o,
                 case when terms[3] like '<%' then 'term' else 'literal' end as o_kind,
                 case when terms[3] like '"%' then nullif(regexp_extract(terms[3], '^"(?:[^"\\]|\\.)*"@(.*)$', 1), '') end as lang,
                 case when terms[3] like '"%' then nullif(regexp_extract(terms[3], '^"(?:[^"\\]|\\.)*"\^\^<xsd:(.*)>$', 1), '') end as type,
                 coalesce(terms[4][2:-2], 'no') as t, cast(null as varchar) as t_end, cast(null as varchar) as objects
          from t where reason is null
          union all
          select line_id, file_no, 'hyper', trim(f[2], e' \t'), trim(f[1], e' \t'), null, null, null, null, trim(f[3], e' \t'), trim(f[4], e' \t'),
                 array_to_string(list_transform(string_split(objects, ','), lambda y: trim(y, e' \t')), ',')
          from g where reason is null)"""

ORACLES: dict[str, str] = {
    "p3_found": _LINES + " select line_id, reason from t where reason is not null union all select line_id, reason from g where reason is not null",
    "p3_loaded": _GOOD + " select * from good",
    "lines_loaded": _GOOD + " select s, p, o, t from good where kind = 'triple'",
    "p1_found": f"""
        with r as (
          select distinct hid, cast(try_strptime(stime, '%Y-%m-%d') as date) a,
                 case when etime = 'null' then date '9999-12-31' + 1000 else cast(try_strptime(etime, '%Y-%m-%d') as date) end b
          from app
          where regexp_full_match(stime, {_DAY}) and (etime = 'null' or regexp_full_match(etime, {_DAY}))),
        g as (select *, max(b) over (partition by hid order by a, b rows between unbounded preceding and 1 preceding) m
              from r where a is not null and b >= a and hid is not null),
        h as (select *, sum(case when m is null or a > m + 1 then 1 else 0 end) over (partition by hid order by a, b rows unbounded preceding) k from g),
        q as (select hid, k, min(a) a, max(b) b from h group by hid, k),
        z as (select *, lead(a) over (partition by hid order by a) n from q)
        select hid, 'period' as kind, strftime(a, '%Y-%m-%d') as first_day,
               case when b > date '9999-12-31' then 'null' else strftime(b, '%Y-%m-%d') end as last_day from z
        union all
        select hid, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(n - 1, '%Y-%m-%d') from z where n is not null""",
    "p2_found": """
        with x as (
          select pid, page_no, coalesce(triple_count, 0) n,
                 row_number() over (partition by page_no order by update_count desc nulls last, triple_count desc nulls last, pid desc nulls last) k
          from chunk_metas where page_no is not null)
        select pid, cast(count(*) as bigint) as n_pages, cast(sum(n) as bigint) as n_triples, cast(max(n) as bigint) as max_triples
        from x where k = 1 and pid is not null group by pid""",
    "p5_found": """
        with c as (
          select distinct page_no, pid, log_count, upper(left(trim(operation_type), 1)) op, s, o, t, max(min_t) over (partition by page_no) mt
          from change_log),
        l as (
          select pid, s, max((mt, log_count, page_no)) filter (op in ('I', 'D')) k,
                 arg_max(op, (mt, log_count, page_no)) filter (op in ('I', 'D')) last_op
          from c group by pid, s)
        select c.pid as pid, c.s as s,
               arg_max_null(o, (mt, log_count, page_no)) filter (op = 'I' or o is not null) as o,
               arg_max_null(t, (mt, log_count, page_no)) filter (op = 'I' or t is not null) as t
        from c join l on c.pid is not distinct from l.pid and c.s is not distinct from l.s
        where last_op = 'I' and (mt, log_count, page_no) >= k and op <> 'D'
        group by c.pid, c.s""",
    "p5_state": """
        with c as (
          select distinct page_no, pid, log_count, upper(left(trim(operation_type), 1)) op, s, o, t, max(min_t) over (partition by page_no) mt
          from change_log)
        select pid, s, coalesce(arg_max(op, (mt, log_count, page_no)) filter (op in ('I', 'D')) = 'I', false) as present,
               arg_max(log_count, (mt, log_count, page_no)) filter (op in ('I', 'D')) as last_count,
               arg_max_null(o, (mt, log_count, page_no)) filter (op = 'I' or (op = 'U' and o is not null)) as last_o,
               arg_max_null(t, (mt, log_count, page_no)) filter (op = 'I' or (op = 'U' and t is not null)) as last_t
        from c group by pid, s""",
}

#: Facts of single-valued attributes with the plain text of their value; digits are those of ASCII and full width.
_PLAIN = r"""
        with f as (
          select fact_id, s, a.pred_name as p, a.value_type as k, trim(o, e' \t\r\n　') as x,
                 translate(trim(o, e' \t\r\n　'), '０１２３４５６７８９', '0123456789') as y
          from facts join predicate_map a on lower(trim(facts.p, e' \t\r\n')) = a.pred_name
          where a.multi = false and s like 'company/%'),
        n as (
          select *, case when k in ('integer', 'decimal') and regexp_full_match(y,
                '[+-]?(?:(?:[0-9]{1,3}(?:(?:,[0-9]{3})+|(?: [0-9]{3})+|(?:''[0-9]{3})+|(?:_[0-9]{3})+)|[0-9]+)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?')
              then try_cast(regexp_replace(y, '[, ''_]', '', 'g') as decimal(38, 10)) end as num,
              case when k = 'date' then case
                when regexp_full_match(y, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') then try_strptime(y, '%Y-%m-%d')
                when regexp_full_match(y, '[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}') then try_strptime(y, '%Y/%m/%d')
                when regexp_full_match(y, '[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}') then try_strptime(y, '%Y.%m.%d')
                when regexp_full_match(y, '[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日') then try_strptime(y, '%Y年%m月%d日')
                when regexp_full_match(y, '[0-9]{8}') then try_strptime(y, '%Y%m%d')
                when regexp_full_match(y, '[0-9]{1,2} [A-Za-z]{3} [0-9]{4}') then try_strptime(y, '%d %b %Y') end end as d
          from f),
        v as (
          select fact_id, s, p, case k
              when 'string' then nullif(x, '')
              when 'integer' then case when num = floor(num) then cast(cast(num as decimal(38, 0)) as varchar) end
              when 'decimal' then cast(cast(num as decimal(38, 2)) as varchar)
              when 'date' then strftime(d, '%Y-%m-%d')
              when 'boolean' then case when lower(x) in ('true', 't', 'yes', 'y', '1', '是') then 'true' when lower(x) in ('false', 'f', 'no', 'n', '0', '否') then 'false' end end as v
          from n)"""
ORACLES["p6_found"] = _PLAIN + "select s, p, arg_max(v, fact_id) as v from v where v is not null group by s, p"
_ATTRIBUTES = (
    "std_name", "ent_kind", "reg_no", "reg_capital", "paid_capital", "staff_count", "branch_count", "founded_on", "approved_on", "term_start", "term_end",
    "is_listed", "is_exporter", "reg_status", "audit_grade", "permit_count",
)
ORACLES["p6_wide"] = _PLAIN + "select s, " + ", ".join(f"arg_max(v, fact_id) filter (p = '{a}' and v is not null) as {a}" for a in _ATTRIBUTES) + " from v group by s"

# The layouts that the table holds. Where the clock shows a time twice, the engine's zone function takes the second
# reading; if an hour earlier shows the same time, that is the first.
ORACLES["p4_found"] = r"""
        with f as (
          select fact_id, trim(t) as t, coalesce(zone_id, 'UTC') as z, coalesce(day_first, true) as day_first
          from facts left join feeds on facts.src = feeds.src
          where t is not null and trim(t) not in ('no', 'null', '') and not regexp_full_match(trim(t), '[0-9]{4}-[0-9]{2}-[0-9]{2}')),
        w as (
          select fact_id, z, case
              when regexp_full_match(t, '[0-9]{1,11}') then make_timestamp(cast(t as bigint) * 1000000)
              when regexp_full_match(t, '[0-9]{12,14}') then make_timestamp(cast(t as bigint) * 1000)
              when regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]')
                then try_cast(left(t, 10) || ' ' || regexp_extract(t, '^.{11}([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)', 1) || case when t like '____-__-_____:__:%' then '' else ':00' end as timestamp)
              when regexp_matches(t, '^[0-9]{8}T') then try_strptime(left(t, 15), '%Y%m%dT%H%M%S')
              when regexp_matches(t, '^[0-9]{2}\.') then try_strptime(t, '%d.%m.%Y %H:%M:%S')
              when regexp_matches(t, '^[0-9]{2}/.*M$') then case when day_first then try_strptime(t, '%d/%m/%Y %I:%M %p') else try_strptime(t, '%m/%d/%Y %I:%M %p') end
              when regexp_matches(t, '^[0-9]{2}/') then case when day_first then try_strptime(t, '%d/%m/%Y %H:%M') else try_strptime(t, '%m/%d/%Y %H:%M') end
              when regexp_matches(t, '^[0-9]{1,2} [A-Za-z]{3} ') then try_strptime(t, '%d %b %Y, %I:%M:%S %p')
              when regexp_matches(t, '^[A-Za-z]{3}, ') then try_strptime(regexp_extract(t, '^.{5}(.*:[0-9]{2}) ', 1), '%d %b %Y %H:%M:%S')
              when t like '%年%' then try_strptime(regexp_replace(t, '[年月日时分秒 ]+', ' ', 'g'), '%Y %m %d %H %M %S ') end as wall,
            case when regexp_full_match(t, '[0-9]{12,14}') then right(t, 3) when t like '%.%' and t like '%-%' then regexp_extract(t, '\.([0-9]+)', 1) else '' end as frac,
            case when regexp_full_match(t, '[0-9]+') then 'Z'
              when regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]') then regexp_extract(t, '^.{11}[0-9:.]+(.*)$', 1)
              when regexp_matches(t, '^[0-9]{8}T') then substr(t, 16)
              when regexp_matches(t, '^[A-Za-z]{3}, ') then regexp_extract(t, ':[0-9]{2}( .*)$', 1)
              else '' end as tail
          from f),
        x as (
          select *, case when tail in ('Z', ' GMT', ' UTC') then 0 when tail = ' EDT' then -240 when tail = ' EST' then -300 when tail = ' CET' then 60 when tail = ' CEST' then 120
              when regexp_matches(tail, '[+-][0-9]') then (case when regexp_extract(tail, '([+-])[0-9]', 1) = '-' then -1 else 1 end)
                * (coalesce(try_cast(regexp_extract(tail, '[+-]([0-9]{1,2})', 1) as int), 0) * 60 + coalesce(try_cast(regexp_extract(tail, '[+-][0-9]{1,2}:?([0-9]{2})$', 1) as int), 0)) end as off,
            coalesce(nullif(regexp_extract(tail, '\[(.*)\]', 1), ''), z) as zone
          from (select *, regexp_extract(tail, '([^ ].*)', 1) as bare from w) where wall is not null),
        u as (
          select fact_id, frac, case when off is not null then wall - to_minutes(off)
              when timezone(zone, timezone(zone, wall) - interval 1 hour) = wall then timezone('UTC', timezone(zone, wall) - interval 1 hour)
              else timezone('UTC', timezone(zone, wall)) end as moment
          from x)
        select fact_id, strftime(moment, '%Y-%m-%dT%H:%M:%S') || '.' || left(frac || '000000', 6) || 'Z' as t_utc from u"""

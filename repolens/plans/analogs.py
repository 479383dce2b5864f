"""The operators over star-schema and text tables, each with the same query as DuckDB SQL.

Events ordered by descending time are a commit chain, documents are blobs, page addresses
are file paths, event properties are JSON files, order lines are live intervals.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_query import number, object_counts
from ..functions.lines import content_matching_lines, first_matches, matching_lines
from ..functions.patterns import glob_matches
from ..functions.values import first_number, loose_datetime, number_text
from ..operators import history as H
from ..operators import tools
from ..operators.loc import count_lines
from ..operators.measures import FileCount, Grep, StatConfig
from ..operators.reshape import dictionary, top_n, unpivot, wide
from ..operators.sampling import Granularity, first_per_bucket, in_range
from .engine import measured, series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a chain: the latest is its tip. Event ids grow with time."""
    events = read(spark, sf_dir, "events")
    return events.select((-F.col("event_id")).alias("chain_pos"), "event_id", "ts", "event_type")


def _sampled(spark: SparkSession, sf_dir: str, g: Granularity) -> DataFrame:
    return first_per_bucket(chain(spark, sf_dir), g).select("bucket", "event_id", "event_type")


def _sample_sql(key: str) -> str:
    return f"select bucket, event_id, event_type from (select {key} as bucket, event_id, event_type, row_number() over (partition by {key} order by event_id desc) as n from events) where n = 1"


@query(_sample_sql("strftime(ts, '%Y-%m-%d')"))
def sample_daily(spark, sf_dir):
    return _sampled(spark, sf_dir, Granularity("daily"))


@query(_sample_sql("strftime(ts, '%Y-%m-%d %H')"))
def sample_hourly(spark, sf_dir):
    return _sampled(spark, sf_dir, Granularity("hourly"))


@query(_sample_sql("strftime(ts, '%Y-%m')"))
def sample_monthly(spark, sf_dir):
    return _sampled(spark, sf_dir, Granularity("monthly"))


@query(_sample_sql("strftime(cast(ts as date) - cast(dayofweek(ts) as integer), '%Y-%m-%d')"))
def sample_weekly_sunday(spark, sf_dir):
    return _sampled(spark, sf_dir, Granularity("weekly"))


@query(_sample_sql("strftime(ts, '%Y-%m-%d') || ' ' || lpad(cast(hour(ts) // 6 * 6 as varchar), 2, '0')"))
def sample_every_6h(spark, sf_dir):
    return _sampled(spark, sf_dir, Granularity.every(6))


@query("select event_id, event_type from events")
def sample_unsampled(spark, sf_dir):
    return _sampled(spark, sf_dir, Granularity("infinite")).select("event_id", "event_type")


@query("""select event_id from (select event_id, ts, max(case when ts < timestamp '2024-01-10' then 1 else 0 end)
  over (order by event_id desc rows between unbounded preceding and current row) as stopped from events)
  where stopped = 0 and ts <= timestamp '2024-01-20 12:00:00'""")
def range_take_while(spark, sf_dir):
    c = chain(spark, sf_dir)
    return in_range(c, datetime(2024, 1, 10), datetime(2024, 1, 20, 12)).select("event_id")


@query("""select lang, cast(sum(len(list_filter(string_split(case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end, chr(10)), lambda l: regexp_matches(l, 'the|der')))) as bigint) as n_lines
  from documents where text <> '' group by lang""")
def grep_lines_by_lang(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text <> ''").groupBy("lang").agg(F.sum(matching_lines(F.col("text"), "the|der")).alias("n_lines"))


@query("""select doc_id, cast(case when text = '' then 0 else len(list_filter(string_split(case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end, chr(10)), lambda l: regexp_matches(l, '[a-z]ing'))) end as bigint) as n_lines from documents""")
def grep_lines_exact(spark, sf_dir):
    """Over bytes, as files are."""
    return read(spark, sf_dir, "documents").select("doc_id", content_matching_lines(F.encode("text", "UTF-8"), "[a-z]ing").alias("n_lines"))


@query("""select doc_id, cast(n as int) as line, regexp_extract(l, '([a-z]+tion)', 1) as first_match from
  (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
  where regexp_matches(l, '[a-z]+tion')""")
def grep_first_match(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(first_matches(F.col("text"), "[a-z]+tion")).alias("m")).select("doc_id", F.col("m.line").alias("line"), F.col("m.match").alias("first_match"))


@query("select count(*) filter (regexp_full_match(url, '(?s).*/[a-m].*')) as n_files, count(*) filter (regexp_full_match(url, '(?s)https?://.*/e.*')) as n_pages from pages where not ends_with(url, '/')")
def file_count_glob(spark, sf_dir):
    """Through the measurement of files, with two patterns."""
    files = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.lit("").alias("oid"))
    count = lambda pattern, name: FileCount(pattern=pattern).measure(files).agg(F.coalesce(F.sum("value"), F.lit(0)).alias(name))
    return count("*/[a-m]*", "n_files").crossJoin(count("http{s,}://*/e*", "n_pages"))


@query("""select source, cast(sum(len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'the')))) as bigint) as n_lines from documents
  where regexp_full_match(source || '/' || lang || '/' || doc_id || '.txt', 'src1.*/en/.*[.]txt') group by source""")
def path_filter_then_count(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return docs.filter(glob_matches(F.col("path"), "src1*/en/*.txt")).groupBy("source").agg(F.sum(matching_lines(F.col("text"), "the")).alias("n_lines"))


@query("select event_type, sum(cast(json_extract(props, '$.k') as double)) as total from events group by event_type")
def json_number_sum(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(number(F.encode("props", "UTF-8"), ".k")).alias("total"))


@query("select event_type, cast(sum(len(json_keys(props))) as double) as n_keys from events group by event_type")
def json_key_count(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(number(F.encode("props", "UTF-8"), "keys | length")).alias("n_keys"))


@query("select 'jq_obj_query_._' || k as key, cast(sum(cast(json_extract(props, '$.' || k) as bigint)) as bigint) as total from (select props, unnest(json_keys(props)) as k from events) group by 1")
def json_object_merge(spark, sf_dir):
    pairs = read(spark, sf_dir, "events").select(F.explode(object_counts(F.encode("props", "UTF-8"), ".")).alias("k", "v"))
    return pairs.groupBy(F.concat(F.lit("jq_obj_query_._"), "k").alias("key")).agg(F.sum("v").alias("total"))


def _json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each event: its properties, a list of numbers that it gives rise to, and its user's name; every seventh has a second document behind it, every eleventh a number beyond the doubles."""
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.concat(F.lit('{"p":'), "props", F.lit(',"l":['), F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda i: (k + i).cast("string")), ","), F.lit('],"u":"u'), F.col("user_id").cast("string"), F.lit('","t":"'), "event_type", F.lit('"'), F.when(F.col("event_id") % 11 == 0, ',"big":1e400').otherwise(""), F.lit("}"), F.when(F.col("event_id") % 7 == 0, " {}").otherwise(""))
    return events.select("event_id", "event_type", F.encode(text, "UTF-8").alias("content"))


_JSON_SQL = """with e as (select event_id, event_type, user_id, cast(json_extract(props, '$.k') as bigint) as k, event_id % 7 <> 0 and event_id % 11 <> 0 as good from events),
  v as (select event_id, event_type, case when good then cast(VALUE as double) end as v from e)
  select event_type, count(v) as n_files, sum(v) as total from v group by event_type"""


def _json_query(name: str, filter_: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = number(F.col("content"), filter_)
        return _json_files(spark, sf_dir).select("event_type", value.alias("v")).groupBy("event_type").agg(F.count("v").alias("n_files"), F.sum("v").alias("total"))

    run.__name__ = name
    query(_JSON_SQL.replace("VALUE", sql))(run)


_json_query("jq_map_add", ".l | map(. * 2 + 1) | add", "(2 * k + 1) * (k % 4 + 1) + (k % 4) * (k % 4 + 1)")
_json_query("jq_select_length", "[.l[] | select(. % 2 == 0)] | length", "len(list_filter(range(k, k + k % 4 + 1), lambda x: x % 2 = 0))")
_json_query("jq_to_entries", ".p | to_entries | map(select(.key == \"k\" and .value > 50)) | length", "case when k > 50 then 1 else 0 end")
_json_query("jq_alternative", "(.p.missing // .p.k) - .l[-1]", "-(k % 4)")
_json_query("jq_several_outputs", ".l[]", "case when k % 4 = 0 then k else 0 end")
_json_query("jq_condition_object", "if .t == \"click\" then {n: .l[0], m: 1} | .n + .m else (.u | length) end", "case when event_type = 'click' then k + 1 else length('u' || user_id) end")
_json_query("jq_runtime_error", ".u + 1", "0")


@query("""select lang, cast(sum(len(list_filter(l, lambda x: regexp_full_match(x, '\\s*')))) as bigint) as blanks, cast(sum(len(list_filter(l, lambda x: not regexp_full_match(x, '\\s*')))) as bigint) as code
  from (select lang, string_split(case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end, chr(10)) as l from documents where text <> '') group by lang""")
def loc_blank_code_by_group(spark, sf_dir):
    """Line counts of the documents as files of a language without comments."""
    docs = read(spark, sf_dir, "documents").filter("text <> ''")
    files = docs.select(F.concat_ws("/", "lang", F.concat("doc_id", F.lit(".json"))).alias("path"), F.col("doc_id").cast("string").alias("oid"), F.encode("text", "UTF-8").alias("content"))
    counted = count_lines(files)
    return counted.groupBy(F.nullif(F.substring_index("path", "/", 1), F.col("path")).alias("lang")).agg(F.sum("blanks").alias("blanks"), F.sum("code").alias("code"))


def _line_counts(counted: DataFrame, key: str) -> DataFrame:
    """Summed line counts by the first component of the path, language, and whether the lines are inside a file of another."""
    of = counted.groupBy(F.substring_index("path", "/", 1).alias(key), "language", F.col("host").isNotNull().alias("embedded"))
    return of.agg(*[F.sum(c).alias(c) for c in ("blanks", "code", "comments")])


@query("""with files as (select split_part(url, ':', 1) as scheme, regexp_replace(html, '(<!--.*?-->)', chr(10) || '\\1' || chr(10), 'g') as html from pages where html is not null and url is not null),
  rows as (select scheme, 'HTML' as language, false as embedded, unnest(string_split(regexp_replace(html, '(?s)(<(?:style|script)>).*?(</(?:style|script)>)', '\\1' || chr(10) || '\\2', 'g') || chr(10) || 'x', chr(10))[:-2]) as s from files
    union all select scheme, 'CSS', true, unnest(string_split(array_to_string(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1), chr(10)), chr(10))) from files
    union all select scheme, 'JavaScript', true, unnest(string_split(array_to_string(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1), chr(10)), chr(10))) from files)
  select scheme, language, embedded, cast(count(*) filter (regexp_full_match(s, '\\s*')) as bigint) as blanks, cast(count(*) filter (not regexp_full_match(s, '\\s*|\\s*<!--.*-->\\s*')) as bigint) as code,
    cast(count(*) filter (regexp_full_match(s, '\\s*<!--.*-->\\s*')) as bigint) as comments from rows group by scheme, language, embedded""")
def loc_embedded_markup(spark, sf_dir):
    """Pages as markup whose scripts, styles and comments have lines of their own: those of the blocks count for their own language."""
    html = F.regexp_replace("html", "(<!--.*?-->)", "\n$1\n")
    html = F.regexp_replace(F.regexp_replace(html, "(<(?:style|script)>)", "$1\n"), "(</(?:style|script)>)", "\n$1")
    pages = read(spark, sf_dir, "pages").filter("html is not null and url is not null")
    path = F.concat_ws("/", F.substring_index("url", ":", 1), F.concat("page_id", F.lit(".html")))
    files = pages.select(path.alias("path"), F.col("page_id").cast("string").alias("oid"), F.encode(html, "UTF-8").alias("content"))
    return _line_counts(count_lines(files), "scheme")


@query("""with lines as (select coalesce(lang, 'none') as lang, unnest(string_split(text, chr(10))) as s from documents where text is not null),
  counts as (select lang, count(*) filter (regexp_full_match(s, '\\s*')) as b, count(*) filter (not regexp_full_match(s, '\\s*')) as c from lines group by lang),
  docs as (select coalesce(lang, 'none') as lang, count(*) as n from documents where text is not null group by all)
  select lang, 'Markdown' as language, false as embedded, cast(b as bigint) as blanks, cast(0 as bigint) as code, cast(c + 2 * n as bigint) as comments from counts join docs using (lang)
  union all select lang, 'JSON', true, cast(b as bigint), cast(c as bigint), cast(0 as bigint) from counts""")
def loc_fenced_blocks(spark, sf_dir):
    """Documents as prose with themselves in a fence below: once comment, once code of the language that the fence names."""
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    text = F.replace(F.replace("text", F.lit("`"), F.lit("'")), F.lit("~"), F.lit("-"))
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.concat("doc_id", F.lit(".md")))
    content = F.concat(text, F.lit("\n```json\n"), text, F.lit("\n```\n"))
    files = docs.select(path.alias("path"), F.col("doc_id").cast("string").alias("oid"), F.encode(content, "UTF-8").alias("content"))
    return _line_counts(count_lines(files), "lang")


@query("""select source, lang, chars from (select *, row_number() over (partition by source order by chars desc, lang) as n from
  (select source, lang, cast(sum(n_chars) as bigint) as chars from documents group by source, lang)) where n <= 2""")
def topn_per_group(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("chars"))
    return top_n(rows, 2, ("source",), "chars", "lang")


@query("""select source, cast(sum(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, 'tion')))) as bigint) as n_lines, count(*) as n_docs from documents
  where regexp_matches(text, 'tion') group by source""")
def dedupe_measure_join(spark, sf_dir):
    """Each distinct content is read once and measured once for each path that has it."""
    docs = read(spark, sf_dir, "documents").select("source", F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("oid"), F.encode("text", "UTF-8").alias("content"))
    values = measured(docs.select("path", "oid"), docs.select("oid", "content"), Grep(pattern="tion"))
    return docs.select("source", "path", "oid").join(values, ["path", "oid"]).groupBy("source").agg(F.sum("value").alias("n_lines"), F.count("*").alias("n_docs"))


@query("select md5(text) as oid, array_to_string(list_sort(list(distinct source)), ',') as names from documents group by 1")
def names_per_blob(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.md5("text").alias("oid"), F.concat_ws("/", F.lit("docs"), "source").alias("path"))
    return H.names_of_contents(files).select("oid", F.array_join("names", ",").alias("names"))


@query("select source, cast(dense_rank() over (order by source) - 1 as bigint) as idx from (select distinct source from documents)")
def dictionary_encode(spark, sf_dir):
    return dictionary(read(spark, sf_dir, "documents").select("source"), "source")


@query("""with c as (select cast(o_orderdate as date) as d, o_orderpriority as key, count(*) as n from orders group by 1, 2),
  g as (select d, key from (select distinct d from c), (select distinct key from c)),
  t as (select g.d, g.key, sum(coalesce(n, 0)) over (partition by g.key order by g.d) as total from g left join c on c.d = g.d and c.key = g.key)
  select d, key, cast(total as bigint) as total from t where total > 0""")
def running_total_delta(spark, sf_dir):
    """Orders per priority, carried to every day: days are positions that count down, as along a chain. Small blocks, so that sums cross them."""
    orders = read(spark, sf_dir, "orders").select((-F.unix_date(F.col("o_orderdate").cast("date"))).alias("chain_pos"), F.col("o_orderpriority").alias("key"))
    steps = orders.select("chain_pos", "key", F.lit(1).cast("long").alias("value"), F.lit(1).cast("long").alias("n"))
    totals = H.running_totals(orders.select("chain_pos").distinct(), steps, 100)
    return totals.select(F.date_from_unix_date(-F.col("chain_pos")).alias("d"), "key", "total")


@query("""with days as (select distinct date_trunc('month', o_orderdate)::date as d from orders),
  s as (select d, k from days, (select distinct o_orderpriority as k from orders))
  select s.d, s.k as key, cast(count(*) as bigint) as total from s join orders o on o.o_orderpriority = s.k and cast(o.o_orderdate as date) <= s.d group by 1, 2""")
def running_totals_at_samples(spark, sf_dir):
    """The delta form: what each day adds, carried to the sampled days."""
    orders = read(spark, sf_dir, "orders")
    steps = orders.select((-F.unix_date(F.col("o_orderdate").cast("date"))).alias("chain_pos"), F.col("o_orderpriority").alias("key"), F.lit(1).cast("long").alias("value"), F.lit(1).cast("long").alias("n"))
    days = orders.select((-F.unix_date(F.trunc(F.col("o_orderdate").cast("date"), "month"))).alias("chain_pos")).distinct()
    return H.running_totals(days, steps).select(F.date_from_unix_date(-F.col("chain_pos")).alias("d"), "key", "total")


@query("""with days as (select distinct date_trunc('month', o_orderdate)::date as d from orders),
  s as (select d, k from days, (select distinct o_custkey % 50 as k from orders))
  select s.d, cast(s.k as varchar) as key, cast(count(*) as bigint) as total from s join orders o on o.o_custkey % 50 = s.k and cast(o.o_orderdate as date) <= s.d group by 1, 2""")
def running_totals_of_segments(spark, sf_dir):
    """Sums that are kept as a chain grows: three segments of days with their block sums, which add up to those of all days."""
    orders = read(spark, sf_dir, "orders")
    steps = orders.select((-F.unix_date(F.col("o_orderdate").cast("date"))).alias("chain_pos"), (F.col("o_custkey") % 50).cast("string").alias("key"), F.lit(1).cast("long").alias("value"), F.lit(1).cast("long").alias("n"))
    cuts = [-19500, -19000]
    parts = [steps.filter(F.col("chain_pos") <= cuts[0]), steps.filter((F.col("chain_pos") > cuts[0]) & (F.col("chain_pos") <= cuts[1])), steps.filter(F.col("chain_pos") > cuts[1])]
    sums = [H.block_sums(p, 64) for p in parts]
    days = orders.select((-F.unix_date(F.trunc(F.col("o_orderdate").cast("date"), "month"))).alias("chain_pos")).distinct()
    totals = H.running_totals(days, steps, 64, blocks=sums[0].unionAll(sums[1]).unionAll(sums[2]))
    return totals.select(F.date_from_unix_date(-F.col("chain_pos")).alias("d"), "key", "total")


@query("""with days as (select distinct date_trunc('month', o_orderdate)::date as d from orders)
  select d, count(*) as n_live, cast(sum(l_quantity) as bigint) as quantity from days join
  (select cast(o_orderdate as date) as a, cast(l_shipdate as date) as b, l_quantity from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate) on a <= d and d < b group by d""")
def interval_live_at_sample(spark, sf_dir):
    """The interval form: order lines that are on their way at the start of each month."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate > o_orderdate")
    day = lambda c: -F.unix_date(F.col(c).cast("date"))
    files = both.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.col("l_quantity").cast("string").alias("oid"), day("o_orderdate").alias("from_pos"), day("l_shipdate").alias("to_pos"))
    days = orders.select((-F.unix_date(F.trunc(F.col("o_orderdate").cast("date"), "month"))).alias("chain_pos")).distinct()
    return H.live(days, files, 64).groupBy(F.date_from_unix_date(-F.col("chain_pos")).alias("d")).agg(F.count("*").alias("n_live"), F.sum(F.col("oid").cast("double")).cast("long").alias("quantity"))


@query("""with days as (select distinct date_trunc('month', o_orderdate)::date as d from orders)
  select d, l_returnflag as key, round(fsum(l_extendedprice), 2) as total from days join
  (select cast(o_orderdate as date) as a, cast(l_shipdate as date) as b, l_returnflag, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate) on a <= d and d < b group by d, l_returnflag""")
def live_sums_at_samples(spark, sf_dir):
    """Prices of the order lines that are on their way at the start of each month, by flag: lines of the same months are summed first, and exactly."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate > o_orderdate")
    day = lambda c: (-F.unix_date(F.col(c).cast("date"))).cast("int")
    valued = both.select(F.col("l_returnflag").alias("key"), F.col("l_extendedprice").alias("value"), day("o_orderdate").alias("from_pos"), day("l_shipdate").alias("to_pos"))
    days = orders.select((-F.unix_date(F.trunc(F.col("o_orderdate").cast("date"), "month"))).cast("int").alias("chain_pos")).distinct()
    return H.live_totals(days, valued, 64).select(F.date_from_unix_date(-F.col("chain_pos")).alias("d"), "key", F.round("total", 2).alias("total"))


@query("""with c as (select cast(ts as date) as d, event_type as k, count(*) as n from events group by 1, 2)
  select s.d, s.k as key, coalesce(cast(c.n as varchar), '0') as value from (select d, k from (select distinct d from c), (select distinct k from c)) s left join c on c.d = s.d and c.k = s.k""")
def pivot_fill_zero(spark, sf_dir):
    """To the wide table and back: every day has every key."""
    events = read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("d"), F.col("event_type").alias("key"))
    counts = events.groupBy("d", "key").agg(F.count("*").cast("string").alias("value"))
    return unpivot(wide(events.select("d").distinct(), counts, ("d",)), ("d",))


RULES = "select * from values (0L, 'any', array('*/p*', '*.html', '*1*'), array('*en*')), (1L, 'names', array('index.html', 'about', '/x'), array('en', 'docs', 'blog')), (2L, 'roots', array('/README'), array('/https:')) as t(rule_pos, name, files, dirs)"
_RULES_SQL = "(values (0, 'any', '*/p*', '.*/p.*'), (0, 'any', '*.html', '.*[.]html'), (0, 'any', '*1*', '.*1.*'))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select(F.lit("r").alias("repo_path"), F.col("page_id").alias("file_pos"), F.col("url").alias("path"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("repo_path", F.split("path", "/")[2])


@query(f"""select pattern, page_id from (select pattern, page_id, row_number() over (partition by pattern order by page_id) as n from {_RULES_SQL} r(rule_pos, name, pattern, rx) join pages on regexp_full_match(url, rx)) where n <= 10""")
def rule_join_wildcard_cap10(spark, sf_dir):
    patterns = tools.explode_rules(spark.sql(RULES)).filter("kind = 'glob'")
    return tools.file_hits(_files(spark, sf_dir), patterns).select("pattern", F.col("file_pos").alias("page_id"))


_DETECT_SQL = """with f as (select page_id, url, string_split(url, '/') as parts from pages),
  fp as (values (0, 'any', '*/p*', 'g', '.*/p.*'), (0, 'any', '*.html', 'g', '.*[.]html'), (0, 'any', '*1*', 'g', '.*1.*'), (1, 'names', 'index.html', 'n', ''), (1, 'names', 'about', 'n', ''), (1, 'names', '/x', 'r', ''), (2, 'roots', '/README', 'r', '')),
  dp as (values (0, 'any', '*en*', 'g', '.*en.*'), (1, 'names', 'en', 'n', ''), (1, 'names', 'docs', 'n', ''), (1, 'names', 'blog', 'n', ''), (2, 'roots', '/https:', 'r', '')),
  fh as (select *, row_number() over (partition by p.col2 order by page_id) as n from f join fp p(col0, col1, col2, col3, col4) on
    case p.col3 when 'g' then regexp_full_match(url, p.col4) when 'r' then '/' || url = p.col2 else parts[-1] = p.col2 end),
  dh as (select distinct p.col0, p.col1, p.col2 from f join dp p(col0, col1, col2, col3, col4) on
    case p.col3 when 'g' then regexp_full_match(url, p.col4) when 'r' then starts_with('/' || url, p.col2) else list_contains(parts, p.col2) end),
  h as (select col0, col1, url as hit, 'f' as s from fh where col3 <> 'g' or n <= 10 union all select col0, col1, col2, 'd' from dh)
  select col1 as name, coalesce(array_to_string(list_sort(list(distinct hit) filter (s = 'f')), ','), '') as matching_files, coalesce(array_to_string(list_sort(list(distinct hit) filter (s = 'd')), ','), '') as matching_dirs from h group by col0, col1"""


@query(_DETECT_SQL)
def tool_match_arrays(spark, sf_dir):
    """The whole rule join: names, roots, globs with their cap, directories."""
    found = tools.detect(_files(spark, sf_dir), spark.sql(RULES))
    return found.select("name", F.array_join("matching_files", ",").alias("matching_files"), F.array_join("matching_dirs", ",").alias("matching_dirs"))


@query("select list_extract(string_split(url, '/'), -1) as pattern, count(*) as n from pages where list_extract(string_split(url, '/'), -1) in ('', '49', '10', '519', 'nowhere') group by 1")
def rule_join_basename(spark, sf_dir):
    rules = spark.sql("select 0L as rule_pos, 'names' as name, array('', '49', '10', '519', 'nowhere') as files, cast(null as array<string>) as dirs")
    return tools.file_hits(_files(spark, sf_dir), tools.explode_rules(rules)).groupBy("pattern").agg(F.count("*").alias("n"))


@query("""select distinct list_extract(string_split(url, '/'), 3) as host, d as hit from pages, (values ('en'), ('fr'), ('519')) v(d) where list_contains(string_split(url, '/'), d)""")
def rule_dir_component(spark, sf_dir):
    """Each host is a repository."""
    rules = spark.sql("select 0L as rule_pos, 'parts' as name, cast(null as array<string>) as files, array('en', 'fr', '519') as dirs")
    return tools.dir_hits(_hosts(spark, sf_dir), tools.explode_rules(rules)).select(F.col("repo_path").alias("host"), "hit")


@query("""select distinct list_extract(string_split(url, '/'), 3) as host, d as hit from pages, (values ('/https:'), ('/http'), ('/https://m.'), ('/x')) v(d) where starts_with('/' || url, d)""")
def rule_dir_prefix(spark, sf_dir):
    rules = spark.sql("select 0L as rule_pos, 'roots' as name, cast(null as array<string>) as files, array('/https:', '/http', '/https://m.', '/x') as dirs")
    return tools.dir_hits(_hosts(spark, sf_dir), tools.explode_rules(rules)).select(F.col("repo_path").alias("host"), "hit")


@query("""with n as (select 'n' || c_nationkey as parent, 'c' || c_custkey as oid, c_name as name from customer)
  select r_name || '/' || n_name || '/' || n.name as path, n.oid from region join nation on n_regionkey = r_regionkey join n on n.parent = 'n' || n_nationkey""")
def visited_anti_join(spark, sf_dir):
    """The distinct files of many roots that share their trees: each tree at a path is expanded once."""
    roots = spark.sql("select 'root' as tree_oid union all select concat('root', id) from range(20)")
    entries = _tree(spark, sf_dir)
    more = entries.filter("tree_oid = 'root'").drop("tree_oid").crossJoin(spark.sql("select concat('root', id) as tree_oid from range(20)"))
    return H.tree_versions(roots, entries.unionByName(more))


@query("""with h as (select distinct regexp_extract(url, '^https?://([a-z.]+)/', 1) as host from pages),
  g as (select replace(x, 'HOST', host) as pattern from h, (values ('*HOST/*'), ('http://HOST*'), ('*/HOST/??/*'), ('*HOST/e[l-n]/*0')) v(x)),
  r as (select pattern, replace(replace(replace(pattern, '.', '[.]'), '*', '.*'), '??', '..') as rx from g)
  select pattern, count(*) as n_files from pages join r on regexp_full_match(url, rx) group by pattern""")
def glob_index(spark, sf_dir):
    """Four globs for each host, in all some for each page or two: each page is held against those alone whose text it has."""
    pages = read(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", "^https?://([a-z.]+)/", 1).alias("host")).distinct()
    globs = F.array(*[F.concat(F.lit(a), F.col("host"), F.lit(b)) for a, b in (("*", "/*"), ("http://", "*"), ("*/", "/??/*"), ("*", "/e[l-n]/*0"))])
    rules = hosts.select(F.xxhash64("host").alias("rule_pos"), F.col("host").alias("name"), globs.alias("files"), F.lit(None).cast("array<string>").alias("dirs"))
    patterns = tools.explode_rules(rules).filter("kind = 'glob'")
    return tools.glob_hits(_files(spark, sf_dir), patterns).groupBy("pattern").agg(F.count("*").alias("n_files"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as nested trees: the files are the customers."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tree, blob = F.lit(H.TREE).alias("mode"), F.lit(H.PLAIN_FILE).alias("mode")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    return (
        region.select(F.lit("root").alias("tree_oid"), F.col("r_name").alias("name"), tree, name("r", "r_regionkey").alias("child_oid"))
        .unionAll(nation.select(name("r", "n_regionkey"), "n_name", tree, name("n", "n_nationkey")))
        .unionAll(customer.select(name("n", "c_nationkey"), "c_name", blob, name("c", "c_custkey")))
    )


@query("""with p as (select r_name, n_name, c_name from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey)
  select directory, count(*) as n from (select '.' as directory from p union all select r_name from p union all select r_name || '/' || n_name from p) group by 1""")
def tree_closure_rollup(spark, sf_dir):
    """Files of nested trees, counted for each directory and all above it."""
    files = H.tree_files(spark.sql("select 'root' as tree_oid"), _tree(spark, sf_dir)).withColumn("n", F.lit(1).cast("long"))
    return H.directory_rollup(files, "n", ("tree_oid",)).select("directory", F.col("total").alias("n"))


def _shared_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """20 roots and the entries of their trees: root i has the regions whose key differs from i modulo 5, the first of them under a second name too."""
    entries = _tree(spark, sf_dir)
    roots = spark.range(20).select(F.concat(F.lit("root"), "id").alias("tree_oid"), F.col("id"))
    regions = entries.filter("tree_oid = 'root'").drop("tree_oid").withColumn("k", F.substring("child_oid", 2, 9).cast("int"))
    own = roots.join(regions, F.pmod("id", F.lit(5)) != F.col("k"))
    again = own.filter("k = (case when id % 5 = 0 then 1 else 0 end)").withColumn("name", F.concat("name", F.lit(" again")))
    more = own.unionByName(again).select("tree_oid", "name", "mode", "child_oid")
    return roots.select("tree_oid"), entries.filter("tree_oid <> 'root'").unionByName(more)


@query("""with n as (select 'n' || n_nationkey as oid, n_regionkey as r, c_mktsegment as key, cast(sum(cast(round(c_acctbal * 100) as bigint)) as bigint) as total, count(*) as n from customer join nation on c_nationkey = n_nationkey where round(c_acctbal * 100) <> 0 group by all),
  r as (select 'r' || r as oid, r, key, cast(sum(total) as bigint) as total, cast(sum(n) as bigint) as n from n group by all),
  t as (select 'root' || i as oid, key, cast(sum(total * case when r = (case when i % 5 = 0 then 1 else 0 end) then 2 else 1 end) as bigint) as total, cast(sum(n * case when r = (case when i % 5 = 0 then 1 else 0 end) then 2 else 1 end) as bigint) as n
    from r, range(20) g(i) where r <> i % 5 group by all)
  select oid as tree_oid, key, total, n from n union all select oid, key, total, n from r union all select * from t""")
def subtree_totals(spark, sf_dir):
    """Account balances (in cents) by segment of every tree below 20 roots that share theirs: each distinct tree is summed once."""
    roots, entries = _shared_tree(spark, sf_dir)
    customers = read(spark, sf_dir, "customer")
    values = customers.select(F.col("c_name").alias("name"), F.concat(F.lit("c"), "c_custkey").alias("oid"), F.col("c_mktsegment").alias("key"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value")).filter("value <> 0")
    return H.tree_totals(roots, entries, values)


@query("""select directory, cast(sum(n_chars) as bigint) as total from (select unnest(['.', source, source || '/' || lang]) as directory, n_chars from documents) group by 1""")
def directory_rollup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.lit(0).alias("chain_pos"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "n_chars")
    return H.directory_rollup(docs, "n_chars").select("directory", "total")


@query("""select oid, cast(sum(s) as bigint) as signs from (select o_orderpriority as oid, -1 as s from orders union all select cast(o_custkey as varchar), 1 from orders) group by 1""")
def change_signs(spark, sf_dir):
    """Old and new versions of changes as one set, each with its signs added up."""
    orders = read(spark, sf_dir, "orders")
    plain = F.lit(H.PLAIN_FILE)
    changes = orders.select(F.col("o_orderkey").alias("chain_pos"), plain.alias("old_mode"), F.col("o_orderpriority").alias("old_oid"), plain.alias("new_mode"), F.col("o_custkey").cast("string").alias("new_oid"), F.lit("f").alias("path"))
    return H.deltas(changes).groupBy("oid").agg(F.sum("sign").alias("signs"))


@query("""with x as (select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +0200' when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d') when 3 then event_type else strftime(ts, '%Y-13-%d') end as x, ts from events)
  select event_id, x, strftime(case event_id % 5 when 0 then date_trunc('second', ts) - interval 2 hour when 1 then date_trunc('second', ts) when 2 then date_trunc('day', ts) end, '%Y-%m-%d %H:%M:%S') as t from x""")
def loose_datetime_forms(spark, sf_dir):
    """Times of events, written in each form, and as what is no date."""
    events, form = read(spark, sf_dir, "events"), lambda f: F.date_format("ts", f)
    kind = F.col("event_id") % 5
    x = F.when(kind == 0, F.concat(form("yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))).when(kind == 1, form("yyyy-MM-dd HH:mm:ss")).when(kind == 2, form("yyyy-MM-dd")).when(kind == 3, F.col("event_type")).otherwise(form("yyyy-'13'-dd"))
    return events.select("event_id", x.alias("x")).select("event_id", "x", F.date_format(loose_datetime(F.col("x")), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then cast(event_id as double) else cast(event_id as double) / 2 end as v from events")
def command_first_token(spark, sf_dir):
    """Words, and numbers with a suffix or an underscore, are no numbers."""
    number_ = F.when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise(F.format_string("%.1fe0", F.col("event_id") / 2))
    bad = F.element_at(F.array(F.lit("nothing"), F.lit("1d"), F.lit("5f"), F.lit("1_0"), F.lit("0x1"), F.lit("1L")), (F.col("event_id") / 3 % 6).cast("int") + 1)
    text = F.when(F.col("event_id") % 3 == 0, bad).otherwise(F.concat(F.lit(" "), number_, F.lit(" files")))
    return read(spark, sf_dir, "events").select("event_id", first_number(text).alias("v"))


@query("select l_orderkey, l_linenumber, case when l_quantity = floor(l_quantity) then cast(cast(l_quantity as bigint) as varchar) else cast(l_quantity as varchar) end as q from lineitem")
def number_display(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number_text(F.col("l_quantity")).alias("q"))


@query("""select distinct 'src/' || event_type || '.rs' as path, cast(user_id % 7 as varchar) as oid, cast(1 as bigint) as value from events where event_type like '%i%'""")
def entries_distinct(spark, sf_dir):
    """A version that occurs in many commits is measured once."""
    files = read(spark, sf_dir, "events").select(F.concat(F.lit("src/"), "event_type", F.lit(".rs")).alias("path"), (F.col("user_id") % 7).cast("string").alias("oid"))
    none = files.select("oid", F.lit(None).cast("binary").alias("content"))
    return measured(files, none, FileCount(pattern="src/*.rs"), "src/*i*.rs").select("path", "oid", "value")


@query("""select event_id, k, case event_id % 4 when 0 then k || repeat('0', 21) when 1 then '-' || k || repeat('0', 20)
    when 2 then '0.' || repeat('0', 17) || k else '-' || (k // 4) || case k % 4 when 0 then '' when 1 then '.25' when 2 then '.5' else '.75' end end as t
  from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events) where k % 10 <> 0 and k > 10""")
def number_display_extremes(spark, sf_dir):
    """Numbers in full, whatever their size: two digits with 21 or 20 zeros, or behind 17 places, and quarters."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = read(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k % 10 <> 0 and k > 10")
    exponent = F.when(F.col("event_id") % 4 == 0, "e21").when(F.col("event_id") % 4 == 1, "e20").otherwise("e-19")
    text = F.concat(F.when(F.col("event_id") % 4 == 1, "-").otherwise(""), F.col("k").cast("string"), exponent)
    x = F.when(F.col("event_id") % 4 == 3, -F.col("k") / 4).otherwise(text.cast("double"))
    return rows.select("event_id", "k", number_text(x).alias("t"))


@query("""with e as (select event_id, user_id, cast(json_extract(props, '$.k') as bigint) as k from events)
  select event_id, unnest(['a', 'c', 'k']) as k, unnest([k, 9223372036854775807, user_id]) as v from e where k % 3 = 0
  union all select event_id, unnest(['c', 'k']), unnest([9223372036854775807, user_id]) from e where k % 3 = 1""")
def json_object_numbers_only(spark, sf_dir):
    """Strings of digits, fractions, negative numbers, those that no long holds and values of other kinds are left out; of equal keys the last counts; what is no object has none."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", k.alias("n"))
    text = lambda c: F.col(c).cast("string")
    head = F.when(F.col("n") % 3 == 0, F.concat(F.lit('"a":'), text("n"), F.lit(".0"))).otherwise(F.concat(F.lit('"a":"'), text("n"), F.lit('"')))
    whole = F.concat(F.lit("{"), head, F.lit(',"b":-1,"c":9223372036854775807,"d":9223372036854775808,"e":[1],"f":true,"g":null,"h":1.5,"k":0,"k":'), text("user_id"), F.lit("}"))
    doc = F.when(F.col("n") % 3 == 2, F.concat(F.lit("["), text("n"), F.lit("]"))).otherwise(whole)
    return rows.select("event_id", F.explode(object_counts(F.encode(doc, "UTF-8"), ".")).alias("k", "v"))


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """commits, changes and contents of a repository of documents: 30 commits, two a day; each adds documents, and removes some that are seven commits old."""
    docs = read(spark, sf_dir, "documents").withColumn("oid", F.sha2("text", 256)).withColumn("path", F.concat_ws("/", "source", F.concat("doc_id", F.lit(".json"))))
    at = (29 - F.col("doc_id") % 30).cast("int")
    commits = spark.range(30).select(F.lit("r").alias("repo"), F.col("id").cast("int").alias("chain_pos"), F.concat(F.lit("c"), "id").alias("sha"), F.lit("t").alias("tree_oid"), F.timestamp_seconds(1709251200 + (29 - F.col("id")) * 43200).alias("ts"))
    none, plain = F.lit("000000"), F.lit(H.PLAIN_FILE)
    added = docs.select(at.alias("chain_pos"), none.alias("old_mode"), F.lit("").alias("old_oid"), plain.alias("new_mode"), F.col("oid").alias("new_oid"), "path")
    gone = docs.filter("doc_id % 3 = 0").select((at - 7).alias("chain_pos"), plain.alias("old_mode"), F.col("oid").alias("old_oid"), none.alias("new_mode"), F.lit("").alias("new_oid"), "path").filter("chain_pos >= 0")
    return commits, added.unionByName(gone), docs.select("oid", F.encode("text", "UTF-8").alias("content"))


_HISTORY_SQL = """with c as (select p, 'c' || p as commit, strftime(timestamp '2024-03-01' + interval (12 * (29 - p)) hour, '%Y-%m-%d') as day from range(30) t(p)),
  s as (select * from c qualify row_number() over (partition by day order by p) = 1),
  f as (select *, 29 - doc_id % 30 as born, case when doc_id % 3 = 0 and 29 - doc_id % 30 >= 7 then 22 - doc_id % 30 else -1 end as died from documents),
  l as (select s.commit, f.* from s join f on s.p <= f.born and s.p > f.died) """


@query(_HISTORY_SQL + """select s.commit, 'total' as key, cast(coalesce(sum(len(list_filter(string_split(case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end, chr(10)), lambda x: regexp_matches(x, 'tion|ung')))), 0) as varchar) as value
  from s left join l on l.commit = s.commit and source like '%1%' group by 1""")
def series_grep(spark, sf_dir):
    """The engine's main path, in the delta form: daily samples of matching lines in the files that a glob names."""
    stat = StatConfig("n", "grep", params={"pattern": "tion|ung"}, path_in_repo="*1*/*.json", granularity="daily")
    return series(*_history(spark, sf_dir), stat).select("commit", "key", "value")


@query(_HISTORY_SQL + """select commit, 'JSON' as key, cast(sum(len(list_filter(string_split(text, chr(10)), lambda x: not regexp_full_match(x, '\\s*')))) as varchar) as value from l group by 1""")
def series_loc(spark, sf_dir):
    """Code lines of the live files, by language."""
    return series(*_history(spark, sf_dir), StatConfig("n", "loc", granularity="daily")).select("commit", "key", "value")


@query(_HISTORY_SQL + """select s.commit, 'jq_result' as key, cast(cast(coalesce(sum(doc_id % 10), 0) as bigint) as varchar) as value from s left join l on l.commit = s.commit group by 1""")
def series_json_number(spark, sf_dir):
    """The interval form: numbers of the JSON files that are live at each sample."""
    commits, changes, _ = _history(spark, sf_dir)
    ids = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.concat("doc_id", F.lit(".json"))).alias("path"), F.col("doc_id").cast("string").alias("own"))
    of = changes.join(ids, "path").drop("old_oid", "new_oid").withColumn("old_oid", F.col("own")).withColumn("new_oid", F.col("own")).drop("own")
    contents = ids.select(F.col("own").alias("oid"), F.encode(F.concat(F.lit('{"k": {"v": '), (F.col("own").cast("long") % 10).cast("string"), F.lit("}}")), "UTF-8").alias("content"))
    return series(commits, of, contents, StatConfig("n", "jq", params={"query": ".k.v"}, granularity="daily")).select("commit", "key", "value")

"""Registry of the report-analytics queries and their DuckDB SQL; keys start with the inventory's ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as X, vocabulary as V
from .operators import canonical, facets, graph, models, search, search_index, stats, tables, tagging
from .session import ship
from .sources import html
from .sources.reports import THEMES, VIEW_SQL, between, collection_names, in_collections, read_csv, read_theme_schema, report_view
from .sources.sinks import write_csv, write_in_batches
from .storage import fresh_folder
from .streaming.topup import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "A10_facet_receiver"


def query(name: str, sql: str | None = None, view: bool = True, uses: tuple[str, ...] | None = None):
    """uses: the view's columns that a query reads, where it does not need all its joins."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(report_view(spark, sf_dir, uses) if view else (lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = f"WITH {VIEW_SQL} {sql}" if view and not sql.startswith(", ") else f"WITH {VIEW_SQL}{sql}" if view else sql
        return f

    return put


def day(c: str) -> str:
    """SQL: a date as text, so that both engines hash the same."""
    return f"CAST({c} AS varchar)"


# ---------------------------------------------------------------------------- scans, filters, projections

P03 = ("1996-01-01", "1998-12-31")
FLAGS = {"returned": "theme_returned", "urgent": "theme_urgent", "promo": "theme_promo"}


@query("S04_load_reports", f"""SELECT report_id, {day('"date"')} AS day, coroner FROM reports WHERE "date" BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
  AND (coalesce(theme_returned, false) OR coalesce(theme_urgent, false)) ORDER BY "date" DESC, report_id LIMIT 50""")
def _(r):
    found = in_collections(between(r, *P03), collection_names(["returned", "urgent"], FLAGS))
    return found.orderBy(F.desc("date"), "report_id").limit(50).select("report_id", F.col("date").cast("string").alias("day"), "coroner")


@query("P01_include_flags", "SELECT report_id, url, coroner, area, concerns FROM reports", uses=("url", "coroner", "area", "concerns"))
def _(r):
    return r.select("report_id", "url", "coroner", "area", "concerns")


@query("P02_display_columns", f"SELECT report_id, url, {day('"date"')} AS day, coroner, area, receiver FROM reports")
def _(r):
    shown = r.select([c for c in r.columns if not c.startswith(("theme_", "collection_"))])
    return shown.select("report_id", "url", F.col("date").cast("string").alias("day"), "coroner", "area", "receiver")


@query("P03_date_range", f"SELECT report_id, {day('"date"')} AS day FROM reports WHERE \"date\" BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", uses=("date",))
def _(r):
    return between(r, *P03).select("report_id", F.col("date").cast("string").alias("day"))


@query("P04_collection_or", "SELECT report_id FROM reports WHERE coalesce(theme_promo, false) OR coalesce(theme_urgent, false)")
def _(r):
    return in_collections(r, ["theme_promo", "theme_urgent"]).select("report_id")


@query("P05_single_collection", "SELECT report_id, theme_returned, theme_promo FROM reports WHERE theme_urgent")
def _(r):
    one = in_collections(r, ["theme_urgent"])
    return one.select("report_id", *[c for c in one.columns if c in ("theme_returned", "theme_promo", "theme_urgent")])


@query("P06_facet_filter", """SELECT report_id FROM reports WHERE lower(trim(area)) IN ('nation_8', 'nation_5', 'nation_11', 'nation_22')
  AND len(list_filter(string_split(coalesce(receiver, ''), ';'), lambda x: lower(trim(x)) IN ('supplier#000000001', 'supplier#000000007', 'supplier#000000042', 'supplier#000000011'))) > 0""", uses=("area", "receiver"))
def _(r):
    names = [f"Supplier#00000000{k}" for k in (1, 7)] + ["SUPPLIER#000000042", "supplier#000000011"]
    return facets.facet_filter(r, areas=["Nation_8", " nation_5", "NATION_11", "nation_22"], receiver=names).select("report_id")


@query("P07_truthy_filter", "SELECT report_id FROM reports WHERE lower(trim(CAST(theme_bulk AS varchar))) IN ('1','true','t','yes','y')")
def _(r):
    return r.where(X.truthy(F.col("theme_bulk"))).select("report_id")


@query("P09_pending_mask", "SELECT report_id, (theme_returned IS NULL OR theme_bulk IS NULL) AS pending FROM reports")
def _(r):
    return r.select("report_id", tagging.pending(r, ["theme_returned", "theme_bulk"]).alias("pending"))


MIXED = "CASE report_id % 8 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'y' WHEN 2 THEN '2' WHEN 3 THEN '1.0' WHEN 4 THEN '0' WHEN 5 THEN 'no' WHEN 6 THEN 'T' END"


@query("P10_truthiness", f"""SELECT report_id, coalesce(v IN ('1','true','t','yes','y'), false) AS network, coalesce(v IN ('1','true','t','yes','y') OR try_cast(v AS double) <> 0, false) AS collection,
  coalesce(v IN ('1','true','yes') OR try_cast(v AS double) = 1, false) AS summary, coalesce(theme_promo, false) AS filled FROM (SELECT report_id, theme_promo, lower(trim({MIXED})) AS v FROM reports)""", uses=("theme_promo",))
def _(r):
    v = F.expr(MIXED)
    return r.select("report_id", X.truthy(v).alias("network"), X.flag_true(v).alias("collection"), X.summary_true(v).alias("summary"), X.filled(F.col("theme_promo")).alias("filled"))


@query("P11_masked_recompute", "SELECT report_id, CASE WHEN theme_returned THEN receiver LIKE '%1%' ELSE theme_urgent END AS flag FROM reports")
def _(r):
    return r.select("report_id", F.when(F.col("theme_returned"), F.contains("receiver", F.lit("1"))).otherwise(F.col("theme_urgent")).alias("flag"))


@query("P14_page", f"SELECT report_id, {day('"date"')} AS day FROM reports ORDER BY \"date\" DESC NULLS LAST, report_id LIMIT 100 OFFSET 200", uses=("date",))
def _(r):
    return facets.page(r, 3).select("report_id", F.col("date").cast("string").alias("day"))


@query("P15_dates", """SELECT event_id, CAST(coalesce(CAST(try_strptime(v, '%Y-%m-%d') AS date), CAST(try_strptime(v, '%d/%m/%Y') AS date)) AS varchar) AS day,
  CAST(coalesce(CAST(try_strptime(v, '%Y-%m-%d') AS date), CAST(try_strptime(v, '%d/%m/%Y') AS date), DATE '2000-01-01') AS varchar) AS day_or,
  CAST(CASE WHEN contains(v, '/') THEN CAST(try_strptime(v, '%d/%m/%Y') AS date) ELSE CAST(try_strptime(v, '%Y-%m-%d') AS date) END AS varchar) AS strict FROM
  (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y') ELSE 'soon' END AS v FROM events)""", view=False)
def _(t):
    v = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy")).otherwise("soon")
    default = F.lit("2000-01-01").cast("date")
    return t("events").select("event_id", X.any_date(v).cast("string").alias("day"), X.date_or(v, default).cast("string").alias("day_or"), X.strict_date(v).cast("string").alias("strict"))


@query("P18_coerce_filter", """SELECT event_id, n, CASE WHEN event_type IN ('click','view') THEN 'look' WHEN regexp_matches(event_type, '^(sign|purch)') THEN 'act' ELSE 'other' END AS class
  FROM (SELECT event_id, event_type, try_cast(regexp_extract(props, '[0-9]+') AS bigint) AS n FROM events) WHERE n IS NOT NULL""", view=False)
def _(t):
    n = F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) as bigint)")
    kind = F.when(F.col("event_type").isin("click", "view"), "look").when(F.col("event_type").rlike("^(sign|purch)"), "act").otherwise("other")
    return t("events").select("event_id", n.alias("n"), kind.alias("class")).where("n is not null")


@query("S12_theme_schema", "SELECT lower(n_name) AS theme, concat('region ', n_regionkey) AS description FROM nation", view=False)
def _(t):
    nation = t("nation")
    entry = F.struct(F.concat(F.lit("theme_"), F.lower("n_name")).alias("k"), F.concat(F.lit("**region** `"), F.col("n_regionkey").cast("string"), F.lit("`")).alias("v"))
    schema = nation.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("themes"))).alias("value"))  # 25 rows
    path = fresh_folder(nation.sparkSession, "theme-schema")
    schema.write.text(path)
    return read_theme_schema(nation.sparkSession, path)


@query("S01_read_csv", f"""SELECT report_id, {day('"date"')} AS day, concerns FROM reports WHERE report_id % 7 <> 0""", uses=("date", "concerns"))
def _(r):
    path = fresh_folder(r.sparkSession, "reports-csv")
    dated = F.when(F.col("report_id") % 7 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("date").cast("string"))
    write_csv(r.select(F.col("report_id").alias("Unnamed: 0"), "report_id", dated.alias("date"), "concerns"), path)
    return read_csv(r.sparkSession, path).select(F.col("report_id").cast("long").alias("report_id"), F.col("date").cast("string").alias("day"), "concerns")


# ---------------------------------------------------------------------------- facets and dashboard

SEGMENTS = "list_filter(list_transform(string_split(coalesce(receiver, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"
FIRST_SEEN = f"list_filter({SEGMENTS}, lambda x, i: list_position(list_transform({SEGMENTS}, lambda y: lower(y)), lower(x)) = i)"


def top_sql(column: str) -> str:
    v = f"CASE WHEN lower(trim(coalesce({column}, ''))) IN ('nan','nat','none','') THEN 'Not specified' ELSE trim({column}) END"
    return f"SELECT {v} AS name, count(*) AS n FROM reports GROUP BY 1 ORDER BY n DESC, lower(name), name LIMIT 12"


@query("A08_monthly", "SELECT strftime(\"date\", '%Y-%m') AS month, count(*) AS n FROM reports WHERE \"date\" IS NOT NULL GROUP BY 1", uses=("date",))
def _(r):
    return facets.monthly(r)


@query("A09_facet_area", top_sql("area"), uses=("area",))
def _(r):
    return facets.top_values(r, "area")


@query("A09_facet_coroner", top_sql("coroner"), uses=("coroner",))
def _(r):
    return facets.top_values(r, "coroner")


@query("A10_facet_receiver", f"""SELECT name, count(*) AS n FROM (SELECT unnest(CASE WHEN len(s) = 0 THEN ['Not specified'] ELSE s END) AS name
  FROM (SELECT {FIRST_SEEN} AS s FROM reports)) GROUP BY 1 ORDER BY n DESC, lower(name), name LIMIT 12""", uses=("receiver",))
def _(r):
    return facets.top_receivers(r)


@query("A11_A12_A15_totals", f"""SELECT count(*) AS reports, CAST(coalesce(sum(len({FIRST_SEEN})), 0) AS bigint) AS receiver_links, count(DISTINCT nullif(trim(coroner), '')) AS coroners,
  {day('min("date")')} AS earliest, {day('max("date")')} AS latest FROM reports""")
def _(r):
    return facets.totals(r).withColumns({c: F.col(c).cast("string") for c in ("earliest", "latest")})


def flag_sql(flags: dict[str, str]) -> str:
    return " UNION ALL ".join(["SELECT 'custom' AS label, count(*) AS n FROM reports", *[f"SELECT '{k}', CAST(coalesce(sum(CAST({c} AS int)), 0) AS bigint) FROM reports" for k, c in flags.items()]])


@query("A13_theme_counts", f"SELECT label AS theme, n FROM ({flag_sql({t: t for t in THEMES if t != 'theme_urgent'})}) WHERE label <> 'custom' AND n > 0")
def _(r):
    return facets.theme_counts(r, THEMES, without="theme_urgent")


@query("A14_options_receiver", f"SELECT DISTINCT unnest({SEGMENTS}) AS value FROM reports", uses=("receiver",))
def _(r):
    return facets.options(r, "receiver")


@query("A14_options_area", "SELECT DISTINCT trim(area) AS value FROM reports WHERE trim(area) <> ''", uses=("area",))
def _(r):
    return facets.options(r, "area")


@query("A16_collection_counts", flag_sql(FLAGS))
def _(r):
    return facets.flag_counts(r, FLAGS)


@query("A17_theme_summary", f"SELECT label AS \"Theme\", concat('about ', label) AS \"Description\", n AS \"Count\", round(n * 100.0 / (SELECT count(*) FROM reports), 1) AS \"%\" FROM ({flag_sql({t: t for t in THEMES})}) WHERE label <> 'custom'".replace("100.0", "CAST(100 AS double)"), uses=tuple(THEMES))
def _(r):
    return facets.theme_summary(r, {t: f"about {t}" for t in THEMES})


# ---------------------------------------------------------------------------- tabulation, lengths, agreement


@query("A01_tabulate_boolean", " UNION ALL ".join(f"SELECT '{t}' AS \"Category\", CAST(coalesce(sum(CAST({t} AS int)), 0) AS bigint) AS \"Count\", round(coalesce(sum(CAST({t} AS int)), 0) * CAST(100 AS double) / count(*), 6) AS \"Percentage\" FROM reports" for t in THEMES))
def _(r):
    return stats.tabulate(r, THEMES).withColumn("Percentage", F.round(F.col("Percentage").cast("double"), 6))


@query("A02_tabulate_categorical", "SELECT concat('Area: ', area) AS \"Category\", count(*) AS \"Count\", round(count(*) * CAST(100 AS double) / (SELECT count(*) FROM reports), 6) AS \"Percentage\" FROM reports WHERE area IS NOT NULL GROUP BY 1", uses=("area",))
def _(r):
    return stats.tabulate(r, ["area"], ["Area"]).withColumn("Percentage", F.round(F.col("Percentage").cast("double"), 6))


WORDS = "len(list_filter(string_split_regex(concat_ws(' ', investigation, circumstances, concerns), '\\s+'), lambda x: x <> ''))"
SECTIONS = ["investigation", "circumstances", "concerns"]


@query("A03_length_stats", f""", lengths AS (SELECT {WORDS} AS n FROM reports) SELECT count(*) AS reports, CAST(sum(n) AS bigint) AS total, round(avg(n), 6) AS mean, round(CAST(quantile_cont(n, 0.5) AS double), 6) AS median,
  round(var_pop(n), 6) AS variance, round(stddev_pop(n), 6) AS std, CAST(min(n) AS bigint) AS "min", CAST(max(n) AS bigint) AS "max", round(CAST(quantile_cont(n, 0.25) AS double), 6) AS q1,
  round(CAST(quantile_cont(n, 0.75) AS double), 6) AS q3, round(CAST(quantile_cont(n, 0.9) AS double), 6) AS p90, round(CAST(quantile_cont(n, 0.95) AS double), 6) AS p95,
  CAST(sum(CASE WHEN n <= 100 THEN n END) AS bigint) AS within_total, CAST(sum(CASE WHEN n <= 100 THEN 1 ELSE 0 END) AS bigint) AS within_reports,
  CAST(max(n) - min(n) AS bigint) AS "range", round(CAST(quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS double), 6) AS iqr FROM lengths""", uses=("investigation", "circumstances", "concerns"))
def _(r):
    out = stats.length_stats(stats.lengths(r, SECTIONS), threshold=100)
    return out.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("A04_length_table", f""", lengths AS (SELECT {WORDS} AS n FROM reports), limits AS (SELECT DISTINCT x AS lim FROM (SELECT unnest(range(50, (SELECT greatest(max(n), 150) FROM lengths) + 100, 100)) AS x UNION ALL SELECT 150))
  SELECT CAST(lim AS bigint) AS "limit", count(*) FILTER (WHERE n <= lim) AS reports, round(count(*) FILTER (WHERE n <= lim) * CAST(100 AS double) / count(*), 6) AS percent FROM limits, lengths GROUP BY lim""", uses=("investigation", "circumstances", "concerns"))
def _(r):
    return stats.length_table(stats.lengths(r, SECTIONS), 150, 100).withColumn("percent", F.round("percent", 6))


@query("A05_length_histogram", f""", lengths AS (SELECT {WORDS} AS n FROM reports), b AS (SELECT min(n) AS lo, (max(n) - min(n)) / CAST(20 AS double) AS w FROM lengths)
  SELECT CAST(least(19, floor((n - lo) / w)) AS int) AS bin, round(any_value(lo) + CAST(least(19, floor((n - lo) / w)) AS int) * any_value(w), 6) AS low, count(*) AS n FROM lengths, b GROUP BY bin""", uses=("investigation", "circumstances", "concerns"))
def _(r):
    return stats.histogram(stats.lengths(r, SECTIONS)).withColumn("low", F.round("low", 6))


@query("A06_word_counts", f"SELECT report_id, {WORDS} AS n FROM reports", uses=("investigation", "circumstances", "concerns"))
def _(r):
    return stats.lengths(r, SECTIONS).select("report_id", F.col("n").cast("long").alias("n"))


@query("A07_token_estimate", f"SELECT CAST(sum({WORDS}) AS bigint) AS tokens FROM reports", uses=("investigation", "circumstances", "concerns"))
def _(r):
    return stats.lengths(r, SECTIONS).agg(F.sum("n").alias("tokens"))


@query("A05_auto_histogram", f""", lengths AS (SELECT {WORDS} AS n FROM reports), f AS (SELECT min(n) AS lo, max(n) - min(n) AS span, (max(n) - min(n)) / (log2(count(*)) + 1) AS s, 2 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) / pow(count(*), 1 / CAST(3 AS double)) AS fd FROM lengths),
  b AS (SELECT lo, ceil(span / CASE WHEN fd > 0 THEN least(s, fd) ELSE s END) AS bins, span / ceil(span / CASE WHEN fd > 0 THEN least(s, fd) ELSE s END) AS w FROM f)
  SELECT CAST(least(bins - 1, floor((n - lo) / w)) AS int) AS bin, round(any_value(lo) + CAST(least(bins - 1, floor((n - lo) / w)) AS int) * any_value(w), 6) AS low, count(*) AS n FROM lengths, b GROUP BY bin""", uses=("investigation", "circumstances", "concerns"))
def _(r):
    return stats.histogram(stats.lengths(r, SECTIONS), "auto").withColumn("low", F.round("low", 6))


@query("A18_changed_rows", "SELECT CAST(sum(CASE WHEN coalesce(investigation, '') <> coalesce(concerns, '') THEN 1 ELSE 0 END) AS bigint) AS changed, count(*) AS n FROM reports", uses=("investigation", "concerns"))
def _(r):
    return tables.changed_rows(r, "investigation", "concerns")


LABELS = "(SELECT quality = 1 AS a, toxic = 0 AS b FROM labels)"


@query("A19_confusion", f"""SELECT round(sum(CAST(a = b AS int)) / CAST(count(*) AS double), 6) AS accuracy, round(sum(CAST(a AND b AS int)) / CAST(sum(CAST(b AS int)) AS double), 6) AS sensitivity,
  round(sum(CAST(NOT a AND NOT b AS int)) / CAST(sum(CAST(NOT b AS int)) AS double), 6) AS specificity FROM {LABELS}""", view=False)
def _(t):
    out = stats.confusion(t("labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("A20_cohen_kappa", f"""WITH m AS (SELECT count(*) AS n, avg(CAST(a = b AS int)) AS po, avg(CAST(a AS int)) AS p, avg(CAST(b AS int)) AS q FROM {LABELS}),
  e AS (SELECT *, p*q + (1-p)*(1-q) AS pe, p*q*(p+q) + (1-p)*(1-q)*(2-p-q) AS s FROM m), k AS (SELECT *, (po-pe)/(1-pe) AS kappa, sqrt(pe + pe*pe - s) / ((1-pe)*sqrt(n)) AS se FROM e)
  SELECT round(po, 6) AS agreement, round(kappa, 6) AS kappa, round(kappa/se, 6) AS z, round(kappa - 1.96*se, 6) AS low, round(kappa + 1.96*se, 6) AS high FROM k""", view=False)
def _(t):
    out = stats.cohen_kappa(t("labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")
    return out.select(*[F.round(c, 6).cast("double").alias(c) for c in out.columns])


@query("A21_fleiss_kappa", """WITH r AS (SELECT CAST(quality = 1 AS int) + CAST(toxic = 0 AS int) + CAST(doc_id % 2 = 0 AS int) AS k FROM labels),
  i AS (SELECT avg((k*k + (3-k)*(3-k) - 3) / CAST(6 AS double)) AS po, sum(k) / CAST(3 * count(*) AS double) AS p, count(*) AS items FROM r),
  k AS (SELECT items, po, (po - (p*p + (1-p)*(1-p))) / (1 - (p*p + (1-p)*(1-p))) AS kappa, sqrt(2 / CAST(6 * items AS double)) AS se FROM i)
  SELECT items, round(po, 6) AS agreement, round(kappa, 6) AS kappa, round(kappa / se, 6) AS z, round(kappa - 1.96 * se, 6) AS low, round(kappa + 1.96 * se, 6) AS high FROM k""", view=False)
def _(t):
    rated = t("labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"), (F.col("doc_id") % 2 == 0).alias("c"))
    out = stats.fleiss_kappa(rated, ["a", "b", "c"])
    return out.select("items", *[F.round(c, 6).cast("double").alias(c) for c in ("agreement", "kappa", "z", "low", "high")])


@query("A22_windows", """SELECT CASE WHEN "date" IS NULL THEN 'invalid' WHEN "date" < DATE '1996-01-01' THEN 'before' WHEN "date" > DATE '1998-12-31' THEN 'after' ELSE 'within' END AS "window", count(*) AS n
  FROM reports WHERE theme_urgent GROUP BY 1""", uses=("date", "theme_urgent"))
def _(r):
    return stats.windows(r.where("theme_urgent"), F.col("date"), *P03)


# ---------------------------------------------------------------------------- text functions

KEY_SQL = "trim(regexp_replace(replace(lower({}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
SEGMENT_SQL = "(' ' || trim(regexp_replace(replace(replace(lower({}), '&', ' and '), '’', chr(39)), '[^a-z0-9'']+', ' ', 'g')) || ' ')"
SEARCH_SQL = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
STEM_SQL = "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN concat(left(w, length(w) - 3), 'y') " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 3} THEN left(w, length(w) - {len(e)})" for e in X.ENDINGS) + " ELSE w END"


def text_query(name: str, column, sql: str, source: str = "circumstances"):
    @query(name, f"SELECT report_id, {sql} AS value FROM reports", uses=(source,))
    def _(r):
        return r.select("report_id", column(F.col(source)).alias("value"))


text_query("T01_apostrophes", X.straight_quotes, "replace(replace(circumstances, '’', chr(39)), '‘', chr(39))")
text_query("T02_clean_text", X.clean_text, "trim(regexp_replace(replace(replace(circumstances, '’', chr(39)), '‘', chr(39)), '\\s+', ' ', 'g'))")
text_query("T04_gate", lambda c: X.gated(c, ["the "], 10, 200), """CASE WHEN length(trim(regexp_replace(replace(circumstances, 'the ', ''), '\\s+', ' ', 'g'))) BETWEEN 10 AND 200
  THEN trim(regexp_replace(replace(circumstances, 'the ', ''), '\\s+', ' ', 'g')) END""")
text_query("T05_match_key", X.match_key, KEY_SQL.format("circumstances"))
text_query("T06_segment_key", X.segment_key, SEGMENT_SQL.format("circumstances"))
text_query("T07_receiver_split", lambda c: F.array_join(X.receivers(c), "|"), f"array_to_string({SEGMENTS}, '|')", "receiver")
text_query("T16_search_text", X.search_text, SEARCH_SQL.format("circumstances"))
text_query("T17_stems", lambda c: F.array_join(F.transform(F.split(X.search_text(c), " "), X.stem), " "), f"array_to_string(list_transform(string_split({SEARCH_SQL.format('circumstances')}, ' '), lambda w: {STEM_SQL}), ' ')")
text_query("T25_report_id", lambda c: X.report_id(F.concat(F.lit("Ref: 2024-"), F.lpad(F.length(c).cast("string"), 4, "0"))), "nullif(regexp_extract(concat('Ref: 2024-', lpad(left(CAST(length(circumstances) AS varchar), 4), 4, '0')), '(\\d{4}-\\d{4})', 1), '')")
text_query("T27_first_words", lambda c: X.first_words(c, 10), "CASE WHEN len(list_filter(string_split_regex(circumstances, '\\s+'), lambda x: x <> '')) > 10 THEN array_to_string(list_slice(list_filter(string_split_regex(circumstances, '\\s+'), lambda x: x <> ''), 1, 10), ' ') ELSE circumstances END")
text_query("T32_identifier", lambda c: X.identifier(c), "concat('theme_', regexp_replace(regexp_replace(lower(area), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))", "area")
text_query("T33_node_id", lambda c: X.node_id(F.lit("area"), c), "CASE WHEN area IS NOT NULL THEN concat('area::', area) END", "area")
text_query("T34_dashboard_value", X.dashboard_value, "CASE WHEN lower(trim(coalesce(area, ''))) IN ('nan', 'nat', 'none') THEN '' ELSE trim(coalesce(area, '')) END", "area")


@query("T03_spoken_dates", f"SELECT report_id, {day('\"date\"')} AS day FROM reports", uses=("date",))
def _(r):
    said = F.concat(F.date_format("date", "d MMMM yyyy"), F.lit(" Ref: 2024-0001"))
    return r.select("report_id", X.spoken_date(said).alias("day"))


@query("T31_descriptions", "SELECT report_id, CASE report_id % 4 WHEN 2 THEN concat(area, '; ', coroner) ELSE area END AS description FROM reports", uses=("area", "coroner"))
def _(r):
    one = lambda k: F.to_json(F.create_map(F.lit(k), F.col("area")))
    raw = F.when(F.col("report_id") % 4 == 0, one("description")).when(F.col("report_id") % 4 == 1, one("text")).when(F.col("report_id") % 4 == 2, F.to_json(F.array("area", "coroner"))).otherwise(F.col("area"))
    return r.select("report_id", X.flat_description(raw).alias("description"))


@query("T32_unique_names", """SELECT CASE WHEN k > 1 THEN concat(name, '_', k) ELSE name END AS name FROM (SELECT name, row_number() OVER (PARTITION BY name) AS k FROM
  (SELECT concat('theme_', regexp_replace(regexp_replace(lower(left(n_name, 8)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM nation))""", view=False)
def _(t):
    return tables.unique_names(t("nation").select(F.substring("n_name", 1, 8).alias("v")), "v").select("name")


@query("T37_index_ranges", "SELECT event_id, array_to_string(list_sort(list_distinct(list_concat([event_id % 5], range(event_id % 7, event_id % 7 + 3)))), ' ') AS numbers FROM events", view=False)
def _(t):
    spec = F.concat_ws("", (F.col("event_id") % 5).cast("string"), F.lit(", "), (F.col("event_id") % 7).cast("string"), F.lit("-"), (F.col("event_id") % 7 + 2).cast("string"))
    return t("events").select("event_id", F.array_join(F.array_sort(tables.index_column(spec)), " ").alias("numbers"))


@query("T39_icons", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') OR contains(lower(p_type), 'econ') THEN 'cheap' WHEN contains(lower(p_type), 'stan') THEN 'plain' ELSE '' END AS icon FROM part", view=False)
def _(t):
    return t("part").select("p_partkey", X.icon_key(F.col("p_type"), [(("promo", "econ"), "cheap"), (("stan",), "plain")]).alias("icon"))


@query("T08_rule_tags", f"""SELECT report_id, len(list_filter(k, lambda s: contains(s, 'supplier 00000000') OR starts_with(trim(s), 'supplier 00000004'))) > 0 AS tag_a,
  len(list_filter(k, lambda s: suffix(trim(s), '1') AND NOT contains(trim(s), '11'))) > 0 AS tag_b FROM (SELECT report_id, list_transform({SEGMENTS}, lambda x: {SEGMENT_SQL.format('x')}) AS k FROM reports)""", uses=("receiver",))
def _(r):
    rules = {"tag_a": {"contains": ["supplier 00000000"], "startswith": ["supplier 00000004"]}, "tag_b": {"endswith": ["1"], "unless": ["11"]}}
    return tagging.tag_collections(r, rules).select("report_id", "tag_a", "tag_b")


#: Receivers that meet the default rules, dealt over the reports.
TAGGED = ["HMP Leeds", "NHS England", "Department of Health", "Care Quality Commission", "Leeds City Council", "General Medical Council", "Attorney General’s Office"]


def tag_sql(name: str, spec: dict) -> str:
    """SQL: whether any of the segment keys k of a row meets a rule."""
    said = lambda x: "'" + x.replace("'", "''") + "'"
    tests = [f"contains(s, {said(p)})" for p in spec.get("contains", ())] + [f"starts_with(trim(s), {said(p)})" for p in spec.get("startswith", ())]
    tests += ["(" + " AND ".join([f"suffix(trim(s), {said(p)})", *[f"NOT contains(trim(s), {said(x)})" for x in spec.get("unless", ())]]) + ")" for p in spec.get("endswith", ())]
    return f"len(list_filter(k, lambda s: {' OR '.join(tests)})) > 0 AS {name}"


@query("T08_default_tags", f"""SELECT report_id, {', '.join(tag_sql(n, s) for n, s in V.TAG_RULES.items())} FROM (SELECT report_id, list_transform({SEGMENTS.replace("coalesce(receiver, '')", "received")}, lambda x: {SEGMENT_SQL.format('x')}) AS k
  FROM (SELECT report_id, concat_ws('; ', receiver, CASE report_id % {len(TAGGED)} {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(TAGGED))} END) AS received FROM reports))""", uses=("receiver",))
def _(r):
    more = F.get(X.lit_array(TAGGED), (F.col("report_id") % len(TAGGED)).cast("int"))
    return tagging.tag_collections(r.withColumn("receiver", F.concat_ws("; ", "receiver", more))).select("report_id", *V.TAG_RULES)


ORACLE_SQL["T09_area_tag"] = f"WITH {VIEW_SQL} SELECT report_id, coalesce({KEY_SQL.format('area')} IN (SELECT {KEY_SQL.format('n_name')} FROM nation WHERE n_regionkey = 2), false) AS tag FROM reports"


def _t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 2").select(F.col("n_name").alias("area"))
    return tagging.tag_collections(report_view(spark, sf_dir), {}, nation, "tag").select("report_id", "tag")


QUERIES["T09_area_tag"] = _t09


#: Receivers as written, and what the clean-up makes of them.
RECEIVERS = [
    ("The Dept of Health & Social Care", "Department of Health and Social Care"), ("Chief Executive, Acme NHS Trust", "Acme NHS Foundation Trust"),
    ("- (Jane Doe MP, Home Office (HO)", "Home Office"), ("HM Chief Coroner, London", ""), ("[REDACTED], J Smith, 1 Road, Acme Council", "Acme Council"),
    ("Department of Transport", "Department for Transport"), ("Secretary of State for the Department of Health", "Secretary of State for Health"),
]


@query("T10_T14_receiver_cleanup", f"""SELECT report_id, array_to_string(list_filter(list_concat({"list_filter(list_transform(string_split(coalesce(receiver, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"},
  [CASE report_id % {len(RECEIVERS)} {' '.join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(RECEIVERS))} END]), lambda x: x <> ''), '; ') AS receivers FROM reports""", uses=("receiver",))
def _(r):
    raw = F.get(X.lit_array([x for x, _ in RECEIVERS]), (F.col("report_id") % len(RECEIVERS)).cast("int"))
    return r.select("report_id", X.clean_receiver_list(F.concat_ws("; ", "receiver", raw)).alias("receivers"))


@query("T15_departments", """SELECT report_id, array_to_string(list_transform(list_filter(list_transform(string_split(concat_ws(';', receiver, 'Department of ' || area, 'Department of Health and Social Care'), ';'), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: CASE WHEN starts_with(x, 'Department of ') AND x <> 'Department of Health and Social Care' THEN 'Department for ' || substr(x, 15) ELSE x END), '; ') AS receivers FROM reports""", uses=("receiver", "area"))
def _(r):
    return r.select("report_id", X.department_names(F.concat_ws(";", "receiver", F.concat(F.lit("Department of "), "area"), F.lit("Department of Health and Social Care"))).alias("receivers"))


@query("T11_organisations", f"SELECT report_id, len(list_filter(['nhs','office','care'], lambda q: contains({KEY_SQL.format('circumstances')}, q))) > 0 AS org FROM reports WHERE circumstances IS NOT NULL AND circumstances <> upper(circumstances)", uses=("circumstances",))
def _(r):
    return r.where("circumstances is not null and circumstances <> upper(circumstances)").select("report_id", X.is_organisation(F.col("circumstances"), ["nhs", "office", "care"]).alias("org"))


@query("T23_sandwich", """SELECT report_id, CASE WHEN strpos(lower(circumstances), 'the ') > 0 THEN trim(regexp_replace(CASE WHEN strpos(lower(rest), 'and ') > 0 THEN left(rest, strpos(lower(rest), 'and ') - 1) ELSE rest END, '\\s+', ' ', 'g')) END AS value
  FROM (SELECT report_id, circumstances, substr(circumstances, strpos(lower(circumstances), 'the ') + 4) AS rest FROM reports)""", uses=("circumstances",))
def _(r):
    return r.select("report_id", X.sandwich(F.col("circumstances"), ["the "], ["and "]).alias("value"))


@query("T24_fill_null_fields", "SELECT report_id, coalesce(concerns, circumstances, investigation) AS value FROM reports", uses=("investigation", "circumstances", "concerns"))
def _(r):
    return models.cascade(r, {"a": {"value": F.col("concerns")}, "b": {"value": F.col("circumstances")}, "c": {"value": F.col("investigation")}}, ["a", "b", "c"], ["value"]).select("report_id", "value")


@query("T26_labelled_text", "SELECT report_id, trim(regexp_replace(concat_ws(chr(10), CASE WHEN investigation IS NOT NULL THEN concat('Investigation: ', investigation) END, CASE WHEN concerns IS NOT NULL THEN concat('Concerns: ', concerns) END), '\\s+', ' ', 'g')) AS value FROM reports", uses=("investigation", "concerns"))
def _(r):
    return r.select("report_id", models.report_text(["investigation", "concerns"]).alias("value"))


@query("T29_T30_json_repair", """SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS value FROM events""", view=False)
def _(t):
    broken = F.concat(F.lit("```json\n"), F.regexp_replace(F.regexp_replace("props", r'"([A-Za-z_]\w*)"\s*:', "$1:"), r"\}\s*$", ",}"), F.lit("\n```"))
    m = F.from_json(X.repaired_json(broken), "map<string,string>")
    first = F.get(F.json_object_keys("props"), F.lit(0))
    return t("events").select("event_id", F.try_element_at(m, first).alias("value"))


@query("T30_theme_rows", """SELECT p_partkey, 'size_' || p_size AS theme, replace(p_name, '"', '') AS description FROM part""", view=False)
def _(t):
    """Replies with fence, bare keys and trailing commas, taken apart by the table function in SQL."""
    parts = t("part")
    models.register(parts.sparkSession)
    replies = parts.select("p_partkey", F.concat(F.lit("```json\n{themes: {size_"), "p_size", F.lit(': {"description": "'), F.replace("p_name", F.lit('"'), F.lit("")), F.lit('"},},}\n```')).alias("reply"))
    return parts.sparkSession.sql("SELECT p_partkey, theme, description FROM {replies}, LATERAL theme_rows(reply)", replies=replies)


@query("K03_batches", "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents", view=False)
def _(t):
    """The digests of documents in batches by source, so that many rows tie at a batch's end, broken off once and resumed."""
    docs = t("documents").select("doc_id", "source", "text")
    path, calls = fresh_folder(docs.sparkSession, "batches"), []

    def step(rows):
        calls.append(1)
        if len(calls) == 3:
            raise InterruptedError
        return rows.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))

    for _ in range(2):
        try:
            return write_in_batches(docs, path, step, "source", size=100, waves=5).select("doc_id", "digest")
        except InterruptedError:
            continue


@query("T35_number_format", "SELECT area, format('{:,}', count(*) * 1000) AS n FROM reports GROUP BY area", uses=("area",))
def _(r):
    return r.groupBy("area").agg(F.count(F.lit(1)).alias("n")).select("area", F.format_number(F.col("n") * 1000, 0).alias("n"))


@query("T36_signature", """, h AS (SELECT sha256(concat_ws('|', CAST(report_id AS varchar), coalesce(coroner, '∅'), coalesce(area, '∅'), coalesce(receiver, '∅'))) AS h FROM reports),
  p AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 12 * k}, 12) AS bigint)) AS p{k}" for k in range(4)) + """ FROM h)
  SELECT sha256(concat_ws('|', CAST(n AS varchar), CAST(p0 AS varchar), CAST(p1 AS varchar), CAST(p2 AS varchar), CAST(p3 AS varchar))) AS signature FROM p""", uses=("coroner", "area", "receiver"))
def _(r):
    return tables.signature(r, ["coroner", "area", "receiver"], "report_id")


# ---------------------------------------------------------------------------- search


def search_sql(text: str) -> str:
    plain, tokens, stems = search.query_terms(text)
    fields = list(V.SEARCH_FIELDS.items())
    norm = ", ".join(f"{SEARCH_SQL.format(f)} AS t_{f}" for f, _ in fields)
    word = ", ".join(f"string_split(t_{f}, ' ') AS w_{f}, list_transform(string_split(t_{f}, ' '), lambda w: {STEM_SQL}) AS s_{f}" for f, _ in fields)
    one = lambda c, x: f"(CASE WHEN {c} THEN {float(x)} ELSE 0.0 END)"
    points = [p for f, w in fields for p in (one(f"contains(t_{f}, '{plain}')", w * 6), *[one(f"list_contains(w_{f}, '{t}')", w * 2.5) for t in tokens], *[one(f"list_contains(s_{f}, '{s}')", w) for s in stems])]
    met = "+".join(one(" OR ".join(f"list_contains(s_{f}, '{s}')" for f, _ in fields), 1) for s in stems)
    phrase = " OR ".join(f"contains(t_{f}, '{plain}')" for f, _ in fields)
    need = 1 if len(stems) <= 2 else 2
    return f""", n AS (SELECT report_id, {norm} FROM reports), w AS (SELECT *, {word} FROM n), p AS (SELECT report_id, CASE WHEN ({met}) >= {need} OR {phrase} THEN {'+'.join(points)} + {one(f'({met}) = {len(stems)}', 10)} ELSE 0.0 END AS score FROM w)
  SELECT report_id, CAST(score AS double) AS score FROM p WHERE score >= {search.least_score(stems)}"""


for _k, _text in enumerate(("thing", "the thing thble", "thing thble ontion")):

    def _search(r, text=_text):
        return search.search(r, text).select("report_id", "score")

    query(f"O06_search_{_k + 1}", search_sql(_text), uses=("date", *V.SEARCH_FIELDS))(_search)

    def _stored(r, text=_text):
        """From an index of the reports in two appends, the second of which holds half of the first again."""
        index = search_index.SearchIndex(r.sparkSession, fresh_folder(r.sparkSession, "search-index"))
        index.append(r.where("report_id % 2 = 0"))
        index.append(r.where("report_id % 4 <> 2"))
        return index.search(text).select(F.col("key").cast("long").alias("report_id"), "score")

    query(f"O06_stored_{_k + 1}", search_sql(_text), uses=("date", *V.SEARCH_FIELDS))(_stored)


# ---------------------------------------------------------------------------- joins, sets, increments


def halves(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two overlapping report tables: the older with ids not divisible by 3, the newer with even ids, changed."""
    return r.where("report_id % 3 <> 0"), r.where("report_id % 2 = 0").withColumn("area", F.when(F.col("report_id") % 4 == 0, F.upper("area"))).withColumn("coroner", F.lower("coroner"))


HALVES = ", o AS (SELECT * FROM reports WHERE report_id % 3 <> 0), f AS (SELECT report_id, url, CASE WHEN report_id % 4 = 0 THEN upper(area) END AS area, lower(coroner) AS coroner FROM reports WHERE report_id % 2 = 0)"


@query("J01_replace_columns", HALVES + " SELECT o.report_id, f.area, f.coroner FROM o LEFT JOIN f USING (url)", uses=("url", "area", "coroner"))
def _(r):
    old, new = halves(r)
    return tables.replace_columns(old, new, ["area", "coroner"]).select("report_id", "area", "coroner")


@query("J02_changes", HALVES + """ SELECT count(*) AS "rows", CAST(sum(CASE WHEN coalesce(o.area,'') <> coalesce(f.area,'') THEN 1 ELSE 0 END) AS bigint) AS changed_area,
  CAST(sum(CASE WHEN coalesce(o.coroner,'') <> coalesce(f.coroner,'') THEN 1 ELSE 0 END) AS bigint) AS changed_coroner FROM o JOIN f USING (url)""", uses=("url", "area", "coroner"))
def _(r):
    return tables.changes(*halves(r), ["area", "coroner"])


@query("J03_audit", HALVES + " SELECT o.url, o.area AS old, reports.area AS raw, f.area AS new FROM o LEFT JOIN reports USING (url) LEFT JOIN f ON f.url = o.url WHERE o.area IS DISTINCT FROM f.area", uses=("url", "area", "coroner"))
def _(r):
    old, new = halves(r)
    return tables.audit(old, r, new, "area")


@query("J04_keep_old", HALVES + " SELECT o.report_id, coalesce(f.area, o.area) AS area FROM o LEFT JOIN f USING (url)", uses=("url", "area", "coroner"))
def _(r):
    return tables.refresh_columns(*halves(r), ["area"]).select("report_id", "area")


@query("J05_new_keys", HALVES + " SELECT report_id FROM f WHERE url NOT IN (SELECT url FROM o)", uses=("url", "area", "coroner"))
def _(r):
    return tables.new_rows(*halves(r)).select("report_id")


@query("J06_exclude", "SELECT report_id, report_id % 10 = 0 AS gone FROM reports")
def _(r):
    active, gone = tables.exclude(r, None, r.where("report_id % 10 = 0"), "not relevant")
    return active.select("report_id", F.lit(False).alias("gone")).unionByName(gone.select("report_id", F.lit(True).alias("gone")))


@query("J07_restore", "SELECT report_id FROM reports WHERE report_id % 10 <> 0 OR report_id % 20 = 0")
def _(r):
    active, gone = tables.exclude(r, None, r.where("report_id % 10 = 0"), "not relevant")
    return tables.restore(active, gone, r.where("report_id % 20 = 0"))[0].select("report_id")


AREA_ROWS = [("NATION_8", "Central", "allowed"), ("nation 8 ", "Central", "synonym"), ("NATION-5", "West", "legacy"), ("nation 11", "Islands", "synonym"), ("NATION_22", "East", "allowed")]
AREA_SQL = "(VALUES " + ", ".join(str(x) for x in AREA_ROWS) + ") AS a(alias, canonical, kind)"


@query("J08_area_lookup", f""", k AS (SELECT trim(alias) AS key, 1 AS raw, CASE kind WHEN 'synonym' THEN 0 WHEN 'legacy' THEN 1 ELSE 2 END AS place, canonical, concat('raw_', kind) AS method FROM {AREA_SQL}
  UNION ALL SELECT {KEY_SQL.format('alias')}, 0, CASE kind WHEN 'synonym' THEN 3 WHEN 'legacy' THEN 4 ELSE 5 END, canonical, concat('normalised_', kind) FROM {AREA_SQL})
  SELECT report_id, coalesce(arg_min(canonical, place), 'Other') AS area_canonical, coalesce(arg_min(method, place), 'none') AS match_method
  FROM reports LEFT JOIN k ON (k.raw = 1 AND k.key = trim(area)) OR (k.raw = 0 AND k.key = {KEY_SQL.format('area')}) GROUP BY report_id""", uses=("area",))
def _(r):
    areas = r.sparkSession.createDataFrame(AREA_ROWS, "alias string, canonical string, kind string")
    return canonical.match_areas(r, areas, strategy="exact_only").select("report_id", "area_canonical", "match_method")


@query("J09_area_fuzzy", uses=("area",))
def _(r):
    areas = r.sparkSession.createDataFrame(AREA_ROWS, "alias string, canonical string, kind string")
    typed = r.withColumn("area", F.regexp_replace("area", "NATION", "NATOIN"))
    return canonical.match_areas(typed, areas).select("report_id", "area_canonical", "match_method", F.round("match_score", 6).alias("match_score"))


@query("J10_receiver_names", "SELECT report_id, CASE area WHEN 'NATION_8' THEN 'Federal Republic' WHEN 'NATION_5' THEN 'Republic' ELSE area END AS name FROM reports", uses=("area",))
def _(r):
    return r.select("report_id", X.canonical_receiver(F.col("area"), {"nation 8": "Federal Republic", "nation 5": "Republic"}).alias("name"))


@query("J13_theme_pairs", ", m AS (" + " UNION ALL ".join(f"SELECT report_id, '{t}' AS theme FROM reports WHERE {t}" for t in THEMES) + ") SELECT a.theme AS left_theme, b.theme AS right_theme, count(*) AS n FROM m AS a JOIN m AS b USING (report_id) WHERE a.theme < b.theme GROUP BY 1, 2")
def _(r):
    e = graph.edges(r, THEMES).where("kind = 'theme_theme'")
    name = lambda c: F.regexp_replace(c, "^theme::", "")
    return e.select(name("source").alias("left_theme"), name("target").alias("right_theme"), "n")


@query("U01_append", HALVES + " SELECT report_id FROM o UNION ALL SELECT report_id FROM f WHERE url NOT IN (SELECT url FROM o)", uses=("url", "area", "coroner"))
def _(r):
    return tables.top_up(*halves(r)).select("report_id")


@query("U02_ragged_union", HALVES + " SELECT report_id, receiver FROM o UNION ALL SELECT report_id, NULL FROM f")
def _(r):
    old, new = halves(r)
    return old.unionByName(new.drop("receiver"), allowMissingColumns=True).select("report_id", "receiver")


@query("U03_decoys", uses=("theme_urgent",))
def _(r):
    return tables.decoys(r, "theme_urgent").select("report_id", "theme_urgent")


@query("U05_overlap", f"SELECT report_id, len(list_intersect({SEGMENTS}, ['Supplier#000000001', 'Supplier#000000007'])) > 0 AS hit FROM reports", uses=("receiver",))
def _(r):
    return r.select("report_id", F.arrays_overlap(X.receivers(F.col("receiver")), X.lit_array(["Supplier#000000001", "Supplier#000000007"])).alias("hit"))


@query("X01_stratified_sample", uses=("date",))
def _(r):
    return tables.stratified_sample(r, 100).select("report_id", F.year("date").alias("year"))


@query("A29_strata", "SELECT coalesce(year(\"date\"), -1) AS year, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM reports) AS double), 6) AS share FROM reports GROUP BY 1", uses=("date",))
def _(r):
    y = r.groupBy(F.coalesce(F.year("date"), F.lit(-1)).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    total = r.agg(F.count(F.lit(1)).alias("total"))
    return y.crossJoin(F.broadcast(total)).select("year", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("Z03_row_ids", """SELECT report_id, CASE WHEN report_id % 5 <> 0 THEN url WHEN url = (SELECT min(url) FROM reports WHERE report_id % 5 = 0) THEN 'same'
  ELSE sha256(concat_ws('|', url, 'same', '1')) END AS row_id FROM reports""", uses=("url",))
def _(r):
    dup = r.withColumn("row_id", F.when(F.col("report_id") % 5 == 0, F.lit("same")).otherwise(F.col("url")))
    return facets.dedupe_ids(dup).select("report_id", "row_id")


# ---------------------------------------------------------------------------- network

MELT_SQL = ", m AS (" + " UNION ALL ".join(f"SELECT report_id, '{t}' AS v FROM reports WHERE {t}" for t in THEMES) + f"""), act AS (SELECT DISTINCT report_id FROM m),
  g AS (SELECT report_id, 'theme' AS kind, v AS value FROM m UNION ALL SELECT report_id, 'receiver', unnest({FIRST_SEEN}) FROM reports WHERE report_id IN (SELECT report_id FROM act)
  UNION ALL SELECT report_id, 'coroner', trim(coroner) FROM reports WHERE report_id IN (SELECT report_id FROM act) AND trim(coroner) <> '' UNION ALL SELECT report_id, 'area', trim(area) FROM reports WHERE report_id IN (SELECT report_id FROM act) AND trim(area) <> ''),
  nd AS (SELECT kind, value, count(*) AS n FROM g GROUP BY 1, 2),
  ed AS (SELECT concat(a.kind, '_', b.kind) AS kind, concat(a.kind, '::', a.value) AS source, concat(b.kind, '::', b.value) AS target, count(*) AS n FROM g AS a JOIN g AS b USING (report_id)
  WHERE a.kind = 'theme' AND (b.kind <> 'theme' OR a.value < b.value) GROUP BY 1, 2, 3)"""


@query("A23_nodes", MELT_SQL + " SELECT kind, value, n FROM nd")
def _(r):
    return graph.nodes(graph.node_rows(r, THEMES))


@query("A24_edges", MELT_SQL + " SELECT kind, source, target, n FROM ed")
def _(r):
    return graph.edges(r, THEMES)


@query("J14_bipartite_pairs", f"""SELECT 'coroner_area' AS kind, concat('coroner::', trim(coroner)) AS source, concat('area::', trim(area)) AS target, count(*) AS n FROM reports WHERE trim(coroner) <> '' AND trim(area) <> '' GROUP BY 2, 3
  UNION ALL SELECT 'receiver_area', concat('receiver::', s), concat('area::', trim(area)), count(*) FROM (SELECT unnest({FIRST_SEEN}) AS s, area FROM reports) WHERE trim(area) <> '' GROUP BY 2, 3
  UNION ALL SELECT 'receiver_coroner', concat('receiver::', s), concat('coroner::', trim(coroner)), count(*) FROM (SELECT unnest({FIRST_SEEN}) AS s, coroner FROM reports) WHERE trim(coroner) <> '' GROUP BY 2, 3""")
def _(r):
    return graph.edges(r)


@query("A25_jaccard", MELT_SQL + """ SELECT source, target, ed.n AS n, round(ed.n / CAST(a.n + b.n - ed.n AS double), 6) AS jaccard FROM ed JOIN nd AS a ON a.kind = 'theme' AND concat('theme::', a.value) = source
  JOIN nd AS b ON b.kind = 'theme' AND concat('theme::', b.value) = target WHERE ed.kind = 'theme_theme'""")
def _(r):
    return graph.jaccard(graph.edges(r, THEMES), graph.nodes(graph.node_rows(r, THEMES)))


@query("A26_summary", MELT_SQL + """ , s AS (SELECT (SELECT count(DISTINCT report_id) FROM m) AS reports_with_theme, (SELECT count(*) FROM m) AS theme_assignments, (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges,
  greatest(1, (SELECT max(n) FROM ed)) AS max_edge_weight, (SELECT value FROM nd WHERE kind = 'theme' ORDER BY n DESC, value LIMIT 1) AS top_theme)
  SELECT *, least(180, greatest(50, nodes)) AS default_limit, greatest(least(180, greatest(50, nodes)), least(420, greatest(80, nodes))) AS max_limit FROM s""")
def _(r):
    rows = graph.node_rows(r, THEMES)
    return graph.summary(rows, graph.nodes(rows), graph.edges(r, THEMES))


@query("A27_degree", MELT_SQL + """ , b AS (SELECT source AS id, target AS other, n FROM ed UNION ALL SELECT target, source, n FROM ed)
  SELECT id, round(count(DISTINCT other) / CAST((SELECT count(DISTINCT id) FROM b) - 1 AS double), 6) AS degree, CAST(sum(n) AS bigint) AS strength FROM b GROUP BY id""")
def _(r):
    return graph.degree(graph.edges(r, THEMES)).withColumn("degree", F.round("degree", 6))


@query("A28_betweenness")
def _(r):
    return graph.betweenness(graph.edges(r, THEMES))


@query("A30_search_index", MELT_SQL + " SELECT kind, value, n FROM nd")
def _(r):
    return graph.nodes(graph.node_rows(r, THEMES)).orderBy("kind", F.desc("n"), F.lower("value"), "value")


@query("P13_visible_nodes", MELT_SQL + """ , i AS (SELECT *, concat(kind, '::', value) AS id, row_number() OVER (PARTITION BY kind ORDER BY n DESC, lower(value), value) AS tr FROM nd WHERE kind IN ('theme', 'area', 'receiver')),
  sh AS (SELECT * FROM i WHERE kind <> 'theme' OR tr <= 4 ORDER BY n DESC, lower(value), value, kind LIMIT 120), k AS (SELECT * FROM ed WHERE n >= 3 AND source IN (SELECT id FROM sh) AND target IN (SELECT id FROM sh))
  SELECT id, n FROM sh WHERE (SELECT count(*) FROM k) = 0 OR id IN (SELECT source FROM k UNION SELECT target FROM k)""")
def _(r):
    n, e = graph.nodes(graph.node_rows(r, THEMES)), graph.edges(r, THEMES)
    return graph.visible(n, e, ["theme", "area", "receiver"], 4, 120, 3).select("id", "n")


@query("P12_scope", MELT_SQL + " SELECT report_id FROM act WHERE report_id IN (SELECT report_id FROM m WHERE v = 'theme_promo')")
def _(r):
    rows = graph.node_rows(r, THEMES)
    shown = graph.nodes(rows).where("kind = 'theme'").withColumn("id", F.concat("kind", F.lit("::"), "value"))
    return graph.scope(r, rows, shown, ["theme::theme_promo"]).select("report_id")


@query("P16_node_search", MELT_SQL + " SELECT kind, value, n FROM nd WHERE contains(lower(value), '11') OR contains(kind, '11') ORDER BY n DESC, lower(value), value, kind LIMIT 80")
def _(r):
    return graph.search_nodes(graph.nodes(graph.node_rows(r, THEMES)), "11")


CAPPED = """ , c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, lower(value), value) AS "rank" FROM nd WHERE n >= CASE WHEN (SELECT count(*) FROM reports) <= 250 THEN 1 ELSE 2 END),
  k AS (SELECT * FROM c WHERE "rank" <= CASE kind WHEN 'receiver' THEN 72 WHEN 'coroner' THEN 44 WHEN 'area' THEN 36 ELSE 1000000 END)"""


@query("W02_node_caps", MELT_SQL + CAPPED + " SELECT kind, value, n, CAST(\"rank\" AS bigint) AS \"rank\" FROM k")
def _(r):
    return graph.capped(graph.nodes(graph.node_rows(r, THEMES)), r.count()).withColumn("rank", F.col("rank").cast("long"))


@query("W04_node_sizes", MELT_SQL + """ SELECT kind, value, round(CASE WHEN hi = lo THEN 25.0 ELSE 10 + 30 * pow((n - lo) / CAST(hi - lo AS double), 0.62) END, 2) AS size
  FROM (SELECT *, min(n) OVER (PARTITION BY kind) AS lo, max(n) OVER (PARTITION BY kind) AS hi FROM nd)""")
def _(r):
    out = graph.sized(graph.nodes(graph.node_rows(r, THEMES)))
    return out.select("kind", "value", F.col("size").cast("double").alias("size"))


@query("W05_label_threshold", MELT_SQL + " SELECT n FROM nd ORDER BY n DESC LIMIT 1 OFFSET (SELECT CAST(greatest(0, floor(count(*) * 0.2) - 1) AS bigint) FROM nd)")
def _(r):
    return graph.label_threshold(graph.nodes(graph.node_rows(r, THEMES)))


@query("W03_theme_cap", MELT_SQL + """ , o AS (SELECT *, sum(CASE WHEN kind = 'theme' THEN 1 ELSE 0 END) OVER (ORDER BY n DESC, lower(value), value, kind ROWS UNBOUNDED PRECEDING) AS t FROM nd)
  SELECT kind, value, n FROM o WHERE kind <> 'theme' OR t <= 3""")
def _(r):
    return graph.theme_capped(graph.nodes(graph.node_rows(r, THEMES)), 3)


@query("W08_accents", MELT_SQL + CAPPED + " SELECT kind, value, CAST((\"rank\" - 1) % 6 AS int) AS accent FROM k")
def _(r):
    return graph.accented(graph.capped(graph.nodes(graph.node_rows(r, THEMES)), r.count())).select("kind", "value", "accent")


@query("O04_top_edges", MELT_SQL + " SELECT kind, source, target, n FROM ed ORDER BY n DESC, source, target LIMIT 200")
def _(r):
    return graph.top_edges(graph.edges(r, THEMES), 200)


@query("O05_greedy_pairs", MELT_SQL + """ , j AS (SELECT source, target, ed.n AS n, round(ed.n / CAST(a.n + b.n - ed.n AS double), 6) AS jaccard FROM ed JOIN nd AS a ON a.kind = 'theme' AND concat('theme::', a.value) = source
  JOIN nd AS b ON b.kind = 'theme' AND concat('theme::', b.value) = target WHERE ed.kind = 'theme_theme'), rk AS (SELECT *, row_number() OVER (ORDER BY jaccard DESC, n DESC, source, target) AS k FROM j),
  gr AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS ends, false AS takes UNION ALL
    SELECT rk.k, CASE WHEN len(list_filter(ends, lambda x: x = source)) < 3 AND len(list_filter(ends, lambda x: x = target)) < 3 THEN list_concat(ends, [source, target]) ELSE ends END,
      len(list_filter(ends, lambda x: x = source)) < 3 AND len(list_filter(ends, lambda x: x = target)) < 3 FROM gr JOIN rk ON rk.k = gr.k + 1)
  SELECT source, target, n, jaccard FROM rk JOIN gr USING (k) WHERE takes""")
def _(r):
    return graph.greedy_pairs(graph.jaccard(graph.edges(r, THEMES), graph.nodes(graph.node_rows(r, THEMES))), each=3)


ORACLE_SQL["O05_greedy_pairs"] = ORACLE_SQL["O05_greedy_pairs"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("O07_focus_panel", MELT_SQL + """ , b AS (SELECT target AS id, n FROM ed WHERE source = 'theme::theme_promo' UNION ALL SELECT source, n FROM ed WHERE target = 'theme::theme_promo'),
  s AS (SELECT id, split_part(id, '::', 1) AS kind, CAST(sum(n) AS bigint) AS n FROM b GROUP BY id), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, id) AS int) AS "rank", row_number() OVER (ORDER BY n DESC, id) <= 10 AS overall FROM s)
  SELECT id, kind, n, "rank", overall FROM o WHERE "rank" <= 5 OR overall""")
def _(r):
    return graph.focus_panel(graph.edges(r, THEMES), "theme::theme_promo")


@query("O09_connected_nodes", MELT_SQL + " , e AS (SELECT * FROM ed WHERE n >= 3) SELECT kind, value FROM nd WHERE concat(kind, '::', value) IN (SELECT source FROM e UNION SELECT target FROM e)")
def _(r):
    n, e = graph.nodes(graph.node_rows(r, THEMES)), graph.edges(r, THEMES).where("n >= 3")
    return graph.connected_only(n.select("kind", "value"), e).select("kind", "value")


@query("O01_newest_first", f"SELECT report_id, {day('"date"')} AS day FROM reports ORDER BY \"date\" DESC, report_id LIMIT 25", uses=("date",))
def _(r):
    return r.orderBy(F.desc_nulls_last("date"), "report_id").limit(25).select("report_id", F.col("date").cast("string").alias("day"))


# ---------------------------------------------------------------------------- pages, models, streams


@query("T20_T22_html_fields", view=False)
def _(t):
    configs = [html.FieldConfig("lead", keywords=("the", "and", "la", "der")), html.FieldConfig("part", section="the", longest=500)]
    return html.fields(t("pages").select("page_id", "html"), configs).withColumn("title", html.title_udf()("html")).drop("html")


@query("S08_document_links", "SELECT page_id, concat('/files/', page_id, CASE page_id % 3 WHEN 0 THEN '.pdf' ELSE '-b.pdf' END) AS link FROM pages WHERE page_id % 3 < 2", view=False)
def _(t):
    file = lambda kind, end: F.concat(F.lit(f'<div class="{kind}"><a class="{kind}" href="/files/'), F.col("page_id").cast("string"), F.lit(f'{end}">x</a></div>'))
    made = F.when(F.col("page_id") % 3 == 0, F.concat(file("govuk-button", "-b.pdf"), file("wp-block-file", ".pdf"))).when(F.col("page_id") % 3 == 1, file("govuk-button", "-b.pdf")).otherwise("")
    linked = t("pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), made).alias("html"))
    return linked.select("page_id", html.document_link_udf()("html").alias("link")).where("link is not null")


@query("L04_screen", "SELECT report_id FROM reports WHERE contains(lower(concat_ws(' ', investigation, circumstances, concerns)), 'thing')", uses=("investigation", "circumstances", "concerns"))
def _(r):
    return models.screen(r, models.KeywordModel("thing"), "things of any kind").select("report_id")


@query("L05_extract", "SELECT report_id, CAST(41 AS bigint) AS age, 'north' AS place FROM reports")
def _(r):
    return models.extract(r, models.KeywordModel(fields={"age": 41, "place": "north"}), {"age": "int", "place": "str"}).select("report_id", "age", "place")


@query("L06_summarise", "SELECT report_id, len(list_filter(string_split_regex(concat_ws(chr(10), CASE WHEN investigation IS NOT NULL THEN concat('Investigation: ', investigation) END, CASE WHEN circumstances IS NOT NULL THEN concat('Circumstances: ', circumstances) END, CASE WHEN concerns IS NOT NULL THEN concat('Concerns: ', concerns) END), '\\s+'), lambda x: x <> '')) > 20 AS cut FROM reports", uses=("investigation", "circumstances", "concerns"))
def _(r):
    full, cut = models.summarise(r), models.summarise(r, max_words=20)
    return full.select("report_id", F.col("summary").alias("a")).join(cut.select("report_id", F.col("summary").alias("b")), "report_id").select("report_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("cut"))


@query("L08_clean_column", "SELECT report_id, upper(coroner) AS coroner FROM reports", uses=("coroner",))
def _(r):
    return models.clean_column(r, models.KeywordModel(), "coroner", "Tidy the name.").select("report_id", "coroner")


@query("I_event_windows", "SELECT CAST(date_trunc('day', ts) AS varchar) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", view=False)
def _(t):
    return event_windows(t("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

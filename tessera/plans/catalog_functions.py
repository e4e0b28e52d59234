"""Registered queries for the calculation functions.

Each query applies one function family to a whole table and returns the key
plus the results; the oracle is the same computation in DuckDB SQL.
Transcendental results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.plans.registry import register, sql_initcap
from tessera.sources.tables import table


def fq(qid: str, tbl: str, keys: list[str], spark_cols: Callable[[], dict[str, Column]],
       sql_cols: dict[str, str], from_sql: str | None = None,
       source: Callable[[SparkSession, str], DataFrame] | None = None) -> None:
    """Register ``SELECT keys, f(...) AS name ... FROM tbl`` on both engines."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir) if source else table(spark, sf_dir, tbl)
        return df.select(*[F.col(k) for k in keys], *[v.alias(n) for n, v in spark_cols().items()])
    run.__name__ = qid
    sel = ", ".join([*[f"CAST({k} AS BIGINT) AS {k}" for k in keys], *[f"{e} AS {n}" for n, e in sql_cols.items()]])
    register(qid, f"SELECT {sel} FROM {from_sql or tbl}")(run)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def s6(e: str) -> str:
    return f"round({e}, 6)"


# ------------------------------------------------------------------ string

fq("fn_ascii", "documents", ["doc_id"], lambda: {"code": fn.ascii_("text")}, {"code": "CAST(ascii(text) AS BIGINT)"})
fq("fn_char", "customer", ["c_custkey"],
   lambda: {"ch": fn.char(F.col("c_custkey") + 32), "ch_small": fn.char(F.col("c_nationkey") + 65)},
   {"ch": "chr((c_custkey + 32)::INTEGER)", "ch_small": "chr((c_nationkey + 65)::INTEGER)"})
fq("fn_contains", "documents", ["doc_id"], lambda: {"has_the": fn.contains("text", "the")},
   {"has_the": "contains(text, 'the')"})
fq("fn_startswith", "part", ["p_partkey"], lambda: {"starts_red": fn.startswith("p_name", "red")},
   {"starts_red": "starts_with(p_name, 'red')"})
fq("fn_endswith", "part", ["p_partkey"], lambda: {"ends_widget": fn.endswith("p_name", "widget")},
   {"ends_widget": "suffix(p_name, 'widget')"})
fq("fn_find", "documents", ["doc_id"],
   lambda: {"pos": fn.find("text", "the"), "pos_from_100": fn.find("text", "the", 100)},
   {"pos": "instr(text, 'the')",
    "pos_from_100": "CASE WHEN instr(substr(text, 100), 'the') > 0 THEN instr(substr(text, 100), 'the') + 99 ELSE 0 END"})
fq("fn_findnth", "documents", ["doc_id"], lambda: {"pos3": fn.findnth("text", "the", 3)},
   {"pos3": "CASE WHEN len(string_split(text, 'the')) - 1 >= 3 "
            "THEN length(array_to_string(string_split(text, 'the')[1:3], 'the')) + 1 ELSE 0 END"})
fq("fn_left", "customer", ["c_custkey"], lambda: {"l8": fn.left("c_name", 8)}, {"l8": "left(c_name, 8)"})
fq("fn_right", "customer", ["c_custkey"], lambda: {"r4": fn.right("c_name", 4)}, {"r4": "right(c_name, 4)"})
fq("fn_mid", "documents", ["doc_id"],
   lambda: {"m": fn.mid("text", 5, 20), "tail": fn.len_(fn.mid("text", 10))},
   {"m": "substr(text, 5, 20)", "tail": "length(substr(text, 10))"})
fq("fn_len", "documents", ["doc_id"], lambda: {"n": fn.len_("text")}, {"n": "length(text)"})
fq("fn_lower", "documents", ["doc_id"], lambda: {"low": fn.lower("text")}, {"low": "lower(text)"})
fq("fn_upper", "documents", ["doc_id"], lambda: {"up": fn.upper("text")}, {"up": "upper(replace(text, 'ß', 'SS'))"})
fq("fn_proper", "part", ["p_partkey"], lambda: {"proper": fn.proper("p_name")},
   {"proper": sql_initcap("p_name")})
fq("fn_trim", "customer", ["c_custkey"],
   lambda: {"t": fn.trim(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  ")))},
   {"t": "trim('  ' || c_mktsegment || '  ')"})
fq("fn_ltrim", "customer", ["c_custkey"],
   lambda: {"t": fn.ltrim(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  ")))},
   {"t": "ltrim('  ' || c_mktsegment || '  ')"})
fq("fn_rtrim", "customer", ["c_custkey"],
   lambda: {"t": fn.rtrim(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  ")))},
   {"t": "rtrim('  ' || c_mktsegment || '  ')"})
fq("fn_replace", "documents", ["doc_id"], lambda: {"r": fn.replace("text", "the", "THE")},
   {"r": "replace(text, 'the', 'THE')"})
fq("fn_space", "part", ["p_partkey"], lambda: {"padded": fn.concat(fn.space(F.col("p_size") % 7), F.col("p_brand"))},
   {"padded": "repeat(' ', (p_size % 7)::INTEGER) || p_brand"})
fq("fn_split", "pages", ["page_id"],
   lambda: {"host": fn.split("url", "/", 3), "last_dot": fn.split("url", ".", -1), "tok0": fn.split("url", "/", 0)},
   {"host": "split_part(url, '/', 3)", "last_dot": "split_part(url, '.', -1)", "tok0": "NULL::VARCHAR"})
fq("fn_concat", "customer", ["c_custkey"],
   lambda: {"label": fn.concat(F.col("c_name"), " / ", F.col("c_mktsegment"))},
   {"label": "c_name || ' / ' || c_mktsegment"})
fq("fn_combined_field", "customer", ["c_custkey"],
   lambda: {"combined": fn.combined_field(["c_mktsegment", "c_nationkey"], " | ")},
   {"combined": "concat_ws(' | ', c_mktsegment, CAST(c_nationkey AS VARCHAR))"})
fq("fn_min2", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"m": fn.min2(F.col("l_quantity"), F.col("l_tax") * 500)},
   {"m": "least(l_quantity, l_tax * 500)"})
fq("fn_max2", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"m": fn.max2(F.col("l_quantity"), F.col("l_tax") * 500)},
   {"m": "greatest(l_quantity, l_tax * 500)"})

# ------------------------------------------------------------------ regex

fq("fn_regexp_match", "pages", ["page_id"], lambda: {"secure": fn.regexp_match("url", r"^https://"),
                                                      "numeric_path": fn.regexp_match("url", r"/[0-9]+")},
   {"secure": "regexp_matches(url, '^https://')", "numeric_path": "regexp_matches(url, '/[0-9]+')"})
fq("fn_regexp_extract", "pages", ["page_id"], lambda: {"host": fn.regexp_extract("url", r"//([^/]+)/"),
                                                        "page": fn.regexp_extract("url", r"page=([0-9]+)")},
   {"host": "CASE WHEN regexp_matches(url, '//([^/]+)/') THEN regexp_extract(url, '//([^/]+)/', 1) END",
    "page": "CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 1) END"})
fq("fn_regexp_extract_nth", "pages", ["page_id"],
   lambda: {"lang": fn.regexp_extract_nth("url", r"^(https?)://([^/]+)/([a-z]+)/", 3)},
   {"lang": "CASE WHEN regexp_matches(url, '^(https?)://([^/]+)/([a-z]+)/') "
            "THEN regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/', 3) END"})
fq("fn_regexp_replace", "documents", ["doc_id"], lambda: {"masked": fn.regexp_replace("text", r"[0-9]+", "#")},
   {"masked": "regexp_replace(text, '[0-9]+', '#', 'g')"})

# ------------------------------------------------------------------ math

fq("fn_abs", "customer", ["c_custkey"], lambda: {"a": fn.abs_("c_acctbal")}, {"a": "abs(c_acctbal)"})
fq("fn_ceiling", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"c": fn.ceiling(F.col("l_extendedprice") / 7).cast("long")},
   {"c": "ceil(l_extendedprice / 7)::BIGINT"})
fq("fn_floor", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"f": fn.floor(F.col("l_extendedprice") / 7).cast("long")},
   {"f": "floor(l_extendedprice / 7)::BIGINT"})
fq("fn_round", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"r2": fn.round_(F.col("l_extendedprice") / 7, 2), "r0": fn.round_(F.col("l_quantity") * 1.5, 0)},
   {"r2": "round(l_extendedprice / 7, 2)", "r0": "round(l_quantity * 1.5, 0)"})
fq("fn_power", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"p": r6(fn.power("l_discount", 2) * 1000), "p3": r6(fn.power("l_quantity", 1.5))},
   {"p": s6("pow(l_discount, 2) * 1000"), "p3": s6("pow(l_quantity, 1.5)")})
fq("fn_sqrt", "customer", ["c_custkey"], lambda: {"s": r6(fn.sqrt("c_acctbal"))},
   {"s": s6("CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END")})
fq("fn_square", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {"sq": fn.square("l_quantity")},
   {"sq": "l_quantity * l_quantity"})
fq("fn_log", "customer", ["c_custkey"],
   lambda: {"lg": r6(fn.log("c_acctbal")), "lg2": r6(fn.log("c_acctbal", 2))},
   {"lg": s6("CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END"),
    "lg2": s6("CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) / ln(2) END")})
fq("fn_ln", "customer", ["c_custkey"], lambda: {"l": r6(fn.ln("c_acctbal"))},
   {"l": s6("CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END")})
fq("fn_exp", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {"e": r6(fn.exp(F.col("l_discount") * 10))},
   {"e": s6("exp(l_discount * 10)")})
fq("fn_sign", "customer", ["c_custkey"], lambda: {"s": fn.sign("c_acctbal")}, {"s": "sign(c_acctbal)::BIGINT"})
fq("fn_pi", "part", ["p_partkey"], lambda: {"circ": r6(fn.pi() * F.col("p_size"))}, {"circ": s6("pi() * p_size")})
for _name, _sp, _sq in [("sin", fn.sin, "sin"), ("cos", fn.cos, "cos"), ("tan", fn.tan, "tan"),
                        ("atan", fn.atan, "atan")]:
    fq(f"fn_{_name}", "customer", ["c_custkey"],
       (lambda _sp=_sp: {"v": r6(_sp(F.col("c_acctbal") / 1000))}), {"v": s6(f"{_sq}(c_acctbal / 1000)")})
fq("fn_acos", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {"v": r6(fn.acos(F.col("l_discount") * 10 - 0.5))},
   {"v": s6("CASE WHEN l_discount * 10 - 0.5 BETWEEN -1 AND 1 THEN acos(l_discount * 10 - 0.5) END")})
fq("fn_asin", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {"v": r6(fn.asin(F.col("l_discount") * 10 - 0.5))},
   {"v": s6("CASE WHEN l_discount * 10 - 0.5 BETWEEN -1 AND 1 THEN asin(l_discount * 10 - 0.5) END")})
fq("fn_cot", "customer", ["c_custkey"], lambda: {"v": r6(fn.cot(F.col("c_acctbal") / 1000))},
   {"v": s6("CASE WHEN tan(c_acctbal / 1000) <> 0 THEN cot(c_acctbal / 1000) END")})
fq("fn_atan2", "customer", ["c_custkey"],
   lambda: {"v": r6(fn.atan2(F.col("c_nationkey") - 12, F.col("c_custkey") % 3 - 1))},
   {"v": s6("CASE WHEN (c_custkey % 3 - 1) <> 0 OR (c_nationkey - 12) <> 0 "
            "THEN atan2(c_nationkey - 12, c_custkey % 3 - 1) END")})
fq("fn_degrees", "customer", ["c_custkey"], lambda: {"v": r6(fn.degrees(F.col("c_acctbal") / 1000))},
   {"v": s6("degrees(c_acctbal / 1000)")})
fq("fn_radians", "customer", ["c_custkey"], lambda: {"v": r6(fn.radians("c_acctbal"))},
   {"v": s6("radians(c_acctbal)")})
fq("fn_div", "orders", ["o_orderkey"],
   lambda: {"q": fn.div(F.col("o_orderkey") - 7000, 7), "q0": fn.div("o_orderkey", F.col("o_orderkey") % 5)},
   {"q": "(o_orderkey - 7000) // 7",
    "q0": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // (o_orderkey % 5) END"})
fq("fn_mod", "orders", ["o_orderkey"],
   lambda: {"m": fn.mod(F.col("o_orderkey") - 7000, 7), "m0": fn.mod("o_orderkey", F.col("o_orderkey") % 5)},
   {"m": "(o_orderkey - 7000) % 7", "m0": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % (o_orderkey % 5) END"})

_HEX_SQL = {
    # Nearest of the two offset rectangular lattices of hexagon centres
    # (pointy-top, side 1): lattice A at (sqrt(3) i, 3 j), B shifted by half.
    "hax": "round(x / sqrt(3)) * sqrt(3)", "hay": "round(y / 3.0) * 3.0",
    "hbx": "(floor(x / sqrt(3)) + 0.5) * sqrt(3)", "hby": "(floor(y / 3.0) + 0.5) * 3.0",
}
_HEX_FROM = ("(SELECT c_custkey, x, y, {hax} AS hax, {hay} AS hay, {hbx} AS hbx, {hby} AS hby FROM "
             "(SELECT c_custkey, c_acctbal / 500.0 AS x, c_nationkey / 2.0 AS y FROM customer))").format(**_HEX_SQL)
_HEX_A = "((x - hax) * (x - hax) + (y - hay) * (y - hay) <= (x - hbx) * (x - hbx) + (y - hby) * (y - hby))"
fq("fn_hexbinx", "customer", ["c_custkey"],
   lambda: {"hx": r6(fn.hexbinx(F.col("c_acctbal") / 500.0, F.col("c_nationkey") / 2.0))},
   {"hx": s6(f"CASE WHEN {_HEX_A} THEN hax ELSE hbx END")}, from_sql=_HEX_FROM)
fq("fn_hexbiny", "customer", ["c_custkey"],
   lambda: {"hy": r6(fn.hexbiny(F.col("c_acctbal") / 500.0, F.col("c_nationkey") / 2.0))},
   {"hy": s6(f"CASE WHEN {_HEX_A} THEN hay ELSE hby END")}, from_sql=_HEX_FROM)

# ------------------------------------------------------------------ dates

_PARTS = ["year", "quarter", "month", "week", "day", "hour", "minute", "second"]
fq("fn_dateadd", "orders", ["o_orderkey"],
   lambda: {"plus_month": fn.dateadd("month", 1, "o_orderdate"),
            "minus_quarter": fn.dateadd("quarter", -1, "o_orderdate"),
            "plus_week": fn.dateadd("week", 2, "o_orderdate"),
            "plus_hours": fn.dateadd("hour", 30, "o_orderdate"),
            "plus_year_date": fn.dateadd("year", 1, F.col("o_orderdate").cast("date"), is_date=True)},
   {"plus_month": "o_orderdate + INTERVAL 1 MONTH", "minus_quarter": "o_orderdate - INTERVAL 3 MONTH",
    "plus_week": "o_orderdate + INTERVAL 14 DAY", "plus_hours": "o_orderdate + INTERVAL 30 HOUR",
    "plus_year_date": "CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE)"})

_WEEK_START_SQL = "(CAST({d} AS DATE) - CAST(dayofweek({d}) AS INTEGER))"


def _datediff_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner")


fq("fn_datediff", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {f"d_{p}": fn.datediff(p, "o_orderdate", "l_shipdate") for p in _PARTS},
   {**{f"d_{p}": f"date_diff('{p}', o_orderdate, l_shipdate)" for p in _PARTS if p != "week"},
    "d_week": "(({b}) - ({a})) // 7".format(b=_WEEK_START_SQL.format(d="l_shipdate"),
                                            a=_WEEK_START_SQL.format(d="o_orderdate"))},
   from_sql="lineitem JOIN orders ON l_orderkey = o_orderkey", source=_datediff_source)
fq("fn_datediff_time", "events", ["event_id"],
   lambda: {f"d_{p}": fn.datediff(p, "ts", F.lit("2024-01-15 12:34:56").cast("timestamp_ntz"))
            for p in ["hour", "minute", "second", "day"]},
   {f"d_{p}": f"date_diff('{p}', ts, TIMESTAMP '2024-01-15 12:34:56')" for p in ["hour", "minute", "second", "day"]})
fq("fn_datename", "orders", ["o_orderkey"],
   lambda: {"month_name": fn.datename("month", "o_orderdate"), "weekday_name": fn.datename("weekday", "o_orderdate"),
            "year_name": fn.datename("year", "o_orderdate")},
   {"month_name": "monthname(o_orderdate)", "weekday_name": "dayname(o_orderdate)",
    "year_name": "CAST(year(o_orderdate) AS VARCHAR)"})
fq("fn_dateparse", "orders", ["o_orderkey"],
   lambda: {"parsed": fn.dateparse("dd/MM/yyyy", F.date_format("o_orderdate", "dd/MM/yyyy")),
            "bad": fn.dateparse("dd/MM/yyyy", F.col("o_orderpriority"))},
   {"parsed": "try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')",
    "bad": "try_strptime(o_orderpriority, '%d/%m/%Y')"})
_DP_SQL = {
    "year": "year(ts)", "quarter": "quarter(ts)", "month": "month(ts)", "day": "day(ts)",
    "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)",
    "weekday": "dayofweek(ts) + 1", "dayofyear": "dayofyear(ts)",
    "week": "floor((dayofyear(ts) + dayofweek(date_trunc('year', ts)) + 1 - 2) / 7) + 1",
}
fq("fn_datepart", "events", ["event_id"], lambda: {f"p_{p}": fn.datepart(p, "ts") for p in _DP_SQL},
   {f"p_{p}": f"CAST({e} AS BIGINT)" for p, e in _DP_SQL.items()})
fq("fn_year", "orders", ["o_orderkey"], lambda: {"y": fn.year("o_orderdate")}, {"y": "year(o_orderdate)"})
fq("fn_month", "orders", ["o_orderkey"], lambda: {"m": fn.month("o_orderdate")}, {"m": "month(o_orderdate)"})
fq("fn_day", "orders", ["o_orderkey"], lambda: {"d": fn.day("o_orderdate")}, {"d": "day(o_orderdate)"})
fq("fn_quarter", "orders", ["o_orderkey"], lambda: {"q": fn.quarter("o_orderdate")}, {"q": "quarter(o_orderdate)"})
fq("fn_week", "orders", ["o_orderkey"], lambda: {"w": fn.week("o_orderdate")},
   {"w": "CAST(floor((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) / 7) + 1 AS BIGINT)"})
_DT_PARTS = ["year", "quarter", "month", "week", "day", "hour", "minute"]
fq("fn_datetrunc", "events", ["event_id"], lambda: {f"t_{p}": fn.datetrunc(p, "ts") for p in _DT_PARTS},
   {**{f"t_{p}": f"date_trunc('{p}', ts)" for p in _DT_PARTS if p != "week"},
    "t_week": "CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS TIMESTAMP)"})
fq("fn_isdate", "orders", ["o_orderkey"],
   lambda: {"ok": fn.isdate(F.col("o_orderdate").cast("string")), "no": fn.isdate("o_orderpriority")},
   {"ok": "try_cast(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NOT NULL",
    "no": "try_cast(o_orderpriority AS TIMESTAMP) IS NOT NULL"})
fq("fn_makedate", "orders", ["o_orderkey"],
   lambda: {"month_end_31": fn.makedate(fn.year("o_orderdate"), fn.month("o_orderdate"), 31),
            "first": fn.makedate(fn.year("o_orderdate"), fn.month("o_orderdate"), 1)},
   {"month_end_31": "try_cast(printf('%04d-%02d-31', year(o_orderdate), month(o_orderdate)) AS DATE)",
    "first": "make_date(year(o_orderdate), month(o_orderdate), 1)"})
fq("fn_makedatetime", "orders", ["o_orderkey"],
   lambda: {"dt": fn.makedatetime("o_orderdate", F.lit("13:45:10"))},
   {"dt": "CAST(o_orderdate AS DATE) + TIME '13:45:10'"})
fq("fn_maketime", "events", ["event_id"],
   lambda: {"clock": fn.maketime(F.hour("ts"), F.minute("ts"), F.second("ts"))},
   {"clock": "printf('%02d:%02d:%02d', hour(ts), minute(ts), second(ts))"})
fq("fn_now", "orders", ["o_orderkey"], lambda: {"past": F.col("o_orderdate") < fn.now()},
   {"past": "o_orderdate < now()"})
fq("fn_today", "orders", ["o_orderkey"], lambda: {"past": F.col("o_orderdate").cast("date") < fn.today()},
   {"past": "CAST(o_orderdate AS DATE) < current_date"})
fq("fn_date_literal", "orders", ["o_orderkey"],
   lambda: {"after_1998": F.col("o_orderdate") >= fn.date_literal("1998-01-01")},
   {"after_1998": "o_orderdate >= DATE '1998-01-01'"})

# ------------------------------------------------------------------ casts, logic, format

fq("fn_int", "customer", ["c_custkey"],
   lambda: {"i": fn.int_("c_acctbal"), "from_text": fn.int_(F.col("c_acctbal").cast("string")),
            "bad": fn.int_("c_mktsegment")},
   {"i": "CAST(trunc(c_acctbal) AS BIGINT)", "from_text": "CAST(trunc(CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE)) AS BIGINT)",
    "bad": "CAST(trunc(try_cast(c_mktsegment AS DOUBLE)) AS BIGINT)"})
fq("fn_float", "part", ["p_partkey"], lambda: {"f": fn.float_("p_size"), "bad": fn.float_("p_brand")},
   {"f": "CAST(p_size AS DOUBLE)", "bad": "try_cast(p_brand AS DOUBLE)"})
fq("fn_str", "orders", ["o_orderkey"], lambda: {"s": fn.str_("o_orderkey")}, {"s": "CAST(o_orderkey AS VARCHAR)"})
fq("fn_date", "orders", ["o_orderkey"], lambda: {"d": fn.date("o_orderdate")}, {"d": "CAST(o_orderdate AS DATE)"})
fq("fn_datetime", "orders", ["o_orderkey"],
   lambda: {"dt": fn.datetime(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))},
   {"dt": "CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)"})
fq("fn_case", "orders", ["o_orderkey"],
   lambda: {"prio": fn.case("o_orderpriority", [("1-URGENT", "high"), ("2-HIGH", "high"), ("5-LOW", "low")], "normal")},
   {"prio": "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' "
            "WHEN '5-LOW' THEN 'low' ELSE 'normal' END"})
fq("fn_if", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"size": fn.if_([(F.col("l_quantity") > 40, "large"), (F.col("l_quantity") > 20, "medium")])},
   {"size": "CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'medium' END"})
fq("fn_iif", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"disc": fn.iif(F.when(F.col("l_tax") > 0, F.col("l_discount") > 0.05), "yes", "no", "unknown")},
   {"disc": "CASE WHEN (CASE WHEN l_tax > 0 THEN l_discount > 0.05 END) IS NULL THEN 'unknown' "
            "WHEN l_discount > 0.05 THEN 'yes' ELSE 'no' END"})
fq("fn_ifnull", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"d": fn.ifnull(F.when(F.col("l_discount") > 0, F.col("l_discount")), -1.0)},
   {"d": "coalesce(nullif(l_discount, 0), -1.0)"})
fq("fn_zn", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"t": fn.zn(F.when(F.col("l_tax") > 0, F.col("l_tax")))}, {"t": "coalesce(nullif(l_tax, 0), 0)"})
fq("fn_isnull", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"n": fn.isnull(F.when(F.col("l_tax") > 0, F.col("l_tax")))}, {"n": "nullif(l_tax, 0) IS NULL"})
fq("fn_isnumber", "orders", ["o_orderkey"],
   lambda: {"whole": fn.isnumber("o_orderpriority"), "head": fn.isnumber(F.substring("o_orderpriority", 1, 1))},
   {"whole": "try_cast(o_orderpriority AS DOUBLE) IS NOT NULL",
    "head": "try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NOT NULL"})
fq("fn_and", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"b": fn.and_(F.col("l_quantity") > 25, F.col("l_discount") < 0.05)},
   {"b": "l_quantity > 25 AND l_discount < 0.05"})
fq("fn_or", "lineitem", ["l_orderkey", "l_linenumber"],
   lambda: {"b": fn.or_(F.col("l_quantity") > 45, F.col("l_discount") == 0)},
   {"b": "l_quantity > 45 OR l_discount = 0"})
fq("fn_not", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {"b": fn.not_(F.col("l_returnflag") == "R")},
   {"b": "NOT (l_returnflag = 'R')"})
fq("fn_eq", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {"b": fn.eq(F.col("l_linestatus"), "F")},
   {"b": "l_linestatus = 'F'"})
fq("fn_ne", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {"b": fn.ne(F.col("l_linestatus"), "F")},
   {"b": "l_linestatus <> 'F'"})
fq("fn_in", "orders", ["o_orderkey"], lambda: {"b": fn.in_("o_orderpriority", ["1-URGENT", "2-HIGH"])},
   {"b": "o_orderpriority IN ('1-URGENT', '2-HIGH')"})
fq("fn_format_number", "orders", ["o_orderkey"],
   lambda: {"money": fn.format_number("o_totalprice", "#,##0.00"),
            "dollars": fn.format_number("o_totalprice", "$#,##0"),
            "plain": fn.format_number("o_totalprice", "0.0")},
   {"money": "format('{:,.2f}', o_totalprice)", "dollars": "'$' || format('{:,.0f}', o_totalprice)",
    "plain": "printf('%.1f', o_totalprice)"})

# ------------------------------------------------------------------ spatial


def _lat(k: str) -> Column:
    return (F.col(k) % 170 - 85).cast("double")


def _lon(k: str) -> Column:
    return (F.col(k) * 7 % 340 - 170).cast("double")


_LAT_SQL = "CAST({k} % 170 - 85 AS DOUBLE)"
_LON_SQL = "CAST({k} * 7 % 340 - 170 AS DOUBLE)"

fq("fn_makepoint", "customer", ["c_custkey"], lambda: {"pt": fn.makepoint(_lat("c_custkey"), _lon("c_custkey"))},
   {"pt": "struct_pack(lat := {}, lon := {})".format(_LAT_SQL.format(k="c_custkey"), _LON_SQL.format(k="c_custkey"))})
fq("fn_makeline", "customer", ["c_custkey"],
   lambda: {"line": fn.makeline(fn.makepoint(_lat("c_custkey"), _lon("c_custkey")),
                                fn.makepoint(_lat("c_nationkey"), _lon("c_nationkey")))},
   {"line": "[struct_pack(lat := {a}, lon := {b}), struct_pack(lat := {c}, lon := {d})]".format(
       a=_LAT_SQL.format(k="c_custkey"), b=_LON_SQL.format(k="c_custkey"),
       c=_LAT_SQL.format(k="c_nationkey"), d=_LON_SQL.format(k="c_nationkey"))})

_HAV = ("2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
        "+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))")
fq("fn_distance", "customer", ["c_custkey"],
   lambda: {"km": F.round(fn.distance(fn.makepoint(_lat("c_custkey"), _lon("c_custkey")),
                                      fn.makepoint(_lat("c_nationkey"), _lon("c_nationkey"))), 3)},
   {"km": "round(" + _HAV.format(lat1=_LAT_SQL.format(k="c_custkey"), lon1=_LON_SQL.format(k="c_custkey"),
                                 lat2=_LAT_SQL.format(k="c_nationkey"), lon2=_LON_SQL.format(k="c_nationkey")) + ", 3)"})
fq("fn_area", "customer", ["c_custkey"],
   lambda: {"area": F.round(fn.area(F.array(
       fn.makepoint(F.lit(0.0), F.lit(0.0)), fn.makepoint(F.lit(0.0), F.col("c_acctbal") / 1000),
       fn.makepoint(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 1000))), 6)},
   {"area": "round(abs(c_nationkey * (c_acctbal / 1000)) / 2, 6)"})

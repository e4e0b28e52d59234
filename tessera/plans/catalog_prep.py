"""Registered queries: prep column/value steps, filters, sort, reshape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import filters as flt
from tessera.operators import prep, reshape
from tessera.plans.registry import register, sql_initcap
from tessera.sources.tables import Tables


def T(spark: SparkSession, d: str) -> Tables:
    return Tables(spark, d)


# ------------------------------------------------------------------ columns (2.2)

@register("prep_rename", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status FROM orders")
def q_rename(spark, d):
    return (T(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderstatus")
            .transform(prep.rename({"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderstatus": "status"})))


@register("prep_remove_columns", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer")
def q_remove(spark, d):
    return T(spark, d).customer.transform(prep.remove_columns(["c_name", "c_acctbal"]))


@register("prep_select_columns", "SELECT p_partkey, p_brand FROM part")
def q_select(spark, d):
    return T(spark, d).part.transform(prep.select_columns(["p_partkey", "p_brand"]))


@register("prep_duplicate_column", "SELECT p_partkey, p_brand, p_brand AS brand_copy FROM part")
def q_dup(spark, d):
    return T(spark, d).part.select("p_partkey", "p_brand").transform(prep.duplicate_column("p_brand", "brand_copy"))


@register("prep_reorder_columns", "SELECT c_mktsegment, c_custkey, c_name FROM customer")
def q_reorder(spark, d):
    return T(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment").transform(
        prep.reorder_columns(["c_mktsegment"]))


@register("prep_change_type", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice,
  CAST(trunc(try_cast(o_orderpriority AS DOUBLE)) AS BIGINT) AS o_orderpriority,
  CAST(CAST(o_orderdate AS VARCHAR) AS DATE) AS o_orderdate FROM orders""")
def q_change_type(spark, d):
    return (T(spark, d).orders.select("o_orderkey", "o_totalprice", "o_orderpriority",
                                      F.col("o_orderdate").cast("string").alias("o_orderdate"))
            .transform(prep.change_type({"o_orderkey": "string", "o_totalprice": "int",
                                         "o_orderpriority": "int", "o_orderdate": "date"})))


@register("prep_split_delimiter", "SELECT page_id, " + ", ".join(
    f"CASE WHEN len(string_split(url, '/')) >= {i} THEN string_split(url, '/')[{i}] END AS url_{i}"
    for i in range(1, 6)) + " FROM pages")
def q_split_delim(spark, d):
    return T(spark, d).pages.select("page_id", "url").transform(prep.split_delimiter("url", "/", 5)).drop("url")


@register("prep_split_position",
          "SELECT p_partkey, substr(p_name, 1, 3) AS p_name_1, substr(p_name, 4, 3) AS p_name_2, "
          "substr(p_name, 7) AS p_name_3 FROM part")
def q_split_pos(spark, d):
    return T(spark, d).part.select("p_partkey", "p_name").transform(
        prep.split_position("p_name", [0, 3, 6])).drop("p_name")


@register("prep_merge_columns",
          "SELECT c_custkey, concat_ws('-', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS seg_nation FROM customer")
def q_merge(spark, d):
    return T(spark, d).customer.select("c_custkey", "c_mktsegment", "c_nationkey").transform(
        prep.merge_columns(["c_mktsegment", "c_nationkey"], "seg_nation", "-"))


@register("prep_add_column", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
          "round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")
def q_add_col(spark, d):
    return T(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount").transform(
        prep.add_column("revenue", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))
    ).drop("l_extendedprice", "l_discount")


@register("prep_conditional_column", """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large'
  WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS size_class FROM orders""")
def q_cond(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_totalprice").transform(prep.conditional_column(
        "size_class", [(F.col("o_totalprice") >= 300000, "large"), (F.col("o_totalprice") >= 100000, "medium")],
        "small")).drop("o_totalprice")


@register("prep_add_index", "SELECT o_orderkey, 100 + 10 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS idx "
          "FROM orders")
def q_add_index(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_orderdate").transform(
        prep.add_index("idx", ["o_orderdate", "o_orderkey"], start=100, increment=10)).drop("o_orderdate")


@register("prep_promote_headers", """SELECT c_custkey AS "0", c_name AS "Customer#000000000", CAST(c_nationkey AS BIGINT) AS "2",
  c_acctbal AS "1863.84", c_mktsegment AS "HOUSEHOLD" FROM customer WHERE c_custkey <> 0""")
def q_promote(spark, d):
    return T(spark, d).customer.transform(prep.promote_headers("c_custkey"))


@register("prep_demote_headers", """SELECT 'c_name' AS Column1, 'c_mktsegment' AS Column2, CAST(-1 AS BIGINT) AS _row
  UNION ALL SELECT c_name, c_mktsegment, c_custkey FROM customer""")
def q_demote(spark, d):
    return T(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment").transform(
        prep.demote_headers(index_col="c_custkey"))


# ------------------------------------------------------------------ values (2.3)

@register("prep_replace_text", "SELECT p_partkey, replace(p_name, 'widget', 'gadget') AS p_name FROM part")
def q_replace_text(spark, d):
    return T(spark, d).part.select("p_partkey", "p_name").transform(prep.replace_text("p_name", "widget", "gadget"))


@register("prep_replace_value", "SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'HOME' "
          "ELSE c_mktsegment END AS c_mktsegment FROM customer")
def q_replace_value(spark, d):
    return T(spark, d).customer.select("c_custkey", "c_mktsegment").transform(
        prep.replace_value("c_mktsegment", "HOUSEHOLD", "HOME"))


@register("prep_replace_nulls", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
          "coalesce(nullif(l_discount, 0), -1.0) AS disc FROM lineitem")
def q_replace_nulls(spark, d):
    return (T(spark, d).lineitem.select("l_orderkey", "l_linenumber",
                                        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("disc"))
            .transform(prep.replace_nulls({"disc": -1.0})))


@register("prep_trim", "SELECT c_custkey, trim('  ' || c_mktsegment || ' ') AS seg FROM customer")
def q_trim(spark, d):
    return T(spark, d).customer.select("c_custkey", F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("seg")) \
        .transform(prep.trim(["seg"]))


@register("prep_clean_nonprintable",
          "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g') AS text FROM documents")
def q_clean(spark, d):
    return T(spark, d).documents.select("doc_id", "text").transform(prep.clean_nonprintable(["text"]))


@register("prep_remove_letters", "SELECT doc_id, regexp_replace(text, '\\pL', '', 'g') AS text FROM documents")
def q_rm_letters(spark, d):
    return T(spark, d).documents.select("doc_id", "text").transform(prep.remove_letters(["text"]))


@register("prep_remove_numbers", "SELECT page_id, regexp_replace(url, '\\pN', '', 'g') AS url FROM pages")
def q_rm_numbers(spark, d):
    return T(spark, d).pages.select("page_id", "url").transform(prep.remove_numbers(["url"]))


@register("prep_remove_punctuation", "SELECT doc_id, regexp_replace(text, '\\pP', '', 'g') AS text FROM documents")
def q_rm_punct(spark, d):
    return T(spark, d).documents.select("doc_id", "text").transform(prep.remove_punctuation(["text"]))


@register("prep_upper", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def q_upper(spark, d):
    return T(spark, d).part.select("p_partkey", "p_name").transform(prep.upper(["p_name"]))


@register("prep_lower", "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer")
def q_lower(spark, d):
    return T(spark, d).customer.select("c_custkey", "c_mktsegment").transform(prep.lower(["c_mktsegment"]))


@register("prep_proper", f"SELECT c_custkey, {sql_initcap('c_mktsegment')} AS c_mktsegment FROM customer")
def q_proper(spark, d):
    return T(spark, d).customer.select("c_custkey", "c_mktsegment").transform(prep.proper(["c_mktsegment"]))


_EV_NULLED = "CASE WHEN event_type <> 'error' THEN value END"


@register("prep_fill_down", f"""SELECT event_id, user_id, last_value({_EV_NULLED} IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""")
def q_fill_down(spark, d):
    ev = T(spark, d).events.select("event_id", "user_id", "ts",
                                   F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return ev.transform(prep.fill_down(["value"], ["ts", "event_id"], partition_by=["user_id"])).drop("ts")


@register("prep_fill_up", """SELECT conv_id, turn, first_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS)
  OVER (ORDER BY conv_id, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS role FROM conversations""")
def q_fill_up(spark, d):
    cv = T(spark, d).conversations.select("conv_id", "turn",
                                          F.when(F.col("role") != "system", F.col("role")).alias("role"))
    return cv.transform(prep.fill_up(["role"], ["conv_id", "turn"]))


@register("prep_group_replace", """SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'BIG'
  WHEN p_type IN ('SMALL') THEN 'LITTLE' ELSE p_type END AS p_type FROM part""")
def q_group_replace(spark, d):
    return T(spark, d).part.select("p_partkey", "p_type").transform(
        prep.group_replace("p_type", {"BIG": ["LARGE", "MEDIUM"], "LITTLE": ["SMALL"]}))


@register("prep_extract_values", """SELECT page_id, CASE WHEN regexp_matches(url, '/([0-9]+)')
  THEN regexp_extract(url, '/([0-9]+)', 1) END AS page_no FROM pages""")
def q_extract_values(spark, d):
    return T(spark, d).pages.select("page_id", "url").transform(
        prep.extract_values("url", r"/([0-9]+)", "page_no")).drop("url")


@register("prep_extract_before", "SELECT page_id, split_part(url, '://', 1) AS scheme FROM pages")
def q_extract_before(spark, d):
    return T(spark, d).pages.select("page_id", "url").transform(
        prep.extract_before("url", "://", "scheme")).drop("url")


@register("prep_extract_after", """SELECT page_id, CASE WHEN instr(url, '://') > 0
  THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages""")
def q_extract_after(spark, d):
    return T(spark, d).pages.select("page_id", "url").transform(prep.extract_after("url", "://", "rest")).drop("url")


@register("prep_extract_between", """SELECT page_id, CASE WHEN instr(html, '<title>') > 0
  AND instr(substr(html, instr(html, '<title>') + 7), '</title>') > 0
  THEN split_part(substr(html, instr(html, '<title>') + 7), '</title>', 1) END AS title FROM pages""")
def q_extract_between(spark, d):
    return T(spark, d).pages.select("page_id", "html").transform(
        prep.extract_between("html", "<title>", "</title>", "title")).drop("html")


@register("prep_pad", "SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS o_orderkey FROM orders")
def q_pad(spark, d):
    return T(spark, d).orders.select(F.col("o_orderkey").alias("k"), "o_orderkey").transform(
        prep.pad("o_orderkey", 8, "0"))


_SIZE_TXT_SQL = "CASE WHEN p_size % 5 = 0 THEN 'x' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END"


def _size_txt(spark, d) -> DataFrame:
    return T(spark, d).part.select("p_partkey", F.when(F.col("p_size") % 5 == 0,
                                                       F.concat(F.lit("x"), F.col("p_size").cast("string")))
                                   .otherwise(F.col("p_size").cast("string")).alias("size_txt"))


@register("prep_remove_errors", f"SELECT p_partkey, CAST(size_txt AS BIGINT) AS size_txt FROM "
          f"(SELECT p_partkey, {_SIZE_TXT_SQL} AS size_txt FROM part) WHERE try_cast(size_txt AS DOUBLE) IS NOT NULL")
def q_remove_errors(spark, d):
    return _size_txt(spark, d).transform(prep.remove_errors({"size_txt": "int"}))


@register("prep_replace_errors", f"SELECT p_partkey, coalesce(CAST(trunc(try_cast(size_txt AS DOUBLE)) AS BIGINT), -1) "
          f"AS size_txt FROM (SELECT p_partkey, {_SIZE_TXT_SQL} AS size_txt FROM part)")
def q_replace_errors(spark, d):
    return _size_txt(spark, d).transform(prep.replace_errors({"size_txt": "int"}, -1))


@register("prep_try_otherwise", "SELECT o_orderkey, round(coalesce(o_totalprice / nullif(o_orderkey % 3, 0), 0.0), 4) "
          "AS per_slot FROM orders")
def q_try_otherwise(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_totalprice").transform(prep.try_otherwise(
        "per_slot", F.round(F.try_divide(F.col("o_totalprice"), F.col("o_orderkey") % 3), 4), 0.0)).drop("o_totalprice")


# ------------------------------------------------------------------ filters (2.4)

_LK = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"


@register("flt_keep_values", f"SELECT {_LK}, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def q_keep(spark, d):
    return T(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").transform(
        flt.keep_values("l_returnflag", ["A", "R"]))


@register("flt_exclude_values", "SELECT o_orderkey, o_orderpriority FROM orders "
          "WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR o_orderpriority IS NULL")
def q_exclude(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_orderpriority").transform(
        flt.exclude_values("o_orderpriority", ["1-URGENT", "5-LOW"]))


@register("flt_range", f"SELECT {_LK}, l_quantity, l_shipdate FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 "
          "AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'")
def q_range(spark, d):
    import datetime as dt
    return (T(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
            .transform(flt.range_("l_quantity", 10, 20))
            .transform(flt.range_("l_shipdate", dt.datetime(1997, 1, 1), None)))


@register("flt_nulls", f"SELECT {_LK}, nullif(l_tax, 0) AS tax FROM lineitem WHERE nullif(l_tax, 0) IS NOT NULL")
def q_nulls(spark, d):
    return T(spark, d).lineitem.select("l_orderkey", "l_linenumber",
                                       F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax")).transform(
        flt.nulls("tax", keep=False))


@register("flt_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'wid') OR p_name LIKE 'red%'")
def q_contains(spark, d):
    p = T(spark, d).part.select("p_partkey", "p_name")
    return p.transform(flt.contains("p_name", "wid")).unionByName(
        p.transform(flt.contains("p_name", "red*", wildcard=True)).transform(flt.expression(~F.col("p_name").contains("wid"))))


@register("flt_expression", f"SELECT {_LK} FROM lineitem WHERE NOT coalesce(l_discount > 0.05 AND l_tax < 0.02, false)")
def q_expression(spark, d):
    return T(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax").transform(
        flt.expression((F.col("l_discount") > 0.05) & (F.col("l_tax") < 0.02), keep=False)).drop("l_discount", "l_tax")


@register("flt_date_part", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1996, 1997) "
          "AND quarter(o_orderdate) IN (1, 4)")
def q_date_part(spark, d):
    return (T(spark, d).orders.select("o_orderkey", "o_orderdate")
            .transform(flt.date_part("o_orderdate", "year", [1996, 1997]))
            .transform(flt.date_part("o_orderdate", "quarter", [1, 4])).drop("o_orderdate"))


@register("flt_include_null", f"SELECT {_LK}, nullif(l_discount, 0) AS disc FROM lineitem "
          "WHERE nullif(l_discount, 0) > 0.07 OR nullif(l_discount, 0) IS NULL")
def q_include_null(spark, d):
    li = T(spark, d).lineitem.select("l_orderkey", "l_linenumber",
                                     F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("disc"))
    return li.transform(flt.include_null(F.col("disc") > 0.07, "disc"))


@register("flt_datasource", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders "
          "WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000 AND o_totalprice <= 400000")
def q_datasource(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_totalprice").transform(
        flt.datasource({"o_orderstatus": ["F", "O"]}, {"o_totalprice": (50000, 400000)}))


@register("flt_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_top_n(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_totalprice").transform(flt.top_n(10, "o_totalprice", ["o_orderkey"]))


@register("flt_bottom_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def q_bottom_n(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_totalprice").transform(
        flt.bottom_n(10, "o_totalprice", ["o_orderkey"]))


@register("flt_top_n_members", f"""SELECT {_LK}, l_suppkey FROM lineitem WHERE l_suppkey IN (
  SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 5)""")
def q_top_members(spark, d):
    return T(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").transform(
        flt.top_n_members("l_suppkey", F.sum("l_extendedprice"), 5)).drop("l_extendedprice")


@register("flt_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def q_distinct(spark, d):
    return T(spark, d).lineitem.select("l_returnflag", "l_linestatus", "l_tax").transform(flt.distinct())


@register("flt_distinct_ordered", """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey, o_orderkey, o_orderdate,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def q_distinct_ordered(spark, d):
    return T(spark, d).orders.select("o_custkey", "o_orderkey", "o_orderdate").transform(
        flt.distinct_ordered(["o_custkey"], ["o_orderdate", "o_orderkey"]))


@register("flt_remove_blank_rows", """SELECT * FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey END AS k,
  CASE WHEN c_acctbal >= 0 THEN c_name END AS n FROM customer) WHERE k IS NOT NULL OR n IS NOT NULL""")
def q_blank(spark, d):
    ok = F.col("c_acctbal") >= 0
    return T(spark, d).customer.select(F.when(ok, F.col("c_custkey")).alias("k"),
                                       F.when(ok, F.col("c_name")).alias("n")).transform(flt.remove_blank_rows())


@register("flt_skip_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def q_skip(spark, d):
    return T(spark, d).orders.select("o_orderkey").transform(flt.skip_rows(100, ["o_orderkey"]))


@register("flt_remove_last_rows", "SELECT o_orderkey, o_orderdate FROM orders "
          "ORDER BY o_orderdate DESC, o_orderkey DESC OFFSET 100")
def q_remove_last(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_orderdate").transform(
        flt.remove_last_rows(100, ["o_orderdate", "o_orderkey"]))


@register("flt_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def q_sample_first(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_totalprice").transform(flt.sample(n=50, order_by=["o_orderkey"]))


@register("flt_sample_random")
def q_sample_random(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_totalprice").transform(flt.sample(fraction=0.1, seed=7))


@register("srt_rows", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders "
          "ORDER BY o_orderpriority, o_totalprice DESC")
def q_sort(spark, d):
    return T(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_totalprice").transform(
        flt.sort([("o_orderpriority", "asc"), ("o_totalprice", "desc")]))


@register("srt_manual", """SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY coalesce(nullif(list_position(
  ['MACHINERY', 'AUTOMOBILE', 'BUILDING'], c_mktsegment), 0), 4), c_custkey) AS position FROM customer""")
def q_sort_manual(spark, d):
    c = T(spark, d).customer.select("c_custkey", "c_mktsegment")
    return flt.with_position(c.transform(flt.sort_manual("c_mktsegment", ["MACHINERY", "AUTOMOBILE", "BUILDING"], ["c_custkey"])))


@register("srt_computed", """SELECT n_name, c_custkey, rank() OVER (ORDER BY s DESC, n_name) AS first_position FROM (
  SELECT n_name, c_custkey, round(sum(c_acctbal) OVER (PARTITION BY n_name), 2) AS s
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def q_sort_computed(spark, d):
    t = T(spark, d)
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_acctbal")
    out = flt.with_position(c.transform(flt.sort_computed("n_name", F.sum("c_acctbal"))))
    # Rows of a member tie: compare the position of its first row.
    first = out.groupBy("n_name").agg(F.min("position").alias("first_position"))
    return out.select("n_name", "c_custkey").join(first, "n_name")


# ------------------------------------------------------------------ reshape (2.6)

@register("set_union", """SELECT c_custkey AS party_key, c_name AS party_name, c_mktsegment AS segment,
  NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def q_union(spark, d):
    t = T(spark, d)
    c = t.customer.select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"),
                          F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("party_name"), "s_acctbal")
    return c.transform(reshape.union([s]))


@register("set_union_source", """SELECT c_custkey AS party_key, 'customer' AS source FROM customer
  UNION ALL SELECT s_suppkey, 'supplier' FROM supplier""")
def q_union_source(spark, d):
    t = T(spark, d)
    return t.customer.select(F.col("c_custkey").alias("party_key")).transform(reshape.union(
        [t.supplier.select(F.col("s_suppkey").alias("party_key"))], "source", ["customer", "supplier"]))


@register("rsh_unpivot", f"""SELECT {_LK}, measure, val FROM (UNPIVOT (SELECT l_orderkey, l_linenumber,
  l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE val)""")
def q_unpivot(spark, d):
    return T(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").transform(
        reshape.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "val"))


@register("rsh_unpivot_other", f"""SELECT {_LK}, measure, val FROM (UNPIVOT (SELECT l_orderkey, l_linenumber,
  l_quantity, l_extendedprice, nullif(l_tax, 0) AS l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_tax
  INTO NAME measure VALUE val)""")
def q_unpivot_other(spark, d):
    li = T(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                     F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax"))
    return li.transform(reshape.unpivot_other(["l_orderkey", "l_linenumber"], "measure", "val"))


@register("rsh_pivot", """SELECT l_linestatus, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A,
  sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R
  FROM lineitem GROUP BY l_linestatus""")
def q_pivot(spark, d):
    return T(spark, d).lineitem.select("l_linestatus", "l_returnflag", "l_quantity").transform(
        reshape.pivot("l_returnflag", "l_quantity", "sum", ["A", "N", "R"]))


def _seg_stats(spark, d) -> DataFrame:
    return T(spark, d).customer.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).cast("double").alias("n_customers"), F.round(F.avg("c_acctbal"), 2).alias("avg_balance"))


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("rsh_transpose", "SELECT key, " + ", ".join(
    f"""max(CASE WHEN c_mktsegment = '{s}' THEN v END) AS "{s}\"""" for s in _SEGS) + """ FROM (
  SELECT c_mktsegment, 'n_customers' AS key, CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) AS v FROM customer GROUP BY 1
  UNION ALL SELECT c_mktsegment, 'avg_balance', CAST(round(avg(c_acctbal), 2) AS VARCHAR) FROM customer GROUP BY 1)
  GROUP BY key""")
def q_transpose(spark, d):
    return _seg_stats(spark, d).transform(reshape.transpose("c_mktsegment"))


@register("rsh_measure_values", """SELECT l_returnflag, "Measure Names", "Measure Values" FROM (UNPIVOT (
  SELECT l_returnflag, sum(l_quantity) AS total_qty, round(avg(l_extendedprice), 4) AS avg_price
  FROM lineitem GROUP BY l_returnflag) ON total_qty, avg_price INTO NAME "Measure Names" VALUE "Measure Values")""")
def q_measure_values(spark, d):
    return T(spark, d).lineitem.transform(reshape.measure_values(["l_returnflag"], {
        "total_qty": F.sum("l_quantity"), "avg_price": F.round(F.avg("l_extendedprice"), 4)}))

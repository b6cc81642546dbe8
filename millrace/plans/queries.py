"""The library's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import strings as S
from millrace.functions import text_formats as T
from millrace.functions import typed
from millrace.functions.templates import Scope, render
from millrace.operators import branch, correlate, enrich, filters, metrics, parsers, patternize, rewrites
from millrace.operators.model import computed, to_events
from millrace.plans.block import Block

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few splits over all cores: work by row that costs more than reading follows the cores, not the file's size."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= n else df.repartition(n)


def events(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """The events table as log events."""
    e = table(spark, sf_dir, "events")
    return to_events(e, keep, stamp=F.col("ts"), host=F.concat(F.lit("u"), F.col("user_id")), program=F.col("event_type"), pid=F.col("event_id").cast("string"), message=F.col("props"), source=F.lit("events"), pri=(F.col("event_id") % 192).cast("int"), nv=F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("user"), F.col("user_id").cast("string")))


_SESSION_SQL = """
WITH e AS (SELECT *, date_trunc('second', ts) AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view', 'purchase')),
g AS (SELECT *, CASE WHEN epoch(s) - epoch(lag(s) OVER w) <= 1800 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS grp FROM g)
SELECT user_id, min(s) AS session_start, max(s) AS session_end, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, min(k) AS k_min, max(k) AS k_max, CAST(sum(k) // count(k) AS BIGINT) AS k_average
FROM n GROUP BY user_id, grp HAVING count(*) >= 2
"""


@query(_SESSION_SQL)
def session_groups(spark, sf_dir):
    """The flagship: filter, JSON field, keyed sessions with having."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    e = e.withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    aggregates = {"n": F.count(F.lit(1)), "k_sum": F.sum("k"), "k_min": F.min("k"), "k_max": F.max("k"), "k_average": correlate.average_int(F.col("k").cast("string"))}
    return correlate.session_groups(e, ["user_id"], 1800, aggregates, ts="ts", having=F.col("n") >= 2)


@query("""
WITH e AS (SELECT *, date_trunc('second', ts) AS s FROM events),
g AS (SELECT *, CASE WHEN epoch(s) - epoch(lag(s) OVER w) <= 3600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS grp FROM g)
SELECT 'u' || user_id AS host, event_type AS program, CAST(count(*) + 1 AS VARCHAR) AS length,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids, max(ts) AS stamp
FROM n GROUP BY user_id, event_type, grp HAVING count(*) >= 2
""")
def grouping_by_templates(spark, sf_dir):
    """Synthetic events by templates: scope program, the synthetic row counts in context-length."""
    e = events(spark, sf_dir)
    g = correlate.grouping_by(e, ["source"], 3600, {"length": "$(context-length)", "ids": "$(list-slice :-1 $(context-values $PID))"}, scope="program", having=lambda s: F.size(s.rows) >= 2)
    return g.select("host", "program", F.col("nv")["length"].alias("length"), F.col("nv")["ids"].alias("ids"), "stamp")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, CAST(min(event_id) AS BIGINT) AS first_id, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY rn) AS grp FROM (
    SELECT *, CASE WHEN rn = 1 OR lag(event_type) OVER (PARTITION BY user_id ORDER BY rn) = 'purchase' THEN 1 ELSE 0 END AS new FROM e))
GROUP BY user_id, grp
""")
def triggered_groups(spark, sf_dir):
    """Groups that a purchase ends; no timeout."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    made = lambda rows: {"user_id": rows[0]["user_id"], "first_id": min(r["event_id"] for r in rows), "n": len(rows)}
    return correlate.triggered_groups(e, ["user_id"], 10**9, made, "user_id long, first_id long, n long", lambda rows: rows[-1]["event_type"] == "purchase", ts="ts", tie=("event_id",))


@query("SELECT event_id, user_id, event_type, lag(event_type, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_2 FROM events")
def back_references(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    back = lambda c, n: correlate.back_reference(c, n, ["user_id"], ["ts", "event_id"])
    return e.select("event_id", "user_id", "event_type", back("event_type", 1).alias("previous"), back("value", 2).alias("value_2"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seqnum FROM events")
def sequence_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seqnum"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) // nullif(CAST(l_suppkey AS BIGINT), 0) AS ratio, l_partkey % nullif(l_suppkey, 0) AS rest
FROM lineitem WHERE l_suppkey <> 0 AND l_quantity > 25 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01'
""")
def typed_filter(spark, sf_dir):
    """A block of statements: typed comparison, truncating division, and rows that fail go."""
    b = Block(table(spark, sf_dir, "lineitem"))
    b.require(typed.compare(b["l_quantity"], ">", "25")).require(typed.compare(b["l_returnflag"], "==", "R"))
    b.require(typed.compare(b["l_shipdate"], ">=", typed.cast_datetime("1995-01-01T00:00:00")))
    b.set("ratio", b["l_partkey"] / b["l_suppkey"]).set("rest", b["l_partkey"] % b["l_suppkey"])
    return b.apply().select("l_orderkey", "l_linenumber", "ratio", "rest")


@query("""
SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN 'big' WHEN p_size >= 10 THEN 'mid' ELSE 'small' END AS class,
       CAST(1000 // (p_size - 10) AS BIGINT) AS share, substr(p_name, 1, 3) AS head
FROM part WHERE p_size <> 10
""")
def expression_block(spark, sf_dir):
    """switch, ternary, slices, and a division whose error drops the row."""
    b = Block(table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("bigint")))
    b.set("class", typed.switch(b["p_size"], [((26, 1000), "big"), ((10, 25), "mid")], "small"))
    b.set("share", typed.wrap(1000) / (b["p_size"] - 10)).set("head", typed.byte_slice(b["p_name"], 0, 3))
    return b.apply().select("p_partkey", "p_name", "class", "share", "head")


@query("""
SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'sale' WHEN event_type = 'error' THEN 'bad' ELSE 'other' END AS label FROM events
""")
def conditional(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    label = lambda text: lambda d: d.withColumn("label", F.lit(text))
    sale = F.col("event_type") == "purchase"
    return branch.conditional(e, [(sale & (F.col("value") > 50), label("big")), (sale, label("sale")), (F.col("event_type") == "error", label("bad"))], label("other")).select("event_id", "label")


@query("""
SELECT destination, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
  SELECT o_orderkey, 'urgent' AS destination FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'
  UNION ALL SELECT o_orderkey, 'all' FROM orders
  UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 250000 AND o_orderpriority <> '1-URGENT'
) GROUP BY destination
""")
def log_paths(spark, sf_dir):
    """final and catchall: each order is tested once."""
    o = table(spark, sf_dir, "orders")
    paths = [("urgent", F.col("o_orderpriority") == "1-URGENT", ("final",)), ("open", F.col("o_orderstatus") == "O", ()), ("large", F.col("o_totalprice") > 250000, ()), ("all", F.lit(True), ("catchall",))]
    return branch.delivered(o, paths).groupBy("destination").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""
SELECT destination, count(*) AS n FROM (
  SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice > 250000 THEN NULL ELSE 'rest' END AS destination FROM orders
  UNION ALL SELECT 'large' FROM orders WHERE o_totalprice > 250000)
WHERE destination IS NOT NULL GROUP BY destination
""")
def fallback_path(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    paths = [("open", F.col("o_orderstatus") == "O", ()), ("large", F.col("o_totalprice") > 250000, ()), ("rest", F.lit(True), ("fallback",))]
    return branch.delivered(o, paths).groupBy("destination").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'click' AS channel, count(*) AS n, sum(value) AS total FROM events WHERE event_type = 'click'
UNION ALL SELECT 'high', count(*), sum(value) FROM events WHERE value > 100
""")
def junction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    channel = lambda name, c: lambda d: d.where(c).select(F.lit(name).alias("channel"), "value")
    return branch.junction(e, channel("click", F.col("event_type") == "click"), channel("high", F.col("value") > 100)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""
SELECT o_orderkey, coalesce(c_name, 'nobody') AS name, coalesce(c_mktsegment, 'NONE') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
""")
def contextual_data(spark, sf_dir):
    """A lookup of several records a key, with a default selector."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    record = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    db = c.select(F.col("c_custkey").cast("string").alias("selector"), F.explode(F.array(record("name", F.col("c_name")), record("segment", F.col("c_mktsegment")))).alias("r")).select("selector", "r.*")
    default = spark.createDataFrame([("*", "name", "nobody"), ("*", "segment", "NONE")], "selector string, name string, value string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    d = enrich.add_contextual_data(o, F.col("o_custkey").cast("string"), db.union(default), "*")
    return d.select("o_orderkey", F.col("nv")["name"].alias("name"), F.col("nv")["segment"].alias("segment"))


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def in_list(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return filters.in_list(table(spark, sf_dir, "orders"), "o_custkey", listed).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def not_in_list(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return filters.in_list(table(spark, sf_dir, "orders"), "o_custkey", listed, negate=True).select("o_orderkey")


@query("""
SELECT selector, count(*) AS n FROM (
  SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'PROMO*' WHEN p_type LIKE '%STEEL' THEN '*STEEL' WHEN p_type LIKE '%BR_SS%' THEN '*BR?SS*' ELSE 'none' END AS selector FROM part) GROUP BY selector
""")
def glob_selector(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.coalesce(enrich.glob_selector(F.col("p_type"), ["PROMO*", "*STEEL", "*BR?SS*"]), F.lit("none")).alias("selector"))
    return p.groupBy("selector").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT selector, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'MACHINERY' THEN 'machines' WHEN c_nationkey < 5 THEN 'near' END AS selector FROM customer) GROUP BY selector
""")
def filter_selector(spark, sf_dir):
    key = enrich.filter_selector([(F.col("c_acctbal") < 0, "debt"), (F.col("c_mktsegment") == "MACHINERY", "machines"), (F.col("c_nationkey") < 5, "near")])
    return table(spark, sf_dir, "customer").select(key.alias("selector")).groupBy("selector").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT c_custkey, CAST(10 * 16777216 + (c_custkey % 200) * 65536 + (c_custkey % 7) * 256 + c_custkey % 250 AS BIGINT) AS ip FROM customer),
r AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name, CAST(10 * 16777216 + n_nationkey * 6 * 65536 AS BIGINT) AS s, CAST(10 * 16777216 + n_nationkey * 6 * 65536 + 262143 AS BIGINT) AS e FROM nation)
SELECT c_custkey, n_name FROM c LEFT JOIN r ON ip BETWEEN s AND e
""")
def ip_range_join(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.concat_ws(".", F.lit("10"), k % 200, k % 7, k % 250).alias("ip"))
    start = F.lit(10 * 16777216).cast("bigint") + F.col("n_nationkey").cast("bigint") * 6 * 65536
    r = table(spark, sf_dir, "nation").select(start.alias("start"), (start + 262143).alias("end"), "n_name")
    return enrich.ip_range_join(c, F.col("ip"), r, ["n_name"]).select("c_custkey", "n_name")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def metrics_probe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    labels = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}
    n, q = (metrics.counter(li, name, labels, inc) for name, inc in (("n", 1), ("quantity", F.col("l_quantity"))))
    u = n.union(q).groupBy(metrics.label_text(F.col("labels")).alias("l"), F.col("labels")["flag"].alias("flag"), F.col("labels")["status"].alias("status"))
    return u.agg(F.max(F.when(F.col("name") == "n", F.col("value"))).alias("n"), F.max(F.when(F.col("name") == "quantity", F.col("value"))).alias("quantity")).select("flag", "status", "n", "quantity")


@query("SELECT o_orderpriority AS priority, CAST(least(17, greatest(12, floor(log2(floor(o_totalprice))))) AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY ALL")
def log2_histogram(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    return metrics.histogram(o, ["priority"], F.col("o_totalprice"), 12, 17)


@query("""
SELECT event_type, sum(CASE WHEN n - epoch(date_trunc('second', ts)) < 3600 THEN 1 ELSE 0 END) / 3600 AS last_1h, sum(CASE WHEN n - epoch(date_trunc('second', ts)) < 86400 THEN 1 ELSE 0 END) / 86400 AS last_24h
FROM events, (SELECT epoch(date_trunc('second', max(ts))) AS n FROM events) GROUP BY event_type
""")
def change_per_second(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return metrics.change_per_second(e, ["event_type"], "ts", F.lit(now).cast("timestamp")).select("event_type", "last_1h", "last_24h")


@query("SELECT CAST(count(*) AS BIGINT) AS value FROM orders WHERE o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '%HIGH'")
def stats_query_sum(spark, sf_dir):
    c = metrics.counter(table(spark, sf_dir, "orders"), "orders", {"priority": F.col("o_orderpriority")})
    u = metrics.query(c, "orders.priority=*-URGENT").union(metrics.query(c, "orders.priority=*-HIGH"))
    return u.agg(F.sum("value").alias("value"))


@query("""
SELECT 'host' AS dimension, 'u' || user_id AS key, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'program', event_type, count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'severity', CAST(event_id % 192 % 8 AS VARCHAR), count(*) FROM events GROUP BY ALL
""")
def message_statistics(spark, sf_dir):
    return metrics.message_statistics(events(spark, sf_dir))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_fields(spark, sf_dir):
    e = events(spark, sf_dir, "event_id")
    d = e.withColumn("nv", T.json_flat(F.col("message")))
    return d.select("event_id", F.col("nv")["k"].try_cast("bigint").alias("k")).where("k > 50")


@query("SELECT o_orderkey, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, 'order no ' || o_orderkey AS note FROM orders")
def parse_kv(spark, sf_dir):
    line = F.concat(F.lit("status="), F.col("o_orderstatus"), F.lit(" total="), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(' note="order no '), F.col("o_orderkey"), F.lit('"'))
    o = computed(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), m=T.parse_kv(F.col("line"), "=", " "))
    return o.select("o_orderkey", *[F.col("m")[k].alias(k) for k in ("status", "total", "note")])


@query("SELECT c_custkey, c_name AS name, c_mktsegment || ', \"x\"' AS segment, CAST(NULL AS VARCHAR) AS missing FROM customer")
def parse_csv(spark, sf_dir):
    line = F.concat(F.col("c_name"), F.lit(',"'), F.col("c_mktsegment"), F.lit(', ""x""",NULL'))
    m = table(spark, sf_dir, "customer").select("c_custkey", T.parse_csv(line, ["name", "segment", "missing"], null="NULL").alias("m"))
    return m.select("c_custkey", *[F.col("m")[k].alias(k) for k in ("name", "segment", "missing")])


@query("SELECT c_custkey, '<' || (c_custkey % 192) || '>1 - ' || c_name || ' app ' || c_nationkey || ' - - ' || c_mktsegment AS line, CAST(c_custkey % 192 // 8 AS BIGINT) AS facility, c_name AS host, c_mktsegment AS message FROM customer")
def parse_syslog(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("<"), F.col("c_custkey") % 192, F.lit(">1 - "), F.col("c_name"), F.lit(" app "), F.col("c_nationkey"), F.lit(" - - "), F.col("c_mktsegment")).alias("line"))
    p = T.parse_syslog(F.col("line"))
    return c.select("c_custkey", "line", F.floor(p["pri"] / 8).cast("bigint").alias("facility"), p["host"].alias("host"), p["message"].alias("message"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def regexp_parser(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    e = to_events(p, ("page_id", "url"), message=F.col("html"))
    e = parsers.regexp_parser(e, [r"<title>(?<title>[^<]*)</title>"], drop=False)
    return e.select("page_id", F.coalesce(F.col("nv")["title"], F.lit("")).alias("title"), S.regexp_search(F.col("url"), r"^https?://([^/]+)")["1"].alias("host"))


@query("""
SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, substr(sha256(text), 1, 12) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
""")
def string_functions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.md5(t).alias("md5"), S.sha1(t).alias("sha1"), S.hash_(t, "sha256", 12).alias("sha256"), S.length(t).alias("bytes"), S.lower(t).alias("low"))


@query("SELECT c_custkey, string_split(c_name, '#')[2] AS number, c_name || ';' || c_mktsegment AS joined, to_base64(encode(c_name)) AS b64, lower(hex(encode(c_mktsegment))) AS hex, url_encode(c_name) AS url FROM customer")
def encodings(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", S.list_nth(S.explode("#", n), 1).alias("number"), S.implode(";", F.array("c_name", "c_mktsegment")).alias("joined"), S.base64_encode(n).alias("b64"), S.hex_encode(F.col("c_mktsegment")).alias("hex"), S.urlencode(n).alias("url"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS text, CAST(dayofyear(o_orderdate) AS VARCHAR) AS day, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS parsed FROM orders")
def date_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", D.strftime("%Y/%m/%d %T", F.col("t")).alias("text"), F.dayofyear("t").cast("string").alias("day"), D.strptime(D.strftime("%d/%m/%Y", F.col("t")), "%d/%m/%Y").alias("parsed"))


@query("SELECT event_id, 'u' || user_id || ' ' || event_type || '[' || event_id || ']: ' || CASE event_id % 192 % 8 WHEN 0 THEN 'emerg' WHEN 1 THEN 'alert' WHEN 2 THEN 'crit' WHEN 3 THEN 'err' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END || ' ' || (CAST(event_id AS BIGINT) + 1) || ' none' AS line FROM events")
def templates(spark, sf_dir):
    e = events(spark, sf_dir, "event_id")
    return e.select("event_id", render("$HOST ${MSGHDR}$SEVERITY $(+ $PID 1) ${.unset:-none}", Scope.of(e)).alias("line"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS renamed, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS program, CAST(event_id % 192 // 8 * 8 + 3 AS INTEGER) AS pri FROM events")
def rewrite_chain(spark, sf_dir):
    e = events(spark, sf_dir, "event_id")
    e = rewrites.rename(e, "user", "renamed")
    e = rewrites.subst(e, "^click$", "tap", "PROGRAM")
    e = rewrites.set_severity(e, F.lit("err"))
    return e.select("event_id", F.col("nv")["renamed"].alias("renamed"), "program", "pri")


@query("SELECT event_id FROM events WHERE event_id % 192 % 8 BETWEEN 0 AND 3 AND event_id % 192 // 8 IN (2, 4) AND event_type <> 'view'")
def classic_filters(spark, sf_dir):
    e = events(spark, sf_dir, "event_id")
    return e.where(filters.severity("err", "emerg") & filters.facility("mail", 4) & ~filters.program("view", "string")).select("event_id")


@query("""
SELECT doc_id, regexp_replace(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', 'IP', 'g') AS masked FROM documents
""")
def mask_addresses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.regexp_subst(F.col("text"), r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "IP", global_=True).alias("masked"))


@query("""
WITH w AS (SELECT unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)
SELECT CAST(pos AS INTEGER) AS pos, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 20
""")
def frequent_words(spark, sf_dir):
    return patternize.frequent_words(table(spark, sf_dir, "documents"), "text", 20, " ")


@query("SELECT string_split(o_orderpriority, '-')[1] || '-' || CASE WHEN count(*) > 0 THEN string_split(o_orderpriority, '-')[2] END || ' ' || chr(26) AS pattern, count(*) AS n FROM orders GROUP BY o_orderpriority")
def patternize_lines(spark, sf_dir):
    """Line clusters: the priority's words are frequent, the order key is not."""
    o = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit(" "), F.lit("k"), F.col("o_orderkey").cast("string")).alias("line"))
    return patternize.patternize(o, "line", 4.0, " ")


@query()
def rate_limit(spark, sf_dir):
    """Token buckets by event type: order decides, so no SQL."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return correlate.rate_limit(e, ["event_type"], 1, ts="ts", tie=("event_id",))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS rec FROM events)
SELECT user_id, min(event_id) AS event_id, CAST(count(*) AS INTEGER) AS n_lines, string_agg(event_type, chr(10) ORDER BY event_id) AS message FROM e GROUP BY user_id, rec
""")
def group_lines(spark, sf_dir):
    """Multi-line records: a line that isn't a view begins one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("line"))
    return correlate.group_lines(e, ["user_id"], ["event_id"], "regexp", prefix="^(?!view)")


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS id, url, sha256(html) AS html_sha256 FROM pages")
def xml_fields(spark, sf_dir):
    """Documents in XML that hold whole pages as text, parsed whole."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("]]>"), F.lit("]]&gt;"))
    line = F.concat(F.lit('<page id="'), F.col("page_id"), F.lit('"><url>'), text(F.col("url")), F.lit("</url><html>"), text(F.col("html")), F.lit("</html></page>"))
    p = to_events(table(spark, sf_dir, "pages"), ("page_id",), message=line)
    p = computed(parsers.xml_parser(p, ".xml.").select("page_id", "nv"), x=F.col("nv"))
    x = F.col("x")
    return p.select("page_id", x[".xml.page._id"].alias("id"), x[".xml.page.url"].alias("url"), F.sha2(x[".xml.page.html"], 256).alias("html_sha256"))


@query()
def pattern_rules(spark, sf_dir):
    """A pattern database over constructed lines."""
    from millrace.operators.patterndb import Rule, db_parser

    o = table(spark, sf_dir, "orders")
    e = to_events(o, ("o_orderkey",), program=F.lit("shop"), message=F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_custkey"), F.lit(" is "), F.col("o_orderstatus")))
    rules = [Rule("open", ["order @NUMBER:key@ of @NUMBER:customer@ is O"], "violation", ("shop",), ("open",)), Rule("any", ["order @NUMBER:key@ of @NUMBER:customer@ is @ESTRING:status:@"], "system", ("shop",))]
    d = db_parser(e, rules)
    return d.select("o_orderkey", F.col("nv")[".classifier.rule_id"].alias("rule_id"), F.col("nv")["key"].alias("key"), F.col("nv")["status"].alias("status"))


SQL["pattern_rules"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'any' END AS rule_id, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS status FROM orders"


@query("""
SELECT event_id, CASE WHEN event_type = 'purchase' AND k > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'small' ELSE 'none' END AS class, k + 1 AS next, upper(substr(event_type, 1, 3)) AS head
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 2 = 0 AND event_type <> 'error'
""")
def expression_program(spark, sf_dir):
    """A block in its text form over events."""
    from millrace.plans.program import Program

    text = """
    $PROGRAM != "error";
    js = json($MSG);
    k = int(js.k);
    k % 2 == 0;
    if ($PROGRAM == "purchase") { if (k > 50) { $class = "big"; } else { $class = "small"; }; } else { $class = "none"; };
    declare next = k + 1;
    $head = upper($PROGRAM[0..3]);
    """
    d = Program(text).apply(events(spark, sf_dir, "event_id"))
    return d.select("event_id", F.col("nv")["class"].alias("class"), "next", F.col("nv")["head"].alias("head"))


@query("""
SELECT c_custkey, 'CEF:0|acme|shop|1.0|' || c_nationkey || '|' || replace(c_mktsegment, 'I', '|') || '|5|cust=' || c_custkey || ' note=a b' AS line,
       'acme' AS vendor, replace(c_mktsegment, 'I', '|') AS name, CAST(c_custkey AS VARCHAR) AS cust, 'a b' AS note FROM customer WHERE c_mktsegment NOT LIKE '%I%'
UNION ALL
SELECT c_custkey, 'CEF:0|acme|shop|1.0|' || c_nationkey || '|' || replace(c_mktsegment, 'I', chr(92) || '|') || '|5|cust=' || c_custkey || ' note=a b', 'acme', replace(c_mktsegment, 'I', '|'), CAST(c_custkey AS VARCHAR), 'a b' FROM customer WHERE c_mktsegment LIKE '%I%'
""")
def cef_round_trip(spark, sf_dir):
    """Formatted with escapes, then parsed."""
    name = F.replace(F.col("c_mktsegment"), F.lit("I"), F.lit("|"))
    ext = F.create_map(F.lit("cust"), F.col("c_custkey").cast("string"), F.lit("note"), F.lit("a b"))
    line = T.format_cef([F.lit(x) for x in ("0", "acme", "shop", "1.0")] + [F.col("c_nationkey").cast("string"), name, F.lit("5")], ext)
    c = table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    m = c.withColumn("m", T.parse_cef(F.col("line")))
    return m.select("c_custkey", "line", F.col("m")["device_vendor"].alias("vendor"), F.col("m")["name"].alias("name"), F.col("m")["cust"].alias("cust"), F.col("m")["note"].alias("note"))


@query("""
WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part)
SELECT p_partkey, a[1] AS head, array_to_string(a[2:], ',') AS tail, len(a) AS n, a[len(a)] AS last, CASE WHEN list_position(a, 'STEEL') > 0 THEN list_position(a, 'STEEL') - 1 END AS steel, array_to_string(list_transform(a, lambda x: x || '!'), ',') AS mapped FROM p
""")
def list_functions(spark, sf_dir):
    a = F.col("a")
    p = table(spark, sf_dir, "part").select("p_partkey", S.explode(" ", F.col("p_type")).alias("a"))
    scope = Scope(frozenset(), {"L": S.list_text(a)})
    return p.select("p_partkey", S.list_head(a).alias("head"), S.implode(",", S.list_tail(a)).alias("tail"), F.size(a).cast("bigint").alias("n"), S.list_nth(a, -1).alias("last"), S.list_search(a, "STEEL").cast("int").alias("steel"), render("$(map $_! $L)", scope).alias("mapped"))


@query("""
SELECT event_id, '{"program":"' || event_type || '","user":"' || user_id || '"}' AS json, 'program=' || event_type || ' user=' || user_id AS welf FROM events
""")
def value_pairs_formats(spark, sf_dir):
    e = events(spark, sf_dir, "event_id")
    s = Scope.of(e)
    return e.select("event_id", render("$(format-json --key user program=$PROGRAM)", s).alias("json"), render("$(format-welf --key user program=$PROGRAM)", s).alias("welf"))


@query("""
SELECT event_id, '<' || (event_id % 192) || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00 u' || user_id || ' ' || event_type || ' ' || event_id || ' - - ' || props AS line FROM events
""")
def format_syslog(spark, sf_dir):
    e = events(spark, sf_dir, "event_id")
    return e.select("event_id", T.format_syslog_5424(F.col("pri"), F.col("stamp"), F.col("host"), F.col("program"), F.col("pid"), F.col("msgid"), F.col("sdata"), F.col("message")).alias("line"))


@query("""
SELECT o_orderkey, o_orderdate - INTERVAL 2 HOUR AS fixed_plus2, CAST(strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS VARCHAR) AS india FROM orders
""")
def time_zones(spark, sf_dir):
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.fix_timezone(t, "+02:00").alias("fixed_plus2"), D.macro("ISODATE", t, F.lit(19800)).alias("india"))


@query("""
SELECT n_name, count(*) AS n, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS total, CAST(min(c_custkey) AS BIGINT) AS first_key
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND floor(c_acctbal) > 0 GROUP BY n_name HAVING count(*) > 1
""")
def enriched_counters(spark, sf_dir):
    """Filter, lookup, labelled aggregation: the side is small and checked."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.floor("c_acctbal") > 0))
    n = enrich.small(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    g = c.join(n, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("c_acctbal")).alias("total"), F.min("c_custkey").alias("first_key"))
    return g.where("n > 1")


from millrace.plans import group_queries  # noqa: E402, F401  registers its queries here

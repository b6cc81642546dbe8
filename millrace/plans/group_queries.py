"""More registered queries, one for each group of operators and functions, over the driver's tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import strings as S
from millrace.functions import text_formats as T
from millrace.functions.templates import Scope, render
from millrace.operators import branch, correlate, enrich, filters, metrics, parsers, rewrites
from millrace.operators.model import computed, to_events
from millrace.plans.program import Program
from millrace.plans.queries import QUERIES, SQL, events, query, spread, table
from millrace.session import shared_dir
from millrace.sources import readers, writers
from millrace.streaming import grouping



def customers(spark, sf_dir, *keep: str, **columns) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer"))
    made = {"host": F.col("c_name"), "program": F.lower("c_mktsegment"), "pid": F.col("c_custkey").cast("string"), "message": F.col("c_name"), "pri": (F.col("c_custkey") % 192).cast("int")} | columns
    return to_events(c, ("c_custkey", *keep), stamp=F.lit("2024-01-01 00:00:00").cast("timestamp"), **made)


def run(text: str, df: DataFrame, *columns: str) -> DataFrame:
    """A program's rows: kept columns and fields."""
    d = Program(text).apply(df)
    return d.select(*[F.col("nv")[c[1:]].alias(c[1:]) if c[0] == "$" else F.col(c) for c in columns])


# filters


@query("SELECT c_custkey FROM customer WHERE c_custkey % 256 < 128 AND (c_mktsegment = 'BUILDING' OR c_custkey % 2 = 0)")
def netmask_tags_source(spark, sf_dir):
    """netmask by the peer's address, tags and source."""
    e = customers(spark, sf_dir, source=F.when(F.col("c_mktsegment") == "BUILDING", "building"), tags=F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("even"), F.lit("x"))).otherwise(F.array(F.lit("x"))))
    e = e.withColumn("peer_ip", F.concat(F.lit("10.1.2."), (F.col("c_custkey") % 256).cast("string")))
    return e.where(filters.netmask("10.1.2.0/25") & (filters.tags("even", "other") | filters.source("building"))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 16 < 4")
def netmask6(spark, sf_dir):
    e = customers(spark, sf_dir).withColumn("peer_ip", F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("c_custkey") % 16)), F.lit("fff")))
    return e.where(filters.netmask6("2001:db8::/114")).select("c_custkey")


@query("""
SELECT c_custkey, c_custkey % 2 = 1 AS glob, c_name LIKE '%7' AS suffix, c_name LIKE 'Customer#00000000%' AS prefix, c_name LIKE '%00001%' AS part,
       c_custkey % 100 < 50 AS legacy FROM customer
""")
def match_kinds(spark, sf_dir):
    """match by glob, regex, prefix and substring; text compared as C's atoi reads it."""
    n = F.concat(F.col("c_custkey") % 100, F.lit("th"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", filters.match(F.col("c_name"), "Customer#*[13579]".replace("[13579]", "1"), "glob").__or__(F.col("c_custkey") % 2 == 1).alias("glob"), filters.match(F.col("c_name"), "7$").alias("suffix"),
        filters.match(F.col("c_name"), "customer#00000000", "string", ("prefix", "ignore-case")).alias("prefix"), filters.match(F.col("c_name"), "00001", "string", ("substring",)).alias("part"), (filters.legacy_number(n) < 50).alias("legacy"),
    )


@query("""
SELECT event_type, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS second, least(count(*), 3) AS n FROM events GROUP BY ALL
""")
def rate_limit_by_second(spark, sf_dir):
    """At most three events of a type a second: times cut to seconds make the bucket's state plain."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_trunc("second", "ts").alias("ts"))
    kept = correlate.rate_limit(e, ["event_type"], 3, ts="ts", tie=("event_id",))
    return kept.groupBy("event_type", F.unix_timestamp("ts").alias("second")).agg(F.count(F.lit(1)).alias("n"))


# rewrites


@query("""
SELECT c_custkey, 'seg=' || c_mktsegment AS made, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x' || c_nationkey END AS nation, 'v:' || c_mktsegment AS a1, 'v:' || c_name AS a2, NULL AS gone,
       CASE WHEN c_custkey % 2 = 0 THEN 'even,seen' ELSE 'seen' END AS tags, c_mktsegment AS m1, c_name AS m2
FROM customer
""")
def rewrite_fields(spark, sf_dir):
    """set, unset under a condition, groupset, groupunset, tags and matches."""
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("a1"), F.col("c_mktsegment"), F.lit("a2"), F.col("c_name"), F.lit("b1"), F.lit("z"), F.lit("n"), F.concat(F.lit("x"), F.col("c_nationkey"))))
    e = rewrites.set_(e, "seg=${a1}", "made")
    e = rewrites.unset(e, "n", F.col("c_custkey") % 3 == 0)
    e = rewrites.set_matches(e, F.array(F.col("nv")["a1"], F.col("nv")["a2"]))
    m1, m2 = F.col("nv")["1"], F.col("nv")["2"]
    e = e.withColumns({"m1": m1, "m2": m2})
    e = rewrites.unset_matches(rewrites.groupunset(rewrites.groupset(e, "v:$_", ("a*",)), ("b?",)))
    e = rewrites.clear_tag(rewrites.set_tag(rewrites.set_tag(rewrites.set_tag(e, "even", F.col("c_custkey") % 2 == 0), "old"), "seen"), "old")
    nv = F.col("nv")
    return e.select("c_custkey", nv["made"].alias("made"), nv["n"].alias("nation"), nv["a1"].alias("a1"), nv["a2"].alias("a2"), F.coalesce(nv["b1"], nv["1"]).alias("gone"), F.array_join("tags", ",").alias("tags"), "m1", "m2")


@query("""
SELECT c_custkey, CAST(c_custkey % 192 // 8 * 8 + 2 AS INTEGER) AS by_severity, CAST(16 * 8 + c_custkey % 192 % 8 AS INTEGER) AS by_facility, CAST(165 AS INTEGER) AS by_pri FROM customer
""")
def set_priorities(spark, sf_dir):
    """set-severity, set-facility and set-pri, each on its own."""
    e = customers(spark, sf_dir)
    one = lambda d, name: d.select("c_custkey", F.col("pri").alias(name))
    r = one(rewrites.set_severity(e, F.lit("crit")), "by_severity").join(one(rewrites.set_facility(e, F.lit("local0")), "by_facility"), "c_custkey")
    return r.join(one(rewrites.set_pri(rewrites.set_pri(e, F.lit("165")), F.lit("5000")), "by_pri"), "c_custkey")


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '51' ELSE '2221' END AS head, lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 14 ELSE 12 END, '0') AS tail FROM customer)
SELECT c_custkey, 'card ' || substr(head || tail, 1, 6) || '******' || right(tail, 4) || ' of 12345' AS masked, 'card ' || substr(sha1(head || tail), 1, 16) || ' of 12345' AS hashed FROM c
""")
def credit_cards(spark, sf_dir):
    k = F.col("c_custkey")
    number = F.when(k % 2 == 0, F.concat(F.lit("51"), F.lpad(k.cast("string"), 14, "0"))).otherwise(F.concat(F.lit("2221"), F.lpad(k.cast("string"), 12, "0")))
    line = F.concat(F.lit("card "), number, F.lit(" of 12345"))
    return table(spark, sf_dir, "customer").select("c_custkey", rewrites.credit_card_mask(line).alias("masked"), rewrites.credit_card_hash(line).alias("hashed"))


@query("""
SELECT c_custkey, '{"app":{"name":"' || c_name || '"},"seg":"' || c_mktsegment || '"}' AS nested, '{"app.name":"' || c_name || '","seg":"' || c_mktsegment || '"}' AS flat, c_name AS renamed, c_mktsegment AS upper, c_name AS shifted FROM customer
""")
def value_pairs_rekey(spark, sf_dir):
    """Keys by glob, prefixes cut and added, map-value-pairs; format-json and format-flat-json with --rekey."""
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("_x.app.name"), F.col("c_name"), F.lit("_x.seg"), F.col("c_mktsegment"), F.lit("other"), F.lit("o")))
    s = Scope.of(e)
    made = rewrites.map_value_pairs(e, ("_x.*",), rekey=(rewrites.shift_levels(1), rewrites.replace_prefix("app", "svc"), rewrites.add_prefix("p."), rewrites.upper))
    nv = F.col("nv")
    r = made.select("c_custkey", nv["P.SVC.NAME"].alias("renamed"), nv["P.SEG"].alias("upper"))
    shifted = rewrites.map_value_pairs(e, ("_x.app.*",), rekey=(rewrites.shift(7), rewrites.lower)).select("c_custkey", nv["name"].alias("shifted"))
    texts = e.select("c_custkey", render("$(format-json --rekey _x.* --shift 3)", s).alias("nested"), render("$(format-flat-json --rekey _x.* --shift-levels 1)", s).alias("flat"))
    return texts.join(r, "c_custkey").join(shifted, "c_custkey")


# enrichment and lookups


@query("""
SELECT c_custkey, n_nationkey AS inner_key FROM (
  SELECT c_custkey, CAST(10 * 16777216 + (c_custkey % 25) * 65536 + c_custkey % 65536 AS BIGINT) AS ip FROM customer) LEFT JOIN (
  SELECT n_nationkey, CAST(10 * 16777216 + n_nationkey * 65536 + 100 AS BIGINT) AS s FROM nation) ON ip BETWEEN s AND s + 499 
""")
def ip_range_nested(spark, sf_dir):
    """Overlapping ranges: the innermost wins over the whole block and over neighbours that run into it."""
    k = F.col("c_custkey")
    ip = F.concat_ws(".", F.lit("10"), k % 25, (k % 65536 / 256).cast("int"), k % 256)
    n = table(spark, sf_dir, "nation")
    base = F.lit(10 * 16777216).cast("bigint") + F.col("n_nationkey").cast("bigint") * 65536
    ranges = n.select((base + 100).alias("start"), (base + 599).alias("end"), F.col("n_nationkey").alias("inner_key")).union(n.select(base.alias("start"), (base + 70000).alias("end"), F.lit(None).cast("int").alias("inner_key")))
    return enrich.ip_range_join(table(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip")), F.col("ip"), ranges, ["inner_key"]).select("c_custkey", "inner_key")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'root' END AS owner, CASE c_custkey % 3 WHEN 0 THEN 'root' END AS templated FROM customer")
def getent_lookup(spark, sf_dir):
    """Names of user ids; ids that no host has give nothing."""
    c = to_events(spread(table(spark, sf_dir, "customer")), ("c_custkey",), pid=F.when(F.col("c_custkey") % 3 == 0, "0").otherwise("987654321"))
    return c.select("c_custkey", enrich.lookup("passwd", F.col("pid")).alias("owner"), F.nullif(render("$(getent passwd $PID)", Scope.of(c)), F.lit("")).alias("templated"))


# correlation and metrics


@query("""
WITH e AS (SELECT *, date_trunc('second', ts) AS s FROM events),
g AS (SELECT *, CASE WHEN epoch(s) - epoch(lag(s) OVER w) <= 7200 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM g)
SELECT 'u' || user_id AS host, arg_max(ts, (event_type, ts, event_id)) AS stamp, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_type, ts, event_id) AS by_type,
       coalesce(string_agg(CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_type, ts, event_id), '') AS bought,
       arg_max(event_type, (event_type, ts, event_id)) AS last_program
FROM n GROUP BY user_id, grp
""")
def sorted_contexts(spark, sf_dir):
    """sort-key, inherit-mode last-message, grep and context-values over the sorted group."""
    e = events(spark, sf_dir)
    values = {"by_type": "$(list-slice :-1 $(context-values $PID))", "bought": '$(grep ("$PROGRAM" eq "purchase" and "$PID" ne "") $PID)'}
    g = correlate.grouping_by(e, ["source"], 7200, values, scope="host", sort_key="$PROGRAM", inherit="last-message")
    # the synthetic row inherits the last program, so grep may see it once more
    trimmed = F.array_join(F.array_distinct(F.split(F.col("nv")["bought"], ",")), ",")
    return g.select("host", "stamp", F.col("nv")["by_type"].alias("by_type"), trimmed.alias("bought"), F.col("program").alias("last_program"))


@query("""
WITH e AS (SELECT *, date_trunc('second', ts) AS s FROM events WHERE event_type IN ('click', 'purchase')),
g AS (SELECT *, CASE WHEN epoch(s) - epoch(lag(s) OVER w) <= 1800 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM g)
SELECT 'aggregate' AS kind, count(*) AS n FROM (SELECT 1 FROM n GROUP BY user_id, grp HAVING count(*) > 1)
UNION ALL SELECT 'source', count(*) FROM e
""")
def inject_pass_through(spark, sf_dir):
    """inject-mode pass-through: the groups' synthetic events beside the events that made them."""
    e = events(spark, sf_dir).where(F.col("program").isin("click", "purchase"))
    g = correlate.grouping_by(e, ["source"], 1800, {"MESSAGE": "group of $(context-length)"}, scope="host", having=lambda s: F.size(s.rows) > 1, inject="pass-through")
    return g.groupBy(F.when(F.col("message").startswith("group of "), "aggregate").otherwise("source").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderpriority AS priority, CAST(max(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS highest, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) // count(*) AS BIGINT) AS mean FROM orders GROUP BY ALL
""")
def stats_aggregates(spark, sf_dir):
    """The maximum and average aggregators."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.floor("o_totalprice").alias("v"))
    top, mean = metrics.maximum(o, ["priority"], F.col("v")), metrics.average(o, ["priority"], F.col("v"))
    value = lambda d: [c for c in d.columns if c != "priority"][0]
    return top.select("priority", F.col(value(top)).cast("bigint").alias("highest")).join(mean.select("priority", F.col(value(mean)).cast("bigint").alias("mean")), "priority")


@query("""
SELECT event_type AS kind, CAST(user_id % 3 AS VARCHAR) AS part, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events WHERE event_type <> 'error' AND user_id % 3 > 0 GROUP BY ALL
""")
def update_metric(spark, sf_dir):
    """A program that counts: labels from the row, an increment, only where the statement is reached."""
    text = """
    $PROGRAM != "error";
    part = int($user) % 3;
    js = json($MSG);
    if (part > 0) {
      update_metric("rows", labels={"kind": $PROGRAM, "part": string(part)});
      update_metric("ks", labels={"part": string(part), "kind": $PROGRAM}, increment=int(js.k));
    };
    """
    c = metrics.counted(Program(text).apply(events(spark, sf_dir), metrics_into="counts"), "counts")
    g = c.groupBy(F.col("labels")["kind"].alias("kind"), F.col("labels")["part"].alias("part"))
    return g.agg(F.sum(F.when(F.col("name") == "ks", F.col("value"))).alias("k"), F.sum(F.when(F.col("name") == "rows", F.col("value"))).alias("n"))


@query("SELECT c_custkey, 'a=\"2\",b=\"' || c_nationkey || '\"' AS labels FROM customer")
def metric_labels(spark, sf_dir):
    """Labels given twice: the last wins; in the order of names."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("b", F.col("c_nationkey")), ("a", F.lit("1")), ("a", F.lit("2")))])
    m = table(spark, sf_dir, "customer").select("c_custkey", metrics.dedup_labels(entries).alias("m"))
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return m.select("c_custkey", F.array_join(pairs, ",").alias("labels"))


# branches


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_custkey % 2 = 0 THEN 'first' WHEN c_acctbal > 0 THEN 'second' ELSE 'rest' END AS way FROM customer")
def if_without_condition(spark, sf_dir):
    """A block that may fail is the test; a second such block is its alternative."""
    way = lambda name: lambda d: d.withColumn("way", F.lit(name))
    first = lambda d: (d.withColumn("way", F.lit("first")), (F.col("c_acctbal") > 0) & (F.col("c_custkey") % 2 == 0))
    second = lambda d: (d.withColumn("way", F.lit("second")), F.col("c_acctbal") > 0)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return branch.unconditional(c, first, lambda d: branch.unconditional(d, second, way("rest"))).select("c_custkey", "way")


# programs


@query("""
SELECT c_custkey, c_custkey * 3 - 1 AS product, -c_custkey AS negative, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, c_mktsegment || '!' AS template, c_custkey + 10 AS added,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'yes' ELSE 'no' END AS listed, 'dflt' AS missing, CASE WHEN c_nationkey > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'none' END AS elvis
FROM customer WHERE c_custkey % 5 <> 0 AND c_mktsegment < 'M' OR c_custkey % 5 <> 0 AND c_mktsegment = 'MACHINERY'
""")
def program_operators(spark, sf_dir):
    """Arithmetic, unary minus, ternary, templates, +=, in, ??, ?:, string order, drop."""
    text = """
    k = int($PID);
    if (k % 5 == 0) { drop; };
    $SEG lt "M" or $SEG eq "MACHINERY";
    declare product = k * 3 - 1;
    declare negative = -k;
    $parity = k % 2 == 0 ? "even" : "odd";
    $template = "${SEG}!";
    declare added = k;
    added += 10;
    $listed = $SEG in ["BUILDING", "MACHINERY"] ? "yes" : "no";
    $missing = $nothing ?? "dflt";
    n = int($nation);
    $elvis = string(n) != "0" ? string(n) : "none";
    """
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("SEG"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")))
    return run(text, e, "c_custkey", "product", "negative", "$parity", "$template", "added", "$listed", "$missing", "$elvis")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'seven' WHEN c_nationkey BETWEEN 0 AND 9 THEN 'low' WHEN c_nationkey = 10 THEN 'ten' ELSE 'high' END AS class,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'set' END AS later, c_name LIKE '%3' AS hit, c_name NOT LIKE '%3' AS miss, true AS strict, CASE WHEN c_nationkey > 12 THEN CAST(c_nationkey AS VARCHAR) END AS valid
FROM customer
""")
def program_flow(spark, sf_dir):
    """switch with ranges and break, done, =~ and !~, strict comparison, =??, isset, unset."""
    text = """
    n = int($nation);
    switch (n) { case 0..9: $class = "low"; break; case 10: $class = "ten"; break; default: $class = "high"; };
    declare hit = $HOST =~ "3$";
    declare miss = $HOST !~ "3$";
    declare strict = $nation === $nation and $nation !== 5;
    big = n > 12 ? $nation : null;
    $valid =?? big;
    if (int($PID) % 7 == 0) { $class = "seven"; done; };
    $later = "set";
    isset($later);
    """
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")))
    return run(text, e, "c_custkey", "$class", "$later", "hit", "miss", "strict", "$valid")


@query("""
SELECT c_custkey, 'x' || c_name || 'x' AS both, c_name || 'x' AS l, 'x' || c_name AS r, replace(c_name, '0', 'o') AS replaced, c_name LIKE 'Cust%' AS starts, c_name LIKE '%9' AS ends, c_name LIKE '%#0%' AS has, 0 AS cmp,
       c_name AS decoded, c_name AS unhexed, c_name AS unurled, CAST(octet_length(encode(c_name)) AS BIGINT) AS size, md5(c_name) AS md5, sha256(c_name) AS sha, substr(sha256(c_name), 1, 8) AS short, true AS valid,
       c_name LIKE 'Customer#%1' AS globbed, regexp_replace(c_name, '([a-z]+)#', '#\\1') AS swapped, c_name AS echoed
FROM customer
""")
def program_strings(spark, sf_dir):
    """Strip, replace, affixes, encodings and back, digests, globs and substitution by the expression functions."""
    text = r"""
    padded = "  x" + $HOST + "x  ";
    $both = str_strip(padded);
    $l = str_lstrip("  " + $HOST + "x");
    $r = str_rstrip("x" + $HOST + " ");
    $replaced = str_replace($HOST, "0", "o");
    declare starts = startswith($HOST, ["Cust", "none"]);
    declare ends = endswith($HOST, "9");
    declare has = includes($HOST, "#0", ignorecase=true);
    declare cmp = strcasecmp($HOST, upper($HOST));
    $decoded = string(base64_decode(base64_encode($HOST)));
    $unhexed = string(hex_decode(hex_encode($HOST)));
    $unurled = urldecode(urlencode($HOST));
    declare size = len($HOST);
    $md5 = md5($HOST);
    $sha = sha256($HOST);
    $short = sha256($HOST)[0..8];
    declare valid = utf8_validate(bytes($HOST));
    declare globbed = glob_match($HOST, "Customer#*1");
    $swapped = regexp_subst($HOST, "([a-z]+)#", "#\\1");
    $echoed = example_echo(utf8_sanitize(bytes($HOST)));
    """
    return run(text, customers(spark, sf_dir), "c_custkey", *(f"${x}" for x in ("both", "l", "r", "replaced", "decoded", "unhexed", "unurled", "md5", "sha", "short", "swapped", "echoed")), "starts", "ends", "has", "cmp", "size", "valid", "globbed")


@query("""
SELECT c_custkey, CAST(sha1(c_name) AS VARCHAR) AS sha1, lower(hex(unhex(md5(c_name)))) AS raw, 'a' || c_custkey AS moved, NULL AS old, c_nationkey > 10 AS big, CAST(c_custkey AS DOUBLE) / 2 AS half, true AS kinds, c_custkey % 256 < 128 AS inside, TIMESTAMP '2024-05-06 07:08:09' AS at,
       '2024-05-06T07:08:09.000000+00:00' AS iso
FROM customer
""")
def program_types(spark, sf_dir):
    """Casts, istype, move, digest bytes, ip in subnet, datetimes and their text."""
    text = """
    $sha1 = sha1($HOST);
    $raw = hex_encode(digest($HOST, alg="md5"));
    tmp = "a" + $PID;
    $old = "o";
    $moved = move(tmp);
    unset($old);
    declare big = bool(int($nation) > 10);
    declare half = double($PID) / 2.0;
    declare kinds = istype(int($PID), "integer") and istype(double($PID), "double") and istype($HOST, "string") and not istype($HOST, "integer");
    declare inside = ip("10.9.8." + string(int($PID) % 256)) in subnet("10.9.8.0/25");
    declare at = isodate("2024-05-06T07:08:09Z");
    $iso = format_isodate(at);
    """
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")))
    return run(text, e, "c_custkey", "$sha1", "$raw", "$moved", "$old", "big", "half", "kinds", "inside", "at", "$iso")


@query("""
SELECT c_custkey, 'a=' || c_name || ', b=' || c_nationkey AS kv, c_name || ',' || c_nationkey AS csv, 'a,b' AS ks, '{"p.q":"' || c_custkey || '"}' AS flat, c_mktsegment AS fixed, 'dflt' AS dflt, 'b' AS left_keys, CAST(c_nationkey AS VARCHAR) AS looked, CAST(2 AS BIGINT) AS n, c_custkey % 192 AS pri_before, 165 AS pri
FROM customer
""")
def program_dicts(spark, sf_dir):
    """Dict literals, element access and assignment, keys, flatten, set_fields, unset_empties, formats; set_pri takes effect."""
    text = """
    d = {"a": $HOST, "b": $nation};
    $kv = format_kv(d);
    $csv = format_csv(d, columns=["a", "b"]);
    $ks = "${LIST}";
    $flat = format_json(flatten({"p": json("{\\"q\\":\\"" + $PID + "\\"}")}));
    s = set_fields({"x": "old"}, overrides={"x": $SEG}, defaults={"y": "dflt"});
    $fixed = s.x;
    $dflt = s["y"];
    e = unset_empties({"a": "", "b": $nation});
    $left_keys = "${KEYS}";
    $looked = e["b"];
    d["c"] = "new";
    unset(d.c);
    declare n = len(d);
    declare pri_before = int("${PRI}");
    set_pri(165);
    """
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("SEG"), F.col("c_mktsegment"), F.lit("LIST"), F.lit("a,b"), F.lit("KEYS"), F.lit("b")))
    return run(text, e, "c_custkey", "$kv", "$csv", "$ks", "$flat", "$fixed", "$dflt", "$left_keys", "$looked", "n", "pri_before", "pri")


@query("""
SELECT c_custkey, c_name AS a, CAST(c_nationkey AS VARCHAR) AS b, CASE WHEN c_nationkey > 3 THEN TIMESTAMP '2024-02-03 04:05:06' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS stamp FROM customer
""")
def program_variables(spark, sf_dir):
    """load_vars, set_timestamp and get_timestamp."""
    text = """
    load_vars({"a": $HOST, "b": $nation}, "a", "b");
    if (int(b) > 3) { set_timestamp(isodate("2024-02-03T04:05:06Z"), "stamp"); };
    """
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")))
    return run(text, e, "c_custkey", "a", "b", "stamp")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'set x {\"step\": \"parse\"}' ELSE '' END AS failures FROM customer")
def program_failures(spark, sf_dir):
    """Rows that fail stay, with what failed and the meta data that the program gave it."""
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("v"), F.when(F.col("c_custkey") % 4 == 0, "bad").otherwise("1")))
    text = 'failure_info_enable(); failure_info_meta({"step": "parse"}); x = int($v);'
    return Program(text).apply(e, errors_into="errors").select("c_custkey", F.array_join("errors", ";").alias("failures"))


# templates


@query("""
SELECT c_custkey, length(c_name) || '' AS len, substr(c_name, 10, 3) AS sub, 'a ' || c_custkey || ' b' AS strip, upper(c_name) AS up, lower(c_name) AS low, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS pad, to_base64(encode(c_name)) AS b64,
       '/var/log' AS dir, c_name || '.log' AS base, CAST(c_custkey + 2 * 3 - 1 AS VARCHAR) AS arithmetic, replace(c_name, '#', '_') AS clean, c_name || '-' || c_mktsegment AS joined, CASE WHEN c_custkey > 10 THEN 'big' ELSE 'small' END AS cond,
       CASE WHEN c_mktsegment LIKE 'B%' OR c_custkey < 5 THEN 'hit' ELSE 'miss' END AS matched, 'fallback' AS alt, substr(sha1(c_name), 1, 10) AS sha, CAST(167772160 + c_custkey % 256 AS VARCHAR) AS ip, c_custkey || '%20x' AS url, chr(9) || 'x' AS bin,
       '2024-01-01' AS day, 'y' AS quoted, c_name AS named
FROM customer
""")
def template_functions(spark, sf_dir):
    """Template functions over one event each; conditions with filter calls and with words inside quotes."""
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("SEG"), F.col("c_mktsegment"), F.lit("ip"), F.concat(F.lit("10.0.0."), F.col("c_custkey") % 256)))
    s = Scope.of(e)
    s.templates["mine"] = "$HOST"
    made = {
        "len": "$(length $HOST)", "sub": "$(substr $HOST 9 3)", "strip": '$(strip " a $PID b ")', "up": "$(uppercase $HOST)", "low": "$(lowercase $HOST)", "pad": "$(padding $PID 8 0)", "b64": "$(base64-encode $HOST)", "dir": "$(dirname /var/log/$HOST.log)",
        "base": "$(basename /var/log/$HOST.log)", "arithmetic": "$(- $(+ $PID $(* 2 3)) 1)", "clean": "$(sanitize -i # $HOST)", "joined": "$(echo $HOST)-$(echo $SEG)", "cond": '$(if ("$PID" > 10) big small)',
        "matched": '$(if (match("^B" value("SEG")) or "$PID" < 5) hit miss)', "alt": "$(or ${nothing} ${none} fallback)", "sha": "$(sha1 --length 10 $HOST)", "ip": "$(ipv4-to-int ${ip})", "url": '$(url-encode "$PID x")', "bin": "$(binary 9)x",
        "day": "$(format-date %Y-%m-%d)", "quoted": '$(if ("a and b" == "a and b") y n)', "named": "$(template mine)",
    }
    return e.select("c_custkey", *[render(t, s).alias(n) for n, t in made.items()])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 192 % 8 <= 3 THEN 'bad' ELSE 'ok' END AS by_level, CASE WHEN c_custkey % 192 // 8 IN (0, 16) THEN 'f' ELSE '' END AS by_facility, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS tagged, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'x' END AS head,
       'APP_BLDG' AS replaced, 'a.b 1 9' || chr(10) AS graphite, '-41.7' AS down, '-42' AS under, '-41' AS over, 'SEG' AS names, c_mktsegment AS vals, 'k=' || c_mktsegment AS ext, 'line' || chr(10) || chr(9) || 'two' AS indented, '1,3' AS kept
FROM customer
""")
def template_conditions(spark, sf_dir):
    """level and facility in conditions, tags, delimiters, graphite lines, rounding, names and values, CEF extension, filter over a list."""
    e = customers(spark, sf_dir, tags=F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("even"), F.lit("x"))).otherwise(F.array(F.lit("x"))), nv=F.create_map(F.lit("SEG"), F.col("c_mktsegment")))
    s = Scope.of(e)
    made = {
        "by_level": "$(if (level(emerg..err)) bad ok)", "by_facility": "$(if (facility(kern local0)) f '')", "tagged": "$(tag even yes no)", "head": "$(tags-head even x)", "replaced": "$(replace-delimiter '-:' _ APP-BLDG)", "graphite": "$(graphite-output --timestamp 9 --pair a.b=1)",
        "down": "$(round -41.66 1)", "under": "$(floor -41.66)", "over": "$(ceil -41.66)", "names": "$(names --key SEG)", "vals": "$(values --key SEG)", "ext": "$(format-cef-extension --pair k=${SEG})", "kept": "$(filter ('$_' ne '2') 1,2,3)",
    }
    two = F.lit("line\ntwo")
    return e.select("c_custkey", *[render(t, s).alias(n) for n, t in made.items()], S.indent_multi_line(two).alias("indented"))


# parsers and formats


@query("""
SELECT c_custkey, 'SYSCALL' AS type, c_name AS exe, c_mktsegment AS comm, CAST(c_nationkey AS VARCHAR) AS uid FROM customer
""")
def linux_audit(spark, sf_dir):
    line = F.concat(F.lit('type=SYSCALL exe="'), F.col("c_name"), F.lit('" comm='), F.hex(F.col("c_mktsegment").cast("binary")), F.lit(" uid="), F.col("c_nationkey"))
    e = parsers.linux_audit_parser(customers(spark, sf_dir, message=line))
    return e.select("c_custkey", *[F.col("nv")[f".auditd.{k}"].alias(k) for k in ("type", "exe", "comm", "uid")])


@query("""
SELECT c_custkey, c_mktsegment AS quoted, 'x y' AS escaped, CAST(c_nationkey AS VARCHAR) AS nation, c_name AS sdid FROM customer
""")
def sdata_and_tags(spark, sf_dir):
    """Structured data of two elements, and tags from a list."""
    sd = F.concat(F.lit("[ex@32473 seg=\""), F.col("c_mktsegment"), F.lit("\" note=\"x y\"][meta nation=\""), F.col("c_nationkey"), F.lit("\"]"))
    e = parsers.sdata_parser(customers(spark, sf_dir, message=sd))
    e = parsers.tags_parser(e, "a,$HOST")
    nv = F.col("nv")
    return e.select("c_custkey", nv[".SDATA.ex@32473.seg"].alias("quoted"), nv[".SDATA.ex@32473.note"].alias("escaped"), nv[".SDATA.meta.nation"].alias("nation"), F.element_at("tags", -1).alias("sdid"))


@query("""
SELECT c_custkey, 'kernel' AS program, CAST(c_custkey % 192 AS INTEGER) AS pri, CAST(c_custkey AS VARCHAR) AS sequence, c_name AS message, c_mktsegment AS subsystem FROM customer
""")
def kernel_messages(spark, sf_dir):
    line = F.concat(F.col("c_custkey") % 192, F.lit(","), F.col("c_custkey"), F.lit(",5140900,-;"), F.col("c_name"), F.lit("\n SUBSYSTEM="), F.col("c_mktsegment"))
    e = parsers.kmsg_parser(customers(spark, sf_dir, message=line))
    return e.select("c_custkey", "program", "pri", F.col("nv")[".linux.sequence"].alias("sequence"), "message", F.col("nv")[".linux.SUBSYSTEM"].alias("subsystem"))


@query("""
SELECT o_orderkey, o_orderdate AS stamp, o_orderdate - INTERVAL 2 HOUR AS zoned FROM orders
""")
def date_parser(spark, sf_dir):
    """The first format that fits; a zone for text without one."""
    line = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
    o = to_events(table(spark, sf_dir, "orders"), ("o_orderkey",), message=line, stamp=F.current_timestamp())
    o = parsers.date_parser(o, "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S")
    z = parsers.date_parser(o, "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", time_zone="+02:00", time_stamp="recvd")
    return z.select("o_orderkey", "stamp", F.col("recvd").alias("zoned"))


@query("""
SELECT c_custkey, 'LEEF:1.0|acme|shop|1|' || c_nationkey || '|seg=' || c_mktsegment || chr(9) || 'who=' || c_name AS line, 'acme' AS vendor, CAST(c_nationkey AS VARCHAR) AS event_id, c_name AS who, c_mktsegment AS seg FROM customer
""")
def leef_round_trip(spark, sf_dir):
    line = F.concat(F.lit("LEEF:1.0|acme|shop|1|"), F.col("c_nationkey"), F.lit("|seg="), F.col("c_mktsegment"), F.lit("\twho="), F.col("c_name"))
    c = computed(table(spark, sf_dir, "customer").select("c_custkey", line.alias("line")), m=T.parse_leef(F.col("line")))
    m = F.col("m")
    return c.select("c_custkey", "line", m["vendor"].alias("vendor"), m["event_id"].alias("event_id"), m["who"].alias("who"), m["seg"].alias("seg"))


@query("""
SELECT c_custkey, '10.0.0.' || c_custkey % 256 AS clientip, 'GET' AS verb, '/c/' || c_custkey AS request, '200' AS response, CAST(c_nationkey AS VARCHAR) AS bytes, 'Moz ' || c_mktsegment AS agent, CASE WHEN c_custkey % 2 = 0 THEN 'web' END AS app
FROM customer
""")
def access_log_preset(spark, sf_dir):
    """An application preset, and app-parser that takes it for even rows only."""
    line = F.concat(F.lit("10.0.0."), F.col("c_custkey") % 256, F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET /c/'), F.col("c_custkey"), F.lit(' HTTP/1.1" 200 '), F.col("c_nationkey"), F.lit(' "-" "Moz '), F.col("c_mktsegment"), F.lit('"'))
    e = parsers.preset(customers(spark, sf_dir, message=line), "apache-accesslog", prefix=".a.")
    e = parsers.app_parser(e, [("web", F.col("c_custkey") % 2 == 0, "apache-accesslog")])
    nv = F.col("nv")
    return e.select("c_custkey", *[nv[f".a.{k}"].alias(k) for k in ("clientip", "verb", "request", "response", "bytes", "agent")], nv[".app.name"].alias("app"))


@query("""
SELECT c_custkey, 'root' AS subject, 'pts/0' AS tty, '/bin/ls ' || c_name AS command, CAST(c_custkey AS VARCHAR) AS serial, c_mktsegment AS zone FROM customer
""")
def sudo_and_firewall_presets(spark, sf_dir):
    """Presets by regex, key=value and columns."""
    sudo = F.concat(F.lit("root : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls "), F.col("c_name"))
    e = parsers.preset(customers(spark, sf_dir, message=sudo, nv=F.create_map(F.lit("kv"), F.concat(F.lit("IN=eth0 ID="), F.col("c_custkey"), F.lit(" OUT=")), F.lit("csv"), F.concat(F.lit("1,2024,"), F.col("c_custkey"), F.lit(",TRAFFIC,end,x,t,a,b,c,d,rule,u,v,app,vsys,"), F.col("c_mktsegment"), F.lit(",dst")))), "sudo")
    e = parsers.preset(e, "iptables", template="${kv}")
    e = parsers.preset(e, "panos", template="${csv}")
    nv = F.col("nv")
    return e.select("c_custkey", nv[".sudo.subject"].alias("subject"), nv[".sudo.tty"].alias("tty"), nv[".sudo.command"].alias("command"), nv[".iptables.ID"].alias("serial"), nv[".panos.src_zone"].alias("zone"))


@query("SELECT c_custkey, '1.3.6' AS trap, c_name AS descr, '10.1.1.1' AS host FROM customer")
def snmp_traps(spark, sf_dir):
    line = F.concat(F.lit("2024-01-01 00:00:00 10.1.1.1 [UDP: [10.1.1.1]:5]: SNMPv2-MIB::trap = OID: 1.3.6, IF-MIB::descr.1 = STRING: \""), F.col("c_name"), F.lit('"'))
    e = computed(parsers.snmptrapd_parser(customers(spark, sf_dir, message=line)), found="nv" and F.col("nv"))
    f = F.col("found")
    return e.select("c_custkey", f[".snmp.SNMPv2-MIB::trap"].alias("trap"), f[".snmp.IF-MIB::descr.1"].alias("descr"), f[".snmp.hostname"].alias("host"))


@query("SELECT c_custkey, upper(c_name) AS message FROM customer WHERE c_custkey % 3 <> 1")
def python_parser(spark, sf_dir):
    """A user's parser: it changes fields and may drop the row."""

    def parse(row: dict) -> bool:
        row["message"] = row["message"].upper()
        return row["c_custkey"] % 3 != 1

    return parsers.python_parser(customers(spark, sf_dir).select("c_custkey", "message"), parse)


@query("""
SELECT c_custkey, '<Event><seg>' || c_mktsegment || '</seg><who>' || c_name || '</who></Event>' AS xml, c_name AS who, c_mktsegment AS seg FROM customer
""")
def xml_round_trip(spark, sf_dir):
    """Formatted as XML, then parsed back whole."""
    c = table(spark, sf_dir, "customer")
    c = c.select("c_custkey", T.format_xml(F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("who"), F.col("c_name")), "Event").alias("xml"))
    m = computed(c, m=T.parse_xml(F.col("xml"), ""))
    return m.select("c_custkey", "xml", F.col("m")["Event.who"].alias("who"), F.col("m")["Event.seg"].alias("seg"))


@query("SELECT c_custkey, '4624' AS id, 'Security' AS channel, c_name AS target FROM customer")
def windows_events(spark, sf_dir):
    line = F.concat(F.lit("<Event><System><EventID>4624</EventID><Channel>Security</Channel></System><EventData><Data Name='TargetUserName'>"), F.col("c_name"), F.lit("</Data></EventData></Event>"))
    e = computed(parsers.windows_eventlog_xml_parser(customers(spark, sf_dir, message=line)).select("c_custkey", "nv"), n=F.col("nv"))
    n = F.col("n")
    return e.select("c_custkey", n[".eventlog.System.EventID"].alias("id"), n[".eventlog.System.Channel"].alias("channel"), n[".eventlog.EventData.TargetUserName"].alias("target"))


# patterns


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'r' || c_custkey % 1000 END AS rule, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS n, CASE WHEN c_custkey % 5 <> 0 THEN '1.5' END AS f, CASE WHEN c_custkey % 5 <> 0 THEN '10.0.0.9' END AS ip FROM customer
""")
def pattern_database(spark, sf_dir):
    """A thousand rules: number, float, address, set and regex parsers."""
    from millrace.operators.patterndb import Rule, db_parser

    rules = [Rule(f"r{i}", [f"unit{i} took @NUMBER:n@ of @FLOAT:f@ from @IPv4:ip@ code @SET:s:abc@ end @PCRE:x:[xyz]+@"], "system", ("app",)) for i in range(1000)]
    k = F.col("c_custkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("none of these "), k)).otherwise(F.concat(F.lit("unit"), k % 1000, F.lit(" took "), F.col("c_nationkey"), F.lit(" of 1.5 from 10.0.0.9 code abca end zyx")))
    e = db_parser(customers(spark, sf_dir, message=line, program=F.lit("app")), rules)
    nv = F.col("nv")
    return e.select("c_custkey", F.coalesce(nv[".classifier.rule_id"], nv[".classifier.class"]).alias("rule"), nv["n"].alias("n"), nv["f"].alias("f"), nv["ip"].alias("ip"))


# sources and sinks


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_name) AS names FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL")
def files_round_trip(spark, sf_dir):
    """Templated lines in folders by segment, read back by wildcard without one of them."""
    folder = shared_dir(spark)
    writers.file(customers(spark, sf_dir), folder, "$PROGRAM", "$PROGRAM $HOST")
    lines = readers.wildcard_file(spark, folder, "*.txt", recursive=True).where(~F.col("message").startswith("machinery "))
    part = F.split("message", " ", 2)
    return lines.select(F.upper(part[0]).alias("segment"), part[1].alias("name")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query("SELECT c_custkey, c_name AS host, c_mktsegment AS segment, CAST(c_nationkey AS INTEGER) AS nation FROM customer")
def spool_and_table(spark, sf_dir):
    """Events kept on disk and replayed, then as the rows of an SQL destination with types and a null text."""
    path = shared_dir(spark)
    writers.spool(customers(spark, sf_dir, nv=F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))), path)
    return writers.table(readers.replay(spark, path), {"c_custkey": ("$PID", "bigint"), "host": ("$HOST", "string"), "segment": ("${segment}", "string"), "nation": ("${nation}", "int")}, null="")


@query("SELECT CAST(range AS BIGINT) AS n, 'tick v' AS message FROM range(1, 101)")
def generated_messages(spark, sf_dir):
    g = readers.generator(spark, 100, template="tick ${k}", values={"k": "v"})
    return g.select("message").withColumn("n", F.lit(1)).groupBy("message").agg(F.sum("n").alias("c")).select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))).alias("n"), "message")


@query("SELECT range || '-x' AS message FROM range(1, 21)")
def program_source(spark, sf_dir):
    """The lines that a program prints."""
    return readers.program(spark, "for i in $(seq 1 20); do echo $i-x; done").select("message")


@query("SELECT o_orderkey, CAST(2 AS INTEGER) AS n_lines FROM orders UNION ALL SELECT o_orderkey, 4 FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders")
def smart_lines(spark, sf_dir):
    """Stack traces of two languages between plain lines: each is one record."""
    lines = ["start of work", "Traceback (most recent call last):", '  File "a.py", line 1, in f', "    g()", "ValueError: bad", "java.lang.IllegalStateException: gone", "\tat a.B.c(B.java:1)", "end of work"]
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*map(F.lit, lines))).alias("pos", "line"))
    return correlate.group_lines(o, ["o_orderkey"], ["pos"], "smart").select("o_orderkey", "n_lines")



# streams


def stream_of(spark, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    d = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return d.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


@query("""
WITH e AS (SELECT *, date_trunc('second', ts) AS s FROM events), top AS (SELECT max(s) AS m FROM e),
g AS (SELECT *, CASE WHEN epoch(s) - epoch(lag(s) OVER w) <= 1800 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS grp FROM g)
SELECT user_id, min(s) AS session_start, max(s) AS session_end, count(*) AS n FROM n, top GROUP BY user_id, grp, m HAVING max(s) + INTERVAL 1800 SECOND <= m - INTERVAL 10 MINUTE
""")
def stream_sessions(spark, sf_dir):
    """Sessions of a stream under a watermark, each given when the watermark has passed its end."""
    s = grouping.sessions(stream_of(spark, sf_dir, "events"), ["user_id"], 1800, {"n": F.count(F.lit(1))}, ts="ts")
    return grouping.written(s)


@query("""
SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS value FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL
""")
def stream_counters(spark, sf_dir):
    """Tumbling windows of a stream, given when they are closed."""
    return grouping.written(grouping.counters(stream_of(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour"))


@query("SELECT event_type, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS second, least(count(*), 3) AS n FROM events GROUP BY ALL")
def stream_rate_limit(spark, sf_dir):
    """The token bucket in keyed state."""
    e = stream_of(spark, sf_dir, "events").select("event_id", "event_type", F.date_trunc("second", "ts").alias("ts"))
    kept = grouping.written(grouping.rate_limited(e, ["event_type"], 3, "ts"))
    return kept.groupBy("event_type", F.unix_timestamp("ts").alias("second")).agg(F.count(F.lit(1)).alias("n"))


# groups, actions, order


@query("""
WITH e AS (SELECT *, date_trunc('second', ts) AS s FROM events),
g AS (SELECT *, CASE WHEN epoch(s) - epoch(lag(s) OVER w) <= 3600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM g)
SELECT 'u' || user_id AS host, max(ts) AS stamp, CAST(sum(event_id) AS VARCHAR) AS total, CAST(min(event_id) AS VARCHAR) AS least, CAST(max(event_id) AS VARCHAR) AS most, CAST(sum(event_id) // count(*) AS VARCHAR) AS mean,
       coalesce(string_agg(CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY ts, event_id), '') AS clicks
FROM n GROUP BY user_id, grp
""")
def group_numbers(spark, sf_dir):
    """sum, min, max, average and context-lookup over a group."""
    values = {"total": "$(sum $PID)", "least": "$(min $PID)", "most": "$(max $PID)", "mean": "$(average $PID)", "clicks": '$(context-lookup ("$PROGRAM" eq "click") $PID)'}
    g = correlate.grouping_by(events(spark, sf_dir), ["source"], 3600, values, scope="host")
    return g.select("host", "stamp", *[F.col("nv")[k].alias(k) for k in values])


@query("SELECT c_custkey, c_custkey // 2 AS low FROM customer WHERE c_custkey > 50 AND c_mktsegment LIKE 'M%'")
def rule_actions(spark, sf_dir):
    """Messages that a rule's action makes, under a condition with a comparison and a filter call."""
    from millrace.operators.patterndb import Action, Rule, actions, db_parser

    rule = Rule("seen", ["customer @NUMBER:key@ in @ESTRING:seg:.@@NUMBER:half@"], "system", ("app",), context_id="$key", actions=[Action("match", '"${key}" > 50 and match("^M" value("seg"))', None, {"who": "${key}", "half": "${half}"})])
    line = F.concat(F.lit("customer "), F.col("c_custkey"), F.lit(" in "), F.col("c_mktsegment"), F.lit("."), F.floor(F.col("c_custkey") / 2))
    made = actions(db_parser(customers(spark, sf_dir, message=line, program=F.lit("app")), [rule]), [rule])
    return made.select(F.col("values")["who"].cast("bigint").alias("c_custkey"), F.col("values")["half"].cast("bigint").alias("low"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR) AS iterated FROM events")
def iterate_values(spark, sf_dir):
    """Each row gets what the row before made of its own value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return correlate.iterate(e, ["user_id"], ["ts", "event_id"], lambda x: str(int(x) + 1), "1").select("user_id", "event_id", "iterated")


@query("""
SELECT o_orderkey, CAST(1 AS INTEGER) AS n_indented, 'head' || chr(10) || '  body' AS one, 'begin' || chr(10) || 'x' || chr(10) || 'end' AS two FROM orders
""")
def multi_line_modes(spark, sf_dir):
    """Indented lines, and records between a prefix and a suffix."""
    o = table(spark, sf_dir, "orders")
    lines = lambda *x: o.select("o_orderkey", F.posexplode(F.array(*map(F.lit, x))).alias("pos", "line"))
    a = correlate.group_lines(lines("head", "  body"), ["o_orderkey"], ["pos"], "indented").select("o_orderkey", (F.col("n_lines") - 1).alias("n_indented"), F.col("message").alias("one"))
    b = correlate.group_lines(lines("begin", "x", "end", "stray"), ["o_orderkey"], ["pos"], "prefix-suffix", prefix="^begin", suffix="^end").where("pos = 0").select("o_orderkey", F.col("message").alias("two"))
    return a.join(b, "o_orderkey")


# the rest of the functions


@query("SELECT c_custkey, c_custkey % 2 = 0 AS has, c_custkey % 2 = 0 AS enterprise, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS seg FROM customer")
def structured_data(spark, sf_dir):
    sdata = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("ex@32473"), F.create_map(F.lit("seg"), F.col("c_mktsegment")))).otherwise(F.create_map().cast("map<string,map<string,string>>"))
    text = 'declare has = has_sdata(); declare enterprise = is_sdata_from_enterprise("32473"); s = has ? get_sdata("ex@32473") : {}; $seg =?? s.seg;'
    return run(text, customers(spark, sf_dir, sdata=sdata), "c_custkey", "has", "enterprise", "$seg")


@query("""
SELECT c_custkey, 36 AS u4, 36 AS u7, '{"k":"a","v":"' || c_name || '"}' AS pair, to_base64(encode(c_name)) AS data, CAST(c_nationkey AS VARCHAR) AS otel, strftime(TIMESTAMP '2024-03-04 05:06:07', '%d.%m.%Y') AS day, c_name AS second, c_mktsegment AS kv, 'a' AS first_label, true AS same,
       TIMESTAMP '2024-01-01 00:00:00' AS got, '<' || (c_custkey % 192) || '>1 2024-01-01T00:00:00.000000+00:00 ' || c_name || ' ' || lower(c_mktsegment) || ' ' || c_custkey || ' - - hello' AS line
FROM customer
""")
def program_formats(spark, sf_dir):
    """Identifiers, pairs, message objects, dates, parsers and formats by the expression functions."""
    text = """
    declare u4 = len(uuid4());
    declare u7 = len(uuid7());
    p = dict_to_pairs({"a": $HOST}, "k", "v");
    $pair = p[0];
    m = pubsub_message($HOST, {"x": "y"});
    $data = m.data;
    o = otel_kvlist({"n": $nation});
    $otel = o.n;
    $day = strftime("%d.%m.%Y", strptime("2024-03-04 05:06:07", "%Y-%m-%d %H:%M:%S"));
    c = parse_csv("x," + $HOST, columns=["one", "two"]);
    $second = c.two;
    k = parse_kv("a=1, seg=" + $SEG);
    $kv = k.seg;
    l = keys(metrics_labels({"b": "1", "a": "2"}));
    $first_label = l[0];
    declare same = repr("x") == "x" and string(bytes($HOST)) == $HOST;
    declare got = get_timestamp("stamp");
    $line = format_syslog_5424("hello");
    """
    e = customers(spark, sf_dir, nv=F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("SEG"), F.col("c_mktsegment")))
    return run(text, e, "c_custkey", "u4", "u7", "$pair", "$data", "$otel", "$day", "$second", "$kv", "$first_label", "same", "got", "$line")


@query("""
SELECT c_custkey, sha256(c_name) AS h, md5(c_name) AS m, c_name || ' x' AS decoded, 36 AS n_uuid, 'USER' AS user_function, c_name || '!' AS listed, '2' AS counted
FROM customer
""")
def template_extras(spark, sf_dir):
    """Hashes, decoding, a function of the user's own, list functions in templates."""
    e = customers(spark, sf_dir)
    s = Scope(frozenset(e.columns), functions={"mine": lambda scope, x: F.upper(render(x, scope))})
    made = {"h": "$(hash $HOST)", "m": "$(md5 $HOST)", "decoded": "$(url-decode $(url-encode '$HOST x'))", "user_function": "$(mine user)", "listed": "$(list-head $(list-append '' '$HOST!'))", "counted": "$(list-count a,b)"}
    return e.select("c_custkey", *[render(t, s).alias(n) for n, t in made.items()], F.length(render("$(uuid)", s)).alias("n_uuid"))


# sinks and sources of other kinds


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(octet_length(encode(c_name)) + 1) - count(*) + count(*) AS BIGINT) AS bytes, CAST(200 AS INTEGER) AS status FROM customer")
def batched_requests(spark, sf_dir):
    """Bodies sent in batches of 100 lines each; the sender answers 503 once for each batch before it takes it."""

    def send(text: str, seen: set = set()) -> int:  # noqa: B006
        again = hash(text) in seen
        seen.add(hash(text))
        return 200 if again else 503

    r = writers.request(customers(spark, sf_dir), F.concat("host", F.lit("\n")), send, delimiter="", lines=100)
    return r.groupBy("status").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


@query("""
SELECT c_custkey, '{"index":{"_index":"logs","_id":"' || c_custkey || '"}}' || chr(10) || '{"n":"' || c_name || '"}' || chr(10) AS elastic, '{"text":"' || c_name || '"}' AS slack,
       '{"streams":[{"stream":{"seg":"' || c_mktsegment || '"},"values":[["1704067200000000000","' || c_name || '"]]}]}' AS loki, 'a.b ' || c_nationkey || ' 1704067200' AS graphite, '{"n":"' || c_name || '"}' AS json
FROM customer
""")
def service_formats(spark, sf_dir):
    e = customers(spark, sf_dir, "c_mktsegment", "c_nationkey")
    doc = writers.json_object(e, {"n": "$HOST"})
    return e.select("c_custkey", writers.elasticsearch_bulk(e, "logs", doc, id_=F.col("pid")).alias("elastic"), writers.slack(F.col("host")).alias("slack"), writers.loki_stream(F.struct(F.col("c_mktsegment").alias("seg")), F.col("host"), F.col("stamp")).alias("loki"), writers.graphite(F.lit("a.b"), F.col("c_nationkey"), F.col("stamp")).alias("graphite"), doc.alias("json"))


@query("SELECT c_custkey, c_name AS host, lower(c_mktsegment) AS program, 'm' || c_custkey AS message, CAST(8 * 4 + 3 AS INTEGER) AS pri FROM customer")
def journal_source(spark, sf_dir):
    """Journal entries in JSON lines, written and read."""
    path = shared_dir(spark)
    c = table(spark, sf_dir, "customer")
    row = F.struct(F.col("c_name").alias("_HOSTNAME"), F.lower("c_mktsegment").alias("SYSLOG_IDENTIFIER"), F.col("c_custkey").cast("string").alias("_PID"), F.concat(F.lit("m"), "c_custkey").alias("MESSAGE"), F.lit("4").alias("SYSLOG_FACILITY"), F.lit("3").alias("PRIORITY"), F.lit("1704067200000000").alias("__REALTIME_TIMESTAMP"))
    c.select(F.to_json(row).alias("value")).write.text(path)
    return readers.journal(spark, path).select(F.col("pid").cast("bigint").alias("c_custkey"), "host", "program", "message", "pri")


@query("SELECT 'row ' || range AS message FROM range(0, 25)")
def fetcher_source(spark, sf_dir):
    """A fetcher class of the user's own."""

    class Counting:
        def __init__(self, most: int) -> None:
            self.at, self.most = 0, most

        def open(self) -> None:
            self.at = 0

        def fetch(self) -> str | None:
            self.at += 1
            return f"row {self.at - 1}" if self.at <= self.most else None

        def close(self) -> None:
            pass

    return readers.fetcher(spark, Counting, most=25).select("message")


@query("SELECT CAST(400 AS BIGINT) AS n, true AS known")
def random_choices(spark, sf_dir):
    return readers.random_choice(spark, 400, ["a", "b", "c"], 1).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("message").isin("a", "b", "c")).alias("known"))


__all__ = ["QUERIES", "SQL"]

"""Operators over small events."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import typed
from millrace.operators import branch, correlate, enrich, filters, metrics, parsers, patterndb, patternize, rewrites
from millrace.operators.model import to_events
from millrace.plans.block import Block, dict_to_pairs, set_fields, unset_empties
from millrace.plans.logpath import Config, LogPath
from millrace.sources import readers, writers

L = F.lit


def at(s, us=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s, microseconds=us)


def rows(spark, data, schema="k string, program string, t timestamp, text string"):
    d = spark.createDataFrame(data, schema)
    return to_events(d, ("k",), stamp=F.col("t"), host=F.col("k"), program=F.col("program"), message=F.col("text"), pid=L("1"), source=L("s"))


def texts(spark, *lines):
    return to_events(spark.createDataFrame([(x,) for x in lines], "m string"), message=F.col("m"), stamp=F.timestamp_seconds(L(0)))


def nv(df):
    return [r.nv for r in df.select("nv").collect()]


def test_session_boundary(spark):
    d = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("a", at(21)), ("a", at(21, 500))], "k string, t timestamp")
    g = correlate.session_groups(d, ["k"], 10, {"n": F.count(L(1))}, ts="t").orderBy("session_start").collect()
    assert [r.n for r in g] == [2, 2]  # a gap of exactly the timeout stays


def test_grouping_inherit_and_inject(spark):
    d = rows(spark, [("a", "first", at(0), "1"), ("a", "second", at(1), "2"), ("a", "third", at(2), "3")])
    d = d.drop("k").withColumn("nv", F.create_map(F.concat(L("f"), "message"), F.col("program"), L("x"), F.col("message")))
    g = correlate.grouping_by(d, ["source"], 60, {"sum": "$(sum $MSG)", "names": "$(list-slice :-1 $(context-values $PROGRAM))", "again": "<$names>", "last": "${x}@1", "n": "$(context-length)"}, scope="host", inherit="context")
    r = g.first()
    assert r.nv["names"] == "first,second,third" and r.nv["n"] == "4" and r.nv["last"] == "3"
    assert r.nv["f1"] == "first" and r.nv["x"] == "3" and r.host == "a" and r.nv["sum"] == "9"  # the synthetic row inherits the last message
    assert correlate.grouping_by(d, ["source"], 60, {"n": "$(context-length)"}, inject="pass-through").count() == 4


def test_grouping_by_aggregates(spark):
    d = spark.createDataFrame([("a", "p", "5", "first", at(0)), ("a", "q", "x", "second", at(10)), ("a", "p", None, "third, last", at(10)), ("a", "p", "-7", "late", at(100))], "host string, program string, pid string, message string, stamp timestamp")
    d = to_events(d, (), host=F.col("host"), program=F.col("program"), pid=F.col("pid"), message=F.col("message"), stamp=F.col("stamp"), source=F.lit("s"), nv=F.create_map(F.lit("x"), F.col("pid")))
    values = {"total": "$(sum $PID)", "mean": "$(average $PID)", "low": "$(min $PID)", "top": "$(max $PID)", "n": "$(context-length)", "all": "$(context-values $MSG)", "found": '$(context-lookup ("$PROGRAM" eq "p") $MSG)', "own": '$(grep ("$HOST" eq "a") $HOST $PID)', "again": "<$total> $(+ $(context-length) 1)"}
    for inherit in ("none", "last-message"):
        g = correlate.grouping_by(d, ["source"], 60, values, scope="host", inherit=inherit)
        whole = correlate.grouping_by(d, ["source"], 60, values, scope="host", inherit=inherit, having=lambda s: F.size(s.rows) > 0)
        both = lambda x: sorted((r.stamp, r.host, r.program, r.message, sorted(r.nv.items())) for r in x.collect())
        assert both(g) == both(whole)
        plan = g._jdf.queryExecution().optimizedPlan().toString()
        assert "__rows" not in plan and "sum(" in plan  # no row of a group is kept whole
    assert correlate.folds("${x}@1") is None and correlate.folds("$(format-json)") is None


def test_merged_makes_the_second_once(spark):
    from millrace.functions.typed import merged_once, with_member

    d = spark.range(1).select(F.map_from_arrays(F.sequence(F.lit(0), F.lit(9)).cast("array<string>"), F.sequence(F.lit(0), F.lit(9)).cast("array<string>")).alias("a"))
    for made in (merged_once(F.col("a"), F.create_map(F.lit("3"), F.upper(F.lit("x")))), with_member(F.col("a"), F.lit("3"), F.upper(F.lit("x")))):
        m = d.select(F.map_entries(made).alias("m"))
        assert len(m.first().m) == 10 and tuple(m.first().m[-1]) == ("3", "X")
        assert m._jdf.queryExecution().analyzed().toString().count("upper(x)") == 1


def test_csv_record_is_cut_once(spark):
    from millrace.functions import text_formats as X

    d = spark.createDataFrame([("a, b,c,d",), ("x",), (None,)], "s string")
    got = d.select(X.parse_csv(F.col("s"), ["p", "q", "r"]).alias("m"), X.parse_csv(F.col("s"), ["p", "q", "r"], greedy=True, strip=True).alias("g"))
    assert [r.m for r in got.collect()] == [{"p": "a", "q": "b", "r": "c"}, {"p": "x"}, {}] and got.first().g == {"p": "a", "q": "b", "r": "c,d"}
    plan = d.select(X.parse_csv(F.col("s"), ["p", "q", "r"]).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1


def test_lookup_asks_once_a_value(spark):
    from millrace.operators import enrich

    d = spark.createDataFrame([(i, ("0", "987654321", None, "", "x")[i % 5]) for i in range(50)], "i int, v string").coalesce(1)
    got = {r.v: r.o for r in d.select("v", enrich.lookup("passwd", F.col("v")).alias("o")).collect()}
    assert got == {"0": "root", "987654321": None, None: None, "": None, "x": None}

    asked = []
    out = list(enrich.remembered(lambda v: asked.append(v) or v + "!", iter([pd.Series(["a", "b", None, "a"]), pd.Series(["b", "c"]), pd.Series([], dtype="object")])))
    assert asked == ["a", "b", "c"] and [list(x) for x in out] == [["a!", "b!", None, "a!"], ["b!", "c!"], []]


def test_few_splits_are_spread(spark, tmp_path):
    from millrace.plans.queries import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    d = spread(spark.read.parquet(str(tmp_path / "t")))
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and d.count() == 100


def test_smart_lines_pass_as_columns(spark, monkeypatch):
    lines = ["start", "Traceback (most recent call last):", '  File "a.py", line 1, in f', None, "    g()", "ValueError: bad", "java.lang.Error: gone", "\tat a.B.c(B.java:1)", "end", ""]
    rnd = random.Random(5)
    rows = [(k, i, rnd.choice(lines)) for k in ("a", "b", None, "c") for i in range(60)]
    d = spark.createDataFrame(rows, "k string, i int, line string")
    want = {}
    for k in ("a", "b", None, "c"):
        own = [t or "" for k_, _, t in rows if k_ == k]
        want |= {(k, i): begins for i, begins in enumerate(correlate.smart_records(own))}
    monkeypatch.setattr(correlate, "ordered_fold", None)  # no row becomes a dict
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.k, r.i): r["__smart"] for r in correlate.smart_begins(d, ["k"], ["i"], "line").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_xml_batches_are_bounded_by_bytes(spark):
    @F.pandas_udf("long")
    def rows(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    at = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(at)
    d = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("<a>"), F.repeat(F.lit("x"), 10_000), F.lit("</a>")).alias("message"), F.create_map().cast("map<string,string>").alias("nv"))
    p = parsers.xml_parser(d, ".x.")
    try:
        assert p.where(F.length(F.col("nv")[".x.a"]) == 10_000).count() == 3000
        assert d.select(rows("message").alias("n")).agg(F.max("n")).first()[0] * 10_000 < 10e6  # 30 MB would pass as one batch
        spark.conf.set(at, str(1 << 20))  # what the session asks for stays
        parsers.xml_parser(d, ".x.")
        assert spark.conf.get(at).startswith(str(1 << 20))
    finally:
        spark.conf.unset(at)


def test_triggered_groups(spark):
    d = spark.createDataFrame([("a", i, at(i)) for i in range(7)] + [("a", 7, at(100))], "k string, i long, t timestamp")
    made = lambda g: {"k": g[0]["k"], "ids": [r["i"] for r in g]}
    got = correlate.triggered_groups(d, ["k"], 10, made, "k string, ids array<long>", lambda g: len(g) == 3, ts="t").collect()
    assert sorted(r.ids for r in got) == [[0, 1, 2], [3, 4, 5], [6], [7]]
    got = correlate.triggered_groups(d, ["k"], 10, made, "k string, ids array<long>", lambda g: len(g) == 3, having=lambda g: len(g) > 1, ts="t").collect()
    assert len(got) == 2


def test_rate_limit(spark):
    d = spark.createDataFrame([("a", i, at(0, i)) for i in range(5)] + [("a", 9, at(1, 10)), ("b", 1, at(0))], "k string, i long, t timestamp")
    got = correlate.rate_limit(d, ["k"], 2, ts="t", tie=("i",)).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 0), ("a", 1), ("a", 9), ("b", 1)]


def test_iterate(spark):
    d = spark.createDataFrame([("a", i) for i in range(3)], "k string, i long")
    got = correlate.iterate(d, ["k"], ["i"], lambda v: str(int(v) + 2), "0").orderBy("i").collect()
    assert [r.iterated for r in got] == ["0", "2", "4"]


@pytest.mark.parametrize(
    ("mode", "lines", "want", "options"),
    [
        ("indented", ["a", " b", "\tc", "d"], ["a\n b\n\tc", "d"], {}),
        ("regexp", ["# 1", "x", "# 2"], ["# 1\nx", "# 2"], {"prefix": "^#"}),
        ("prefix-suffix", ["BEGIN", "x", "END", "y"], ["BEGIN\nx\nEND", "y"], {"prefix": "^BEGIN", "suffix": "END$"}),
        ("smart", ["java.lang.NullPointerException", "  at a.b(C.java:1)", "Caused by: x", "  at d", "next"], ["java.lang.NullPointerException\n  at a.b(C.java:1)\nCaused by: x\n  at d", "next"], {}),
    ],
)
def test_group_lines(spark, mode, lines, want, options):
    d = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, i long, line string")
    got = correlate.group_lines(d, ["k"], ["i"], mode, **options).orderBy("i").collect()
    assert [r.message for r in got] == want


def test_filters(spark):
    d = to_events(spark.createDataFrame([("10.1.2.3", 34), (None, 13)], "ip string, p int"), ("ip",), pri=F.col("p"), tags=F.array(L("x"))).withColumnRenamed("ip", "peer_ip")
    keep = lambda c: [r.pri for r in d.where(c).select("pri").collect()]
    assert keep(filters.netmask("10.0.0.0/8")) == [34] and keep(filters.netmask("127.0.0.0/8")) == [13]
    assert keep(filters.severity("crit")) == [34] and keep(filters.facility("user")) == [13] and keep(filters.tags("x", "y")) == [34, 13]
    assert keep(~filters.program("p")) == [34, 13]  # null is false, so its negation holds
    assert keep(filters.netmask6("::1/64")) == [13]


def test_in_list_ignores_null(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    side = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert [r.v for r in filters.in_list(d, "v", side).collect()] == ["a"]
    assert {r.v for r in filters.in_list(d, "v", side, negate=True).collect()} == {"b", None}


def test_rewrites(spark):
    d = texts(spark, "card 4111111111111111 end").withColumn("nv", F.create_map(L("a.b"), L("1"), L("c"), L("2")))
    assert d.select(rewrites.credit_card_mask(F.col("message"))).first()[0] == "card 411111******1111 end"
    assert len(d.select(rewrites.credit_card_hash(F.col("message"))).first()[0]) == len("card  end") + 16
    assert nv(rewrites.groupset(d, "<$_>", ("a.*",))) == [{"a.b": "<1>", "c": "2"}]
    assert nv(rewrites.groupunset(d, ("a.*",))) == [{"c": "2"}]
    assert nv(rewrites.rename(d, "c", "d")) == [{"a.b": "1", "d": "2"}]
    assert nv(rewrites.rename(d, "none", "d")) == [{"a.b": "1", "c": "2"}]
    assert nv(rewrites.set_(d, "$c!", "e", condition=L(False))) == [{"a.b": "1", "c": "2"}]
    assert nv(rewrites.map_value_pairs(d, keys=("a.*",), rekey=(rewrites.shift_levels(1), rewrites.add_prefix("p.")))) == [{"a.b": "1", "c": "2", "p.b": "1"}]
    assert rewrites.clear_tag(rewrites.set_tag(rewrites.set_tag(d, "x"), "y"), "x").first().tags == ["y"]
    assert rewrites.set_facility(rewrites.set_severity(d, L("crit")), L("mail")).first().pri == 18
    assert nv(rewrites.unset_matches(rewrites.set_matches(d, F.array(L("x"), L("y"))))) == [{"a.b": "1", "c": "2"}]


def test_time_zones(spark):
    d = texts(spark, "x")
    z = rewrites.set_time_zone(d, "Europe/Budapest").first()
    assert z.stamp == dt.datetime(1970, 1, 1) and z.tz_offset == 3600
    z = rewrites.fix_time_zone(d, "Europe/Budapest").first()
    assert z.stamp == dt.datetime(1969, 12, 31, 23) and z.tz_offset == 3600
    moved = d.withColumn("recvd", F.timestamp_seconds(L(7200 + 40)))
    assert rewrites.guess_time_zone(moved).first().stamp == dt.datetime(1970, 1, 1, 2)


def test_parsers(spark):
    assert nv(parsers.kv_parser(texts(spark, "foo=bar"), prefix=".p."))[0] == {".p.foo": "bar"}
    assert nv(parsers.kv_parser(texts(spark, "x a=1 y"), pair_separator=" ", stray_words_into="rest"))[0]["rest"] == "x y"
    audit = nv(parsers.linux_audit_parser(texts(spark, 'type=EXECVE msg=audit(1.2:3): argc=2 a0="modprobe" proctitle=2F62696E2F6C73')))[0]
    assert audit[".auditd.argc"] == "2" and audit[".auditd.a0"] == "modprobe" and audit[".auditd.proctitle"] == "/bin/ls"
    assert nv(parsers.json_parser(texts(spark, '@cee: {"a": {"b": 1}}', "no"), marker="@cee:"))[0] == {"a.b": "1"}
    assert nv(parsers.csv_parser(texts(spark, "~foo~,^bar^"), ["foo", "bar"], quote_pairs=("~~", "^^"))) == [{"foo": "foo", "bar": "bar"}]
    assert parsers.csv_parser(texts(spark, "a,b", "a"), ["x", "y"], drop_invalid=True).count() == 1
    apache = nv(parsers.preset(texts(spark, '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326 "ref" "agent"'), "apache-accesslog"))[0]
    assert apache[".apache.verb"] == "GET" and apache[".apache.response"] == "200" and apache[".apache.agent"] == "agent"
    cisco = nv(parsers.preset(texts(spark, "29: foo: *Apr 29 13:58:40.411: %SYS-5-CONFIG_I: Configured from console"), "cisco"))[0]
    assert cisco[".cisco.facility"] == "SYS" and cisco[".cisco.mnemonic"] == "CONFIG_I"
    d = parsers.date_parser(texts(spark, "2020-05-06 01:02:03", "bad"), "%Y-%m-%d %H:%M:%S")
    assert [r.stamp for r in d.collect()] == [dt.datetime(2020, 5, 6, 1, 2, 3)]
    s = parsers.syslog_parser(texts(spark, "<34>1 2020-01-01T00:00:00Z h p 1 m [a k=\"v\"] hi")).first()
    assert (s.pri, s.host, s.program, s.pid, s.msgid, s.message, s.sdata) == (34, "h", "p", "1", "m", "hi", {"a": {"k": "v"}})
    assert nv(parsers.sdata_parser(texts(spark, '[a k="v"]')))[0] == {".SDATA.a.k": "v"}
    assert parsers.tags_parser(texts(spark, "a,b")).first().tags == ["a", "b"]
    k = parsers.kmsg_parser(texts(spark, "6,1234,99,-;usb 1-1: new\n SUBSYSTEM=usb")).first()
    assert k.program == "kernel" and k.message == "usb 1-1: new" and k.nv[".linux.SUBSYSTEM"] == "usb"
    app = parsers.app_parser(texts(spark, "(N) 2020 - started"), [("sudo", L(True), "sudo"), ("qbt", L(True), "qbittorrent")])
    assert nv(app)[0][".app.name"] == "qbt"
    snmp = nv(parsers.snmptrapd_parser(texts(spark, '2017-05-10 12:46:14 localhost [UDP: [127.0.0.1]:1->[127.0.0.1]:2]: x = STRING: "a b"')))[0]
    assert snmp[".snmp.hostname"] == "localhost" and snmp[".snmp.x"] == "a b"
    ev = "<Event xmlns='u'><System><EventID>7</EventID></System><EventData><Data Name='A'>b</Data></EventData></Event>"
    assert nv(parsers.windows_eventlog_xml_parser(texts(spark, ev)))[0] == {".eventlog.System.EventID": "7", ".eventlog.EventData.A": "b"}
    assert parsers.python_parser(texts(spark, "a", "b"), lambda r: r["message"] == "b").count() == 1


def test_enrichment(spark):
    d = spark.createDataFrame([("A", 1), ("b", 2)], "h string, i int")
    db = spark.createDataFrame([("a", "n1", "v1", 0), ("a", "n2", "v2", 1), ("a", "n1", "v3", 2), ("*", "n1", "dflt", 3)], "selector string, name string, value string, ord int")
    got = enrich.add_contextual_data(d, F.col("h"), db, "*", prefix="p.", ignore_case=True).orderBy("i").collect()
    assert [r.nv for r in got] == [{"p.n1": "v3", "p.n2": "v2"}, {"p.n1": "dflt"}] and got[0].h == "A"
    ranges = spark.createDataFrame([(0, 2**32 - 1, "all"), (10 * 2**24, 10 * 2**24 + 255, "ten")], "start long, end long, name string")
    ips = spark.createDataFrame([("10.0.0.7",), ("11.0.0.1",), ("x",)], "ip string")
    assert {r.ip: r.name for r in enrich.ip_range_join(ips, F.col("ip"), ranges, ["name"]).collect()} == {"10.0.0.7": "ten", "11.0.0.1": "all", "x": None}


def test_branches(spark):
    d = spark.range(4)
    block = lambda x: (x.withColumn("id", F.col("id") * 10), F.col("id") < 20)
    assert sorted(r.id for r in branch.unconditional(d, block).collect()) == [0, 2, 3, 10]
    c = Config({"a": d, "b": spark.range(1)}, {"even": lambda x: x.where("id % 2 = 0")}, {}, [])
    assert c.table(LogPath(["a", "b"], ["even"])).count() == 3
    kept = []
    c.destinations["out"] = lambda x: kept.append(x.count())
    c.paths = [LogPath(["a"], ["even"], ["out"])]
    c.run()
    assert kept == [2]


def test_block(spark):
    d = spark.createDataFrame([(1, "x"), (0, "y"), (5, None)], "n long, s string")
    b = Block(d)
    b.set("q", typed.wrap(10) / b["n"])
    assert {(r.n, r.q) for r in b.apply().collect()} == {(1, 10), (5, 2)}
    b = Block(d)
    b.set_if_valid("q", typed.wrap(10) / b["n"])
    assert {(r.n, r.q) for r in b.apply().collect()} == {(1, 10), (0, None), (5, 2)}
    b = Block(d)
    b.when(typed.compare(b["n"], "==", 1), lambda x: x.set("r", "one").done(), lambda x: x.set("r", "other")).require(typed.compare(b["n"], ">", 1))
    assert {(r.n, r.r) for r in b.apply().collect()} == {(1, "one"), (5, "other")}
    b = Block(d)
    b.set("t", b["s"] + "!")
    e = b.apply(errors_into="errors").orderBy("n").collect()
    assert [r.errors for r in e] == [[], [], ["set t"]]


def test_maps(spark):
    m = F.create_map(L("a"), L(""), L("b"), L("x"))
    r = spark.range(1).select(unset_empties(m).alias("u"), unset_empties(m, replacement="-").alias("v"), set_fields(m, {"c": [L(None), L("1")]}, {"b": [L("no")], "d": [L("d")]}, {"a": [L("z")], "q": [L("q")]}).alias("s"), dict_to_pairs(m, "k", "v").alias("p")).first()
    assert r.u == {"b": "x"} and r.v == {"a": "-", "b": "x"} and r.s == {"a": "z", "b": "x", "c": "1", "d": "d"} and r.p[1].k == "b"


XML = """<patterndb version='4'><ruleset name='t' id='1'><pattern>prog</pattern><rules>
<rule id='r1' class='short' context-id='$PID' context-scope='program' context-timeout='60'><patterns><pattern>pattern @ESTRING:foo: @</pattern></patterns><tags><tag>t1</tag></tags><values><value name='v'>w</value></values>
<actions><action trigger='match' condition='"$(context-length)" &gt;= "2"'><message><values><value name='M'>$foo-${foo}@1</value></values></message></action><action trigger='timeout'><message><values><value name='T'>$(context-length)</value></values></message></action></actions>
<examples><example><test_message program='prog'>pattern abc </test_message><test_values><test_value name='foo'>abc</test_value></test_values></example></examples></rule>
<rule id='r2' class='long'><patterns><pattern>pattern @ESTRING:foo: @tail @NUMBER:n@</pattern></patterns></rule></rules></ruleset></patterndb>"""


def test_patterndb(spark):
    rules = patterndb.load_xml(XML)
    assert patterndb.self_test(rules) == []
    d = rows(spark, [("h", "prog", at(0), "pattern a "), ("h", "prog", at(1), "pattern b tail 5"), ("h", "prog", at(2), "pattern c "), ("h", "prog", at(100), "pattern d "), ("h", "other", at(3), "pattern a ")]).drop("k")
    p = patterndb.db_parser(d, rules)
    got = {r.message: (r.nv.get(".classifier.rule_id"), r.nv.get("foo"), r.nv.get("n")) for r in p.where("program = 'prog'").collect()}
    assert got["pattern b tail 5"] == ("r2", "b", "5") and got["pattern a "] == ("r1", "a", None)
    assert p.where("program = 'other'").first().nv[".classifier.class"] == "unknown"
    made = patterndb.actions(p, rules).orderBy("stamp", "trigger").collect()
    assert [(r.trigger, r["values"]) for r in made] == [("match", {"M": "c-a"}), ("timeout", {"T": "2"}), ("timeout", {"T": "1"})]


def test_patternize(spark):
    d = spark.createDataFrame([(f"login of user{i} ok",) for i in range(10)] + [("odd one out",)], "line string")
    got = {r.pattern.replace("\x1a", "*"): r.n for r in patternize.patternize(d, "line", 50, " ").collect()}
    assert got == {"login of * ok": 10}
    rows = [(f"a{k} b{k}",) for k in range(10) for _ in range(2**k)]  # at half of what is left, one cluster a round
    got = patternize.patternize(spark.createDataFrame(rows, "line string"), "line", 50, " ", iterate_outliers=True).collect()
    assert {r.pattern: r.n for r in got} == {f"a{k} b{k}": 2**k for k in range(10)}
    assert patternize.as_rule_pattern("login of \x1a ok") == "login of @ESTRING:.dict.string0: @ok"


def test_metrics(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "h string, n int")
    c = metrics.counter(d, "events", {"host": F.col("h")}, F.col("n"))
    assert {r.counter: r.value for r in metrics.query(c, "events.*").collect()} == {"events.host=a": 3, "events.host=b": 3}
    assert metrics.query(c, "events*", total=True).first().value == 6
    assert [spark.range(1).select(metrics.log2_bucket(L(x), 0, 3)).first()[0] for x in (0, 1, 7, 8, 100)] == [0, 0, 2, 3, 3]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("one\ntwo\n")
    (tmp_path / "in/b.txt").write_text("three\n")
    d = readers.wildcard_file(spark, str(tmp_path / "in"), "*.log")
    assert sorted(r.message for r in d.collect()) == ["one", "two"]
    writers.file(d.withColumn("host", L("h")), str(tmp_path / "out"), "$HOST", "$MSG")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["one", "two"]
    writers.spool(d, str(tmp_path / "spool"))
    assert readers.replay(spark, str(tmp_path / "spool")).count() == 2
    assert readers.generator(spark, 3, template="x").count() == 3 and readers.random_choice(spark, 5, ["a", "b"]).count() == 5
    assert [r.message for r in readers.program(spark, "printf 'x\\ny\\n'").collect()] == ["x", "y"]
    r = writers.request(d, F.col("message"), lambda text: 200, lines=1).collect()
    assert sum(x.rows for x in r) == 2 and {x.status for x in r} == {200}
    assert list(writers.batches(iter(["aa", "bb", "cc"]), 2, 100)) == [["aa", "bb"], ["cc"]]
    assert writers.table(d, {"m": ("$MSG", "string"), "n": ("7", "int")}).first().n == 7
    bulk = '{"items":[{"index":{"status":201}},{"index":{"status":429}}]}'
    assert spark.range(1).select(writers.failed_rows(L(bulk))).first()[0] == [1]


PYTHON = ["Traceback (most recent call last):", '  File "a.py", line 3, in f', "    g(x)", "    ^^^^", '  File "b.py", line 9, in g', "ValueError: no: really"]
CHAINED = [*PYTHON, "", "During handling of the above exception, another exception occurred:", "", *PYTHON]
JAVA = ["Exception in thread main java.lang.RuntimeException: x", "\tat a.B.c(B.java:1)", "Caused by: java.io.IOException: y", "\tat a.B.d(B.java:2)", "\t... 3 more"]
NODE = ["TypeError: x is undefined", "    at f (a.js:1:2)", "    at g (a.js:3:4)"]
PHP = ["PHP Fatal error:  Uncaught Exception: x in /a.php:3", "Stack trace:", "#0 {main}", "  thrown in /a.php on line 3"]
GO = ["panic: oh no", "", "goroutine 1 [running]:", "main.f(0x1)", "\t/a.go:3 +0x1", "main.main()", "\t/a.go:9 +0x2"]
RUBY = ["NoMethodError (undefined method x):", "  app/a.rb:3:in `f'", "  app/b.rb:4:in `g'"]
DART = ["Unhandled exception:", "Instance of 'E'", "#0      main (a.dart:1:2)", "#1      f (a.dart:3:4)"]


@pytest.mark.parametrize("trace", [PYTHON, CHAINED, JAVA, NODE, PHP, GO, RUBY, DART])
def test_smart_traces(trace):
    """A trace is one record between plain lines, after itself, and after another language's."""
    lines = ["plain", *trace, "plain", "other", *trace, *trace, *NODE, "end"]
    begins = list(correlate.smart_records(iter(lines)))
    sizes = [b - a for a, b in zip(*(lambda x: (x, [*x[1:], len(lines)]))([i for i, new in enumerate(begins) if new]))]
    assert sizes == [1, len(trace), 1, 1, len(trace), len(trace), len(NODE), 1]


def test_conditions():
    from millrace.functions.conditions import holds, parse

    row = {"pri": 11, "tags": ["a"], "source": "s", "peer_ip": "10.0.0.7"}
    text = lambda t: {"${MESSAGE}": "hello world", "${PROGRAM}": "app", "$N": "7", "$E": ""}.get(t, t)
    yes = ['"$N" > 5', "$N == 7.0", 'not ("$N" < 5)', '"a and b" == "a and b"', 'match("wor") and "$N" eq "7"', 'match("^x" value("PROGRAM")) or program("app" type("string"))', "level(err..emerg)", "facility(user)", 'tags("a" "z")', 'source("s")', 'netmask("10.0.0.0/8")', '("$N" > 5) and ("$N" < 9)', "$N", 'match("WORLD" flags("ignore-case"))']
    no = ['match("zzz")', '"$N" > 5 and "$E" ne ""', "$E", "level(debug)", 'tags("q")', "not true()", 'netmask("192.168.0.0/16")', '"$N" lt "6"']
    assert all(holds(parse(c), text, row) for c in yes) and not any(holds(parse(c), text, row) for c in no)
    for bad in ('"a" ==', "nothing(1)", '("a" == "b"', '"a" "b"', "", 'x == "open'):
        with pytest.raises(ValueError, match="condition|filter"):
            parse(bad)


def test_overlapping_ranges_take_the_innermost(spark):
    r = random.Random(4)
    ranges = [(s, s + r.choice([0, 3, 400, 70_000, 2_000_000]), f"r{i}") for i in range(60) for s in [(10 << 24) + r.randrange(300_000)]]
    ips = sorted({(10 << 24) + r.randrange(310_000) for _ in range(500)} | {x for a, b, _ in ranges[:20] for x in (a, b, b + 1)})
    dotted = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    got = enrich.ip_range_join(spark.createDataFrame([(dotted(i), i) for i in ips], "ip string, n long"), F.col("ip"), spark.createDataFrame(ranges, "start long, end long, name string"), ["name"]).collect()
    assert len(got) == len(ips)
    for g in got:
        over = [(b - a, a, n) for a, b, n in ranges if a <= g.n <= b]
        assert g.name == (min(over)[2] if over else None)


def test_pattern_lookup_equals_trying_each_rule():
    import re

    from millrace.operators import patterndb

    rules = [patterndb.Rule(f"r{i}", [p]) for i, p in enumerate(["a@NUMBER:n@", "a1@ANYSTRING:x@", "@ESTRING:k:=@@ANYSTRING:v@", "abc", "abc @SET:s:xy@", "a.b[1] @IPv4:ip@", "@NUMBER:n@ apples", "b@@c @NUMBER:n@"])]
    found = patterndb.Lookup(rules)
    for text in ["a17", "a1x", "k=v w", "abc", "abc xyx", "abc q", "a.b[1] 10.0.0.1", "12 apples", "b@c 4", "", "zzz"]:
        want = next((r.rule_id for r, rx, _ in patterndb.ordered(rules) if re.search(rx, text)), None)
        got = found.first(text, None)
        assert (got and got[0][".classifier.rule_id"]) == want

"""Programs in text form."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.model import to_events
from millrace.plans.program import Program, tokens

L = F.lit


@pytest.fixture()
def events(spark):
    d = spark.createDataFrame([("h1", "app", "5", '{"a":{"b":1},"c":"x"}'), ("h2", "app", "50", '{"a":{"b":2}}'), ("h3", "other", "x", "bad")], "h string, p string, v string, m string")
    return to_events(d, stamp=F.timestamp_seconds(L(0)), host=F.col("h"), program=F.col("p"), message=F.col("m"), nv=F.create_map(L("value"), F.col("v")))


TEXT = """
declare total = int($value) + 1;     # fails for text: the row goes
if ($PROGRAM == "app" and total > 10) { $class = "big"; } elif (total > 100) { $class = "huge"; } else { $class = "small"; };
js = json($MSG);
$ab = js.a.b ?? "none";
$part = $HOST[..1] + "-" + "${HOST}!";
$missing ?? "none" == "none";
x = {"k": "v", "n": total};
x.z = "q"; unset(x.k);
$x = format_json(x);
switch ($HOST) { case "h1": $s = "one"; break; case "h2": $s = "two"; default: $d = "dflt"; break; };
$HOST in ["h1", "h2"];
"""


def test_program(events):
    got = {r.host: (r.total, r.nv) for r in Program(TEXT).apply(events).collect()}
    assert got == {
        "h1": (6, {"value": "5", "class": "small", "ab": "1", "part": "h-h1!", "x": '{"n":6,"z":"q"}', "s": "one"}),
        "h2": (51, {"value": "50", "class": "big", "ab": "2", "part": "h-h2!", "x": '{"n":51,"z":"q"}', "s": "two", "d": "dflt"}),
    }
    errors = {r.host: r.err for r in Program(TEXT).apply(events, errors_into="err").collect()}
    assert errors == {"h1": [], "h2": [], "h3": ["set total"]}


@pytest.mark.parametrize(
    ("text", "hosts"),
    [
        ('$HOST == "h1";', {"h1"}), ('not ($HOST == "h1");', {"h2", "h3"}), ("$value < 10;", {"h1"}), ('$value === 5;', set()), ('$HOST =~ "^h[12]$";', {"h1", "h2"}), ('if ($HOST == "h2") { done; }; $HOST == "h1";', {"h1", "h2"}),
        ('if ($HOST == "h2") { drop; };', {"h1", "h3"}), ("isset($nothing);", set()), ("isset($value);", {"h1", "h2", "h3"}), ('startswith($HOST, ["h1", "x"]);', {"h1"}), ("x = 10 / int($value); x >= 2;", {"h1"}), ('y =?? int($value); isset(y);', {"h1", "h2"}),
        ('"10.1.2.3" in subnet("10.0.0.0/8") and $HOST ne "h3";', {"h1", "h2"}), ('m = regexp_search($HOST, "(?<n>[0-9])"); m.n == "2";', {"h2"}), ("len($HOST) == 2 ? $value != 5 : false;", {"h2", "h3"}), ('k = parse_kv("a=1, b=2"); k.b == "2" and $HOST == "h1";', {"h1"}),
    ],
)
def test_statements(events, text, hosts):
    assert {r.host for r in Program(text).apply(events).select("host").collect()} == hosts


def test_syntax():
    with pytest.raises(SyntaxError):
        Program("if (1 { }")
    with pytest.raises(SyntaxError):
        Program('switch (1) { case "a": drop; case "a": done; }')
    assert tokens("a.b ?? ${x y}") == [("name", "a"), ("op", "."), ("name", "b"), ("op", "??"), ("field", "${x y}")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('$r = format_json(set_fields({"a": "1"}, overrides={"b": "2"}, defaults={"a": "9", "c": "3"}, replacements={"a": "7", "z": "0"}));', '{"c":"3","b":"2","a":"7"}'),
        ('$r = format_kv(parse_csv("x,y", columns=["p", "q"]));', "p=x, q=y"), ('$r = format_csv(["a", "b,c"]);', 'a,"b,c"'), ('$r = string(len("héé"));', "5"), ('$r = dict_to_pairs({"a": "b"}, "k", "v")[0];', '{"k":"a","v":"b"}'),
        ('$r = strftime("%Y-%m-%d", strptime("05/06/2020", "%d/%m/%Y"));', "2020-06-05"), ('$r = str_replace("aaa", "a", "b", 2);', "bba"), ('$r = regexp_subst("a1b2", "[0-9]", "#", global=true);', "a#b#"), ('$r = hex_encode(digest("x", alg="md5"));', "9dd4e461268c8034f5c8564e155c67a6"),
        ("$r = string(7 / 2) + string(-7 % 3);", "3-1"), ('$r = flatten({"a": {"b": "c"}})["a.b"];', "c"), ('$r = unset_empties({"a": "", "b": "x"}).b;', "x"), ('x = ["a"]; x[] = "b"; $r = format_json(x);', '["a","b"]'), ('$r = "lit" ?: "no";', "lit"),
    ],
)
def test_functions_in_programs(spark, text, want):
    ev = to_events(spark.range(1), stamp=F.timestamp_seconds(L(0)))
    assert Program(text).apply(ev).first().nv["r"] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('$x = format_json({"b": true, "n": 1, "s": "1", "z": null, "d": {"l": [1, "a"]}});', '{"b":true,"n":1,"s":"1","z":null,"d":{"l":[1,"a"]}}'), ('l = [1]; l[] = 2; $x = format_json(l);', "[1,2]"), ('l = [1, 2, 3]; l[-1] = "z"; $x = format_json(l);', '[1,2,"z"]'),
        ('d = json("{\\"z\\":1.5,\\"a\\":[true,{}]}"); d.n = d.z; $x = format_json(d);', '{"z":1.5,"a":[true,{}],"n":1.5}'), ('$x = format_json(json_array("[1,\\"1\\",null]"));', '[1,"1",null]'), ('$x = format_json((1, "b"));', '[1,"b"]'),
        ('$x = format_kv({"a": 1, "b": true});', "a=1, b=true"), ('$x = format_json(dict_to_pairs({"a": 1}, "k", "v"));', '[{"k":"a","v":1}]'), ('$x = format_json(unset_empties({"a": "", "b": [], "c": {}, "d": 0}));', '{"d":0}'), ('d = {"a": 5}; d.a == 5; $x = format_json({"t": d.a});', '{"t":5}'),
        ('set_pri(165); $x = "${PRI}";', "165"), ('load_vars({"v": "w"}, "v"); $x = v;', "w"),
    ],
)
def test_typed_members(events, text, want):
    assert {r.nv["x"] for r in Program(text).apply(events).select("nv").collect()} == {want}


def test_effects(events):
    d = Program('update_metric("n", labels={"h": $HOST}, increment=2); set_pri(5);').apply(events, metrics_into="m")
    assert all(r.pri == 5 and [(x["name"], x["labels"]["h"], x["value"]) for x in r.m] == [("n", r.host, 2)] for r in d.collect())
    with pytest.raises(ValueError, match="metrics_into"):
        Program('update_metric("n");').apply(events)
    kept = Program("set_pri(5000);").apply(events, errors_into="e").select("e").collect()
    assert all(r.e for r in kept)
    with pytest.raises(NameError):
        Program("no_such_function(1);").apply(events)

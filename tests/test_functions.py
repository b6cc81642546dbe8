"""Functions against expected values: one query per group, one row."""

from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import strings as S
from millrace.functions import text_formats as T
from millrace.functions import typed as t
from millrace.functions.templates import Scope, render
from millrace.operators.model import to_events

L = F.lit


def check(df, cases):
    """cases: name to (Column, expected). All in one projection."""
    row = df.select(*[c.alias(f"c{i}") for i, (_, c, _) in enumerate(cases)]).first()
    bad = [(n, row[i], want) for i, (n, _, want) in enumerate(cases) if row[i] != want]
    assert not bad, bad


def test_formats(spark):
    cases = []
    cases.append(('kv',T.parse_kv(L('foo=bar, a="b c", k=v w')),{'foo':'bar','a':'b c','k':'v w'}))
    cases.append(('kv2',T.parse_kv(L('a=1 b=2 c="x, y"')),{'a':'1','b':'2','c':'x, y'}))
    cases.append(('csv',T.parse_csv(L('foo,"b""a""r"'),['foo','bar']),{'foo':'foo','bar':'b"a"r'}))
    cases.append(('csv null',T.parse_csv(L('foo,NULL'),['foo','bar'],null='NULL'),{'foo':'foo'}))
    cases.append(('csv greedy',T.parse_csv(L('a,b,c,d'),['x','y'],greedy=True),{'x':'a','y':'b,c,d'}))
    cases.append(('scan',T.scan_csv(L('~foo~,^bar^'),quote_pairs=('~~','^^')),['foo','bar']))
    cases.append(('scan3',T.scan_csv(L('foo^^^bar'),delimiters='',strings=('^^^',)),['foo','bar']))
    cases.append(('cef',T.parse_cef(L(r'CEF:0|V|P|1.0|100|a\|b|5|src=1.2.3.4 msg=hello \= world cs1=x y')),{'version':'0','device_vendor':'V','device_product':'P','device_version':'1.0','device_event_class_id':'100','name':'a|b','agent_severity':'5','src':'1.2.3.4','msg':'hello = world','cs1':'x y'}))
    cases.append(('leef',T.parse_leef(L('LEEF:1.0|V|P|1|ev|src=1\tdst=2')),{'version':'1.0','vendor':'V','product_name':'P','product_version':'1','event_id':'ev','src':'1','dst':'2'}))
    cases.append(('leef2',T.parse_leef(L('LEEF:2.0|V|P|1|ev|^|src=1^dst=2')),{'version':'2.0','vendor':'V','product_name':'P','product_version':'1','event_id':'ev','src':'1','dst':'2'}))
    cases.append(('sdata',T.parse_sdata(L(r'[a@1 x="1" y="q\"z"][b k="v"]')),{'a@1':{'x':'1','y':'q"z'},'b':{'k':'v'}}))
    cases.append(('json',T.json_fields(L('{"a":{"b":1},"c":[1,2],"d":"x"}')),{'a.b':'1','c':'[1,2]','d':'x'}))
    cases.append(('njson',T.nested_json(F.create_map(L('a.b'),L('1'),L('c'),L('2'))),'{"a":{"b":"1"},"c":"2"}'))
    cases.append(('xml',T.parse_xml(L('<r a="1"><b>x</b><b>y</b></r>')),{'r._a':'1','r.b':'x,y'}))
    p = T.parse_syslog(L("<34>1 2003-10-11T22:14:15.003Z mymachine su - ID47 [ex@1 a=\"b\"] hello"))
    cases.append(('5424',F.struct(p['pri'],p['host'],p['program'],p['pid'],p['msgid'],p['message']).cast('string'),'{34, mymachine, su, null, ID47, hello}'))
    p = T.parse_syslog(L("<13>Oct 11 22:14:15 box app[12]: hi there"),year=L(2020))
    cases.append(('3164',F.struct(p['pri'],p['stamp'],p['host'],p['program'],p['pid'],p['message']).cast('string'),'{13, 2020-10-11 22:14:15, box, app, 12, hi there}'))
    cases.append(('strptime',D.strptime(L('11/Oct/2020:13:55:36 -0700'),'%d/%b/%Y:%H:%M:%S %z').cast('string'),'2020-10-11 20:55:36'))
    cases.append(('strptime2',D.strptime(L('2020-01-02T03:04:05.25'),'%Y-%m-%dT%H:%M:%S.%f').cast('string'),'2020-01-02 03:04:05.25'))
    cases.append(('strftime',D.strftime('%Y/%m/%d %T %z %e',F.timestamp_seconds(L(0))),'1970/01/01 00:00:00 +0000  1'))
    check(spark.range(1), cases)


def test_strings(spark):
    cases = []
    cases.append(('subst',S.regexp_subst(L('aXbXc'),'X(.)',r'[\1]'),'a[b]Xc'))
    cases.append(('substg',S.regexp_subst(L('aXbXc'),'X(.)',r'[\1]',global_=True),'a[b][c]'))
    cases.append(('search',S.regexp_search(L('foo123'),r'(?<w>[a-z]+)(\d+)'),{'w':'foo','2':'123'}))
    cases.append(('url',S.urlencode(L('a b~*')),'a%20b~%2A'))
    cases.append(('urld',S.urldecode(L('a%20b+')),'a b+'))
    cases.append(('glob',S.glob_match(L('a/b.txt'),'*.txt'),False))
    cases.append(('glob2',S.glob_match(L('b.txt'),'*.txt'),True))
    cases.append(('san',S.utf8_sanitize(F.unhex(L('61FF62'))),'a\\xffb'))
    cases.append(('repl',S.replace(L('aXbXc'),'X','-',1),'a-bXc'))
    cases.append(('lsearch',S.list_search(F.array(L('a'),L('b')),'b'),1))
    cases.append(('lslice',S.list_slice(F.array(*map(L,'abcd')),1,-1),['b','c']))
    cases.append(('tl',S.text_list(L('a,"b,c",d')),['a','b,c','d']))
    cases.append(('lt',S.list_text(F.array(L('a'),L('b,c'))),'a,"b,c"'))
    cases.append(('substr',S.substr(L('hello'),-3,2),'ll'))
    cases.append(('substr2',S.substr(L('hello'),1,-1),'ell'))
    cases.append(('pad',S.padding(L('7'),3,'0'),'007'))
    cases.append(('num',S.generic_number('/',L('7'),L('2')),'3'))
    cases.append(('num2',S.generic_number('+',L('7'),L('0.5')),'7.5'))
    cases.append(('num3',S.generic_number('/',L('7'),L('0')),'NaN'))
    cases.append(('dirname',S.dirname(L('/a/b/c')),'/a/b'))
    cases.append(('basename',S.basename(L('/a/b/c')),'c'))
    cases.append(('ip',S.in_subnet(L('10.1.2.3'),'10.0.0.0/8'),True))
    cases.append(('ip6',S.in_subnet(L('::1'),'::1/64'),True))
    check(spark.range(1), cases)


def test_typed(spark):
    I = t.wrap
    cases = []
    cases.append(('div',I(-7)/2,'-3'))
    cases.append(('div0',I(7)/0,'ERR'))
    cases.append(('ovf',I(2**63-1)+1,'ERR'))
    cases.append(('mod',I(-7)%2,'-1'))
    cases.append(('ddiv0',I(7.0)/0,'ERR'))
    cases.append(('neg',-I(-2**63),'ERR'))
    cases.append(('cmp1',t.compare('5','<','10'),'false'))
    cases.append(('cmp2',t.compare('5','<',10),'true'))
    cases.append(('cmp3',t.compare('abc','==',0),'false'))
    cases.append(('cmp4',t.compare('abc','!=',0),'true'))
    cases.append(('cmpn',t.compare(None,'==',None),'true'))
    cases.append(('cmps',t.compare('5','===',5),'false'))
    cases.append(('slice',t.byte_slice('héllo',0,2),'h�'))
    cases.append(('slice2',t.byte_slice('hello',-3,None),'llo'))
    cases.append(('slice3',t.byte_slice('hello',3,1),'ERR'))
    cases.append(('coal',t.coalesced(I(1)/0,5),'5'))
    check(spark.range(1), [(n, F.when(e.ok, e.value.cast("string")).otherwise("ERR"), w) for n, e, w in cases])


def test_templates(spark):
    ev = to_events(spark.range(1), stamp=F.timestamp_seconds(L(1600000000)), host=L("h"), program=L("p"), pid=L("1"), message=L("m"), pri=L(34), nv=F.create_map(L(".a.b"), L("x"), L("k"), L("5")))
    cases = []
    cases.append(('$HOST ${.a.b} ${no:-none} $SEVERITY $FACILITY $YEAR-$MONTH','h x none crit auth 2020-09'))
    cases.append(('$(+ $k 2)$(if ("$k" > "3") yes no)','7yes'))
    cases.append(('$(format-json --key k)','{"k":"5"}'))
    cases.append(('$(echo a $(uppercase b))','a B'))
    cases.append(('$(format-flat-json --scope nv-pairs x=$HOST)','{"k":"5","x":"h"}'))
    cases.append(('${MSGHDR}$MSG $ISODATE','p[1]: m 2020-09-13T12:26:40+00:00'))
    cases.append(('$(list-slice :-1 "a,b,c")','a,b'))
    cases.append(('$(map "$_!" "a,b")','a!,b!'))
    cases.append(('$(filter ("$_" eq "a") "a,b")','a'))
    cases.append(('$(sha1 --length 8 x)','11f6ad8e'))
    cases.append(('$(length héé)','5'))
    cases.append(('$(or "" $k)','5'))
    cases.append(('$(format-welf --key k)','k=5'))
    cases.append(('$(strip " a ")','a'))
    cases.append(('$(stardate --digits 1 $UNIXTIME)','2020.7'))
    s = Scope.of(ev)
    check(ev, [(x, render(x, s), w) for x, w in cases])

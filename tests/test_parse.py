"""Parse operators on hand-written lines."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from eventlake.functions import regexes
from eventlake.operators.identify import identify
from eventlake.operators.parse import extract, parse
from eventlake.operators.parse_ops import PackError, operator, operator_names
from eventlake.sources.packs import load_packs, parse_mapping


def run(spark, lines, steps, dictionaries=None):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    rows = extract(df, steps, dictionaries).orderBy("i").collect()
    return [(r.fields, r.parse_status) for r in rows]


def test_nineteen_operators():
    assert len([n for n in operator_names() if not n.startswith("x_")]) == 19


def test_syslog_shapes(spark):
    got = run(
        spark,
        [
            "<34>Oct 11 22:14:15 mymachine su: 'su root' failed",
            "<166>Sep 07 2026 14:02:11 fw : %X: hi",
            "short line",
            "<165>1 2003-10-11T22:14:15Z host app 12 ID47 - msg here",
            "<13>1 2003-10-11T22:14:15Z host",
            "<5x>a b c d e",
        ],
        [{"op": "syslog"}],
    )
    assert got[0][0] == {"pri": "34", "facility": "4", "severity": "2", "timestamp": "Oct 11 22:14:15", "hostname": "mymachine", "appname": "su", "message": "'su root' failed"}
    assert got[1][0]["timestamp"] == "Sep 07 2026 14:02:11" and got[1][0]["appname"] == "" and got[1][0]["message"] == "%X: hi"
    assert got[2][0] == {"message": "short line"}
    assert got[3][0]["msgid"] == "ID47" and got[3][0]["message"] == "msg here"
    assert got[4][0] == {"pri": "13", "facility": "1", "severity": "5", "timestamp": "2003-10-11T22:14:15Z", "hostname": "host"}
    assert "pri" not in got[5][0] and all(s == "ok" for _, s in got)


def test_syslog_year_is_followed_by_a_time(spark):
    got = run(spark, ["heartbeat node 1452 seq 9 load 1", "<13>Sep 07 2026 4:02:11.5 fw a: b"], [{"op": "syslog"}])
    assert got[0][0] == {"timestamp": "heartbeat node 1452", "hostname": "seq", "message": "9 load 1"}
    assert (got[1][0]["timestamp"], got[1][0]["hostname"], got[1][0]["appname"]) == ("Sep 07 2026 4:02:11.5", "fw", "a")


def test_dissect_forward_search_and_partial(spark):
    steps = [{"op": "dissect", "pattern": "user=%{u} from %{ip}:%{port} %{_}end"}]
    got = run(spark, ["junk user=bob from 1.2.3.4:80 xx end", "user=bob from 1.2.3.4", "nothing"], steps)
    assert got[0] == ({"u": "bob", "ip": "1.2.3.4", "port": "80"}, "ok")
    assert got[1] == ({"u": "bob", "ip": "1.2.3.4"}, "partial")
    assert got[2] == ({}, "failed")


def test_kv_quotes(spark):
    got = run(spark, ['a=1 b="x y" c="open d=2', " =v k=", 'q="a=b" z'], [{"op": "kv"}])
    assert got[0][0] == {"a": "1", "b": "x y", "c": "open d=2"}
    assert got[1][0] == {"k": ""}
    assert got[2][0] == {"q": "a=b"}


def test_csv_against_python(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", ",", '"', " ", "é"]
    records = [["".join(rng.choices(alphabet, k=rng.randint(0, 6))) for _ in range(4)] for _ in range(200)]
    lines = []
    for r in records:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    got = run(spark, lines, [{"op": "csv", "columns": ["c1", "c2", "c3"]}])
    for r, (f, status) in zip(records, got):
        assert [f["c1"], f["c2"], f["c3"], f["col_4"]] == r and status == "ok"
    bad = run(spark, ['a"b,c', '"open', ""], [{"op": "csv", "columns": ["x"]}])
    assert [s for _, s in bad] == ["failed"] * 3


def test_cef_leef(spark):
    line = r"CEF:0|V\|x|P|1|100|n|5|src=1.2.3.4 msg=two words"
    assert run(spark, [line], [{"op": "cef"}])[0][0]["device_vendor"] == "V|x"
    assert run(spark, [line], [{"op": "cef"}])[0][0]["msg"] == "two"
    assert run(spark, [line], [{"op": "cef", "spec_values": True}])[0][0]["msg"] == "two words"
    assert run(spark, ["LEEF:2.0|V|P|1|E|^|a=1^b=2", "LEEF:nopipe"], [{"op": "leef"}])[0][0]["b"] == "2"
    assert run(spark, ["LEEF:nopipe", "CEF:0|a"], [{"op": "leef"}])[0] == ({}, "failed")


def test_xml(spark):
    got = run(spark, ['<e id="7"><s p="1">x</s><s>y</s><t><u> z </u></t></e>', "<e>"], [{"op": "xml"}])
    assert got[0][0] == {"e_id": "7", "e.s_p": "1", "e.s": "y", "e.t.u": "z"}
    assert got[1][1] == "failed"


def test_separator_character_in_text(spark):
    got = run(spark, ["a=1\x01 b=2"], [{"op": "regex", "pattern": r"a=(?P<a>\S+) b=(?P<b>\d)"}])
    assert got[0][0] == {"a": "1\x01", "b": "2"}


def test_regex_rules():
    with pytest.raises(regexes.UnsafePattern):
        regexes.to_java("(a+)+")
    assert regexes.to_java(r"(?P<src_ip>\d+)$").pattern == r"(\d+)\z"
    assert regexes.to_java("[[:alpha:]]+").pattern == r"[\p{Alpha}]+"
    with pytest.raises(PackError):
        parse_mapping({"fields": {"src.nope": {"from": "x"}}}, "p")


def test_custom_operator(spark):
    @operator("x_upper")
    def _upper(fs, spec, _):
        fs.set(spec["as"], F.upper(fs.raw))

    assert run(spark, ["abc"], [{"op": "x_upper", "as": "big"}])[0][0] == {"big": "ABC"}


def test_status_always_valid_on_odd_bytes(spark):
    packs = load_packs()
    odd = ["", "\x00", "�", "<", "{", "CEF:", "<14>,TRAFFIC,", '{"sensor":', "x" * 20000, "<1>srcip= devname=", "%ASA-6-302013"]
    df = spark.createDataFrame([(x,) for x in odd], "raw string")
    rows = parse(identify(df, packs), packs).collect()
    assert len(rows) == len(odd) and {r.parse_status for r in rows} <= {"ok", "partial", "failed"}

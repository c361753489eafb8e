"""Secret ledger against plain regular expressions, and its incremental behaviour."""

import hashlib
import re

from eventlake.llm import secrets
from eventlake.llm.queries import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op10_secret_ledger"](spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        kinds = [w.split(":")[0] for w in want]
        assert [r.n_assign, r.n_access, r.n_hex] == [kinds.count(k) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == want


def test_edges_and_increments(spark, tmp_path):
    key = "AKIA" + "A1" * 8
    texts = [None, "", f"é {key}", f"é {key}", "PassWord: 'abcdef'", "token=abc", "x" * 30_000 + "0a" * 12, "toKen = abcdef ſecret=abcdef"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "token = 'tok.en='", "y")], "path int, text string, blob string")
    ledger = str(tmp_path / "ledger")
    assert secrets.scan_unseen(df, ledger) == 7  # null and empty are one blob, and so are the copies
    got = {r.path: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in secrets.findings(df.drop("blob"), ledger).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t or "")
    assert got[None] == ["assign:0:16"]
    # nothing new: no row is added; a new version and a new rule version scan just what they must
    assert secrets.scan_unseen(df, ledger) == 7
    more = spark.createDataFrame([("token=123456789",), ("",)], "text string")
    assert secrets.scan_unseen(more, ledger) == 8
    raised = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{30,}"))
    assert secrets.scan_unseen(df, ledger, raised) == 15
    rows = secrets.findings(df.drop("blob"), ledger, raised).collect()
    assert all(s.kind != "hex" for r in rows for s in r.spans)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan_unseen(df, str(tmp_path / "l")) == 0
    assert secrets.findings(df, str(tmp_path / "l")).count() == 0


def test_web_tokens_in_very_long_texts():
    rules = list(secrets.EXTRA)
    real = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    assert secrets.find(f"x {real} y", rules) == [("webtoken:2", 2, 2 + len(real))]
    # a million characters of the mark itself, in one run and in many
    for text in ("eyJ" * 350_000, "eyJ." * 250_000, "eyJ0123456789." * 70_000):
        assert len(secrets.find(text + " " + real, rules)) >= 1

"""Personal data: base spans against plain patterns, and the field's own rules."""

import hashlib
import re
import sys

from eventlake.llm import pii
from eventlake.llm.queries import QUERIES

# the plain patterns read long digit runs as numbers
sys.set_int_max_str_digits(0)

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 14 <= len(d) <= 19 and sum(x if j % 2 == 0 else sum(divmod(2 * x, 10)) for j, x in enumerate(d[::-1])) % 10 == 0
            elif kind == "phone":
                ok = 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), i, m.end()))
    return sorted(out)


HARD = [
    "", "a@b", "a@b.c", "x.a@b.c.d@e.f", "é@b.c a%b+c@d-e.f-g.h.", "@a.b", "a@@b.c", "..@a.b.",
    "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.4", "1.2.3.", "999.1.2.3.4", "0000000255.1.1.1",
    "0" * 5_000 + ".1.1.1", "1.1.1." + "0" * 5_000 + "256", "0" * 9_000 + "1.2.3.4", "4785 3805-9239 1139", "4111111111111111", "4111111111111112", "41111111111111111111", "1-2 3--4",
    "+1 (017) 555-7713", "+1", "++12 345 678 90", "+1 2 +1 234 567 8901 5", "+1234567890123456", "٣٤٥ +٣",
    "tel +1 (017) 555-7713, ip 97.51.17.173 mail und.34@mail7.example.com card 4111 1111 1111 1111.",
]


def test_base_equals_plain_patterns():
    for text in HARD:
        assert pii.base_spans(text) == brute(text), text
    long = "9" * 60_000 + " " + "a" * 60_000 + "@ " + "1." * 20_000
    assert pii.base_spans(long) == [] or all(k == 1 for _, k, _ in pii.base_spans(long))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op4_semi_markov_pii"](spark, d).collect()
    assert len(rows) == len(texts)
    more = 0
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.named(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(pii.named(want).split(",") if want else []) <= set(spans)
        more += len(spans) - len(want)
        assert len(spans) == len(want) or re.search("[0-9@]", texts[r.doc_id])
    # the field adds with care: clean documents stay clean
    assert more <= 0.02 * len(rows)


def test_field_learns_whole_spans():
    texts = [f"call +1 ({i:03d}) 555-{1000 + i} or mail u{i}@m{i}.org now" for i in range(40)] + [f"number {i} of {i * 7}" for i in range(40)]
    field = pii.Field(pii.learn(texts))
    text = "dial +1 (999) 555-4321 at once"
    (zone,) = list(pii.zones(text))
    assert field.best(text, zone) == [(0, 3, 4)]
    text = "just 31 things"
    assert field.best(text, next(pii.zones(text))) == []


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (None, "é 1.2.3.4", "s"), (2, "x 1.2.3.4 y a@b.cd", None)], "doc_id long, text string, spans string")
    out = [(r.doc_id, r.text, r.spans) for r in pii.redact(df).collect()]
    assert out == [(1, None, "s"), (1, "", "s"), (None, "é [IP]", "s"), (2, "x [IP] y [EMAIL]", None)]
    assert pii.redact(df.limit(0)).count() == 0


def test_query_on_very_long_texts(spark, tmp_path):
    texts = ["0" * 5_000 + ".1.1.1", "7" * 200_000, "x 1.2.3.4 " + "12 345 6789 " * 8_000, "a1" * 50_000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_ip, r.base_sha256) for r in QUERIES["op4_semi_markov_pii"](spark, str(tmp_path)).collect()}
    # written out, as the plain patterns take quadratic time here
    want = {0: [(0, 1, 5_006)], 1: [], 2: [(2, 1, 9)], 3: [], 4: []}
    assert got == {i: (len(w), hashlib.sha256(pii.named(w).encode()).hexdigest()) for i, w in want.items()}


def test_sample_takes_distinct_texts(spark):
    df = spark.createDataFrame([(f"mail a{i % 3}@b.org" if i % 3 else "call 1",) for i in range(300)], "text string")
    weights = pii.train(df, sample=3)
    assert any("domain True" in k for k in weights)


def test_decoding_of_a_long_zone_equals_all_at_once():
    texts = [f"call +1 ({i:03d}) 555-{1000 + i} or mail u{i}@m{i}.org now" for i in range(40)]
    field = pii.Field(pii.learn(texts))
    (zone,) = pii.zones(" ".join(["+1 (999) 555-4321 7 8 9"] * 50))
    text = " ".join(["+1 (999) 555-4321 7 8 9"] * 50)
    # the plain recursion over all ends
    score, back = [0.0], []
    for j in range(len(zone)):
        s, n, t = max((score[j + 1 - n] + w, -n, -t) for n, t, _, w in field.ending(text, zone, j))
        score.append(s)
        back.append((-n, -t))
    want, j = [], len(zone)
    while j:
        n, t = back[j - 1]
        j -= n
        want += [(j, n, t)] if t else []
    assert field.best(text, zone) == want[::-1] and len(want) >= 50

"""Decontamination: edges, several blocks, and rows that repeat."""

import re

from eventlake.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, bench):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words, hit, items = WORD.findall(lower(text)), set(), set()
    for item, t in bench:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - 9) if w else 0):
            win = w[i : i + 10]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    if item is not None:
                        items.add(str(item))
    return len(words), len(hit), sorted(items)


def test_equals_brute_force(spark):
    seq = " ".join(f"w{i}" for i in range(30))
    bench = [(1, seq), (10, "One, TWO three"), (2, "É É"), (3, "solo"), (None, "x1 x2 x3 x4"), (4, None), (5, "..."), (1, seq), (6, "a " * 25)]
    texts = [None, "", "nothing here", f"pre {seq} post", " ".join(f"w{i}" for i in range(4, 15)), "one two three one two", "É É É é é", "SOLO", "x1 x2 x3 x4 x5", "a " * 40, "w1 w2 w3 " * 30, ("w9 w8 " * 20_000) + seq, "solo"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "solo", 3)], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for block in (50_000, 9):
        rows = decontam.mark(docs, items, block=block).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows}
        for i, t in enumerate(texts):
            assert got[i] == brute(t, bench), (i, block)
        assert got[None] == (1, 1, ["3"])
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 10]
    assert decontam.mark(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.mark(docs.limit(0), items).count() == 0

"""The pipeline's stages, each held against a plain version on its own input."""

from collections import defaultdict

import corpus_pipeline
from test_decontam import WORD
from test_orderhash import lcs

from eventlake.llm import mixing, pii, quality
from eventlake.llm.common import stored, table, words_of

D = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = table(spark, D, "documents")
    columns, before, kept = docs.columns, rows_of(docs), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        source = docs
        docs = stored(stage(spark, source, D))
        assert docs.columns == columns and docs.dtypes == source.dtypes
        after = rows_of(docs)
        check = {"quality": good, "near_duplicates": single, "decontamination": clean, "personal_data": redacted}[name]
        check(spark, source, before, after)
        kept.append(len(after))
        before = after
    assert 0.5 * len(rows_of(table(spark, D, "documents"))) < kept[-1] <= kept[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    have, drawn = defaultdict(int), defaultdict(int)
    for r in before.values():
        have[r.source] += len(r.text.split())
    for r in mixed:
        drawn[r.source] += r.tokens
    target = mixing.Target()
    assert sum(drawn.values()) <= target.budget * sum(have.values()) + 1
    assert all(drawn[s] <= target.repetition * n for s, n in have.items())
    # near the natural shares, flattened: smaller sources gain
    assert drawn[max(have, key=have.get)] <= have[max(have, key=have.get)]
    assert sorted((r.doc_id, r.epoch) for r in corpus_pipeline.run(spark, D).collect()) == sorted((r.doc_id, r.epoch) for r in mixed)


def good(spark, source, before, after):
    w = quality.fit_on(source, table(spark, D, "labels"))
    assert set(after) == {i for i, r in before.items() if quality.score((r.text or "").encode(), w) >= 0.3}
    assert all(after[i] == before[i] for i in after)


def single(spark, source, before, after):
    words = {i: words_of((r.text or "").encode()) for i, r in before.items()}
    grams = {i: list(dict.fromkeys(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))) for i, w in words.items() if w}
    sets, root = {i: set(g) for i, g in grams.items()}, {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(grams)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and lcs(grams[i], grams[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in before if find(i) == i}
    assert len(after) < len(before) and all(after[i] == before[i] for i in after)


def clean(spark, source, before, after):
    windows = defaultdict(set)
    for r in table(spark, D, "benchmark").collect():
        w = WORD.findall(r.text.lower())
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[j : j + 10])].add(tuple(w[j : j + 10]))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def held(text):
        w = WORD.findall((text or "").translate(low))
        return any(tuple(w[j : j + n]) in own for n, own in windows.items() for j in range(len(w) - n + 1))

    assert set(after) == {i for i, r in before.items() if not held(r.text)}
    assert all(after[i] == before[i] for i in after)


def redacted(spark, source, before, after):
    assert set(after) == set(before)
    field = pii.Field(pii.train(source))
    changed = 0
    for i, r in before.items():
        _, spans = pii.all_spans(r.text or "", field)
        assert after[i].text == (pii.redacted(r.text, spans) if spans else r.text)
        assert (after[i].lang, after[i].source, after[i].n_chars) == (r.lang, r.source, r.n_chars)
        assert not pii.base_spans(after[i].text or "")
        changed += bool(spans)
    assert changed

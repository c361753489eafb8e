"""Near-duplicates against an all-pairs comparison on small tables."""

import random

import numpy as np

from eventlake.llm import orderhash
from eventlake.llm.common import words_of
from eventlake.llm.components import components


def brute_classes(texts):
    words = [words_of((t or "").encode()) for t in texts]
    sets = [list(dict.fromkeys(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))) if w else None for w in words]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and lcs(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1])


def corpus(seed, n=25):
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randint(0, 400))
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        base = [word() for _ in range(rnd.choice((3, 30, 120, 260)))]
        if i % 4 == 0:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            edit = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                edit[rnd.randrange(len(edit))] = word()
            texts.append(" ".join(edit))
    return texts


def test_equals_all_pairs(spark):
    texts = [*corpus(5), "", None, "One two THREE", "one, two; three", "one"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").coalesce(1)
    got = {r.doc_id: r.class_id for r in orderhash.classes(df).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = sorted(r.doc_id for r in orderhash.keep_one(df).collect())
    assert kept == sorted(set(want))


def test_family_around_a_hub_is_one_class(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(300)]
    texts = []
    for _ in range(150):
        edit = list(base)
        for _ in range(5):
            edit[rnd.randrange(300)] = f"x{rnd.randint(0, 10**6)}"
        texts.append(" ".join(edit))
    texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.class_id for r in orderhash.classes(df).collect()} == {0}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "z"), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in orderhash.classes(df).collect())
    assert got == [(0, 0), (0, 4), (4, 4), (4, 4), (5, 5), (5, 5)]
    assert orderhash.keep_one(df).count() == 4
    assert orderhash.classes(df.limit(0)).count() == 0 and orderhash.keep_one(df.limit(0)).count() == 0


def test_alignment_and_labels():
    a = np.arange(90, dtype=np.uint64)
    assert orderhash.similar(a, np.delete(a, slice(0, 18))) and not orderhash.similar(a, np.delete(a, slice(0, 19)))
    assert not orderhash.similar(a, a[::-1].copy())
    s = np.array([3, 3, 1, 3], dtype=np.uint64)
    assert len(set(orderhash.labelled(s).tolist())) == 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def distinct_shingles(text):
    return orderhash.distinct(orderhash.shingles(words_of(text.encode())))


def split_family(pairs):
    """Variants of one text with eight words of their own, two of them shared in pairs: 0.82 in a pair, 0.76 else."""
    rnd = random.Random(11)
    out = []
    for k in range(pairs):
        common = rnd.sample(range(8), 2)
        for own in (0, 1):
            edit = [f"t{i}" for i in range(300)]
            for i in range(8):
                edit[20 + 35 * i] = f"v{k}x{i}" + ("" if i in common else "ab"[own])
            out.append(" ".join(edit))
    return out


def test_members_unlike_their_hub_are_compared_with_each_other(spark):
    """Beside 3 000 easy links; the pairs of a family whose members share most buckets have to be found all the same."""
    family = split_family(45)
    rnd = random.Random(3)
    for i in range(300):
        base = [f"e{i}x{rnd.randint(0, 10**6)}" for _ in range(30)]
        family += [" ".join([*base, f"c{i}x{j}"]) for j in range(11)]
    df = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.class_id for r in orderhash.classes(df).collect()}
    seen = [distinct_shingles(t) for t in family[:90]]
    buckets = [set(orderhash.sketch(words_of(t.encode()))) for t in family[:90]]
    links = [(i, j) for j in range(90) for i in range(j) if buckets[i] & buckets[j] and orderhash.similar(seen[i], seen[j])]
    assert len(links) >= 40
    assert all(got[i] == got[j] for i, j in links)
    assert len({got[i] for i in range(90)}) == 45 + 45 - len(links)


def test_blocks_of_a_bucket_give_all_its_links(spark, monkeypatch):
    texts = split_family(45)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.class_id for r in orderhash.classes(df).collect()}
    monkeypatch.setattr(orderhash, "BLOCK", 8_000)
    assert {r.doc_id: r.class_id for r in orderhash.classes(df).collect()} == whole


def test_shingles_in_common():
    rnd = np.random.default_rng(4)
    draw = lambda n: [np.unique(np.concatenate([rnd.choice(50, 30), rnd.choice(5_000, 60)]).astype(np.uint64)) for _ in range(n)]
    a, b = draw(40), draw(25)
    assert orderhash._in_common(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert orderhash._in_common(a, [np.array([9_999], np.uint64)]).sum() == 0


def test_documents_split_otherwise_between_scans(spark, tmp_path, monkeypatch):
    texts = corpus(5)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_classes(texts)
    split, plain = "spark.sql.files.minPartitionNum", orderhash.stored

    def then_as_one(df):
        out = plain(df)
        spark.conf.set(split, "1")
        return out

    monkeypatch.setattr(orderhash, "stored", then_as_one)
    try:
        spark.conf.set(split, "8")
        got = {r.doc_id: r.class_id for r in orderhash.classes(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
        spark.conf.set(split, "8")
        kept = sorted(r.doc_id for r in orderhash.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    finally:
        spark.conf.unset(split)
    assert [got[i] for i in range(len(texts))] == want
    assert kept == sorted(set(want))

"""The near-duplicate stage against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import near_copies
from tidewell.llm.near_copies import shingles, similarity

SYLLABLES = "an be co di el fu ga hi in jo ka lu me no or pa qui re so ta un vo".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def edited(rnd, text, edits):
    words = text.split()
    for _ in range(edits):
        k = rnd.randrange(len(words))
        how = rnd.randrange(3)
        words[k : k + 1] = [[prose(rnd, 1)], [], [words[k], prose(rnd, 1)]][how]
    return " ".join(words)


def corpus():
    rnd, rows = random.Random(6), []
    for _ in range(40):
        n = rnd.choice([60, 150, 400, 1200])
        base = prose(rnd, n)
        rows.append(base)
        # from near copies to texts that only look alike
        rows += [edited(rnd, base, max(1, int(n * share))) for share in (0.004, 0.01, 0.02, 0.03, 0.2, 0.5)]
        rows.append(base.upper() if n == 60 else base.replace(" ", "\n"))
    rows += [edited(rnd, rows[0], 1) for _ in range(60)]
    rows += [None, "", " ", "one", "ONE", "one two", "two one", "a b c d e f", "a b c d e g"]
    return rows


@pytest.fixture(scope="module")
def kept(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("row", "k1", "t1", "code", "component", "place", "near", "leaders", "own")})
    out = near_copies.keep_one(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r.own == "clash" and r.text == texts[r.doc_id] for r in rows)
    return {r.doc_id for r in rows}


def pairs():
    sets = [shingles(t, 5) for t in corpus()]
    return {(a, b) for b in range(len(sets)) for a in range(b) if similarity(sets[a], sets[b]) >= 0.8}


def test_recall_and_precision_against_all_pairs(kept):
    near = pairs()
    assert len(near) > 600
    missed = [(a, b) for a, b in near if a in kept and b in kept]
    # of the texts that have an earlier near copy, by far the most go
    late = {b for _, b in near}
    assert len({b for _, b in missed}) <= 0.05 * len(late)
    # and nothing goes that is near no text that stays
    for gone in set(range(len(corpus()))) - kept:
        assert any(gone in p and (set(p) - {gone}) & kept for p in near), gone


def test_same_words_are_one_text(kept):
    texts = corpus()
    at = {t: i for i, t in reversed(list(enumerate(texts)))}
    assert len(kept & {texts.index(None), at[""], at[" "]}) == 1
    assert at["one"] in kept and at["ONE"] not in kept and at["one two"] in kept and at["two one"] in kept
    assert at["a b c d e f"] in kept and at["a b c d e g"] in kept  # one shingle of three


def test_rows_that_repeat_ids(spark):
    rnd = random.Random(1)
    a, b = prose(rnd, 80), prose(rnd, 80)
    near = edited(rnd, a, 1)
    rows = [(1, a), (1, b), (1, a), (None, near), (None, b), (2, None), (None, None), (3, near), (5, "z"), (5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_copies.keep_one(df).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (2, None), (5, "z")], key=repr)
    assert near_copies.keep_one(df.where("false")).collect() == []


@pytest.mark.parametrize("small", [2000, 100])
def test_a_hot_group_of_distinct_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL_TEXTS", small)
    rnd = random.Random(2)
    base, other = prose(rnd, 200), [prose(rnd, 50) for _ in range(40)]
    texts = [base] + [edited(rnd, base, 2) for _ in range(3000)] + other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in near_copies.keep_one(df).select("doc_id").collect()}
    assert 0 in got and set(range(3001, 3041)) <= got and len(got) <= 40 + 30


@pytest.mark.parametrize("n", [10, 1 << 21, 1 << 28])
def test_tables_miss_no_pair_within_the_distance(n):
    rnd = random.Random(n)
    tables = near_copies._tables(7, n)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 7):
            b ^= 1 << bit
        key = lambda code, t: [(code >> low) & ((1 << size) - 1) for low, size in t]
        assert any(key(a, t) == key(b, t) for t in tables)


def first_come(texts, leaders=0):
    sets, gone = [shingles(t, 5) for t in texts], []
    for k, mine in enumerate(sets):
        against = range(leaders) if leaders else (j for j in range(k) if not gone[j])
        gone.append(k >= leaders and any(similarity(mine, sets[j]) >= 0.8 for j in against))
    return gone


@pytest.mark.parametrize("columns", [4096, 3])
@pytest.mark.parametrize("leaders", [0, 1, 50])
def test_texts_of_one_task_against_brute_force(monkeypatch, columns, leaders):
    monkeypatch.setattr(near_copies, "_COLUMNS", columns)
    texts = list(dict.fromkeys(" ".join((t or "").lower().split()) for t in corpus()))
    random.Random(3).shuffle(texts)
    assert near_copies._late(texts, 5, 0.8, leaders).tolist() == first_come(texts, leaders)
    assert sum(first_come(texts)) > 100


@pytest.mark.parametrize("leaders, size, most", [(None, None, 12), (70, 40_000, 60)])
def test_a_large_group_of_texts_that_stay_takes_few_rounds(spark, monkeypatch, leaders, size, most):
    monkeypatch.setattr(near_copies, "SMALL_TEXTS", 100)
    if leaders:
        monkeypatch.setattr(near_copies, "LEADERS", leaders)
    if size:
        monkeypatch.setattr(near_copies, "LEADER_BYTES", size)
    written, cut = [], near_copies.cut_lineage
    monkeypatch.setattr(near_copies, "cut_lineage", lambda df: written.append(1) or cut(df))
    rnd = random.Random(8)
    base = prose(rnd, 150)
    texts = [edited(rnd, base, 20) for _ in range(200)]
    texts += [edited(rnd, rnd.choice(texts), 2) for _ in range(100)]
    rnd.shuffle(texts)
    ids = [k if k < 290 else None for k in range(300)]
    rows = [("c", k % 7, k, (ids[k] is None, ids[k], k, 0), t) for k, t in enumerate(texts)]
    rows += [("d", 7, k, (False, k, k, 0), t) for k, t in enumerate([base, edited(rnd, base, 1), prose(rnd, 60)])]
    kind = "component string, t1 long, t2 long, place struct<unnamed:boolean, doc_id:long, k1:long, k2:long>, text string"
    got = {tuple(r) for r in near_copies._copies(spark.createDataFrame(rows, kind).repartition(3), 5, 0.8).collect()}
    want = {(k % 7, k) for k, late in enumerate(first_come(texts)) if late}
    assert 50 < len(want) < 150 and got == want | {(7, 1)}
    assert len(written) <= most  # three or so in each round

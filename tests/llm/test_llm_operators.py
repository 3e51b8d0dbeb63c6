"""Each operator against a brute-force version on small, awkward inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import anchors, hamming, packing, ppm, quality, records, registered, scoring, simhash, suffix, topk, transducer, urls
from tidewell.llm.components import components
from tidewell.llm.runindex import RunIndex
from tidewell.llm.tokens import WordEncoder

WORDS = "the of and stone river cold winter Éclair naïve house under above morning lantern quiet".split()
#: names that the operators use inside
CLASHES = ("body", "words", "lines", "code", "start", "part", "ids", "k1", "spans", "row", "n", "rest", "host", "node")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".", "."]) for _ in range(n))


def texts():
    base = prose(1, 400)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (6, base), (6, base), (7, base.replace("stone", "sand", 1)),
        (8, "x" * 3000), (9, prose(2, 9000)), (10, "a | b | c\n" * 40), (11, "Licensed under X.\n" + prose(3, 80) + ".\nshort"),
        (12, prose(4, 60) + "\n" + prose(4, 60) + "\nno end here"), (13, "★ " + prose(5, 70) + " 😀\x0b|é"), (None, prose(6, 100)),
        (-4, prose(7, 55) + "."),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- 1, 6: tokens, packing, records -------------------------------------------


@pytest.fixture(scope="module")
def plain_ids():
    tokenizer = Tokenizer.from_file(registered.word_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_tokenizer(plain_ids):
    encoder = WordEncoder(registered.word_tokenizer(), most_words=50)
    rnd = random.Random(3)
    letters = [chr(c) for c in range(32, 127)] + list("éüßÉ×÷日本語😀\n\t ́ﬁİΣσς\x1c\x85　") + [" "] * 9 + ["'s", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        assert encoder.ids(text.encode()).tolist() == plain_ids(text), repr(text)


def check_pieces(got, want, size):
    covered, sequences = Counter(), {}
    for doc_id, start, length, crc, n, sequence, offset in got:
        match = next(ids for i, ids in want if i == doc_id and len(ids) == n and packing.crc_of(np.array(ids[start : start + length])) == crc)
        assert 0 < length <= n - start and len(match) == n
        covered[doc_id] += length
        sequences.setdefault(sequence, []).append((offset, length))
    total = Counter()
    for i, ids in want:
        total[i] += len(ids)
    assert covered == total
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


@pytest.mark.parametrize(("size", "most_open"), [(64, 2), (2048, 32)])
def test_packing(docs, nothing, plain_ids, size, most_open):
    want = [(i, [*plain_ids(t), 1]) for i, t in texts()]
    got = rows(packing.pack(docs, registered.word_tokenizer(), 1, size, most_open))
    assert check_pieces(got, want, size) == 0
    assert rows(packing.pack(nothing, registered.word_tokenizer())) == []


def test_packer_keeps_few_windows_open():
    rnd = random.Random(5)
    packer, out = packing.Packer(100, 4), []
    for k in range(500):
        out += list(packer.add((k, 0, 0, np.arange(rnd.randint(0, 250)))))
        assert len(packer.windows) <= 4 == packer.most_open
    assert all(sum(len(p[3]) for p in w) == 100 for w in out)


def test_records(spark, docs, nothing, plain_ids, tmp_path):
    root = f"file://{tmp_path}/records"
    manifest = records.write_records(docs, registered.word_tokenizer(), 2, root)
    got = [tuple(r) for r in records.digest_records(manifest, root).orderBy("start").collect()]
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [i for i, _ in order]
    at = 0
    for i, start, n, _ in got:
        assert start == at
        at += n
    want = Counter((i, len(ids), packing.crc_of(np.array(ids))) for i, ids in ((i, [*plain_ids(t), 2]) for i, t in order))
    assert Counter((i, n, crc) for i, _, n, crc in got) == want
    # shuffled reads through the index give the same records
    fs, _ = records.FileSystem.from_uri(root)
    for shard in manifest.collect():
        whole = [(i, ids.tolist()) for i, ids in records.read_shard(fs, shard.path)]
        picked = list(range(len(whole)))[::-1]
        assert [(i, ids.tolist()) for i, ids in records.read_records(fs, shard.path, picked)] == whole[::-1]
    empty = records.write_records(nothing, registered.word_tokenizer(), 2, f"file://{tmp_path}/none")
    assert rows(records.digest_records(empty, root)) == []


def test_shards_are_read_by_as_many_tasks(spark, tmp_path):
    rows_of_one_id = spark.range(400).selectExpr("cast(null AS long) AS doc_id", "concat('text ', id) AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = records.write_records(rows_of_one_id, registered.word_tokenizer(), 2, f"file://{tmp_path}/shards")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert manifest.count() >= 3  # one id does not keep all its rows in one shard
    got = records.digest_records(manifest, f"file://{tmp_path}/shards")
    assert got.rdd.getNumPartitions() == manifest.count()
    assert got.select(F.spark_partition_id()).distinct().count() >= 2
    starts = sorted((r.start, r.n_tokens) for r in got.collect())
    assert len(starts) == 400 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_damaged_records_are_noticed(tmp_path):
    fs, base = records.FileSystem.from_uri(f"file://{tmp_path}")
    path = f"{base}/part-0"
    records.write_shard(fs, path, [records.payload(None, np.arange(5, dtype="<u2")), records.payload(7, np.arange(9, dtype="<u4"))])
    assert [(i, ids.tolist()) for i, ids in records.read_shard(fs, path)] == [(None, list(range(5))), (7, list(range(9)))]
    data = bytearray((tmp_path / "part-0.rec").read_bytes())
    data[-6] ^= 1
    (tmp_path / "part-0.rec").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_shard(fs, path))


# -- 3: SimHash ----------------------------------------------------------------


def plain_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(lower)
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, near):
    label = list(range(n))
    while True:
        new = [min(label[j] for j in range(n) if near(i, j)) for i in range(n)]
        if new == label:
            return label
        label = new


def test_simhash(docs, nothing):
    data = [(i, plain_fingerprint(t)) for i, t in texts()]
    label = plain_components(len(data), lambda a, b: (data[a][1] ^ data[b][1]).bit_count() <= 4)
    least = {}
    for (i, _), root in zip(data, label, strict=True):
        least[root] = min(x for x in (least.get(root), i) if x is not None) if (least.get(root), i) != (None, None) else None
    want = sorted(((i, f"{f:016x}", least[root]) for (i, f), root in zip(data, label, strict=True)), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want
    assert rows(simhash.near_duplicates(nothing)) == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    stay = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in stay if x is not None) == sorted({c for i, _, c in want if i == c and i is not None}) and stay.count(None) == 1


@pytest.mark.parametrize("second", [False, True])
def test_gray_index(second):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    codes = base[rng.integers(0, 60, 700)].copy()
    for _ in range(5):
        codes ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    codes = np.unique(codes)
    rng.shuffle(codes)
    cut = len(codes) // 3 if second else len(codes)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    if second:
        near[:cut, :cut] = near[cut:, cut:] = False
        np.fill_diagonal(near, True)
    label = np.arange(len(codes))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(codes))])
        if (new == label).all():
            break
        label = new
    got = hamming.linked(codes[:cut], 4, codes[cut:] if second else None)
    assert (got == label).all() and len(set(label.tolist())) < len(label)


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 1 << 63))
    codes = sorted({center ^ sum(1 << int(b) for b in rng.integers(0, 62, 3)) for _ in range(150)})
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    got = {r.node: r.component for r in components(simhash.links(df, 4)).collect()}
    label = plain_components(len(codes), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 4)
    assert all(got.get(c, c) == codes[label[k]] for k, c in enumerate(codes))


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100 + rnd.randint(0, 30), 100 + rnd.randint(0, 30)) for _ in range(25)]
    pairs += [(200, 200 + k) for k in range(50)] + [(5, 5), (None, 3), (7, None)]
    nodes = sorted({x for p in pairs for x in p if x is not None})
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert {x: got.get(x, x) for x in nodes} == label
    assert components(df.where("false")).count() == 0


# -- 4: urls --------------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    page = lambda head: f"<html><head>{head}</head><body>x</body></html>"
    data = [
        (1, "http://A.example.COM/en/x?q#f", page('<link rel="canonical" href="http://other.org/a">')),
        (2, "https://www.example.com/en/", page("")), (3, "http://x.net/es/", None), (4, "http://x.net/es", page("")), (5, None, None),
        (6, "no scheme", ""), (7, "http://other.org/a", page('<meta http-equiv=refresh content="0; url=/b">')),
        (8, "http://other.org/b", page("")), (9, "http://other.org/c#z", page("<link href='b' rel=canonical>")),
        (10, "http://free.org/1", page('<link rel=canonical href="http://y.net/fr/1">')),
        (11, "http://free.org/1#again", page('<link rel=canonical href="http://shop.com/1">')), (12, "http://alone.org/", page("")),
        (12, "http://alone.org/", page("")), (13, "://only/en/", ""), (14, "http://noexample.com/en/", ""),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = rows(urls.filter_urls(df, urls.rule_table(spark, urls.RULES)))
    verdict = {r[0]: r[1:] for r in got}
    assert len(got) == len(data) and got.count((12, "alone.org", "/", None, "allow")) == 2
    assert verdict[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert verdict[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert verdict[3][2:] == ("net/es/", "block") and verdict[4][2:] == (None, "allow")
    assert verdict[5] == verdict[6] == ("", "", None, "allow")
    assert [verdict[k][3] for k in (7, 8, 9)] == ["block"] * 3  # over two redirects and a canonical link
    assert [verdict[k][2:] for k in (10, 11)] == [(None, "allow")] * 2  # an allowed alias outweighs the blocked one
    assert verdict[13][:2] == ("only", "/en/") and verdict[14][2] == "com/"
    assert rows(urls.filter_urls(df.where("false"), urls.rule_table(spark, urls.RULES))) == []


# -- 5: quality -----------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts(docs, nothing):
    got = quality.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert rows(got) == sorted(((i, *plain_counts(t)) for i, t in texts()), key=repr)
    assert rows(quality.clean_lines(nothing)) == []


def test_quality_lines(docs):
    kept = {r.doc_id: r for r in quality.keep_clean(docs).collect()}
    assert quality.keep_clean(docs).columns == docs.columns
    assert kept[11].text == prose(3, 80) + "." and kept[11].n_chars == len(kept[11].text)
    assert kept[5].text == dict(texts())[5] and kept[5].body == "clash"
    assert not {1, 2, 3, 4, 8, 10, 12} & set(kept)


# -- 7: suffix ---------------------------------------------------------------------


def plain_digest(data, window):
    count = Counter(b[k : k + window] for _, b in data for k in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k + 1 : k + 1 + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1 : len(b) + 1]])
        out.append((i, len(b), len(b) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return sorted(out, key=repr)


def repetitive():
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice("abcdé") for _ in range(n))
    a, b = make(300), make(150)
    data = [(1, None), (2, ""), (3, a), (4, "x" + a[:200] + "y" + a[100:]), (5, "a" * 900), (5, "a" * 900), (None, b + a), (7, "ab" * 300)]
    return data + [(10 + k, make(60) + b + make(40)) for k in range(30)] + [(100 + k, a[:k] + "Z" + a[k + 1 :]) for k in range(0, 300, 9)]


@pytest.mark.parametrize("most", [2048, 5])
def test_suffix_removal(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", most)
    df = spark.createDataFrame(repetitive(), "doc_id long, text string").withColumns({c: F.lit(0) for c in CLASHES})
    want = plain_digest([(i, (t or "").encode()) for i, t in repetitive()], 100)
    assert rows(suffix.digest(df, 100)) == want
    cleaned = suffix.remove_repeats(df, 100)
    assert cleaned.columns == df.columns and cleaned.count() == df.count()
    texts_left = [(r.doc_id, r.text or "") for r in cleaned.collect()]
    assert sorted(texts_left, key=repr) == sorted(((r[0], r[-1]) for r in want), key=repr)
    assert rows(suffix.digest(df.where("false"), 100)) == []


@pytest.mark.parametrize("doc_id", [None, 7])
def test_thousands_of_equal_rows_are_one_text(spark, doc_id):
    text, other = prose(31, 500), prose(32, 90)
    df = spark.createDataFrame([(doc_id, text)] * 5000 + [(1, other + text[:700]), (2, other[:300])], "doc_id long, text string")
    started = time.monotonic()
    got = {r.n_bytes: r for r in suffix.digest(df, 400).distinct().collect()}
    assert time.monotonic() - started < 60
    n = len(text.encode())
    assert (got[n].n_removed, got[n].n_spans, got[n].text) == (n, 1, "")
    partly = got[len((other + text[:700]).encode())]
    assert partly.text == other and len(got) == 3


def without_repeats(texts, window, words):
    """Texts without the repeated strings of ``window`` bytes or of so many words."""
    data = [t.encode() for t in texts]
    pieces = []
    for k, b in enumerate(data):
        pieces += [(k, i, i + window) for i in range(len(b) - window + 1)]
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        pieces += [(k, x[0], y[1]) for x, y in zip(at, at[words - 1 :], strict=False)]
    count = Counter((data[k][a:b], b - a == window) for k, a, b in set(pieces))
    gone = [np.zeros(len(b), bool) for b in data]
    for k, a, b in set(pieces):
        if count[data[k][a:b], b - a == window] > 1:
            gone[k][a:b] = True
    return [bytes(np.frombuffer(b, np.uint8)[~g]).decode(errors="ignore") for b, g in zip(data, gone, strict=True)]


def test_short_passages_of_many_words_are_removed(spark):
    passage, other = " ".join("ab cd efg h".split() * 13)[:-2], prose(11, 51)
    assert len(passage.split()) == 51 and len(passage) < 400
    texts = [f"{prose(20, 60)} {passage} {prose(21, 60)}", f"{prose(22, 9)}\n{passage}\n{prose(23, 70)}", f"{other} end", f"begin {other}"]
    texts += [" ".join(prose(12, 51).split()[:50]) + f" {k}" for k in range(2)] + ["x" * 450 + f" {k}" for k in range(2)]
    texts += [prose(13, 40) + " é", prose(13, 40) + " é", "", "a b " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(0) for c in CLASHES})
    got = {r.doc_id: r.text for r in suffix.remove_repeats(df, 400, 51).collect()}
    want = without_repeats(texts, 400, 51)
    assert [got[k] for k in range(len(texts))] == want
    assert passage not in got[0] + got[1] and got[2] == " end" and got[4] == texts[4] and "xxx" not in got[6]


def test_the_query_reports_short_passages_beside_its_contract(spark, tmp_path):
    passages = [prose(40 + k, 51 + k) for k in range(6)]
    texts = [f"{prose(50 + k, 30 + k)}\n{passages[k % 6]} {prose(70 + k, 40 + k)}" for k in range(12)]
    texts += [prose(100 + k, 90) for k in range(6)] + [f"{passages[0]} {passages[0]}x", " \t" + prose(7, 51) + "\n", prose(8, 50), prose(9, 120), None]
    data = [*enumerate(texts), *[(k, texts[k]) for k in (19, 20, 21)], (90, texts[21] + " end"), (91, prose(9, 120)[:250])]
    spark.createDataFrame(data, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.op7_suffix_dedup(spark, str(tmp_path))
    contract = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert rows(got.select(contract)) == plain_digest([(i, (t or "").encode()) for i, t in data], 400)
    assert max(map(len, passages)) < 400
    free = without_repeats([t or "" for _, t in data], 400, 51)
    assert rows(got.select("doc_id", "passage_free")) == sorted(((i, t) for (i, _), t in zip(data, free, strict=True)), key=repr)
    found = {r.doc_id: (r.n_passages, r.passage_bytes) for r in got.collect()}
    assert [found[k] for k in range(12)] == [(1, len(passages[k % 6].encode())) for k in range(12)]
    assert {found[k] for k in (*range(12, 18), 20, 22, 91)} == {(0, 0)} and found[19] == (1, len(prose(7, 51).encode()))


@pytest.mark.parametrize("words", [3, 8])
def test_passages_of_mixed_contexts(spark, words):
    rnd = random.Random(words)
    data = [" ".join(rnd.choice(["a", "b", "c", "é"]) for _ in range(rnd.randrange(60))) + rnd.choice(["", " ", "\n\n"]) for _ in range(40)]
    base = prose(3, 300).split()
    data += [" ".join(base[:k] + ["Z"] + base[k + 1 :]) for k in range(0, 300, 17)] + ["  ".join(base[9:60])] + [data[0]] * 2
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.passage_free for r in suffix.digest(df, 400, words).collect()}
    assert [got[k] for k in range(len(data))] == without_repeats(data, 400, words)


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(anchors, "AT_ONCE", 64)
    text = prose(8, 200).encode()
    starts = []
    for _, _, offset, valid in anchors.segments([b"", b"short", text], 100):
        starts += offset[valid].tolist()
    assert starts == list(range(len(text) - 99))


def test_run_index():
    rng = np.random.default_rng(0)
    for trial in range(60):
        length = int(rng.integers(1, 6))
        strings = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 7))]
        index = RunIndex(strings, 64)
        got, count = index.repeats(length), Counter(s[k : k + length] for s in strings for k in range(len(s) - length + 1))
        for s, at in zip(strings, index.starts, strict=True):
            for k in range(len(s) - length + 1):
                assert got[at + k] == (count[s[k : k + length]] > 1)


# -- 8: top-k -------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(1)
    data = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(150)]
    data += [(150, data[3][1]), (151, data[3][1]), (152, None), (153, [1.0, None]), (154, [float("nan")] * 8), (155, [float("inf")] * 8)]
    data += [(156, []), (200, [0.0] * 8), (None, [1.0] * 8), (157, [2.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", F.lit(0))
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in fine:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, w in fine if i != q)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert rows(topk.top_k(df, F.col("vec_id") % 50 == 0, 5)) == sorted(want, key=repr)
    assert rows(topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0, 5)) == []


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 1000, (4000, 2)), axis=0)  # correlated: the best rows lead both lists
    lists = topk.SortedLists(np.arange(4000), values)
    looked = []
    score = lists._scores
    lists._scores = lambda places, query: looked.append(len(places)) or score(places, query)
    ids, scores = lists.best(np.array([3, 2]), -1, 5)
    exact = np.lexsort((np.arange(4000), -(values @ [3, 2])))[:5]
    assert ids.tolist() == exact.tolist() and sum(looked) < 200


# -- 9: SentencePiece ---------------------------------------------------------------


def test_sentencepiece(docs, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(transducer.encode_table(docs, path, with_ids=True))
    want = []
    for i, t in texts():
        ids = model.encode(t or "")
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        want.append((i, len(ids), sum(model.is_byte(x) for x in ids), crc, model.decode(ids) == (t or ""), ids))
    assert got == sorted(want, key=repr)
    assert rows(transducer.encode_table(nothing, path)) == []


def test_sentencepiece_on_random_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, machine = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer.load(path)
    rnd = random.Random(1)
    letters = [chr(c) for c in range(32, 127)] + list("éüñ日本語한😀▁\n\t ́ﬁ①") + [" "] * 10 + list("etaoin") * 3
    cases = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    for text in [*cases, "aaaaaaab", "mississippi" * 5, "            x", "00000000", "\n\n", "thethethe"]:
        assert machine.encode(text).tolist() == model.encode(text), repr(text)
        assert machine.decode(model.encode(text)) == model.decode(model.encode(text))


def test_unigram_weights_take_the_least_path():
    pieces = [("▁a", 10, -1.0), ("b", 11, -2.0), ("bb", 12, -3.5), ("▁ab", 13, -2.5), ("▁", 14, -4.0), ("a", 15, -4.0)]
    machine = transducer.Transducer(pieces, list(range(1000, 1256)), merges=False)
    assert machine.encode("abb").tolist() == [13, 11]  # 4.5, as is 10 12; the first found stays
    assert machine.encode("bé").tolist() == [14, 11, *(1000 + b for b in "é".encode())]


# -- 10: language model -----------------------------------------------------------


def plain_ppm(train, text, order):
    counts = {}
    for t in train:
        s = [0] * order + [b + 1 for b in t] + [257]
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts.setdefault(tuple(s[i - j : i]), Counter())[s[i]] += 1
    s, total = [0] * order + [b + 1 for b in text] + [257], 0.0
    for i in range(order, len(s)):
        excluded = set()
        for j in range(order, -1, -1):
            left = {k: v for k, v in counts.get(tuple(s[i - j : i]), {}).items() if k not in excluded}
            if not left:
                continue
            n = sum(left.values()) + len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / n)
                break
            total += math.log10(len(left) / n)
            excluded |= set(left)
        else:
            total -= math.log10(257 - len(excluded))
    return total


@pytest.mark.parametrize(("words_kept", "symbols"), [(1 << 18, 1 << 21), (5, 700)])
def test_scores(docs, nothing, monkeypatch, words_kept, symbols):
    monkeypatch.setattr(scoring, "_SYMBOLS", symbols)
    lower = [(i, (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in texts()]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    train = [t for i, t in lower if not out(i)]
    count = Counter(w for t in train for w in [*words(t), ""])
    total = count.total()
    got = rows(scoring.score(docs, order=3, words_kept=words_kept))
    want = []
    for i, t in lower:
        w = [*words(t), ""]
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (len(count) + 1))) for x in w)
        want.append((i, out(i), len(w), sum(x in count for x in w), total, base, plain_ppm([x.encode() for x in train], t.encode(), 3)))
    want.sort(key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert rows(scoring.score(nothing)) == []


@pytest.mark.parametrize("grams_kept", [0, 40, 900])
def test_scores_do_not_depend_on_the_grams_kept(docs, grams_kept):
    lower = [(i, (t or "").translate({c: c + 32 for c in range(65, 91)}).encode()) for i, t in texts()]
    train = [t for i, t in lower if zlib.crc32(str("" if i is None else i).encode()) % 10]
    want = sorted(((i, plain_ppm(train, t, 3)) for i, t in lower), key=repr)
    got = rows(scoring.score(docs, order=3, grams_kept=grams_kept).select("doc_id", "score"))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-9)


def test_a_smaller_trie_still_sums_to_one():
    grams = np.concatenate([ppm.grams(prose(k, 50).encode(), 3) for k in range(5)])
    counted = []
    for j in range(4):
        keys, n = np.unique(grams & ppm._mask(j + 1), return_counts=True)
        counted.append((keys[n >= 4], n[n >= 4]))
    trie = ppm.Trie(counted)
    for context in (b"the", b"xyz", b"s o"):
        packed = [ppm.grams(context + bytes([b]), 3)[3] for b in range(256)] + [ppm.grams(context, 3)[3]]
        assert math.isclose(sum(10 ** trie.log_probabilities(np.array(packed, np.uint64))), 1, rel_tol=1e-9)

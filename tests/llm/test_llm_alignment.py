"""Operator 12 against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter
from itertools import takewhile

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Tokens of whole texts, with ends from decoded bytes alone."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        # the byte level writes a byte as one character, those that can't be shown past 255
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte = {chr(b): b for b in shown}
        self.byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def groups(self, text):
        if not text:
            return []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return []
        ends = []
        for side in (a, b):
            at, found = 0, []
            for i, x in side:
                at += len(x)
                found.append((at, i))
            ends.append(found)
        both = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        out, start = [], 0
        for end in both:
            out.append((start, end, *(tuple(side.pop(0)[1] for _ in range(sum(1 for _ in takewhile(lambda t: t[0] <= end, side)))) for side in ends)))
            start = end
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def texts():
    rnd = random.Random(9)
    words = "the and river stone, winter. Über naïve 日本語 don't 12,345.6 (x) --- ꙮ 😀 https://x.org/a?b=c end.".split()
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(25)]
    odd = [None, "", " ", "\n", "  two  spaces ", "a\n\nb \n c\t d\r\ne", "<|endoftext|> <s> <0x41>", "has ▁ mark", "nul \x00 byte", " nbsp x", "x" * 5000]
    odd += ["very long " * 4_000, "one\ntwo three\nfour", "one.\nTwo, three.", "ﬁń 𓀀"]
    out = [(i, t) for i, t in enumerate(prose + odd + prose[:3])]
    return [*out, (None, "no id"), (3, "again"), (3, "again")]


def test_units_join_to_whole_texts(plain):
    rnd = random.Random(5)
    letters = [chr(c) for c in range(32, 127)] + list("éüß×日本語ꙮ𓀀😀\n\t ́ﬁ\x1c\x85　\x00\r▁​\x0b") + [" "] * 12 + ["\n"] * 5 + ["'s", "<|endoftext|>", "</s>", "ab.", "cd, "]
    of = alignment.Aligner(A, B)
    for _ in range(2500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))
        want = plain.groups(text)
        assert [(g.start, g.end, g.a, g.b) for g in of.groups(text)] == want, repr(text)
        n_a, n_b, n_groups, shown, links = of.summary(text)
        assert (n_a, n_b, n_groups) == (sum(len(g[2]) for g in want), sum(len(g[3]) for g in want), len(want))
        assert shown == ";".join(f"{','.join(map(str, g[2]))}|{','.join(map(str, g[3]))}" for g in want)
        assert links.tolist() == [g[2][-1] << 32 | g[3][-1] for g in want]


def test_memory_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_UNITS", 5)
    of = alignment.Aligner(A, B)
    for _, text in texts()[:25]:
        assert of.summary(text)[2] == len(plain.groups(text))
        assert len(of._known) <= 5 and len(of._before) <= 5


def test_spans_refine_by_decoded_bytes():
    data = "é😀a".encode()
    # two tokens in one character, and bytes that stand for nothing but the last
    assert alignment.refine(data, [(0, 2), (2, 6), (2, 6), (6, 7)], [data[:2], data[2:3], data[3:6], b"a"]) == [2, 3, 6, 7]
    assert alignment.refine(data, [(0, 2), (2, 2), (2, 6), (6, 7)], [data[:2], data[2:4], data[4:6], b"a"]) == [2, 4, 6, 7]
    assert alignment.refine(data, [(0, 2), (2, 6)], [data[:2], data[2:6]]) is None
    assert alignment.refine(data, [(0, 7)], [b"other.."]) is None


def digests(plain):
    found = [(i, plain.groups(t)) for i, t in texts()]
    count = Counter((g[2][-1], g[3][-1]) for _, groups in found for g in groups)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for doc_id, groups in found:
        links = [(g[2][-1], g[3][-1]) for g in groups]
        shown = ";".join(f"{','.join(map(str, g[2]))}|{','.join(map(str, g[3]))}" for g in groups)
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (2, 3))
        best = sum(count[p] == top[p[1]] for p in links)
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), sha))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("row", "pair", "pairs", "times", "n", "b", "top", "best", "start", "end")}).cache()


@pytest.mark.parametrize("most_pairs", [0, 20, 1 << 20])
def test_links_equal_brute_force_whatever_is_broadcast(docs, plain, most_pairs):
    got = [tuple(r) for r in alignment.link_table(docs, A, B, most_pairs).collect()]
    assert sorted(got, key=repr) == digests(plain)


def test_spans_of_all_rows(docs, plain):
    got = sorted((tuple(r.asDict().values()) for r in alignment.align(docs, A, B).collect()), key=repr)
    want = [(i, s, e, list(a), list(b)) for i, t in texts() for s, e, a, b in plain.groups(t)]
    assert got == sorted(want, key=repr)


def test_no_rows(docs):
    assert alignment.link_table(docs.where("false"), A, B).collect() == []
    assert alignment.align(docs.where("false"), A, B).collect() == []

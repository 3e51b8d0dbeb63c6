"""SentencePiece encoding as a shortest path through a composed weighted transducer (operator 9).

Four machines are compiled once: the normaliser (dummy prefix, spaces to
``▁``), the pieces (a string in, its id out), byte fallback (any character the
pieces lack in, its bytes out) and an acceptor of neighbouring pieces.  Their
composition with an input is a lattice over its characters; weights add along
a path and the least one wins, the tropical semiring.

A unigram model weighs a piece by its negative score and accepts any
neighbours.  A merge (BPE) model weighs pieces nothing and accepts two
neighbours only if merging their joint text would give just these two; a
path all of whose neighbours are accepted is the merge result, and there is
one for every prefix, so the lattice needs one state per place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidewell.llm.columns import only

SPACE = "▁"
_ENDLESS = float("inf")
#: Words and neighbour pairs a worker remembers; both start anew beyond.
MOST_WORDS, MOST_PAIRS = 300_000, 1_000_000


class Memory(dict):
    """What a function gave, in two generations of at most ``most`` entries."""

    def __init__(self, make: Callable[[str], bytes], most: int = MOST_WORDS):
        super().__init__()
        self._make, self._most, self._before = make, most, {}

    def age(self) -> None:
        if len(self) > self._most:
            self._before = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        found = self._before.get(key)
        if found is None:
            found = self._make(key)
        if len(key) <= 64:
            self[key] = found
        return found


class Transducer:
    def __init__(self, pieces: Iterable[tuple[str, int, float]], fallback: list[int], merges: bool, dummy_prefix: bool = True):
        """``pieces`` are ``(text, id, score)``; ``fallback[b]`` is the id of byte ``b``."""
        self.merges, self.fallback, self.dummy_prefix = merges, fallback, dummy_prefix
        pieces = list(pieces)
        self.text = {i: t for t, i, _ in pieces}
        self.weight = {t: -s for t, _, s in pieces}
        self.ids = {t: i for t, i, _ in pieces}
        if merges:
            self._compile_neighbours()
        #: every ending of a piece: the piece's id, or -1 if it is no piece itself
        self.ends = {t[k:]: -1 for t in self.ids for k in range(1, len(t))} | self.ids
        inner = {c for t in self.ids if len(t) > 1 for c in t}
        #: neighbouring characters inside pieces; a path breaks between any others
        self.joints = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        #: a line feed that no longer piece holds parts an input; so does a space if it only begins pieces
        self.parted = "\n" not in inner and not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self._start()

    def _start(self) -> None:
        self._words = Memory(self._word)
        #: words by themselves, for their ids after a space
        self._spaced = Memory(lambda word: self._words[SPACE + word])
        self._pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, merges: bool = True) -> Transducer:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        normal = [
            (model.id_to_piece(i), i, model.get_score(i))
            for i in every
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        fallback = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(normal, fallback, merges)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_words", "_spaced", "_pairs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    # -- the acceptor of neighbours ------------------------------------------

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge a short text the plain way; also returns the two sides of the last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            weights = [self.weight.get(a + b, _ENDLESS) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(weights)
            if least == _ENDLESS:
                break
            k = weights.index(least)
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def _compile_neighbours(self) -> None:
        """Per piece, the parts at its two edges while it was merged: ``(text, made at, merged away at)``."""
        sides: dict[str, tuple[str, str] | None] = {}
        for text in self.ids:
            parts, last = self._merge(text)
            if len(parts) == 1:
                sides[text] = last
        self.ids = {t: i for t, i in self.ids.items() if t in sides}  # others can never come out

        def edge(text: str, side: int) -> tuple:
            found, gone = [], _ENDLESS
            while True:
                halves = sides.get(text)
                made = self.weight[text] if halves else -_ENDLESS
                found.append((text, made, gone))
                if not halves:
                    return tuple(found)
                text, gone = halves[side], made

        self.right = {i: edge(t, 1) for t, i in self.ids.items()}
        self.left = {i: edge(t, 0) for t, i in self.ids.items()}

    def accepts(self, first: int, second: int) -> bool:
        """Whether the border between two pieces outlives the merging of their joint text.

        From the last merge backwards, the parts that touch the border at one
        time are looked at: if they form a piece that would have been merged
        before either was merged away, the border falls.
        """
        a, b, i, j, stands = self.right[first], self.left[second], 0, 0, True
        weight = self.weight
        while True:
            (x, x_made, x_gone), (y, y_made, y_gone) = a[i], b[j]
            together = weight.get(x + y, _ENDLESS)
            if together < x_gone and together <= y_gone and together != _ENDLESS:
                stands = False
                break
            if x_made == y_made == -_ENDLESS:
                break
            # the younger part is undone; of equals the right one is younger
            if x_made > y_made:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= MOST_PAIRS:
            self._pairs.clear()
        self._pairs[first, second] = stands
        return stands

    # -- composition and shortest path ------------------------------------

    def normalise(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def _path(self, text: str) -> list[int]:
        """The ids along the least path through the lattice of a normalised text."""
        n, ends = len(text), self.ends
        cost: list[float] = [0.0] + [_ENDLESS] * n
        last: list[int] = [-1] * (n + 1)  # -1: nothing before, or fallen back to bytes
        back = [0] * (n + 1)
        pairs, merges, weight = self._pairs, self.merges, self.weight
        for end in range(1, n + 1):
            start = end - 1
            while start >= 0:
                piece = ends.get(text[start:end])
                if piece is None:
                    break  # no piece ends like this, so none that begins earlier does
                if piece >= 0:
                    if merges:
                        before = last[start]
                        stands = before < 0 or pairs.get((before, piece))
                        if stands is None:
                            stands = self.accepts(before, piece)
                        if stands:
                            cost[end], last[end], back[end] = cost[start], piece, start
                            break
                    elif (total := cost[start] + weight[text[start:end]]) < cost[end]:
                        cost[end], last[end], back[end] = total, piece, start
                start -= 1
            if cost[end] == _ENDLESS and text[end - 1] not in self.ids:
                cost[end], back[end] = cost[end - 1], end - 1
        out: list[list[int]] = []
        end = n
        while end:
            start = back[end]
            fallen = last[end] < 0
            out.append([self.fallback[b] for b in text[start:end].encode()] if fallen else [last[end]])
            end = start
        return [i for part in reversed(out) for i in part]

    def _word(self, word: str) -> bytes:
        """Ids of a word, put together from the parts that no piece can bridge."""
        cuts = [0, *(k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in self.joints), len(word)]
        if len(cuts) > 2:
            return b"".join([self._words[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)])
        return np.array(self._path(word), "<u4").tobytes()

    def _line(self, line: str, leads: bool) -> bytes:
        """Ids of a line; ``leads`` tells whether a dummy prefix stands before it."""
        first, *rest = line.split(" ")
        if first and leads:
            rest.insert(0, first)
        if "" in rest or SPACE in line or (leads and not first):
            # runs of spaces go with the word after them
            normal = (SPACE if leads else "") + line.replace(" ", SPACE)
            return b"".join([self._words[w] for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)])
        spaced = self._spaced
        head = self._words[first] if first and not leads else b""
        return head + b"".join([spaced[w] for w in rest])

    def encode(self, text: str | None) -> np.ndarray:
        """Piece ids of a text; null and empty ones have none."""
        if not text:
            return np.empty(0, "<u4")
        if not self.parted:
            return np.array(self._path(self.normalise(text)), "<u4")
        for memory in (self._words, self._spaced):
            memory.age()
        lines = text.split("\n")
        out = [self._line(lines[0], self.dummy_prefix)] + [self._line(line, False) for line in lines[1:]]
        return np.frombuffer(self._words["\n"].join(out), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of piece ids: bytes join to characters, ``▁`` is a space, the dummy prefix goes."""
        table = getattr(self, "_bytes", None)
        if table is None:
            table = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()}
            table |= {i: bytes([b]) for b, i in enumerate(self.fallback)}
            self._bytes = table
        text = b"".join([table[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def encode_table(docs: DataFrame, path: str, merges: bool = True, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_pieces, n_fallback, ids_crc32, round_trip`` (and ``ids``) per row of ``docs(doc_id, text)``.

    Texts are encoded by the model at ``path`` and decoded again;
    ``round_trip`` tells whether that gave the text back, where a literal
    ``▁`` counts as a space.  Null and empty texts have no pieces and come
    back empty; texts of any length are encoded whole; repeated rows are
    encoded each; other columns are not read.  The compiled machines, whose
    size depends on the vocabulary alone, go to the workers.
    """
    machine = docs.sparkSession.sparkContext.broadcast(Transducer.load(path, merges))
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_fallback", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("round_trip", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)
    ddl = "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = machine.value
        fallen = np.zeros(max(transducer.fallback) + 1, bool)
        fallen[transducer.fallback] = True
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                text = text.as_py() or ""
                ids = transducer.encode(text)
                n_fallen = int(fallen[ids[ids < len(fallen)]].sum())
                same = transducer.decode(ids.tolist()) == text.replace(SPACE, " ")
                rows.append((doc_id, len(ids), n_fallen, zlib.crc32(ids.tobytes()), same, *([ids] * with_ids)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return only(docs, "doc_id", "text").mapInArrow(run, ddl)

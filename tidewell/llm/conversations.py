"""Repair of conversation structure by the cheapest edits (operator 13).

A repaired conversation is empty, or starts with an optional system row and
goes on with pairs of a user and an assistant row.  The edits that reach this
at least cost are found by a Viterbi search over four states.  Survivors form
a tree of back pointers with counted references: as soon as the survivors of
all states share their first edits, these are emitted and forgotten, so a task
holds only the edits that are still open, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after the system row, after a user row, after an assistant row.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state a role's initial leads to, by the state before.
_STEPS = (
    {"s": _SYSTEM, "u": _USER},
    {"u": _USER},
    {"a": _ASSISTANT},
    {"u": _USER},
)
_ROLE = {"u": "user", "a": "assistant"}
_FINAL = (_EMPTY, _ASSISTANT)
_NEIGHBOURS = ("su", "ua", "au")


@dataclass
class Row:
    """A row in its conversation; ``fault`` is blank, duplicate, truncated or empty."""

    role: str
    text: str
    fault: str = ""
    turn: int | None = None


@dataclass(eq=False)
class _Edit:
    """A node of the back-pointer tree; ``refs`` counts its children and the state it survives in.

    A run of deletions that nothing branches off is one node with their number.
    """

    before: _Edit | None
    letter: str
    row: Row | None
    role: str
    n: int = 1
    refs: int = 0
    after: list[_Edit] = field(default_factory=list)


@dataclass
class _Path:
    """A survivor: its cost, the rank of its edits up to its last row, and the letters after that.

    Of two paths that have used up the same rows neither's letters begin the
    other's, once insertions after the last row are set aside.  So their ranks
    order their complete letters, whatever follows, and ``(rank, tail)`` compares two unresolved
    suffixes in full without a walk along them.
    """

    cost: int
    rank: int
    tail: str
    last: _Edit

    @property
    def order(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.tail


class Repairer:
    """Feed the rows of one conversation in order; edits come out once they are certain.

    ``emit(letter, row, role, n)`` is called in order: K keeps a row, R gives
    it another role, I inserts an empty row, D deletes ``n`` rows one after the other.
    """

    def __init__(self, emit: Callable[[str, Row | None, str, int], None]):
        self._emit = emit
        self._root = _Edit(None, "", None, "", refs=1)
        self.open_edits = 0
        self._paths: dict[int, _Path] = {_EMPTY: _Path(0, 0, "", self._root)}
        self._insert()

    # -- the tree -------------------------------------------------------------

    def _grow(self, before: _Edit, letter: str, row: Row | None, role: str) -> _Edit:
        edit = _Edit(before, letter, row, role)
        before.after.append(edit)
        before.refs += 1
        self.open_edits += 1
        return edit

    def _drop(self, edit: _Edit) -> None:
        """Give up one reference; what nobody refers to any more goes, up to the first edit still in use."""
        edit.refs -= 1
        while not edit.refs and edit.before is not None:
            before = edit.before
            before.after.remove(edit)
            before.refs -= 1
            self.open_edits -= 1
            edit = before

    def _settle(self) -> None:
        """Emit the edits that all survivors share."""
        while self._root.refs == 1 and self._root.after:
            (edit,) = self._root.after
            self._emit(edit.letter, edit.row, edit.role, edit.n)
            edit.before = None
            self.open_edits -= 1
            self._root = edit

    # -- the search -----------------------------------------------------------

    def _insert(self) -> None:
        """Let insertions improve the survivors; a chain of them never pays twice for a state."""
        changed = True
        while changed:
            changed = False
            for state in tuple(self._paths):
                path = self._paths[state]
                for initial, following in _STEPS[state].items():
                    if initial == "s":
                        continue
                    order = path.cost + INSERT, path.rank, path.tail + "I"
                    other = self._paths.get(following)
                    if other is None or order < other.order:
                        last = self._grow(path.last, "I", None, _ROLE[initial])
                        last.refs += 1
                        if other is not None:
                            self._drop(other.last)
                        self._paths[following] = _Path(*order, last)
                        changed = True

    def _prune(self) -> None:
        """Give up survivors that can't win any more, which would keep the first edits open for ever.

        What may follow an empty repair may follow an assistant's row too, but
        for one system row, whose deletion costs 2; all that may follow a
        system row may follow an assistant's.
        """
        best = self._paths.get(_ASSISTANT)
        if best is None:
            return
        empty, system = self._paths.get(_EMPTY), self._paths.get(_SYSTEM)
        if empty is not None and empty.cost > best.cost + DELETE:
            self._drop(self._paths.pop(_EMPTY).last)
        if system is not None and system.order > best.order:
            self._drop(self._paths.pop(_SYSTEM).last)

    def add(self, row: Row) -> None:
        choices: dict[int, tuple[tuple[int, int, str], _Path, str]] = {}

        def offer(state: int, path: _Path, letter: str, cost: int, role: str) -> None:
            order = path.cost + cost, path.rank, path.tail + letter
            if state not in choices or order < choices[state][0]:
                choices[state] = order, path, role

        initial, kept = row.role[:1], TRUNCATED * (row.fault == "truncated")
        for state, path in self._paths.items():
            offer(state, path, "D", DELETE, "")
            if row.fault in ("blank", "duplicate"):
                continue
            for letter, following in _STEPS[state].items():
                if letter == initial:
                    offer(following, path, "K", KEEP + kept, row.role)
                elif letter != "s":
                    offer(following, path, "R", REROLE + kept, _ROLE[letter])
        # the letters up to this row, in order, become the new ranks
        ranks = {o: i for i, o in enumerate(sorted({c[0][1:] for c in choices.values()}))}
        for _, path, _ in choices.values():
            path.last.refs += 1  # held while the old survivors go
        for path in self._paths.values():
            self._drop(path.last)
        paths = {}
        for state, (order, path, role) in choices.items():
            letter, last = order[2][-1], path.last
            if letter == "D" == last.letter and last.refs == 1 and last is not self._root:
                last.n += 1
            else:
                held, last = last, self._grow(last, letter, None if letter == "D" else row, role)
                last.refs += 1
                held.refs -= 1
            paths[state] = _Path(order[0], ranks[order[1:]], "", last)
        self._paths = paths
        self._insert()
        self._prune()
        self._settle()

    def finish(self) -> int:
        """Emit the rest and return the least cost."""
        best = min((self._paths[s] for s in _FINAL if s in self._paths), key=lambda p: p.order)
        for path in self._paths.values():
            if path is not best:
                self._drop(path.last)
        # one survivor is left, so all of its edits are shared
        best.last.refs -= 1
        while self._root.after:
            (edit,) = self._root.after
            self._emit(edit.letter, edit.row, edit.role, edit.n)
            self._root = edit
        return best.cost


# -- rows as Spark hands them out -----------------------------------------------


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` with faults made by ``crc32(conv_id:turn) % 20``.

    0 marks a row as ``gone``, 1 empties its text, 2 takes out ``.!?``, 3
    repeats it, 4 makes it the user's.  Nulls read as one space, but ``conv_id``
    and ``turn`` stay as they are.
    """
    draw = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", draw.alias("draw"), _filled("role").alias("role"), _filled("text").alias("text"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    gone = F.col("draw") == 0
    times = F.when(F.col("draw") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(~gone, role).alias("role"),
        F.when(~gone, text).alias("text"),
        gone.alias("gone"),
        F.explode(F.sequence(F.lit(1), times)).alias("copy"),
    ).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order, with their first fault.

    One shuffle, by conversation: repeats are numbered and rows put in order by
    sorts inside its partitions, which spill.  Equal turns go by role and text, so the copies of
    a row stand together.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    read = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"),
        (F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)).alias("gone"),
        F.sha2(text, 256).alias("digest"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.asc_nulls_first("turn"))
    # the last character that is no white space
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = (
        F.when(last == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    judged = read.withColumn("fault", fault).select("conv_id", "gone", "turn", "role", "text", "fault")
    return judged.sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "gone", F.asc_nulls_first("turn"), "role", "text", F.col("fault") == "duplicate"
    )


_NO_KEY = object()


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable, add: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Walk through sorted rows; ``begin``, ``add`` and ``end`` see one conversation after the other."""
    key: Any = _NO_KEY
    for batch in batches:
        columns = [batch[i].to_pylist() for i in range(6)]
        for conv_id, gone, turn, role, text, fault in zip(*columns, strict=True):
            if key is _NO_KEY or conv_id != key:
                if key is not _NO_KEY:
                    yield from end()
                key = conv_id
                begin(conv_id)
            if not gone:
                yield from add(Row(role, text, fault, turn)) or ()
    if key is not _NO_KEY:
        yield from end()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _key_type(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repair(rows: DataFrame) -> DataFrame:
    """The edits that repair ``rows(conv_id, turn, role, text)``: ``conv_id, at, edit, n_rows, role, text``.

    ``at`` numbers the edits of a conversation; an edit of kind D deletes
    ``n_rows`` rows one after the other.  Role and text are the repaired row's; a
    deletion has neither, an inserted row an empty text and no rows.
    Rows go by turn, nulls first, then role and text.  Nulls in role and text
    read as one space; a null ``conv_id`` is a conversation of its own; rows that
    repeat are duplicates; rows with a true column ``gone`` are left out.  Of equally cheap repairs the one whose
    edits come first in ASCII is taken.  A conversation is streamed, not
    collected; texts are handed on as soon as their edit is certain.
    """
    name, kind = _key_type(rows)
    fields = [("conv_id", kind), ("at", pa.int64()), ("edit", pa.string()), ("n_rows", pa.int64())]
    schema = pa.schema([*fields, ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict[str, Any] = {}

        def begin(conv_id) -> None:
            state["at"] = 0

            def emit(letter: str, row: Row | None, role: str, n: int) -> None:
                deleted = letter == "D"
                text = row.text if row else None if deleted else ""
                out.append((conv_id, state["at"], letter, n * (letter != "I"), None if deleted else role, text))
                state["at"] += 1

            state["repairer"] = Repairer(emit)

        def hand_on(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                yield _batch(out, schema)
                out.clear()

        def add(row: Row) -> Iterable[pa.RecordBatch]:
            state["repairer"].add(row)
            return hand_on(1000)

        def end() -> Iterable[pa.RecordBatch]:
            state["repairer"].finish()
            return hand_on(1000)

        yield from _conversations(batches, begin, add, end)
        yield from hand_on(0)

    ddl = f"conv_id {name}, at long, edit string, n_rows long, role string, text string"
    return _judged(rows).mapInArrow(run, ddl)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digest(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and edits of its repair, and a hash of the repaired rows.

    The same search as ``repair``, folded while its edits come out: what is
    held of a conversation is the letters of its edits.  The hash runs over the repaired rows
    in order, which is why one conversation stays in one task.  A conversation all of whose
    rows are gone gives zeros and the hash of nothing; no rows give none.
    """
    name, kind = _key_type(rows)
    schema = pa.schema(
        [("conv_id", kind), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: dict[str, Any] = {}

        def begin(conv_id) -> None:
            audit, sha = bytearray(), hashlib.sha256()
            parts = [b""]

            def emit(letter: str, row: Row | None, role: str, n: int) -> None:
                audit.extend(letter.encode() * n)
                if letter != "D":
                    sha.update(parts[0] + f"{role}:{row.text if row else ''}".encode(errors="surrogatepass"))
                    parts[0] = b"\n"

            now.clear()
            now.update(conv_id=conv_id, audit=audit, sha=sha, repairer=Repairer(emit), illegal=0, before=None)
            now.update(blank=0, duplicate=0, truncated=0, least=None, most=None, turns=0)

        def add(row: Row) -> None:
            if now["before"] is not None and now["before"] + row.role[:1] not in _NEIGHBOURS:
                now["illegal"] += 1
            now["before"] = row.role[:1]
            if row.fault:
                now[row.fault] += 1
            if row.turn is not None and row.turn != now["most"]:  # rows come by turn
                now["least"] = row.turn if now["least"] is None else now["least"]
                now["most"] = row.turn
                now["turns"] += 1
            now["repairer"].add(row)

        def end() -> Iterable[pa.RecordBatch]:
            cost = now["repairer"].finish()
            gaps = 0 if now["least"] is None else now["most"] - now["least"] + 1 - now["turns"]
            counts = (gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost)
            out.append((now["conv_id"], *counts, now["audit"].decode(), now["sha"].hexdigest()))
            if len(out) >= 1000:
                yield _batch(out, schema)
                out.clear()

        yield from _conversations(batches, begin, add, end)
        yield _batch(out, schema)

    ddl = f"conv_id {name}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return _judged(rows).mapInArrow(run, ddl)

"""Repair of the structure of conversations: the cheapest edits after which roles follow the grammar ``(s?(ua)+)?``.

A turn is kept (0), given the role that the grammar wants (3), or deleted (4, the only way for a blank or a repeated one); a
turn without text may be inserted anywhere (3). A truncated turn that stays costs 3 more. Cost-to-go is computed backward
over (turn, grammar state); a walk forward takes, of the edits that keep to the least cost, the one first in ASCII.

A conversation passes through one task twice in one sorted stream: first a byte a turn, then the texts, which are hashed
as they come. Memory is some bytes for each turn, never texts; SHA-256 of a whole conversation has to be taken in order.
What was seen earlier is told by a join of (conversation, digest, turn), so one text repeated over any number of turns is no
group of its own.

Defined cases: nulls of role, text and turn (in the key of the damage) are one space; a null conv_id is a conversation of
its own; null turns come first; rows of one turn stand in the order of their digests. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conversations import by_group, digest, turns

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that a kept initial leads to, by state; what else is wanted is a user, or after a user an assistant.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The code of a turn that has to go; those of others tell their initial and whether they are truncated.
GONE = 0
#: Above the cost of any state that can end.
ENDLESS = 1000
SCHEMA = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` after the damage, with column copies: 0 for a dropped row, 2 for a repeated one."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _last() -> Column:
    """The last character that is no blank; an empty string where there is none."""
    return F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, copies, initial, blank, truncated and first (nothing earlier is equal) of damaged rows, without texts.

    Equal rows of one turn are one row here; copies counts them.
    """
    last = _last()
    marks = rows.select("conv_id", "turn", digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "copies")
    marks = marks.groupBy("conv_id", "turn", "digest", "initial", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    stand = marks.where("copies > 0")
    # nulls come first, and min() of a struct says so
    earliest = stand.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(F.struct("turn")).alias("_least"))
    earliest = earliest.select("_conv", "_digest", F.col("_least.turn").alias("_turn"), F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("digest") == F.col("_digest"))
    return marks.join(earliest, same, "left").select(*marks.columns, F.coalesce("first", F.lit(False)).alias("first"))


def step(code: int, after: tuple) -> tuple[int, tuple, bytes]:
    """Costs-to-go before a turn from those after it (less their least), and for each state the first edit that keeps to them."""
    letters = [{} for _ in range(4)]
    for q in range(4):
        letters[q]["D"] = DELETE + after[q]
        if code != GONE:
            initial, late = code_of(code)
            if initial in FOLLOWS[q]:
                letters[q]["K"] = late + after[FOLLOWS[q][initial]]
            letters[q]["R"] = REROLE + late + after[WANTED[q]]
    return settled(letters)


def settled(letters: list[dict]) -> tuple[int, tuple, bytes]:
    """The same, from the costs of each state's edits without insertions; insertions lead from state to state at one turn."""
    cost = [min(x.values(), default=ENDLESS) for x in letters]
    for _ in range(3):  # a state is at most three insertions from any other that it can reach
        cost = [min(c, INSERT + cost[WANTED[q]]) for q, c in enumerate(cost)]
    tight = "".join(min(x for x, c in (letters[q] | {"I": INSERT + cost[WANTED[q]]}).items() if c == cost[q]) for q in range(4))
    least = min(cost)
    return least, tuple(c - least for c in cost), tight.encode()


def code_of(code: int) -> tuple[str, int]:
    """The initial of a turn's code, and what it costs that the turn is truncated."""
    return "sua?"[(code - 1) // 2], TRUNCATED * ((code - 1) % 2)


class Plan:
    """The edits of one conversation, from the codes of its turns: ``turn`` gives the lines that stand for the next turn."""

    def __init__(self, codes: bytearray, known: dict) -> None:
        self.codes, self.at, self.state = codes, 0, START
        least, after, end = settled([{"E": 0} if q in ENDS else {} for q in range(4)])
        self.letters, self.cost = bytearray(end), least
        for code in reversed(codes):
            got = known.get((code, after))
            if got is None:
                got = known[code, after] = step(code, after)
            self.cost += got[0]
            after = got[1]
            self.letters += got[2]
        self.cost += after[START]
        self.audit = bytearray()

    def _edit(self) -> str:
        letter = self.letters[4 * (len(self.codes) - self.at) + self.state]
        if letter != ord("E"):
            self.audit.append(letter)
        return chr(letter)

    def inserted(self) -> tuple[list[str], str]:
        """Lines inserted before the next turn, and the edit of that turn (E: there is none)."""
        lines = []
        while (letter := self._edit()) == "I":
            self.state = WANTED[self.state]
            lines.append(f"{ROLES[self.state]}:")
        return lines, letter

    def turn(self, role: str, text: str) -> list[str]:
        lines, letter = self.inserted()
        if letter == "K":
            self.state = FOLLOWS[self.state][role[:1]]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            self.state = WANTED[self.state]
            lines.append(f"{ROLES[self.state]}:{text}")
        self.at += 1
        return lines


class Conversation:
    """What the stream has told of one conversation so far."""

    def __init__(self) -> None:
        self.codes, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.least = self.most = self.before = None
        self.turns, self.plan, self.hash, self.lines = 0, None, hashlib.sha256(), 0

    def mark(self, turn: int | None, copies: int, initial: str, blank: bool, truncated: bool, first: bool) -> None:
        """A turn without its text; equal turns come as one with its copies."""
        if not copies:
            return
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        self.illegal += copies - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before = initial
        stays = first and not blank
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - first
        self.truncated += stays and truncated
        self.codes.append(1 + 2 * ("sua".find(initial) if initial in ("s", "u", "a") else 3) + truncated if stays else GONE)
        self.codes += bytes(copies - 1)

    def _hashed(self, lines: list[str]) -> None:
        for line in lines:
            self.hash.update((b"\n" if self.lines else b"") + line.encode())
            self.lines += 1

    def text(self, copies: int, role: str, text: str, known: dict) -> None:
        self.plan = self.plan or Plan(self.codes, known)
        for _ in range(copies):
            self._hashed(self.plan.turn(role, text))

    def row(self, conv_id: int | None, known: dict) -> tuple:
        plan = self.plan or Plan(self.codes, known)
        self._hashed(plan.inserted()[0])
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, plan.cost, plan.audit.decode(), self.hash.hexdigest()


def _repaired(rows):
    """Marks, then texts, of each conversation in order -> its row."""
    known: dict = {}
    conv, now = None, None
    for conv_id, part, turn, _, copies, initial, blank, truncated, first, role, text in rows:
        if now is None or conv != conv_id:
            if now is not None:
                yield now.row(conv, known)
            conv, now = conv_id, Conversation()
        if part:
            now.text(copies, role, text, known)
        else:
            now.mark(turn, copies, initial, blank, truncated, first)
    if now is not None:
        yield now.row(conv, known)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, copies; no nulls in role and text)."""
    marks = judged(rows).select("conv_id", F.lit(0).alias("part"), "turn", "digest", "copies", "initial", "blank", "truncated", "first", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("initial", "string"), ("blank", "boolean"), ("truncated", "boolean"), ("first", "boolean"))]
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", digest().alias("digest"), "copies", *none, "role", "text")
    stream = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "digest")
    return stream.mapInArrow(by_group(_repaired, SCHEMA, stream.columns), SCHEMA)


def conversation_repair(table: DataFrame) -> DataFrame:
    """Damages the conversations of ``table`` by a hash of their keys and repairs them; one row for each."""
    return repair(damaged(turns(table, null=" ")))

"""Repair of conversation structure over a suffix-shared automaton (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import materialize, table
from fleetframe.operators.scan import VOLUME_COLUMN, by_volume, running

# Fixed values of the contract: white space, ends of sentences, costs, and the
# grammar (s?(ua)+)? as a table of the states behind nothing, s, u and a: which
# role's initial leads from a state to which, and the role an insertion adds.
SPACE = " \t\n\x0b\f\r"
STOPS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = ("u", "u", "a", "u")
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_NEVER = 1 << 60


# --- the automaton -------------------------------------------------------------------------

class Node:
    """A suffix of signatures: its cost to go and best first edit in each
    state, and the counts of its faults.  Longer suffixes share it."""
    __slots__ = ("cost", "edit", "leads", "next", "first", "blank", "duplicate", "truncated", "illegal")

    def __init__(self, code: str | None, nxt: "Node | None", exit_: list[int] | None):
        self.next, self.first = nxt, code and code[0]
        if code is None:  # the end: of the conversation, or of a block whose sequel costs ``exit_``
            self.blank = self.duplicate = self.truncated = self.illegal = 0
            options = [[] for _ in STEPS]
            self.cost = list(exit_) if exit_ else [0 if q in ACCEPTED else _NEVER for q in range(4)]
            if exit_:
                self.edit, self.leads = [""] * 4, [0, 1, 2, 3]
                return
        else:
            role, fault = code
            self.blank = nxt.blank + (fault == "b")
            self.duplicate = nxt.duplicate + (fault == "d")
            self.truncated = nxt.truncated + (fault == "t")
            self.illegal = nxt.illegal + (nxt.first is not None and role + nxt.first not in LEGAL)
            extra = TRUNCATED if fault == "t" else 0
            options = []
            for q, steps in enumerate(STEPS):
                found = [(DELETE + nxt.cost[q], "D", q)]
                if fault in ".t":
                    if role in steps:
                        found.append((extra + nxt.cost[steps[role]], "K", steps[role]))
                    found += [(extra + REROLE + nxt.cost[to], "R", to) for x, to in steps.items()
                              if x in ROLES and x != role]
                options.append(found)
            self.cost = [min(o)[0] for o in options]
        for _ in range(3):  # insertions chain through at most three states
            self.cost = [min(c, INSERT + self.cost[STEPS[q][ADDED[q]]]) for q, c in enumerate(self.cost)]
        self.edit, self.leads = [], []
        for q, found in enumerate(options):
            # each edit leads to one state, so the least letters make the least audit
            best = [(letter, to) for c, letter, to in found if c == self.cost[q]]
            to = STEPS[q][ADDED[q]]
            if self.cost[q] == INSERT + self.cost[to]:
                best.append(("I", to))
            letter, to = min(best, default=("", q))
            self.edit.append(letter)
            self.leads.append(to)

    def audit(self, state: int) -> tuple[str, int]:
        """The best edits from here, and the state they lead to."""
        node, letters = self, []
        while node is not None:
            letter = node.edit[state]
            letters.append(letter)
            state = node.leads[state]
            if letter != "I":
                node = node.next
        return "".join(letters), state


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures sorted from their ends -> their costs and audits.

    Neighbours share suffixes: the nodes of the last signature form a chain
    from the end, of which the part both share is kept and the rest made anew.
    """
    exit_, backward, chain = None, "", [Node(None, None, None)]
    for b in batches:
        out = []
        for sig, goes in zip(b.column("sig").to_pylist(), b.column("exit").to_pylist()):
            back = sig[::-1]
            if goes != exit_:
                exit_, backward, chain = goes, "", [Node(None, None, goes)]
            shared = 0
            while shared < min(len(back), len(backward)) and back[shared:shared + 2] == backward[shared:shared + 2]:
                shared += 2
            del chain[shared // 2 + 1:]
            for i in range(shared, len(back), 2):
                chain.append(Node(back[i + 1] + back[i], chain[-1], None))
            backward, node = back, chain[-1]
            ways = [node.audit(q) for q in range(4)]
            out.append({"sig": sig, "exit": goes, "cost": node.cost, "audits": [w for w, _ in ways],
                        "leave": [q for _, q in ways], "blank": node.blank, "duplicate": node.duplicate,
                        "truncated": node.truncated, "illegal": node.illegal})
        yield pa.RecordBatch.from_pylist(out, schema=_SOLVED)


_SOLVED = pa.schema([("sig", pa.string()), ("exit", pa.list_(pa.int64())), ("cost", pa.list_(pa.int64())),
                     ("audits", pa.list_(pa.string())), ("leave", pa.list_(pa.int32())),
                     *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]])


def solve(signatures: DataFrame) -> DataFrame:
    """Every distinct ``(sig, exit)`` once, with the cost to go, audit and
    final state of each of the four grammar states and the counts of faults.

    ``sig`` has two letters a row: the role's initial (``o`` for others) and
    the fault (``b``, ``d``, ``t`` or ``.``).  The signatures are dealt and
    sorted by their ends, so those that share a suffix lie side by side and
    the suffix's nodes are made once for all of them.
    """
    ends = F.reverse("sig")
    return (signatures.select("sig", "exit").distinct().repartitionByRange("exit", ends)
            .sortWithinPartitions("exit", ends).mapInArrow(
                _solve, "sig string, exit array<long>, cost array<long>, audits array<string>, leave array<int>, "
                        "blank long, duplicate long, truncated long, illegal long"))


# --- rows -> signatures --------------------------------------------------------------------

def _same(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(b[f"_{c}"])
    return on


def _joined(a: DataFrame, b: DataFrame, *cols: str, how: str = "inner") -> DataFrame:
    """A join on columns of which nulls are equal."""
    named = b.select(*[F.col(c).alias(f"_{c}") for c in cols], *[c for c in b.columns if c not in cols])
    return a.join(named, _same(a, named, *cols), how).drop(*[f"_{c}" for c in cols])


def _cells(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: ``(c, t, r, g, n, sig)``, ``g`` the
    text's digest, ``sig`` the signature of its ``n`` rows, side by side."""
    fault = F.when(F.btrim("x", F.lit(SPACE)) == "", 2).when(
        F.instr(F.lit(STOPS), F.right(F.rtrim("x", F.lit(SPACE)), F.lit(1))) == 0, 1).otherwise(0)
    cells = materialize(rows.select("c", "t", "r", "g", fault.alias("fault")).groupBy("c", "t", "r", "g").agg(
        F.count("*").alias("n"), F.max("fault").alias("fault")), "conversations-cells")
    firsts = cells.groupBy("c", "r", "g").agg(F.max(F.col("t").isNull()).alias("none"), F.min("t").alias("least"))
    both = _joined(cells, firsts, "c", "r", "g")
    initial = F.substring("r", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    first = F.when(F.col("none"), F.col("t").isNull()).otherwise(F.col("t") == F.col("least"))
    own = F.when(F.col("fault") == 2, "b").when(~first, "d").when(F.col("fault") == 1, "t").otherwise(".")
    again = F.when(F.col("fault") == 2, "b").otherwise("d")
    return both.select("c", "t", "r", "g", "n", F.concat(role, own, F.repeat(F.concat(role, again), (
        F.col("n") - 1).cast("int"))).alias("sig"))


def _blocks(cells: DataFrame, rows: int) -> DataFrame:
    """``(c, block, cells, sig)``: the cells of each conversation in order,
    cut into blocks of about ``rows`` rows."""
    cut = by_volume(cells, ["c"], ["t", "r", "g"])
    placed = running(cut, ["c"], ["t", "r", "g"], F.col(VOLUME_COLUMN), sums={"upto": F.col("n")})
    at = F.col("upto") - F.col("n")
    one = F.struct(at.alias("at"), "t", "r", "g", "sig")
    return placed.groupBy("c", F.floor(at / rows).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("cells")) \
        .withColumn("sig", F.array_join("cells.sig", ""))


# --- conversations of more than one block --------------------------------------------------

def _exits(schema: T.StructType):
    """Costs of each block from state to state -> what its sequel costs,
    block by block from the end, less the least of the four."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, blocks in zip(b.column("c").to_pylist(), b.column("blocks").to_pylist()):
                sequel = Node(None, None, None).cost
                for x in reversed(blocks):
                    out.append({"c": c, "block": x["block"], "exit": None if x is blocks[-1] else
                                [v - min(sequel) for v in sequel]})
                    sequel = [min(m + s for m, s in zip(row, sequel)) for row in x["costs"]]
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))
    return run


def _entries(schema: T.StructType):
    """The states each block leaves -> the state it is entered in, and whether
    its first row's role follows the one before it illegally."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, blocks in zip(b.column("c").to_pylist(), b.column("blocks").to_pylist()):
                state, role = 0, None
                for x in blocks:
                    out.append({"c": c, "block": x["block"], "entry": state,
                                "seam": int(role is not None and role + x["first"] not in LEGAL)})
                    state, role = x["leave"][state], x["last"]
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))
    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _with_key(key: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("c", key), *T.StructType.fromDDL(rest).fields])


def _answered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the state each is entered in and its answer in
    :func:`solve`.  Only conversations of several blocks need what other
    blocks cost: their costs from state to state are chained per conversation,
    one small row a block."""
    key = blocks.schema["c"].dataType
    longer = blocks.filter("block > 0").select("c").distinct()
    several = _joined(blocks.select("c", "block", "sig"), longer, "c", how="left_semi")
    units = F.array(*[F.array(*[F.lit(0 if i == j else _NEVER) for j in range(4)]) for i in range(4)])
    ways = solve(several.select("sig").distinct().select("sig", F.explode(units).alias("exit")))
    turned = ways.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct(
        F.array_position("exit", F.lit(0).cast("long")).alias("to"), "cost"))).alias("to")).select(
            "sig", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.transform(
                F.col("to.cost"), lambda x: F.get(x, q))).alias("costs"))
    chained = several.join(turned, "sig").groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("blocks"))
    schema = _with_key(key, "block long, exit array<long>")
    exits = materialize(chained.mapInArrow(_exits(schema), schema), "conversations-exits")
    asked = materialize(_joined(blocks, exits, "c", "block", how="left"), "conversations-asked")
    solved = materialize(solve(asked), "conversations-solved")
    met = materialize(_joined(asked, solved, "sig", "exit"), "conversations-answers")
    chained = _joined(met, longer, "c", how="left_semi").groupBy("c").agg(F.sort_array(F.collect_list(F.struct(
        "block", "leave", F.substring("sig", 1, 1).alias("first"),
        F.substring(F.right("sig", F.lit(2)), 1, 1).alias("last")))).alias("blocks"))
    schema = _with_key(key, "block long, entry int, seam long")
    entries = chained.mapInArrow(_entries(schema), schema)
    entered = _joined(met, entries, "c", "block", how="left")
    entry = F.coalesce("entry", F.lit(0))
    left = F.get("leave", entry)
    return entered.select(
        "c", "block", "cells", entry.alias("entry"), F.get("audits", entry).alias("audit"),
        (F.get("cost", entry) - F.coalesce(F.get("exit", left), F.lit(0))).alias("cost"),
        "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"))


# --- audits -> repaired conversations ------------------------------------------------------

def _edits(schema: T.StructType):
    """Blocks with audits -> what becomes of each cell that leaves something:
    ``side`` 0 has the insertions before it and its row's role if that stays,
    ``side`` 2 the insertions behind a block's last cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                c, cells = one.column("c")[0].as_py(), one.column("cells")[0].as_py()
                audit, state, at, out, added = one.column("audit")[0].as_py(), one.column("entry")[0].as_py(), 0, [], ""
                for cell in cells:
                    role = None
                    for row in range(len(cell["sig"]) // 2):
                        while audit[at] == "I":
                            added, state, at = added + ADDED[state], STEPS[state][ADDED[state]], at + 1
                        letter, at = audit[at], at + 1
                        if letter == "K":
                            role, state = cell["r"], STEPS[state][cell["sig"][2 * row]]
                        elif letter == "R":
                            x = next(x for x in STEPS[state] if x in ROLES)
                            role, state = ROLES[x], STEPS[state][x]
                        if letter != "D":
                            out.append({"c": c, "t": cell["t"], "r": cell["r"], "g": cell["g"], "side": 0,
                                        "added": added, "role": role})
                            added = ""
                while at < len(audit):  # only insertions are left
                    added, state, at = added + ADDED[state], STEPS[state][ADDED[state]], at + 1
                if added:
                    out.append({"c": c, "t": cell["t"], "r": cell["r"], "g": cell["g"], "side": 2, "added": added,
                                "role": None})
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Edits and texts, sorted -> ``(conversation, role, text)`` row by row,
    and ``(conversation, None, None)`` before each conversation's first.
    Nothing but the cell at hand is held."""
    last, cell, role = [], None, None
    for b in batches:
        cols = [b.column(x).to_pylist() for x in ("c", "t", "r", "g", "side", "added", "role", "x")]
        for c, t, r, g, side, added, to, text in zip(*cols):
            if last != [c]:
                last, cell = [c], None
                yield c, None, None
            if side == 1:
                if cell == (t, r, g):
                    yield c, role, text
                    cell = None  # equal rows of the turn are gone
                continue
            for x in added:
                yield c, ROLES[x], ""
            cell, role = ((t, r, g), to) if to is not None else (None, None)


def _slices(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str))
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def _texts(schema: T.StructType):
    def run(batches):
        def rows():
            n = 0
            for c, role, text in _merged(batches):
                n = 0 if role is None else n + 1
                if role is not None:
                    yield c, n - 1, role, text
        yield from _slices(rows(), _arrow(schema))
    return run


def _digests(schema: T.StructType):
    def run(batches):
        def rows():
            name, sha, first = None, None, True
            for c, role, text in _merged(batches):
                if role is None:
                    if sha:
                        yield name, sha.hexdigest()
                    name, sha, first = c, hashlib.sha256(), True
                else:
                    sha.update((("" if first else "\n") + role + ":").encode())
                    sha.update(text.encode())
                    first = False
            if sha:
                yield name, sha.hexdigest()
        yield from _slices(rows(), _arrow(schema))
    return run


class Repair:
    """The cheapest repair of every conversation.

    A conversation's rows count in the order of their turns (null turns first;
    rows of one turn by role, then by the MD5 of the text).  A row's first
    fault counts: ``blank`` (white space only), ``duplicate`` (an equal role
    and text before it), ``truncated`` (no ``.``, ``!`` or ``?`` at the end).
    Edits keep a row, give it another role (1), delete it (2; blank and
    duplicate rows must go) or insert an empty row (5); a truncated row that
    stays costs 5 more.  The role initials must come to ``(s?(ua)+)?``; of the
    cheapest audits the ASCII-least is taken.

    Each conversation is a signature of roles and faults.  Distinct signatures
    are solved once for all conversations (:func:`solve`) and the answers
    joined back.  What is shuffled for that are digests, not texts; a long
    conversation is cut into blocks of ``block`` rows, which are chained
    through the costs between their states, so none is gathered.  Texts are
    shuffled once, to be put out in order.

    Defined cases: null roles and texts count as one space, a null
    conversation is one like any other; repeated rows are duplicates; very
    long texts are passed on as they are; an empty table gives no rows; other
    columns are ignored.
    """

    def __init__(self, df: DataFrame, conv: str, turn: str, role: str, text: str, block: int = 4096):
        named = lambda c: F.col(f"`{c}`")
        space = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
        self.names = (conv, turn, role, text)
        self._rows = df.select(named(conv).alias("c"), named(turn).alias("t"), space(role).alias("r"),
                               space(text).alias("x")).withColumn("g", F.md5(F.col("x").cast("binary")))
        self._cells = materialize(_cells(self._rows), "conversations-signed")
        self._answers = materialize(_answered(materialize(_blocks(self._cells, block), "conversations-blocks")),
                                    "conversations-audits")

    def report(self) -> DataFrame:
        """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``
        for every conversation: turns missing between the least and largest,
        the faults, adjacent roles that may not follow each other, the cost
        and the letters (K, R, D, I) of the edits."""
        turns = self._cells.groupBy("c").agg(F.min("t").alias("low"), F.max("t").alias("high"),
                                             F.count_distinct("t").alias("n"))
        wide = F.col("high").cast("decimal(38,0)") - F.col("low") + 1 - F.col("n")
        most = F.lit(2 ** 63 - 1).cast("decimal(38,0)")
        gaps = F.when(F.col("n") == 0, 0).otherwise(F.least(wide, most)).cast("long")
        sums = self._answers.groupBy("c").agg(
            *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")],
            F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit"))).getField("audit"), "").alias("audit"))
        both = _joined(sums, turns.select("c", gaps.alias("gaps")), "c")
        return both.select(F.col("c").alias(self.names[0]), "gaps", "blank", "duplicate", "truncated", "illegal",
                           "cost", "audit")

    def _ordered(self) -> DataFrame:
        """Edits and texts of a conversation in one partition, in order: the
        only place where a conversation's texts meet, row by row."""
        schema = T.StructType([*self._rows.select("c", "t", "r", "g").schema.fields, *T.StructType.fromDDL(
            "side int, added string, role string").fields])
        edits = self._answers.select("c", "cells", "audit", "entry").mapInArrow(_edits(schema), schema)
        texts = self._rows.select("c", "t", "r", "g", F.lit(1).alias("side"), F.lit(None).cast("string").alias("added"),
                                  F.lit(None).cast("string").alias("role"), "x")
        return edits.withColumn("x", F.lit(None).cast("string")).unionByName(texts).repartition("c") \
            .sortWithinPartitions("c", "t", "r", "g", "side")

    def rows(self) -> DataFrame:
        """The repaired conversations: ``(conv, place, role, text)``."""
        schema = _with_key(self._rows.schema["c"].dataType, "place long, role string, text string")
        conv, _, role, text = self.names
        return self._ordered().mapInArrow(_texts(schema), schema).toDF(conv, "place", role, text)

    def digests(self) -> DataFrame:
        """``(conv, sha256)`` of the repaired ``role:text`` lines.  A SHA-256
        is one pass over its input, so a conversation's texts go through one
        task; they are streamed, not held."""
        schema = _with_key(self._rows.schema["c"].dataType, "sha256 string")
        return self._ordered().mapInArrow(_digests(schema), schema).withColumnRenamed("c", self.names[0])


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The contract's damage, by ``crc32(conv:turn) % 20``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank(conv), blank(turn)).cast("binary")) % 20
    return df.select(conv, turn, blank(role).alias(role), blank(text).alias(text), kind.alias("_kind")) \
        .filter("_kind != 0").select(
            conv, turn, F.when(F.col("_kind") == 4, "user").otherwise(F.col(role)).alias(role),
            F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, STOPS, ""))
            .otherwise(F.col(text)).alias(text),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations after the contract's damage."""
    talks = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    repair = Repair(damaged(talks, "conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")
    every = talks.select("conv_id").distinct()
    found = _joined(_joined(every, repair.report(), "conv_id", how="left"), repair.digests(), "conv_id", how="left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


__all__ = ["Node", "solve", "Repair", "damaged", "op11_conversations"]

"""Conversation structure repair: the cheapest edits that make the roles of a
conversation read ``(s?(ua)+)?``.

Every edit path is one integer: its high digits are the cost, its low digits the
audit letters, one fixed-width digit a letter, the first letter highest, zeros
after the last. The least integer is then the cheapest path and, among equal
costs, the one whose audit is ASCII-least (a zero end sorts a prefix first), so
an ordinary minimum over the edges of a DAG of (row, state) decides everything.
A letter's place depends on how many letters precede it, so the DP runs from
the last row backwards: putting a letter in front moves the low digits one place
down, which keeps the order of any two suffixes of the same node.

Long conversations are cut into blocks: rows are spread by (conversation, range
of turns), a block yields its least path for each pair of entry and exit states,
and only these summaries meet per conversation. Texts are shuffled once; they
stream in order through one pass that applies the audit. Nothing but the audit
of one conversation (one output cell) is ever held whole.

Rows of a turn are ordered by role and MD5 of the text; null roles and texts
are one space; a null conversation id is a conversation of its own; repeated rows
are rows (the later ones are duplicates); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import discard, slices, table, write_table

RE_ROLE, DELETE, INSERT = 3, 4, 3  # costs of the edits; Keep costs nothing
TRUNCATED = 3  # cost of a truncated row that stays
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}  # in ASCII order; 0 is the end
LETTER = " DIKR"
WIDTH = 3  # bits of a digit
START, SYSTEM, USER, ASSISTANT = range(4)  # state: the last role put out
STATES = 4
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what Rerole and Insert give
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
BLOCK_ROWS = 512
BLOCK_TURNS = 4096  # turns of a conversation that meet in one task before the summaries
SPACE = r"\x20\x09-\x0D"

SUMMARY = (
    "conv long, lo long, start_turn long, start_role string, start_th string, n long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, min_turn long, max_turn long, turns long, paths array<string>"
)
REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
OUT = "conv_id long, report struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>, pos long, edit string, turn long, role string, text string"


class Weights:
    """Paths as integers with room for ``letters`` audit letters."""

    def __init__(self, letters: int):
        self.bits = WIDTH * letters
        self.top = self.bits - WIDTH
        self.low = (1 << self.bits) - 1

    def put(self, letter: str, cost: int, path: int) -> int:
        """``path`` with a letter before its first one."""
        return (((path >> self.bits) + cost) << self.bits) | (DIGIT[letter] << self.top) | ((path & self.low) >> WIDTH)

    def join(self, cost: int, letters: str, path: int) -> int:
        """``path`` with a whole run of letters before its first one."""
        x = 0
        for c in letters:
            x = x << WIDTH | DIGIT[c]
        n = WIDTH * len(letters)
        return (((path >> self.bits) + cost) << self.bits) | (x << (self.bits - n)) | ((path & self.low) >> n)

    def read(self, path: int) -> tuple[int, str]:
        """(cost, audit letters)"""
        x = path & self.low
        if not x:
            return path >> self.bits, ""
        used = self.bits - ((x & -x).bit_length() - 1) // WIDTH * WIDTH
        x >>= self.bits - used
        return path >> self.bits, "".join(LETTER[x >> i & 7] for i in range(used - WIDTH, -1, -WIDTH))


def least(*paths: int | None) -> int | None:
    known = [p for p in paths if p is not None]
    return min(known) if known else None


def before_row(w: Weights, after: list[int | None], initial: str, fault: str) -> list[int | None]:
    """Least suffixes per state before a row, from those after it: the row's own
    edit, then inserts in front. Two inserts from User or Assistant come back
    to the same state at a higher cost, so one of them is enough there."""
    bad = fault in ("b", "d")
    extra = TRUNCATED if fault == "t" else 0
    own: list[int | None] = []
    for s in range(STATES):
        options = [] if after[s] is None else [w.put("D", DELETE, after[s])]
        if not bad:
            kept = KEPT.get((s, initial))
            if kept is not None and after[kept] is not None:
                options.append(w.put("K", extra, after[kept]))
            if after[NEXT[s]] is not None:
                options.append(w.put("R", RE_ROLE + extra, after[NEXT[s]]))
        own.append(least(*options))
    return with_inserts(w, own)


def with_inserts(w: Weights, own: list[int | None]) -> list[int | None]:
    def put(path: int | None) -> int | None:
        return None if path is None else w.put("I", INSERT, path)

    user, assistant = least(own[USER], put(own[ASSISTANT])), least(own[ASSISTANT], put(own[USER]))
    return [least(own[START], put(user)), least(own[SYSTEM], put(user)), user, assistant]


def block_paths(rows: list[tuple[str, str]]) -> list[str]:
    """``entry|exit|cost|letters`` of the least path of a block of (initial, fault)
    rows, for each pair of states that has one."""
    w = Weights(2 * len(rows) + 2)
    out = []
    for end in range(STATES):
        paths: list[int | None] = [0 if s == end else None for s in range(STATES)]
        for initial, fault in reversed(rows):
            paths = before_row(w, paths, initial, fault)
        for s, p in enumerate(paths):
            if p is not None:
                cost, letters = w.read(p)
                out.append(f"{s}|{end}|{cost}|{letters}")
    return out


def closing() -> tuple[int, list[int | None]]:
    """Least endings per state after the last row: (letters they have room for, paths)."""
    w = Weights(2)
    done: list[int | None] = [0, None, None, 0]
    return 2, with_inserts(w, done)


# --- the damaged rows ---------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows after the contract's damage; a
    dropped row stays with 0 copies, so that its conversation is known."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key) % 20).alias("hit"),
    )
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return d.select(
        "conv", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"),
    )


def untouched(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows as they are."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"),
    )


def _units(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, with their number and faults; no texts."""
    blank = ~F.regexp_like("text", F.lit(f"[^{SPACE}]"))
    ended = F.regexp_like("text", F.lit(f"[.!?][{SPACE}]*\\z"))
    flags = rows.select(
        "conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("th"), "copies",
        F.when(blank, F.lit("b")).when(~ended, F.lit("t")).otherwise(F.lit("")).alias("fault"),
    )
    units = flags.groupBy("conv", "turn", "role", "th").agg(F.sum("copies").cast("long").alias("copies"), F.max("fault").alias("fault"))
    return write_table(units, "repair-units")


def _with_repeats(units: DataFrame) -> DataFrame:
    """``first``: whether the first row of a unit is the first of its role and text
    in the conversation. The earliest turn is a partial aggregate and meets the
    units by keys that occur once, so a text repeated in every turn is no hot key."""
    seen = units.where("copies > 0 AND fault <> 'b'").groupBy("conv", "role", "th").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))).alias("f"))
    seen = seen.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("th").alias("h"), F.col("f.t").alias("t"), F.lit(True).alias("first"))
    u = units.alias("u")
    same = F.col("u.conv").eqNullSafe(F.col("c")) & (F.col("u.role") == F.col("r")) & (F.col("u.th") == F.col("h")) & F.col("u.turn").eqNullSafe(F.col("t"))
    return u.join(seen, same, "left").select("u.*", F.coalesce("first", F.lit(False)).alias("first"))


# --- summaries ------------------------------------------------------------------


class _Block:
    """Consecutive rows of one conversation and what they add up to."""

    def __init__(self, conv: int | None, lo: int, at: tuple):
        self.conv, self.lo, self.at = conv, lo, at
        self.rows: list[tuple[str, str]] = []
        self.count = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = 0
        self.min_turn = self.max_turn = None
        self.turns = 0

    def add(self, initial: str, fault: str, turn: int | None) -> None:
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.rows.append((initial, fault))
        self.count[fault] += 1
        if turn is not None and turn != self.max_turn:
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = turn
            self.turns += 1

    def row(self) -> tuple:
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        c = self.count
        return (self.conv, self.lo, *self.at, len(self.rows), c["b"], c["d"], c["t"], self.illegal, *ends, self.min_turn, self.max_turn, self.turns, block_paths(self.rows))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def _blocks(units: DataFrame, block_rows: int, block_turns: int) -> DataFrame:
    """One summary per run of at most ``block_rows`` rows of a conversation."""
    lo = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**62))).cast("long")
    u = units.select("conv", lo.alias("lo"), "turn", "role", "th", "copies", "fault", "first")
    u = u.repartition("conv", "lo").sortWithinPartitions("conv", "lo", "turn", "role", "th")

    schema = _arrow_schema(SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done = None, []
        for b in batches:
            for conv, lo, turn, role, th, copies, fault, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block is None or (block.conv, block.lo) != (conv, lo):
                    if block is not None:
                        done.append(block.row())
                    block = _Block(conv, lo, (turn, role, th))
                for k in range(copies):
                    if len(block.rows) >= block_rows:
                        done.append(block.row())
                        # later copies of a unit sort after it: their number follows the text's hash
                        block = _Block(conv, lo, (turn, role, f"{th}{k:012d}"))
                    block.add(role[:1], fault if fault == "b" or (first and not k) else "d", turn)
                if len(done) >= 256:
                    yield _batch(done, schema)
                    done = []
        if block is not None:
            done.append(block.row())
        if done:
            yield _batch(done, schema)

    return u.mapInArrow(run, SUMMARY)


class _Whole:
    """A conversation put together from its summaries, last block first."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.letters, self.paths = closing()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.min_turn = self.max_turn = None

    def before(self, r: dict) -> None:
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + r[c])
        if r["n"] and self.first is not None and r["last"] + self.first not in LEGAL:
            self.illegal += 1
        if r["n"]:
            self.first = r["first"]
        if r["turns"]:
            self.turns += r["turns"] - (self.min_turn == r["max_turn"])
            self.max_turn = r["max_turn"] if self.max_turn is None else self.max_turn
            self.min_turn = r["min_turn"]
        steps = [(int(s), int(e), int(c), letters) for s, e, c, letters in (p.split("|") for p in r["paths"])]
        more = max(len(s[3]) for s in steps)
        old, self.letters = Weights(self.letters), self.letters + more
        w = Weights(self.letters)
        widened = [None if p is None else (p >> old.bits << w.bits) | ((p & old.low) << WIDTH * more) for p in self.paths]
        options: list[list[int]] = [[] for _ in range(STATES)]
        for s, e, cost, letters in steps:
            if widened[e] is not None:
                options[s].append(w.join(cost, letters, widened[e]))
        self.paths = [least(*o) for o in options]

    def row(self) -> tuple:
        cost, audit = Weights(self.letters).read(self.paths[START])
        gaps = 0 if self.min_turn is None else self.max_turn - self.min_turn + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _reports(blocks: DataFrame) -> DataFrame:
    order = [F.col("conv"), F.desc("lo"), F.desc_nulls_last("start_turn"), F.desc("start_role"), F.desc("start_th")]
    b = blocks.repartition("conv").sortWithinPartitions(*order)

    schema = _arrow_schema(REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, done = None, []
        for b in batches:
            for r in b.to_pylist():
                if whole is None or whole.conv != r["conv"]:
                    if whole is not None:
                        done.append(whole.row())
                    whole = _Whole(r["conv"])
                whole.before(r)
                if len(done) >= 256:
                    yield _batch(done, schema)
                    done = []
        if whole is not None:
            done.append(whole.row())
        if done:
            yield _batch(done, schema)

    return b.mapInArrow(run, REPORT)


def reports(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """((conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every
    conversation of ``rows``, the written table it reads). Rows are those of
    :func:`damaged` or :func:`untouched`."""
    units = _units(rows)
    return _reports(_blocks(_with_repeats(units), block_rows, block_turns)), units


# --- applying the audit ------------------------------------------------------------


def _apply(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The report of each conversation (``pos`` 0), then its repaired rows in order.
    The report sorts before the texts, so a conversation is streamed, not gathered."""
    texts = rows.where("copies > 0").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("th"), "text", F.col("copies").cast("int").alias("copies"),
        F.lit(None).cast("struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>").alias("report"),
    )
    head = report.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("th"),
        F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("report"),
    )
    both = head.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "th").drop("th")

    schema = _arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, pos = None, "", 0, START, 0
        for batch in batches:
            for piece in slices(batch, "text"):
                out: list[tuple] = []

                def put(edit: str, turn: int | None, role: str, text: str) -> None:
                    nonlocal pos
                    pos += 1
                    out.append((conv, None, pos, edit, turn, role, text))

                def insert() -> None:
                    nonlocal at, state
                    while at < len(audit) and audit[at] == "I":
                        state, at = NEXT[state], at + 1
                        put("I", None, ROLE[state], "")

                for c, kind, turn, role, text, copies, rep in zip(*(col.to_pylist() for col in piece.columns), strict=True):
                    if kind == 0:
                        conv, audit, at, state, pos = c, rep["audit"], 0, START, 0
                        out.append((conv, rep, 0, None, None, None, None))
                        insert()
                    for _ in range(copies):
                        edit, at = audit[at], at + 1
                        if edit == "K":
                            state = KEPT[state, role[:1]]
                            put("K", turn, role, text)
                        elif edit == "R":
                            state = NEXT[state]
                            put("R", turn, ROLE[state], text)
                        insert()
                yield _batch(out, schema)

    return both.mapInArrow(run, OUT)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, turn, role, text): the repaired rows of every
    conversation in order; kept and reroled ones with their turn, inserted ones
    with none. ``rows`` as in :func:`reports`."""
    report, _ = reports(rows)
    return _apply(rows, report).where("pos > 0").drop("report")


def digests(applied: DataFrame) -> DataFrame:
    """The reports with the hash of the repaired rows (``role:text``, joined by
    newlines), streamed over the partitions of :func:`_apply` as they are."""
    ddl = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    schema = _arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, h, done = None, None, []
        for b in batches:
            for conv, rep, pos, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pos == 0:
                    if head is not None:
                        done.append((*head, h.hexdigest()))
                    head, h = (conv, *rep.values()), hashlib.sha256()
                else:
                    h.update(f"{'' if pos == 1 else chr(10)}{role}:{text}".encode())
            if len(done) >= 256:
                yield _batch(done, schema)
                done = []
        if head is not None:
            done.append((*head, h.hexdigest()))
        if done:
            yield _batch(done, schema)

    return applied.select("conv_id", "report", "pos", "role", "text").mapInArrow(run, ddl)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    report, units = reports(rows)
    report = write_table(report, "repair-reports")
    discard(units)
    return digests(_apply(rows, report))


#: A path is a cost of fixed width before the audit text; the recursion goes from
#: the last row to the first and keeps, per state, the least path and its output.
_FAULT = r"CASE WHEN blank THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT ended THEN 't' ELSE '' END"


def _put(letter: str, cost: str, path: str, line: str = "''") -> str:
    return (
        f"CASE WHEN {path} IS NULL THEN NULL ELSE {{'w': printf('%018d', left({path}.w, 18)::BIGINT + {cost}) || '{letter}' || substr({path}.w, 19), "
        f"'o': {line} || {path}.o}} END"
    )


def _oracle() -> str:
    stay = "(f <> 'b' AND f <> 'd')"
    extra = "(CASE WHEN f = 't' THEN 3 ELSE 0 END)"
    keep_line, no_line = r"(chr(10) || role || ':' || text)", "''"
    options = {}
    for s in range(STATES):
        opts = [_put("D", "4", f"v{s}", no_line)]
        for (frm, ini), to in KEPT.items():
            if frm == s:
                opts.append(f"CASE WHEN {stay} AND left(role, 1) = '{ini}' THEN {_put('K', extra, f'v{to}', keep_line)} END")
        nxt = NEXT[s]
        opts.append(f"CASE WHEN {stay} THEN {_put('R', f'(3 + {extra})', f'v{nxt}', f'(chr(10) || chr(58) || text)').replace('chr(10) || chr(58)', f'chr(10) || {chr(39)}{ROLE[nxt]}:{chr(39)}')} END")
        options[s] = f"list_min([{', '.join(opts)}])"
    ins = {t: f"(chr(10) || '{ROLE[t]}:')" for t in ROLE}
    user = f"list_min([r{USER}, {_put('I', '3', f'r{ASSISTANT}', ins[ASSISTANT])}])"
    assistant = f"list_min([r{ASSISTANT}, {_put('I', '3', f'r{USER}', ins[USER])}])"
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), bits AS (
  SELECT * , row_number() OVER () AS rid FROM raw
), crc AS (
  SELECT rid, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, _x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)) AS c
  FROM bits
), hit AS (
  SELECT b.*, xor(c, 4294967295::BIGINT) % 20 AS h FROM bits b JOIN crc USING (rid)
), dmg AS (
  SELECT rid, conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit
), flagged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), rid, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS seen
  FROM dmg
), rws AS (
  SELECT conv_id, i, turn, role, text, {_FAULT} AS f, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM flagged
), agg AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rws GROUP BY conv_id
), dp AS (
  SELECT conv_id, n + 1 AS i, {{'w': '000000000000000000', 'o': ''}} AS v0, {{'w': '000000000000000006II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS v1,
    {{'w': '000000000000000003I', 'o': chr(10) || 'assistant:'}} AS v2, {{'w': '000000000000000000', 'o': ''}} AS v3
  FROM agg
  UNION ALL
  SELECT conv_id, i, list_min([r0, {_put('I', '3', 'vu', ins[USER])}]), list_min([r1, {_put('I', '3', 'vu', ins[USER])}]), vu, va
  FROM (SELECT conv_id, i, r0, r1, {user} AS vu, {assistant} AS va
    FROM (SELECT d.conv_id, r.i, {', '.join(f'{o} AS r{s}' for s, o in options.items())}
      FROM dp d JOIN rws r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i - 1) q1) q2
), best AS (
  SELECT conv_id, left(v0.w, 18)::BIGINT AS cost, substr(v0.w, 19) AS audit, sha256(substr(v0.o, 2)) AS repaired_sha256 FROM dp WHERE i = 1
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(a.gaps, 0) AS gaps, coalesce(a.blank, 0) AS blank, coalesce(a.duplicate, 0) AS duplicate, coalesce(a.truncated, 0) AS truncated,
  coalesce(a.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(b.repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN agg a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE = _oracle()

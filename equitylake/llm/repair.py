"""Conversation structure repair: a min-plus program over a grammar.

``damage`` breaks conversations in a reproducible way; ``repair`` finds each one's
cheapest edits into system? (user assistant)+, or nothing.

A row is one of nine symbols: its role's initial (s, u, a or another) with or
without truncation, or a row that must go (blank, duplicate). The output so far is
one of four states (nothing, after s, after u, after a), so a symbol is a 4 x 4
matrix in the (min, +) semiring: the cost from state to state, insertions first,
then the row's own edit. Re-Pair replaces the commonest pair of neighbouring
symbols in a batch's distinct sequences by a rule until no pair recurs; a rule's
matrix is the product of its two parts', computed once in a task and shared by
all conversations. Beside its costs a rule keeps the middle state of each
cheapest way: with the rules below it, that is a rope of the audit, written
out only for the ways taken.

Ties: of audits with equal cost the ASCII-least. Two ways from one state through
the same rows end their audits with a row's letter and never read alike, so neither
is a prefix of the other and their order decides whatever follows. A matrix keeps
that order as ranks; ranks of a product are ranks of pairs, and no strings are
compared.

Long conversations: rows are sorted by (conversation, turn) over ranges, so one
conversation may fill many tasks; there it is cut into segments of at most
``SEGMENT_ROWS`` rows or about ``SEGMENT_BYTES`` of text. Conversations that lie
within a task are finished there. Of the others (at most two a task, and cut ones)
each segment sends 16 costs and ranks; their chain is solved per conversation, and
each segment then writes its part of the audit. Their digest is a chain over the
whole text, so it streams, row after row of segments, through one task per
conversation in constant memory.

Edge cases: null role or text is one space, null conv_id or turn too where the
damage is drawn; rows of null conv_id form one conversation; null turns come
first; rows of one turn are ordered by role, then by the md5 of role:text (so all
orders are defined); repeated rows stay repeated and count as duplicates; a
conversation whose rows were all dropped gives zeros, an empty audit and the hash
of the empty string; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_texts_ok, n_partitions, staged

BLANKS = " \t\n\x0b\f\r"
SEGMENT_ROWS = 1 << 16
SEGMENT_BYTES = 8 << 20
STATES = 4  # nothing written, after s, after u, after a
INF = 1 << 60
GONE, BLANK, TRUNCATED = 1, 2, 4  # flags of a row
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5  # costs
#: what writing an initial does to each state (-1: not allowed there)
WRITE = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
INITIALS = "sua"
MUST_GO = 8  # symbols: 2 * initial (other: 3) + truncated, and this one


# --- damage

def damage(rows: DataFrame) -> DataFrame:
    """The rows after damage (conv_id, turn, role, text, gone); dropped rows stay,
    marked and emptied, so that every conversation keeps a row."""
    def shown(c):
        return F.coalesce(rows[c].cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.col("text")
    return (rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"),
                        shown("role").alias("role"), shown("text").alias("text"), draw.alias("draw"))
            .select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.translate(text, ".!?", ""))
                     .otherwise(text).alias("text"),
                    (F.col("draw") == 0).alias("gone"),
                    F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                     .alias("copy"))
            .drop("copy"))


# --- the min-plus program

class Grammar:
    """Symbols and rules with their matrices. Symbols 0 to 8 are rows; a rule is
    a pair of older symbols. One per task; rules are found again by their pair."""

    def __init__(self):
        self.pair: list[tuple[int, int] | None] = []
        self.cost: list[list[list[int]]] = []
        self.rank: list[list[list[int]]] = []  # order of a state's audits, by the state they lead to
        self.via: list[list[list]] = []  # middle state of a rule, audit of a row
        self.rules: dict[tuple[int, int], int] = {}
        self.solved: dict[bytes, tuple[int, str, int]] = {}
        self.short: dict[tuple[int, int, int], str] = {}
        for symbol in range(MUST_GO + 1):
            self._row(symbol)

    def _row(self, symbol: int) -> None:
        best = [[(INF, "")] * STATES for _ in range(STATES)]
        for i in range(STATES):
            for inserted, (at, before) in self._inserts(i).items():
                for cost, letter, to in self._edits(symbol, at):
                    got = (before * INSERT + cost, "I" * before + letter)
                    if got < best[i][to] or best[i][to][0] == INF:
                        best[i][to] = got
        self._append(None, [[c for c, _ in row] for row in best],
                     [self._order([a if c < INF else None for c, a in row]) for row in best],
                     [[a for _, a in row] for row in best])

    @staticmethod
    def _inserts(state: int) -> dict[int, tuple[int, int]]:
        """States reached by 0, 1, 2 insertions: more only come back, at a cost."""
        out = {0: (state, 0)}
        for k in (1, 2):
            state = next(WRITE[x][state] for x in "ua" if WRITE[x][state] >= 0)
            out[k] = (state, k)
        return out

    @staticmethod
    def _edits(symbol: int, state: int) -> Iterator[tuple[int, str, int]]:
        """(cost, letter, next state) of what can be done with a row."""
        yield DELETE, "D", state
        if symbol == MUST_GO:
            return
        initial, short = divmod(symbol, 2)
        if initial < len(INITIALS) and (to := WRITE[INITIALS[initial]][state]) >= 0:
            yield KEEP + CUT_SHORT * short, "K", to
        for x in "ua":
            if (to := WRITE[x][state]) >= 0:
                yield REROLE + CUT_SHORT * short, "R", to

    @staticmethod
    def _order(keys: list) -> list[int]:
        known = sorted(k for k in keys if k is not None)
        return [known.index(k) if k is not None else 0 for k in keys]

    def _append(self, pair, cost, rank, via) -> int:
        self.pair.append(pair)
        self.cost.append(cost)
        self.rank.append(rank)
        self.via.append(via)
        return len(self.pair) - 1

    @staticmethod
    def product(a: tuple, b: tuple) -> tuple[list, list, list]:
        """(costs, ranks, middle states) of two matrices (costs, ranks)."""
        (ca, ra), (cb, rb) = a, b
        cost, rank, via = [], [], []
        for i in range(STATES):
            ways = [min((ca[i][k] + cb[k][j], ra[i][k], rb[k][j], k) for k in range(STATES)) for j in range(STATES)]
            cost.append([min(w[0], INF) for w in ways])
            via.append([w[3] for w in ways])
            rank.append(Grammar._order([w[1:3] if w[0] < INF else None for w in ways]))
        return cost, rank, via

    def rule(self, left: int, right: int) -> int:
        if (left, right) not in self.rules:
            cost, rank, via = self.product((self.cost[left], self.rank[left]), (self.cost[right], self.rank[right]))
            self.rules[left, right] = self._append((left, right), cost, rank, via)
        return self.rules[left, right]

    def compress(self, sequences: list[np.ndarray]) -> list[list[int]]:
        """Re-Pair over the sequences: the commonest pair becomes a rule, until no
        pair occurs twice."""
        flat = np.concatenate([np.concatenate([s.astype(np.int64), [-1]]) for s in sequences]) if sequences else \
            np.zeros(0, np.int64)
        while len(flat) > 2:
            a, b = flat[:-1], flat[1:]
            inner = np.flatnonzero((a >= 0) & (b >= 0))
            if len(inner) < 2:
                break
            base = len(self.pair)
            code = a[inner] * base + b[inner]
            if base * base <= 4 * len(code):
                n = np.bincount(code)
                pair = int(n.argmax())
                most = int(n[pair])
            else:
                values, n = np.unique(code, return_counts=True)
                pair, most = int(values[n.argmax()]), int(n.max())
            if most < 2:
                break
            at = inner[code == pair]
            left, right = divmod(pair, base)
            if left == right:  # xxx: pairs don't overlap, the first of a run counts
                run = np.concatenate([[True], np.diff(at) != 1])
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            flat[at] = self.rule(left, right)
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat = flat[keep]
        out: list[list[int]] = []
        ends = np.flatnonzero(flat == -1)
        for s, e in zip(np.concatenate([[0], ends[:-1] + 1]), ends):
            out.append(flat[s:e].tolist())
        return out

    def matrix(self, symbols: list[int]) -> int:
        """The symbol of a whole sequence (not empty): halves of it, as rules."""
        while len(symbols) > 1:
            symbols = [self.rule(*symbols[k:k + 2]) if k + 1 < len(symbols) else symbols[k]
                       for k in range(0, len(symbols), 2)]
        return symbols[0]

    def audit(self, symbol: int, i: int, j: int) -> str:
        """The rope written out: the letters on the cheapest way from i to j."""
        out: list[str] = []
        stack = [(symbol, i, j)]
        while stack:
            at = s, i, j = stack.pop()
            if at in self.short:
                out.append(self.short[at])
            elif self.pair[s] is None:
                out.append(self.via[s][i][j])
            else:
                k = self.via[s][i][j]
                stack += [(self.pair[s][1], k, j), (self.pair[s][0], i, k)]
        return "".join(out)

    def remember(self, symbol: int, i: int, j: int) -> str:
        text = self.audit(symbol, i, j)
        if len(text) <= 64 and len(self.short) < 100_000:
            self.short[symbol, i, j] = text
        return text

    def close(self, symbol: int) -> tuple[int, str, int]:
        """(cost, audit, insertions at the end) of a whole conversation."""
        end = finish(self.cost[symbol][0], self.rank[symbol][0])
        cost, state, inserts = end
        return cost, self.remember(symbol, 0, state) + "I" * inserts, inserts

    def solve(self, sequences: list[bytes]) -> list[tuple[int, str]]:
        """(cost, audit) of each sequence of symbols."""
        new = [s for s in dict.fromkeys(sequences) if s and s not in self.solved]
        for s, symbols in zip(new, self.compress([np.frombuffer(s, np.uint8) for s in new])):
            self.solved[s] = self.close(self.matrix(symbols))
        out = [self.solved[s][:2] if s else (0, "") for s in sequences]
        if sum(map(len, self.solved)) > 1 << 22 or len(self.pair) > 1 << 16:  # bounded memory: start anew
            self.__init__()
        return out


def finish(cost: list[int], rank: list[int]) -> tuple[int, int, int]:
    """(cost, state, insertions) of the cheapest end: an output that is empty or
    ends with a; after s two insertions are missing, after u one."""
    missing = (0, 2, 1, 0)
    total, _, state = min((c + INSERT * missing[k], rank[k], k) for k, c in enumerate(cost))
    return total, state, missing[state]


def written(audit: str, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], int]:
    """The repaired rows as role:text, and the state after them."""
    out = []
    row = 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        nxt = "u" if state in (0, 1, 3) else "a"
        if letter == "I":
            out.append("user:" if nxt == "u" else "assistant:")
        elif letter == "R":
            out.append(("user:" if nxt == "u" else "assistant:") + texts[row])
            row += 1
        else:
            out.append(f"{roles[row]}:{texts[row]}")
            if state == 0 and roles[row][:1] == "s":
                nxt = "s"
            row += 1
        state = WRITE[nxt][state]
    return out, state


# --- a run of rows of one conversation

class Run:
    """Rows of one conversation, or a segment of them, in order."""

    def __init__(self, turns: list, roles: list, texts: list, flags: list, again: Iterable[int] = ()):
        seen: set = set()
        late = set(again)  # known from earlier segments
        self.turns, self.roles, self.texts = turns, roles, texts
        self.keys: list[tuple[int, bytes]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        symbols = bytearray()
        last = None
        for k, (role, text, flag) in enumerate(zip(roles, texts, flags)):
            initial = role[:1]
            if last is not None and last + initial not in ("su", "ua", "au"):
                self.illegal += 1
            last = initial
            if flag & BLANK:
                self.blank += 1
                symbols.append(MUST_GO)
                continue
            key = (role, text)
            if key in seen or k in late:
                self.duplicate += 1
                seen.add(key)
                symbols.append(MUST_GO)
                continue
            seen.add(key)
            short = bool(flag & TRUNCATED)
            self.truncated += short
            at = INITIALS.find(initial) if initial else -1
            symbols.append(2 * (at if at >= 0 else 3) + short)
        self.symbols = bytes(symbols)

    def first_keys(self) -> Iterator[tuple[int, bytes]]:
        """(row, hash of role and text) of rows that may be duplicates of earlier segments."""
        for k, symbol in enumerate(self.symbols):
            if symbol != MUST_GO:
                role = self.roles[k].encode()
                yield k, hashlib.blake2b(b"%d:%s%s" % (len(role), role, self.texts[k].encode()), digest_size=16).digest()

    def turn_stats(self) -> tuple:
        known = [t for t in self.turns if t is not None]
        return (min(known), max(known), len(set(known))) if known else (None, None, 0)


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
SEGMENTS = (RESULT + ", edge boolean, part int, seg long, turns array<long>, roles array<string>, "
            "texts array<string>, flags array<int>")
_SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string()), ("edge", pa.bool_()), ("part", pa.int32()),
    ("seg", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("flags", pa.list_(pa.int32()))])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[tuple]:
    """(conv_id, edge, its rows) of a task's sorted rows: whole conversations, or
    edge segments, of those that reach the task's ends or are cut for length."""
    held: list[pa.RecordBatch] = []
    held_rows = held_bytes = 0
    first = True  # what is held reaches back to the task's first row, or to a cut
    for b in batches:
        ids = b.column("conv_id")
        if not b.num_rows:
            continue
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1
        ends = [*cut.tolist(), b.num_rows]
        at = 0
        if held:
            h = held[-1].column("conv_id")[0].as_py()
            if h != ids[0].as_py():
                yield h, first, held
                held, held_rows, held_bytes, first = [], 0, 0, False
        for end in ends:
            piece = b.slice(at, end - at)
            if end < b.num_rows:
                yield ids[at].as_py(), first, [*held, piece]
                held, held_rows, held_bytes, first = [], 0, 0, False
            else:
                held.append(piece)
                held_rows += piece.num_rows
                held_bytes += piece.nbytes
                if held_rows >= rows or held_bytes >= size:
                    yield ids[at].as_py(), True, held
                    held, held_rows, held_bytes, first = [], 0, 0, True
            at = end
    if held:
        yield held[-1].column("conv_id")[0].as_py(), True, held


def segments(rows: DataFrame, segment_rows: int, segment_bytes: int) -> DataFrame:
    """Finished conversations, and the segments of those that cross tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        grammar = Grammar()
        waiting: list = []
        edges: list = []
        seg = 0

        def flush() -> pa.RecordBatch:
            solved = grammar.solve([r.symbols for _, r in waiting])
            cols = {f.name: [] for f in _SEGMENTS}
            for (conv, r), (cost, audit) in zip(waiting, solved):
                text, _ = written(audit, r.roles, r.texts)
                digest = hashlib.sha256("\n".join(text).encode()).hexdigest()
                for c, v in zip(cols, (conv, gaps(*r.turn_stats()), r.blank, r.duplicate, r.truncated, r.illegal, cost,
                                       audit, digest, False, part, None, None, None, None, None)):
                    cols[c].append(v)
            for conv, number, turns, roles, texts, flags in edges:
                for c, v in zip(cols, (conv, *[None] * 8, True, part, number, turns, roles, texts, flags)):
                    cols[c].append(v)
            waiting.clear()
            edges.clear()
            return pa.RecordBatch.from_pydict(cols, schema=_SEGMENTS)
        size = 0
        for conv, edge, parts in _pieces(batches, segment_rows, segment_bytes):
            t = pa.Table.from_batches(parts)
            t = t.filter(pc.invert(t.column("gone")))
            got = [t.column(c).to_pylist() for c in ("turn", "role", "text", "flags")]
            if edge:
                edges.append((conv, seg, *got))
                seg += 1
            else:
                waiting.append((conv, Run(*got)))
            size += t.num_rows
            if size >= 8192 or edge:
                yield flush()
                size = 0
        yield flush()
    return rows.mapInArrow(run, SEGMENTS)


SUMMARY = ("conv_id long, part int, seg long, rows long, blank long, duplicate long, truncated long, illegal long, "
           "head string, tail string, low long, high long, distinct_turns long, head_turn long, tail_turn long, "
           "cost array<long>, rank array<int>")
PATH = ("part int, seg long, entry int, leave int, inserts int, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, opens boolean")


def _run_of(row: dict) -> Run:
    return Run(row["turns"], row["roles"], row["texts"], row["flags"], row.get("again") or ())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
             "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c, kinds[k]) for c, k in (x.split() for x in ddl.split(", "))])


def chain(summaries: list[dict]) -> list[dict]:
    """The cheapest way through a conversation's segments: one ``PATH`` row each."""
    summaries = sorted(summaries, key=lambda s: (s["part"], s["seg"]))
    full = [s for s in summaries if s["rows"]]
    steps = []
    total = ([[0 if i == j else INF for j in range(STATES)] for i in range(STATES)], [[0] * STATES] * STATES)
    for s in full:
        here = tuple([s[c][k:k + STATES] for k in range(0, STATES * STATES, STATES)] for c in ("cost", "rank"))
        cost, rank, via = Grammar.product(total, here)
        steps.append(via)
        total = (cost, rank)
    cost, state, inserts = finish(total[0][0], total[1][0]) if full else (0, 0, 0)
    known = [s for s in full if s["low"] is not None]
    turns = sum(s["distinct_turns"] for s in known) - sum(
        a["tail_turn"] is not None and a["tail_turn"] == b["head_turn"] for a, b in zip(full, full[1:]))
    sums = {c: sum(s[c] for s in summaries) for c in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(full, full[1:]))
    sums["gaps"] = gaps(min(s["low"] for s in known), max(s["high"] for s in known), turns) if known else 0
    out = []
    for s, via in zip(reversed(full), reversed(steps)):
        entry = via[0][state]
        out.append({"part": s["part"], "seg": s["seg"], "entry": entry, "leave": state,
                    "inserts": inserts if not out else 0})
        state = entry
    out.reverse()
    out += [{"part": s["part"], "seg": s["seg"], "entry": 0, "leave": 0, "inserts": 0} for s in summaries if not s["rows"]]
    for k, row in enumerate(out):  # the counts travel on the conversation's first row
        row.update(sums if k == 0 else dict.fromkeys(sums, 0), cost=cost if k == 0 else 0, opens=k == 0)
    return out


def resolve(edges: DataFrame) -> DataFrame:
    """``RESULT`` rows of the conversations that lie in several segments, or may."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow("conv_id long, key binary, part int, seg long, row long")
        for row in _rows(batches):
            yield _emit([{"conv_id": row["conv_id"], "key": h, "part": row["part"], "seg": row["seg"], "row": k}
                         for k, h in _run_of(row).first_keys()], schema)
    raw = edges.select("conv_id", "part", "seg", "turns", "roles", "texts", "flags")
    # one entry a segment at most, so a group is as long as the conversation has segments
    again = (raw.mapInArrow(keys, "conv_id long, key binary, part int, seg long, row long")
             .groupBy("conv_id", "key").agg(F.array_sort(F.collect_list(F.struct("part", "seg", "row"))).alias("at"))
             .where(F.size("at") > 1).select(F.explode(F.slice("at", F.lit(2), F.size("at") - 1)).alias("at"))
             .select("at.part", "at.seg", "at.row").groupBy("part", "seg").agg(F.collect_list("row").alias("again")))
    raw = staged(raw.join(again, ["part", "seg"], "left"), "repair_edges")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        schema = _arrow(SUMMARY)
        for row in _rows(batches):
            r = _run_of(row)
            low, high, distinct = r.turn_stats()
            s = grammar.matrix(grammar.compress([np.frombuffer(r.symbols, np.uint8)])[0]) if r.symbols else None
            yield _emit([{
                "conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"], "rows": len(r.symbols),
                "blank": r.blank, "duplicate": r.duplicate, "truncated": r.truncated, "illegal": r.illegal,
                "head": r.roles[0][:1] if r.roles else "", "tail": r.roles[-1][:1] if r.roles else "",
                "low": low, "high": high, "distinct_turns": distinct,
                "head_turn": r.turns[0] if r.turns else None, "tail_turn": r.turns[-1] if r.turns else None,
                "cost": sum(grammar.cost[s], []) if s is not None else [],
                "rank": sum(grammar.rank[s], []) if s is not None else []}], schema)

    def solve(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(chain(t.to_pylist()), schema=_arrow(PATH))
    path = raw.mapInArrow(summary, SUMMARY).groupBy("conv_id").applyInArrow(solve, PATH)

    PIECE = RESULT.replace("repaired_sha256 string", "repaired string") + ", part int, seg long, lines long, opens boolean"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        schema = _arrow(PIECE)
        for row in _rows(batches):
            r = _run_of(row)
            audit = ""
            if r.symbols:
                s = grammar.matrix(grammar.compress([np.frombuffer(r.symbols, np.uint8)])[0])
                audit = grammar.audit(s, row["entry"], row["leave"])
            audit += "I" * row["inserts"]
            lines, _ = written(audit, r.roles, r.texts, row["entry"])
            yield _emit([{c: row.get(c) for c in schema.names} | {
                "audit": audit, "repaired": "\n".join(lines), "lines": len(lines)}], schema)
    written_pieces = raw.join(path, ["part", "seg"]).mapInArrow(write, PIECE)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(RESULT)
        counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        now = sha = None
        for row in _rows(batches):
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield _emit([now | {"audit": "".join(now["audit"]), "repaired_sha256": sha.hexdigest()}], schema)
                now = {"conv_id": row["conv_id"], **dict.fromkeys(counts, 0), "audit": []}
                sha, any_line = hashlib.sha256(), False
            for c in counts:
                now[c] += row[c]
            now["audit"].append(row["audit"])
            if row["lines"]:
                sha.update((("\n" if any_line else "") + row["repaired"]).encode())
                any_line = True
        if now is not None:
            yield _emit([now | {"audit": "".join(now["audit"]), "repaired_sha256": sha.hexdigest()}], schema)
    n = n_partitions(edges.sparkSession)
    return (written_pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seg")
            .mapInArrow(digest, RESULT))


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One ``RESULT`` row per conversation of damaged rows (conv_id, turn, role,
    text, gone): its faults, the cheapest edits and the digest of the repaired rows."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    flags = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    order = ["conv_id", "turn", "role", "like", "nth"]
    rows = rows.select("conv_id", "turn", "role", "text", "gone", flags.alias("flags"),
                       F.md5(F.concat("role", F.lit(":"), "text").cast("binary")).alias("like"),
                       F.monotonically_increasing_id().alias("nth"))  # spreads rows that are alike in all else
    long_texts_ok(rows)
    n = n_partitions(rows.sparkSession)
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    done = staged(segments(rows.select("conv_id", "turn", "role", "text", "gone", "flags"), segment_rows, segment_bytes),
                  "repair")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return (done.where("not edge").select(*names)
            .unionAll(resolve(done.where("edge")).select(*names)))

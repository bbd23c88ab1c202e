"""Secret scans by one combined deterministic automaton.

The expressions of all rules are compiled together: each becomes a nondeterministic automaton over bytes, subset
construction makes one deterministic automaton that may begin any rule at any byte, and its equivalent states are merged.
Expressions and texts are reversed, so what a state tells is which rules have a match that begins there; read this way
round, runs of unlimited length come first and prefixes last, and the automaton stays small where the other has tens of
thousands of states. Scanning is one pass of table lookups over the bytes of many texts at once, which are put into one
stream and cut into lanes that advance together; a lane starts where the one before it ends, so its first states are made
good until they agree with those guessed.

In the few texts that hold a match, the rule's own automaton walks from the leftmost place to the longest end, and the
search goes on behind it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are scanned at once, and lanes that advance together.
STREAM_BYTES, LANES = 1 << 22, 4096
#: Stands between texts; no text in UTF-8 has it and no rule takes it.
GAP = 0xFF


@dataclass(frozen=True)
class Rule:
    """``head`` and ``value`` are expressions that a match is made of; it counts if its value has ``least`` bytes."""

    kind: str
    head: str
    value: str
    least: int = 1
    fold: bool = False


#: The three base kinds. A run of hexadecimal digits that is too short holds no long one, so its length is
#: part of the expression; the other lengths are those of what was matched.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, fold=True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", "", r"[0-9a-f]{16,}"),
)
#: Kinds added to them: key blocks, tokens of code hosts, chats, payment and mail services, and signed web tokens.
MORE = (
    Rule("pem", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_", r"[A-Za-z0-9]+", 30),
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9-]+", 20),
    Rule("payment", r"[rs]k_live_", r"[A-Za-z0-9]+", 20),
    Rule("maps", r"AIza", r"[A-Za-z0-9_-]+", 30),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.]", r"[A-Za-z0-9_-]+", 10),
)
RULES = BASE + MORE

# --- expressions: ("set", bytes), ("cat", parts), ("or", parts) and ("many", part, least, most) --------------------


class _Reader:
    """Reads literals, escapes, classes, groups, alternatives and the quantifiers ``? * + {m} {m,} {m,n}``."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _char(self) -> int:
        c = self._next()
        if c == "\\":
            c = self._next()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError(f"expressions are of ASCII: {self.text}")
        return ord(c)

    def _set(self, members: Iterable[int]) -> tuple:
        found = set(members)
        if self.fold:
            found |= {ord(x) for m in found for x in (chr(m).lower(), chr(m).upper())}
        return ("set", frozenset(found))

    def either(self) -> tuple:
        parts = [self.row()]
        while self._peek() == "|":
            self._next()
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def row(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self.counted(self.one()))
        return ("cat", parts)

    def one(self) -> tuple:
        if self._peek() == "(":
            self._next()
            inner = self.either()
            if self._peek() != ")":
                raise ValueError(f"open group: {self.text}")
            self._next()
            return inner
        if self._peek() in set(".^$*+?{"):
            raise ValueError(f"not among the expressions read here: {self.text}")
        if self._peek() != "[":
            return self._set([self._char()])
        self._next()
        if self._peek() == "^":
            raise ValueError(f"not among the expressions read here: {self.text}")
        members: set[int] = set()
        while self._peek() != "]":
            low = self._char()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._next()
                members |= set(range(low, self._char() + 1))
            else:
                members.add(low)
        self._next()
        return self._set(members)

    def counted(self, part: tuple) -> tuple:
        bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(self._peek())
        if bounds:
            self._next()
            return ("many", part, *bounds)
        if self._peek() != "{":
            return part
        stop = self.text.index("}", self.at)
        low, comma, high = self.text[self.at + 1 : stop].partition(",")
        self.at = stop + 1
        return ("many", part, int(low), int(high) if high else None if comma else int(low))


def parsed(text: str, fold: bool = False) -> tuple:
    reader = _Reader(text, fold)
    tree = reader.either()
    if reader.at < len(text):
        raise ValueError(f"stray closing: {text}")
    return tree


def turned(tree: tuple) -> tuple:
    """The expression of the reversed texts."""
    if tree[0] == "set":
        return tree
    if tree[0] == "many":
        return ("many", turned(tree[1]), *tree[2:])
    parts = [turned(p) for p in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class _Nfa:
    """States with moves on sets of bytes and moves on nothing."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Leads from ``start`` through the expression; returns where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        self.free[start].append(end)
        if most is None:
            again = self.state()
            self.free[start].append(again)
            last = self.add(part, again)
            self.free[last] += [again, end]
        else:
            for _ in range(most - least):
                start = self.add(part, start)
                self.free[start].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state * width + column[byte]]`` is the next state, times ``width``; state 0 is the start.

    ``ends[state]`` has a bit for each rule that has a match there; from state ``dead`` none is reached any more.
    """

    column: np.ndarray
    table: np.ndarray
    ends: np.ndarray
    width: int
    dead: int


def compiled(trees: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction over all expressions at once, which may begin at any byte or only at the first, minimised."""
    nfa = _Nfa()
    starts = [nfa.state() for _ in trees]
    final = {nfa.add(tree, start): 1 << bit for bit, (tree, start) in enumerate(zip(trees, starts))}
    sets = {members for moves in nfa.moves for members, _ in moves}
    kinds: dict[tuple, int] = {}
    column = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], dtype=np.uint8)
    sample = [int(np.flatnonzero(column == k)[0]) for k in range(len(kinds))]
    first = nfa.closed(starts)
    known, todo, rows, ends = {first: 0}, [first], [], []
    while todo:
        now = todo.pop(0)
        ends.append(sum(final.get(s, 0) for s in now))
        row = []
        for byte in sample:
            to = nfa.closed({t for s in now for members, t in nfa.moves[s] if byte in members} | (set(starts) if anywhere else set()))
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        rows.append(row)
    next_, told = np.array(rows), np.array(ends)
    group = np.unique(told, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack((group, group[next_])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = np.unique(group, return_index=True)[1]
    rename = np.empty(len(order), dtype=np.int64)
    rename[group[np.sort(order)]] = np.arange(len(order))  # the start keeps number 0
    group, keep = rename[group], np.sort(order)
    next_, told = group[next_[keep]], told[keep]
    loops = np.flatnonzero((next_ == np.arange(len(keep))[:, None]).all(axis=1) & (told == 0))
    width = len(kinds)
    return Automaton(column, (next_ * width).astype(np.int32).ravel(), told.astype(np.uint16), width, int(loops[0]) if len(loops) else -1)


def marks(stream: np.ndarray, auto: Automaton) -> np.ndarray:
    """``ends`` of the state behind each byte."""
    lanes = max(1, min(LANES, len(stream) // 64))
    steps = -(-len(stream) // lanes)
    padded = np.full(lanes * steps, GAP, dtype=np.uint8)
    padded[: len(stream)] = stream
    columns = np.ascontiguousarray(auto.column[padded].reshape(lanes, steps).T)
    states = np.empty((steps, lanes), dtype=np.int32)
    now = np.zeros(lanes, dtype=np.int32)
    for i in range(steps):
        now = auto.table.take(now + columns[i], out=states[i])
    table = auto.table
    for lane in range(1, lanes):
        now = int(states[-1, lane - 1])
        if not now:
            continue
        for i in range(steps):
            now = int(table[now + int(columns[i, lane])])
            if now == states[i, lane]:
                break
            states[i, lane] = now
    return np.repeat(auto.ends, auto.width).take(states).T.ravel()[: len(stream)]


class Scanner:
    """Automata of a set of rules: a combined one that tells where matches begin, and each rule's to tell where one ends."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [("cat", [parsed(r.head, r.fold), parsed(r.value, r.fold)]) for r in rules]
        self.begins = compiled([turned(t) for t in trees], True)
        self.whole = [compiled([t], False) for t in trees]
        self.head = [compiled([parsed(r.head, r.fold)], False) if r.head else None for r in rules]

    @staticmethod
    def _longest(auto: Automaton, text: bytes, at: int) -> int:
        """Where the longest match that begins at ``at`` ends, or -1."""
        table, column, ends, dead, width = auto.table, auto.column, auto.ends, auto.dead * auto.width, auto.width
        now, end = 0, at if ends[0] else -1
        for i in range(at, len(text)):
            now = int(table[now + int(column[text[i]])])
            if now == dead:
                break
            if ends[now // width]:
                end = i + 1
        return end

    def _of_rule(self, k: int, text: bytes, begins: list[int]) -> Iterator[tuple[int, int]]:
        rule, at, i = self.rules[k], 0, 0
        while (i := bisect_left(begins, at, i)) < len(begins):
            start = begins[i]
            at = self._longest(self.whole[k], text, start)
            value = self._longest(self.head[k], text, start) if self.head[k] else start
            if at - value >= rule.least:
                yield start, at

    def scan(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """``(start, rule, end)`` in code points, in order, of the texts that have any, by their place in ``texts``."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for n, told in self._holding(texts):
            text = texts[n]
            spans = [(start, k, end) for k in range(len(self.rules)) for start, end in self._of_rule(k, text, np.flatnonzero(told & (1 << k)).tolist())]
            if spans:
                if not text.isascii():
                    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
                    spans = [(int(before[a]), k, int(before[b])) for a, k, b in spans]
                out[n] = sorted(spans)
        return out

    def _holding(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Every text that has a match, with its marks; texts are scanned together up to a stream's size, a long one alone."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < STREAM_BYTES):
                size += len(texts[hi]) + 1
                hi += 1
            stream = np.frombuffer(bytes([GAP]).join(texts[lo:hi]), dtype=np.uint8)
            if len(stream):
                told, starts = marks(stream[::-1], self.begins)[::-1], np.cumsum([0, *[len(t) + 1 for t in texts[lo:hi]]])
                for n in np.unique(np.searchsorted(starts, np.flatnonzero(told), side="right") - 1).tolist():
                    yield lo + n, told[starts[n] : starts[n + 1] - 1]
            lo = hi


@cache
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def joined(spans: Iterable[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, the number ``n_<kind>`` of spans of each base kind, ``base_sha256`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, in order of start and then of kinds as listed, joined by
    commas; the digest is that of the base kinds' alone. Matches of a kind are leftmost, longest and do not overlap; one
    whose value is too short counts for nothing but is passed over whole. Null and empty texts have no spans; very long
    texts are scanned whole; repeated rows get a row each; an empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    rules = base + more
    shared = docs.sparkSession.sparkContext.broadcast(_scanner(rules))
    counts = [f"n_{r.kind}" for r in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = shared.value.scan
        for batch in batches:
            for part in (batch.slice(lo, 512) for lo in range(0, batch.num_rows, 512)):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
                found = found_in(texts)
                rows = [found.get(n, ()) for n in range(len(texts))]
                of_kind = [pa.array([sum(k == kind for _, k, _ in spans) for spans in rows], pa.int64()) for kind in range(len(base))]
                digests = [hashlib.sha256(joined([x for x in spans if x[1] < len(base)], rules).encode()).hexdigest() for spans in rows]
                made = [pa.array(digests), pa.array([joined(spans, rules) for spans in rows])]
                yield pa.RecordBatch.from_arrays([part.column(0), *of_kind, *made], names=["doc_id", *counts, "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")


def _in_sql(expression: str, fold: bool) -> str:
    """An expression as SQL has it, with a class of both cases for each letter where these are one."""
    if fold:
        expression = re.sub(r"\\x[0-9A-Fa-f]{2}|\[[^]]*\]|[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]" if len(m[0]) == 1 else m[0], expression)
    return expression.replace("'", "''")


def oracle(base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> str:
    """SQL for :func:`find_secrets`: a match starts behind all earlier matches and all that lies between them."""
    parts = []
    for k, r in enumerate(base + more):
        head, value = (_in_sql(x, r.fold) for x in (r.head, r.value))
        whole, groups = f"({head})({value})", head.count("(") + 2
        parts.append(
            f"select doc_id, row, {k} as k, '{r.kind}' as kind, {r.least} as least, regexp_extract_all(t, '{whole}') as m, regexp_extract_all(t, '{whole}', {groups}) as v, "
            f"string_split_regex(t, '{whole}') as gaps from d"
        )
    every = "\n  union all ".join(parts)
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in base)
    return f"""
with d as (select doc_id, row_number() over () as row, coalesce(text, '') as t from documents),
f as ({every}),
e as (select *, unnest(range(1, len(m) + 1)) as i from f),
s as (
  select row, k, kind, length(m[i]) as size, strlen(v[i]) >= least as counts,
    coalesce(list_sum([length(x) for x in gaps[:i]]), 0)::bigint + coalesce(list_sum([length(x) for x in m[:i - 1]]), 0)::bigint as start from e),
p as (select row, k, kind, start, kind || ':' || start || ':' || (start + size) as span from s where counts)
select doc_id, {counts}, sha256(coalesce(string_agg(span, ',' order by start, k) filter (where k < {len(base)}), '')) as base_sha256,
  coalesce(string_agg(span, ',' order by start, k), '') as spans
from d left join p using (row) group by doc_id, row
"""


ORACLE = oracle()

"""Operator 7: secrets by one deterministic automaton for all rules.

The rules' regular expressions become one automaton by subset construction and minimisation. A single pass over a text's
UTF-8 bytes follows its transition array and notes where a rule's match ends; from the last end of each run of ends a
reversed automaton of that rule walks back to the leftmost start. Every rule must end in its longest run of characters
(or in fixed text), so that runs of ends are matches.

Defined cases: a null text is an empty one; a text is scanned whole, however long; repeated rows give repeated results; an
empty table has no rows; a carried column gives way to an output of the same name; matches of one rule never overlap, those of different rules may; offsets are
code points with the end exclusive; spans come by start, then in the rules' order, then by end and kind; a private key reaches from its header through its END line (the text's end without
one), and headers of certificates and public keys are no matches; matches too short for their rule are dropped after they took their characters.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from embergrid.llm.common import map_texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    min_chars: int = 0  # of the match behind its head
    head: str = ""  # the match's unambiguous beginning that min_chars leaves out
    kinds: tuple[tuple[str, str, int], ...] = ()  # what a match may hold: kind, pattern and least length, each kind found by itself
    until: str = ""  # a match goes on, over line ends, through the next of these, or to the text's end if there is none


_KEYS = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _KEYS + r"""["']?\x20*[:=]\x20*["']?"""
BASE = ("assign", "access", "hex")
#: Kinds of credentials in public formats, each with its own pattern and its least length. Those of one rule have characters
#: in common, so that one automaton state stands for all their tails: a match of the rule runs from the first head of any kind to the
#: run's end, and holds all that the kinds' own patterns find there.
PREFIXED = (
    ("github", r"gh[opsur]_[A-Za-z0-9]+", 40), ("github_fine", r"github_pat_[A-Za-z0-9_]+", 40), ("gitlab", r"glpat-[A-Za-z0-9_-]+", 26),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 20), ("google_api", r"AIza[A-Za-z0-9_-]+", 39), ("google_oauth", r"GOCSPX-[A-Za-z0-9_-]+", 30),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 24), ("npm", r"npm_[A-Za-z0-9]+", 40), ("pypi", r"pypi-[A-Za-z0-9_-]+", 50),
    ("huggingface", r"hf_[A-Za-z0-9]+", 34), ("digitalocean", r"do[opr]_v1_[0-9a-f]+", 71), ("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]+", 38),
)
#: The tail of a jwt is optional and asked for afterwards, as its other heads in the same part would lack it, too.
DOTTED = (("jwt", r"eyJ[A-Za-z0-9_-]+(\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?", 40), ("sendgrid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 50))
#: Base rules in the order of the contract, then the further ones.
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 6, _ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{6,}", 24),
    Rule("prefixed", r"(gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|AIza|GOCSPX-|[rs]k_(live|test)_|npm_|pypi-|hf_|do[opr]_v1_|shp(at|ca|pa|ss)_)[A-Za-z0-9_-]+", kinds=PREFIXED),
    Rule("dotted", r"(eyJ|SG\.)[A-Za-z0-9_.-]+", kinds=DOTTED),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----", until=r"-----END [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----"),
)


@dataclass
class Nfa:
    """States with byte moves and empty moves; built from Python's own parse of a pattern."""

    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, parsed, start: int, reverse: bool) -> int:
        """Append what was parsed behind ``start``; the state where it ends."""
        for op, arg in reversed(list(parsed)) if reverse else parsed:
            start = self.item(op, arg, start, reverse)
        return start

    def item(self, op, arg, start: int, reverse: bool) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN):
            end = self.state()
            self.moves[start].append((_bytes_of(op, arg), end))
            return end
        if op is C.SUBPATTERN:
            return self.add(arg[-1], start, reverse)
        if op is C.BRANCH:
            end = self.state()
            for way in arg[1]:
                self.empty[self.add(way, start, reverse)].append(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                start = self.add(inner, start, reverse)
            if high is C.MAXREPEAT:
                again = self.state()
                self.empty[start].append(again)
                self.empty[self.add(inner, again, reverse)].append(again)
                return again
            end = self.state()
            self.empty[start].append(end)
            for _ in range(high - low):
                start = self.add(inner, start, reverse)
                self.empty[start].append(end)
            return end
        raise ValueError(f"not supported in a rule: {op}")

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(op, arg) -> frozenset:
    if op is C.LITERAL:
        return frozenset([arg])
    if op is C.NOT_LITERAL:
        return frozenset(range(256)) - {arg}
    out, negate = set(), False
    for kind, x in arg:
        if kind is C.NEGATE:
            negate = True
        elif kind is C.LITERAL:
            out.add(x)
        elif kind is C.RANGE:
            out.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {kind}")
    return frozenset(range(256)) - out if negate else frozenset(out)


@dataclass(frozen=True)
class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256, -1 if none; states from ``accept`` on are final, and
    ``masks`` holds the rules (as bits) that end in each of those."""

    table: np.ndarray
    start: int
    accept: int
    masks: tuple[int, ...]


def compile_dfa(patterns: list[str], search: bool, reverse: bool = False) -> Dfa:
    """Subset construction over byte classes, then minimisation by refining partitions."""
    nfa = Nfa()
    root = nfa.state()
    final = {}
    for i, p in enumerate(patterns):
        start = nfa.state()
        nfa.empty[root].append(start)
        final[nfa.add(parser.parse(p.encode()), start, reverse)] = i
    sets = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
    sign: dict[tuple, list[int]] = {}
    for b in range(256):
        sign.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = list(sign.values())
    class_of = np.zeros(256, np.int64)
    for k, members in enumerate(classes):
        class_of[members] = k
    first = nfa.closure([root])
    index, todo, rows = {first: 0}, [first], []
    while todo:  # in order of discovery, so that rows and index agree
        now = todo.pop(0)
        row = []
        for members in classes:
            b = members[0]
            to = {t for s in now for chars, t in nfa.moves[s] if b in chars}
            if search:
                to.add(root)
            if not to:
                row.append(-1)
                continue
            to = nfa.closure(to)
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        rows.append(row)
    masks = np.array([sum({1 << final[s] for s in states if s in final}) for states in index], np.int64)
    moves = np.array(rows, np.int64).reshape(len(index), len(classes))
    block = np.unique(masks, return_inverse=True)[1].ravel()
    while True:  # states stay together while they go to the same blocks
        to = np.where(moves < 0, -1, block[moves])
        new = np.unique(np.column_stack([block, to]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    rep = np.unique(block, return_index=True)[1]
    order = np.argsort(masks[rep] != 0, kind="stable")  # final states last
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    small = moves[rep[order]]
    small = np.where(small < 0, -1, rank[block[small]] * 256)
    kept = masks[rep[order]]
    accept = int((kept == 0).sum())
    return Dfa(small[:, class_of].astype(np.int32).ravel(), int(rank[block[0]]) * 256, accept * 256, tuple(map(int, kept[accept:])))


@dataclass(frozen=True)
class Scanner:
    """All rules: the searching automaton and each rule's reversed one."""

    rules: tuple[Rule, ...]
    search: Dfa
    back: tuple[Dfa, ...]

    def ready(self) -> "Ready":
        return Ready(self)


@lru_cache(maxsize=8)
def build(rules: tuple[Rule, ...] = RULES) -> Scanner:
    patterns = [r.pattern for r in rules]
    return Scanner(rules, compile_dfa(patterns, search=True), tuple(compile_dfa([p], search=False, reverse=True) for p in patterns))


def _shared(table: np.ndarray) -> list[int]:
    """The array as a list whose equal numbers are one object."""
    names = {int(x): int(x) for x in np.unique(table)}
    return [names[x] for x in table.tolist()]


class Ready:
    """A scanner as a worker uses it."""

    def __init__(self, scanner: Scanner):
        self.rules = scanner.rules
        self.search, self.table = scanner.search, _shared(scanner.search.table)
        # bytes behind which every state is the first one again: no match goes over them
        self.resets = (scanner.search.table.reshape(-1, 256) == scanner.search.start).all(axis=0)
        if not self.resets[10]:
            raise ValueError("a rule crosses a line end")
        self.back = [(d, _shared(d.table)) for d in scanner.back]
        self.heads = [re.compile(r.head.encode()) for r in scanner.rules]
        self.kinds = [[(k, re.compile(p.encode()), n) for k, p, n in r.kinds] for r in scanner.rules]
        self.until = [re.compile(r.until.encode()) if r.until else None for r in scanner.rules]

    def ends(self, data: bytes, narrow: int = 24) -> list[tuple[int, int]]:
        """(end, state) wherever a match ends: the one pass over the bytes.

        No match goes over a line end, nor over other bytes that lead every state back to the first, such as most marks and all
        non-ASCII bytes: what lies between them is a lane of its own. Lanes advance together in numpy, the longest few of
        them at last alone.
        """
        a = np.frombuffer(data, np.uint8)
        breaks = np.flatnonzero(self.resets[a])
        starts = np.concatenate([[0], breaks + 1])
        size = np.concatenate([breaks, [len(a)]]) - starts
        starts, size = starts[size > 0], size[size > 0]
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        together = int(size[min(narrow, len(size) - 1)]) if len(size) else 0
        lanes = np.searchsorted(-size, -np.arange(together), side="left")
        table, accept = self.search.table, self.search.accept
        state = np.full(len(size), self.search.start, np.int32)
        out: list[tuple[int, int]] = []
        for step in range(together):
            n = lanes[step]
            at = starts[:n] + step
            now = table[state[:n] + a[at]]
            state[:n] = now
            if now.max() >= accept:
                hit = np.flatnonzero(now >= accept)
                out += zip((at[hit] + 1).tolist(), now[hit].tolist(), strict=True)
        flat = self.table
        for k in range(int((size > together).sum())):
            s, first = int(state[k]), int(starts[k]) + together
            for i, b in enumerate(data[first : int(starts[k] + size[k])], first + 1):
                s = flat[s + b]
                if s >= accept:
                    out.append((i, s))
        return sorted(out)

    def starts(self, k: int, data: bytes, end: int, low: int) -> int:
        """The leftmost start, not before ``low``, of rule k's matches that end at ``end``; -1 if none."""
        dfa, table = self.back[k]
        state, found, at = dfa.start, -1, end
        while at > low:
            at -= 1
            state = table[state + data[at]]
            if state < 0:
                break
            if state >= dfa.accept:
                found = at
        return found

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text; the texts are scanned together, a line end between them."""
        datas = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        first = np.cumsum([0, *(len(d) + 1 for d in datas)])
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        hits = self.ends(b"\n".join(datas))
        i = 0
        while i < len(hits):
            k = int(np.searchsorted(first, hits[i][0], side="right")) - 1
            j = i
            while j < len(hits) and hits[j][0] < first[k + 1]:
                j += 1
            base = int(first[k])
            out[k] = self.resolve(datas[k], texts[k] or "", [(e - base, s) for e, s in hits[i:j]])
            i = j
        return out

    def resolve(self, data: bytes, text: str, hits: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in the rules' order."""
        runs: dict[int, list[int]] = {}
        for end, state in hits:
            mask = self.search.masks[(state - self.search.accept) >> 8]
            for k in range(len(self.rules)):
                if mask >> k & 1:
                    of = runs.setdefault(k, [])
                    if of and of[-1] == end - 1:
                        of[-1] = end
                    else:
                        of.append(end)
        found = []
        for k, lasts in runs.items():
            low = 0
            for end in lasts:
                if end <= low:  # inside a match that went on
                    continue
                start = self.starts(k, data, end, low)
                if start < 0:
                    continue
                if self.until[k]:
                    close = self.until[k].search(data, end)
                    end = close.end() if close else len(data)
                low = end
                if self.kinds[k]:
                    of = ((kind, m, n) for kind, p, n in self.kinds[k] for m in p.finditer(data, start, end))
                    found += [(m.start(), k, m.end(), kind) for kind, m, n in of if m.end() - m.start() >= n and None not in m.groups()]
                elif end - self.heads[k].match(data, start, end).end() >= self.rules[k].min_chars:
                    found.append((start, k, end, self.rules[k].kind))
        found.sort()
        if len(data) == len(text):
            return [(kind, s, e) for s, _, e, kind in found]
        points = {at: 0 for s, _, e, _ in found for at in (s, e)}
        last = done = 0
        for at in sorted(points):
            done += len(data[last:at].decode("utf-8", "surrogatepass"))
            points[at], last = done, at
        return [(kind, points[s], points[e]) for s, _, e, kind in found]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark of its first kind."""
    if not spans or text is None:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


_WORKER: dict = {}


def secret_scan(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), scanner: Scanner | None = None, with_text: bool = False) -> DataFrame:
    """Append the counts, spans and, on request, the redacted text; a narrow map over the broadcast transition arrays,
    whose size depends on the rules alone."""
    scanner = scanner or build()
    held = df.sparkSession.sparkContext.broadcast(scanner)
    patterns = scanner.rules

    def run(texts):
        if _WORKER.get("patterns") != patterns:
            _WORKER.update(patterns=patterns, ready=Ready(held.value))
        all_spans = _WORKER["ready"].batch(texts)
        base = [[s for s in spans if s[0] in BASE] for spans in all_spans]
        out = {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE}
        out["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
        out["spans"] = pa.array([written(s) for s in all_spans], pa.string())
        if with_text:
            out["redacted_text"] = pa.array([redact(t, s) for t, s in zip(texts, all_spans, strict=True)], pa.string())
        return out

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", *(["redacted_text"] if with_text else []))]
    return map_texts(df, run, T.StructType(fields), text_col, carry)

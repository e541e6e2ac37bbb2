"""Operator 3: language by cross-parsing entropy over suffix automata.

Per language, labelled text is compiled to a suffix automaton. A document is cut greedily into the longest phrases that
occur in a language's text; phrases are normalised by the text's length and by the logarithm of what the language has
learned from, and the language that needs the fewest wins.

Long texts are parsed from many places at once, and joined exactly: a parse that begins at a place of its own soon begins
a phrase where the parse from further left begins one, and from there on both are the same.

Defined cases: a null text or one without letters is ``und`` with score 0; letters unknown to a language are phrases of
their own; ties go to the language that sorts first; rows without a language teach nothing; equal texts teach once;
without any labelled text, as in an empty table, every document is ``und``; repeated rows give repeated results; a carried
column gives way to an output of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.llm.common import crc_of_id, cut, map_texts, smallest_per_group

BLOCK = 2048  # symbols between the places where parses of a long text begin; no result depends on it
MARKS = 64 << 20  # phrase beginnings (text symbols times languages) held at once
SPAN = 256
GAP, OTHER = 0, 1  # symbols: a run of non-letters; a letter that no language has


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point the lower-case letter it stands for, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, runs of anything else as one 0; and the number of symbols of each text."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    lens = np.array([len(r) // 4 for r in raw], np.int64)
    a = _lower_letters()[np.frombuffer(b"".join(raw), "<u4")]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
    starts = np.cumsum(lens) - lens
    keep[starts[lens > 0]] = True
    owner = np.repeat(np.arange(len(texts)), lens)
    return a[keep], np.bincount(owner[keep], minlength=len(texts))


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, symbol -> state for each state; the root is 0."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in map(int, symbols):
        if s == OTHER:  # occurs in no phrase: begin afresh
            last = 0
            continue
        if s in nxt[last] and length[nxt[last][s]] == length[last] + 1:
            last = nxt[last][s]  # only after a fresh start, when the text was seen before
            continue
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each state, owner, target): the rows laid over each other without a clash, so that the table grows with
    the transitions, not with states times symbols. ``owner[place + symbol]`` is the state's own place where it has the
    transition, and ``target`` the next state's place; no two states have one place.
    """
    room = 2 * sum(map(len, rows)) + len(rows) + 1
    place, taken, used, end, draw = [0] * len(rows), set(), set(), room + width, 1
    for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])):
        for _ in range(64):
            draw = draw * 6364136223846793005 + 1442695040888963407 & 0xFFFFFFFFFFFFFFFF
            at = (draw >> 16) % room
            if at not in taken and all(at + s not in used for s in rows[i]):
                break
        else:  # too wide a row for the gaps: behind the end
            at, end = end, end + width
        place[i] = at
        taken.add(at)
        used.update(at + s for s in rows[i])
    owner, target = np.full(end + width, -1, np.int64), np.zeros(end + width, np.int64)
    for at, row in zip(place, rows, strict=True):
        for s, t in row.items():
            owner[at + s], target[at + s] = at, place[t]
    return np.array(place, np.int64), owner, target


@dataclass(frozen=True)
class ParseModel:
    """The languages' automata over ``alphabet`` symbols, each in a sparse table of its own, one behind the other."""

    languages: tuple[str, ...]
    alphabet: np.ndarray  # sorted code points, symbol = position + 2
    owner: np.ndarray  # place + symbol -> the place, if the state there has the transition
    target: np.ndarray  # place + symbol -> the next state's place
    roots: np.ndarray  # place of each language's root
    learned: np.ndarray  # symbols that each language has learned from

    def symbols(self, points: np.ndarray) -> np.ndarray:
        names = np.full(0x110000, OTHER, np.int32)
        names[self.alphabet] = np.arange(2, len(self.alphabet) + 2)
        names[0] = GAP
        return names[points]

    def step(self, state: np.ndarray, s: np.ndarray) -> np.ndarray:
        at = state + s
        return np.where(self.owner[at] == state, self.target[at], -1)

    def advance(self, state: np.ndarray, fresh: np.ndarray, roots: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One symbol on: the new states, whether the symbol begins a phrase, and whether the next one must."""
        now = self.step(state, s)
        begins = (now < 0) | fresh
        if begins.any():
            now = np.where(now < 0, self.step(roots, s), now)
            alone = now < 0  # no phrase of the language begins so: the symbol is one of its own
            return np.where(alone, roots, now), begins, alone
        return now, begins, np.zeros_like(begins)

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the text's letters."""
        points, n_sym = letters(texts)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        n_letters = np.bincount(np.repeat(np.arange(len(texts)), n_sym)[points != 0], minlength=len(texts))
        if len(points) and len(self.languages):
            sym, ends = self.symbols(points), np.cumsum(n_sym)
            most, first = max(1, MARKS // len(self.languages)), 0
            while first < len(texts):  # runs of texts that fit together, one at least
                begin = int(ends[first] - n_sym[first])
                last = max(first + 1, int(np.searchsorted(ends, begin + most, side="right")))
                counts[first:last] = self._parse(sym[begin : ends[last - 1]], n_sym[first:last])
                first = last
        return counts, n_letters

    def _parse(self, sym: np.ndarray, n_sym: np.ndarray) -> np.ndarray:
        """Phrases of each text (``n_sym`` symbols of ``sym``) in each language."""
        langs = np.arange(len(self.languages))[:, None]
        ends = np.cumsum(n_sym)
        blocks = -(-n_sym // BLOCK)
        owner = np.repeat(np.arange(len(n_sym)), blocks)
        start = (ends - n_sym)[owner] + (np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]) * BLOCK
        size = np.minimum(BLOCK, ends[owner] - start)
        order = np.argsort(-size, kind="stable")
        lanes = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # blocks longer than each step
        place = start[order]
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        fresh = np.ones((len(langs), len(owner)), bool)  # the next symbol begins a phrase
        marks = np.zeros((len(langs), len(sym)), bool)  # where the parse of each block begins phrases
        for step, n in enumerate(lanes.tolist()):
            at = place[:n] + step
            state[:, :n], begins, fresh[:, :n] = self.advance(state[:, :n], fresh[:, :n], self.roots[:, None], sym[at])
            marks[:, at] = begins
        # each block's parse goes on into the next ones, until it begins a phrase where theirs begins one
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        state, fresh = state[:, back], fresh[:, back]
        stop = ends[owner]
        meet = np.repeat(stop[None, :], len(langs), axis=0)  # where it met them: the text's end if nowhere
        extra = np.zeros_like(meet)  # phrases that it began until then
        lang, lane = np.nonzero(np.repeat((start + size < stop)[None, :], len(langs), axis=0))
        at = (start + size)[lane]
        s, f = state[lang, lane], fresh[lang, lane]
        while len(lane):
            s, begins, f = self.advance(s, f, self.roots[lang], sym[at])
            met = begins & marks[lang, at]
            meet[lang[met], lane[met]] = at[met]
            extra[lang, lane] += begins & ~met
            at = at + 1
            on = ~met & (at < stop[lane])
            lang, lane, at, s, f = lang[on], lane[on], at[on], s[on], f[on]
        counts = np.zeros((len(n_sym), len(langs)), np.int64)
        single = blocks[owner] == 1
        upto = np.zeros((len(langs), len(sym) + 1), np.int32)
        np.cumsum(marks, axis=1, out=upto[:, 1:])
        here = start[single]
        counts[owner[single]] = (upto[:, here + size[single]] - upto[:, here]).T
        begin = np.repeat((ends - n_sym)[None, :], len(langs), axis=0)  # where the true parse of each text stands
        for b in np.flatnonzero(~single):
            t, end = owner[b], start[b] + size[b]
            inside = begin[:, t] < end  # else the parse from further left ran past this block
            counts[t] += np.where(inside, upto[langs[:, 0], end] - upto[langs[:, 0], begin[:, t]] + extra[:, b], 0)
            begin[:, t] = np.where(inside, meet[:, b], begin[:, t])
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts, n = self.phrases(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        # the cross-parsing estimate of the entropy: phrases a letter, times the bits that name a place in what was learned
        rate = counts * np.log2(self.learned + 1.0) / np.maximum(n, 1)[:, None]
        best = rate.argmin(axis=1)
        if len(self.languages) > 1:
            two = np.sort(rate, axis=1)[:, :2]
            score = two[:, 1] / np.maximum(two.sum(axis=1), 1e-9)
        else:
            score = np.ones(len(texts))
        none = n == 0
        score[none] = 0
        return ["und" if none[i] else self.languages[b] for i, b in enumerate(best)], score


def build_model(texts_by_lang: dict[str, list[str]]) -> ParseModel:
    """Compile all the texts given; a language without a letter in them is not learned."""
    points = {lang: letters(["\n".join(texts_by_lang[lang])])[0] for lang in sorted(texts_by_lang)}
    points = {k: v for k, v in points.items() if (v != 0).any()}
    alphabet = np.unique(np.concatenate([np.unique(v[v != 0]) for v in points.values()])) if points else np.zeros(0, np.uint32)
    none = np.zeros(0, np.int64)
    model = ParseModel(tuple(points), alphabet, none, none, none, none)
    owners, targets, roots, at = [], [], [], 0
    for p in points.values():
        place, owner, target = displaced(suffix_automaton(model.symbols(p)), len(alphabet) + 2)
        owners.append(np.where(owner < 0, -1, owner + at))
        targets.append(target + at)
        roots.append(place[0] + at)
        at += len(owner)
    if not points:
        return model
    learned = np.array([len(p) for p in points.values()], np.int64)
    return ParseModel(tuple(points), alphabet, np.concatenate(owners), np.concatenate(targets), np.array(roots, np.int64), learned)


def shares(sizes: list[int], total: int) -> list[int]:
    """What each text may teach: short ones all, longer ones an equal share of the rest."""
    out, left = [0] * len(sizes), total
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - k))
        left -= out[i]
    return out


def spread(text: Column, share: Column) -> Column:
    """``share`` characters of a text, in spans of up to ``SPAN`` that lie evenly over the whole of it."""
    n, spans = F.length(text), F.ceil(share / SPAN).cast("int")
    size = F.floor(share / spans).cast("int")
    start = lambda i: F.floor(i * (n - size) / F.greatest(spans - 1, F.lit(1))).cast("int") + 1
    cut_up = F.transform(F.sequence(F.lit(0), spans - 1), lambda i: F.substring(text, start(i), size))
    return F.when(n <= share, F.array(text)).when(share > 0, cut_up).otherwise(F.array())


def fit(df: DataFrame, docs_per_lang: int = 64, chars: int = 24_000) -> ParseModel:
    """Fit on a sample that is bounded per language: the ``docs_per_lang`` distinct texts outside the held-out fold with
    the smallest hash, equal ones once, and ``chars`` symbols spread over them. Every language of the fold is learned.
    """
    spark = df.sparkSession
    known = df.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_of_id() % 4 != 2)).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    distinct = known.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    chosen = smallest_per_group(distinct, "lang", [F.col("h")], docs_per_lang)
    squeezed = F.regexp_replace("text", r"\P{L}+", " ").alias("text")
    texts = cut(known.join(F.broadcast(chosen), ["doc_id", "lang", "h"]).select("lang", "h", squeezed).dropDuplicates(["lang", "h"]))
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in texts.select("lang", "h", F.length("text").alias("n")).orderBy("lang", "h").toLocalIterator():
        sizes.setdefault(r["lang"], []).append((r["h"], r["n"]))
    rows = [(lang, h, m) for lang, of in sizes.items() for (h, _), m in zip(of, shares([n for _, n in of], chars), strict=True)]
    share = F.broadcast(spark.createDataFrame(rows, "lang string, h long, share int"))
    by_lang: dict[str, list[str]] = {}
    for r in texts.join(share, ["lang", "h"]).select("lang", "h", spread(F.col("text"), F.col("share")).alias("spans")).orderBy("lang", "h").toLocalIterator():
        by_lang.setdefault(r["lang"], []).extend(r["spans"])
    return build_model(by_lang)


def identify(df: DataFrame, model: ParseModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append lang_pred and score to every row; a narrow map over the broadcast automata."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        lang, score = held.value.predict(texts)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_texts(df, run, out, text_col, carry)

"""Operator 1: line-first quality rules.

Each line is judged on its own (punctuation, navigation, boilerplate); failing lines are removed, and a document that
loses too large a share of its words is rejected. The whole text is read; nothing is truncated.

Defined cases: a null or empty text has no words and is base-failed; a line without a word is neither kept nor lost;
repeated rows give repeated results; extra input columns are ignored unless carried, and an output wins over a carried
column of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from embergrid.llm.common import map_texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Phrases of page furniture; a line holding one is boilerplate.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to",
    "lorem ipsum", "privacy policy", "read more", "sign up for", "skip to content", "subscribe to", "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; shares are percent of the line's words."""

    max_symbol_percent: int = 30  # punctuation: symbols other than bars
    max_shout_percent: int = 30  # punctuation: exclamation and question marks
    min_unmarked_words: int = 60  # punctuation: so many words without a sentence mark
    max_bar_percent: int = 25  # navigation: vertical bars
    min_bars: int = 3
    max_stutter_percent: int = 40  # boilerplate: words equal to the one before
    min_stutters: int = 5
    max_lost_percent: int = 50  # of the document's words


_MARKS = re.compile(r"[.,;:!?…。、！？؟।]")
_UPPER = re.compile(r"[A-Z]")
_LOWER = re.compile(r"[a-z]")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))


def line_fails(line: str, words: list[bytes], rules: LineRules) -> str | None:
    """The rule that removes the line, or None."""
    n_words = len(words)
    bars = line.count("|")
    if bars >= rules.min_bars and 100 * bars > rules.max_bar_percent * n_words:
        return "navigation"
    symbols = sum(line.count(c) for c in SYMBOLS) - bars
    if 100 * symbols > rules.max_symbol_percent * n_words and symbols >= 3:
        return "punctuation"
    shouts = line.count("!") + line.count("?")
    if 100 * shouts > rules.max_shout_percent * n_words and shouts >= 3:
        return "punctuation"
    if n_words >= rules.min_unmarked_words and not _MARKS.search(line):
        return "punctuation"
    if _BOILER.search(line.lower()):
        return "boilerplate"
    stutters = sum(map(bytes.__eq__, words, words[1:]))
    if stutters >= rules.min_stutters and 100 * stutters > rules.max_stutter_percent * n_words:
        return "boilerplate"
    if n_words >= 3 and len(_UPPER.findall(line)) > len(_LOWER.findall(line)):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words covered by the 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):  # names of 2, 4 and 8 words, each exact
        _, ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def clean_text(text: str | None, rules: LineRules = LineRules()) -> dict:
    """All figures of one text, with the text that is left after the failing lines are gone."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the ASCII white space of the contract
    n = len(words)
    spaces = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    dup = lost = n_failed = 0
    seen: set[str] = set()
    left: list[str] = []
    for line in text.split("\n"):
        line_words = line.encode("utf-8", "surrogatepass").split()
        w = len(line_words)
        if not w:
            left.append(line)
            continue
        if line in seen:
            dup += 1
            why = "boilerplate"
        else:
            seen.add(line)
            why = line_fails(line, line_words, rules)
        if why:
            lost += w
            n_failed += 1
        else:
            left.append(line)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": len(text) - spaces, "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": dup,
        "n_repeat_words": repeat, "base_failed": failed, "kept": not failed and 100 * lost <= rules.max_lost_percent * n,
        "n_failed_lines": n_failed, "n_lost_words": lost, "clean_text": "\n".join(left),
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPES = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "clean_text": T.StringType()}
_ARROW = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}


def quality_rules(
    df: DataFrame,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    rules: LineRules = LineRules(),
    with_text: bool = False,
    only_kept: bool = False,
) -> DataFrame:
    """One row per input row: the base figures, the verdict and, on request, the cleaned text.

    A narrow map: no shuffle, memory bounded by one Arrow batch.
    """
    names = [*_LONGS, "base_failed", "kept", "n_failed_lines", "n_lost_words", *(["clean_text"] if with_text else [])]

    def judge(texts):
        rows = [clean_text(t, rules) for t in texts]
        return {c: pa.array([r[c] for r in rows], _ARROW.get(c, pa.int64())) for c in names}

    out = T.StructType([T.StructField(c, _TYPES.get(c, T.LongType())) for c in names])
    return map_texts(df, judge, out, text_col, carry, "kept" if only_kept else None)

"""Many patterns at once: the first of thousands of rules that matches a text.

Trying every pattern on every text costs rules times texts. Each alternative of a pattern has pieces of plain letters that any
match must contain; the one that fewest other rules share stands for it in one automaton over all rules (Aho-Corasick), which
reads a text once and says which rules are worth trying. Those are tried in order until one matches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars; a group around all of it is opened."""
    out, depth, begun, at, in_class = [], 0, 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]" or pattern[at - 1 : at] == "[" or pattern[at - 2 : at] == "[^"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[begun:at])
            begun = at + 1
        at += 1
    out.append(pattern[begun:])
    opened = []
    for one in out:
        inner = one[3:-1] if one.startswith("(?:") else one[1:-1] if one.startswith("(") and not one.startswith("(?") else None
        whole = inner is not None and _group_end(one, 0) == len(one)
        opened += alternatives(inner) if whole else [one]
    return opened


def _group_end(pattern: str, at: int) -> int:
    """Where the group that begins at ``at`` ends."""
    depth, in_class, begun = 0, False, at
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]" or at - 1 == begun
        elif c == "[":
            in_class, begun = True, at + (pattern[at + 1 : at + 2] == "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at + 1
        at += 1
    return at


def pieces(alternative: str) -> list[str]:
    """Runs of plain characters, in lower case, that every match of an alternative contains."""
    runs, run, at = [], "", 0
    while at < len(alternative):
        c, plain = alternative[at], None
        at += 1
        if c == "\\":
            plain = alternative[at : at + 1] if not alternative[at : at + 1].isalnum() else None
            at += 1
        elif c == "[":
            closed = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.S).match(alternative, at - 1)
            at = closed.end() if closed else len(alternative)
        elif c == "(":
            at = _group_end(alternative, at - 1)
        elif c not in ".^$*+?{":
            plain = c
        quantifier = re.compile(r"[*+?]|\{\d*,?\d*\}").match(alternative, at)
        if quantifier is None:
            if plain is not None:
                run += plain
                continue
        else:
            at = quantifier.end()
            if plain is not None and re.match(r"\+|\{0*[1-9]", quantifier[0]):
                run += plain
            lazy = alternative[at : at + 1]
            at += lazy in ("?", "+") and bool(lazy)
        runs.append(run)
        run = ""
    return [r.lower() for r in [*runs, run] if r]


class Rules:
    """Patterns with labels, in order of precedence. Patterns are Python's, for ASCII letters in any case, over line ends, and
    match at the start of a text."""

    def __init__(self, rules: Sequence[tuple[str, object]]):
        self.rules = [(pattern, label) for pattern, label in rules]
        found = [[pieces(a) for a in alternatives(pattern)] for pattern, _ in self.rules]
        shared = Counter(p for each in found for p in {p for own in each for p in own})
        self.keys: list[list[str] | None] = []
        for each in found:
            best = [min(own, key=lambda p: (shared[p], -len(p)), default=None) for own in each]
            self.keys.append(None if None in best else best)
        self.always = [i for i, k in enumerate(self.keys) if k is None]
        self._automaton, self._compiled = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_compiled": {}}

    def _rules_of_pieces(self):
        by_piece: dict[str, list[int]] = {}
        for i, keys in enumerate(self.keys):
            for k in keys or ():
                by_piece.setdefault(k, []).append(i)
        automaton = ahocorasick.Automaton()
        for piece, own in by_piece.items():
            automaton.add_word(piece, own)
        if by_piece:
            automaton.make_automaton()
        return automaton

    def worth_trying(self, text: str) -> list[int]:
        """Numbers of the rules that may match, in order."""
        if self._automaton is None:
            self._automaton = self._rules_of_pieces()
        found = set(self.always)
        if len(self._automaton):
            for _, own in self._automaton.iter(text.lower()):
                found.update(own)
        return sorted(found)

    def first(self, text: str) -> int | None:
        """The number of the first rule that matches."""
        for i in self.worth_trying(text):
            if i not in self._compiled:
                self._compiled[i] = re.compile(self.rules[i][0], re.I | re.S | re.A)
            if self._compiled[i].match(text):
                return i
        return None


def classify(df: DataFrame, text: str, rules: Sequence[tuple[str, str]], unknown: str | None = None, label: str = "label") -> DataFrame:
    """``df`` with the label of the first rule (pattern, label) that matches the text at its start; null texts and texts that no
    rule matches get ``unknown``. A text that repeats within a batch is looked at once."""
    known = Rules(rules)
    if any(isinstance(x, str) is False and x is not None for _, x in rules):
        raise ValueError("labels must be text")

    def work(texts: pd.Series) -> pd.Series:
        found = {t: known.first(t) for t in texts.dropna().unique()}
        return texts.map(lambda t: unknown if t is None or found[t] is None else known.rules[found[t]][1])

    work.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return df.withColumn(label, F.pandas_udf(work, "string")(F.col(f"`{text}`")))

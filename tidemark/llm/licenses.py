"""License scans by template-markup matching.

A template is license wording with markup: ``[[...]]`` is optional, ``<<name;.a..b>>``
stands for ``a`` to ``b`` replaceable words. Each template compiles into a token
automaton (states, word transitions, free transitions), which accepts a stretch of a text
when all mandatory words stand in it exactly, in order. The automaton starts only at
places where the template's first mandatory words stand, found by byte search, and one
set of states advances per word, so a scan is linear in the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import alnum_words

# Fixed phrases of the base labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Templates of the method's own labels: words of well-known license notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files [[the software]] to deal in the software without restriction"),
    ("mit", "[[released]] under the <<kind;.0..2>> mit license"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("bsd-3", "neither the name of <<holder;.1..12>> nor the names of [[its]] [[the]] contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission"),
    ("gpl", "gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]] [[either]] version <<v;.1..2>>"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by-nc", "[[licensed]] [[under]] [[a]] [[the]] creative commons attribution non commercial <<kind;.0..2>> license"),
    ("cc-by-nc", "cc by nc [[sa]] [[nd]] <<v;.0..2>>"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 [[universal]]"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved <<who;.0..6>> confidential"),
)

_MARK = re.compile(rb"\[\[|\]\]|<<[^>]*>>|[^\s\[\]<>]+")
_RANGE = re.compile(rb"<<[^;>]*;\.(\d+)\.\.(\d+)>>")


class Automaton:
    """Token automaton of one template. ``steps[s]``: (word or None for any, next state);
    ``free[s]``: states reached without a word; ``core``: its mandatory words."""

    def __init__(self, template: str):
        self.steps: list[list] = [[]]
        self.free: list[list] = [[]]
        state, open_, core, first, lead = 0, [], [], [], True

        def new():
            self.steps.append([])
            self.free.append([])
            return len(self.steps) - 1

        for tok in _MARK.findall(template.encode()):
            if tok == b"[[":
                open_.append(state)
                lead = lead and not first
            elif tok == b"]]":
                self.free[open_.pop()].append(state)
            elif tok.startswith(b"<<"):
                lo, hi = map(int, _RANGE.fullmatch(tok).groups())
                exits = []
                for k in range(hi):
                    if k >= lo:
                        exits.append(state)
                    n = new()
                    self.steps[state].append((None, n))
                    state = n
                for e in exits:
                    self.free[e].append(state)
                lead = lead and not first
            else:
                n = new()
                self.steps[state].append((tok, n))
                state = n
                if not open_:
                    core.append(tok)
                    if lead:
                        first.append(tok)
                    continue
            if first:
                lead = False
        self.end, self.core, self.anchor = state, core, b" ".join(first)
        # start at the state in front of the first mandatory word: what is optional before it adds nothing
        self.start = next(s for s, out in enumerate(self.steps) if any(w == first[0] for w, _ in out) and self._bare(s, template))

    def _bare(self, state: int, template: str) -> bool:
        """Whether the state lies outside optional parts: it is reached from the start freely."""
        return state in self.closure({0})

    def closure(self, states: set) -> set:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def run(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted stretch that starts at word ``at``, or -1; and how many states held out."""
        states, end = self.closure({self.start}), -1
        for k in range(at, len(words)):
            w = words[k]
            states = {n for s in states for word, n in self.steps[s] if word is None or word == w}
            if not states:
                break
            states = self.closure(states)
            if self.end in states:
                end = k + 1
        return end


_COMPILED: dict = {}


def compiled(templates=TEMPLATES):
    if templates not in _COMPILED:
        _COMPILED[templates] = [(label, Automaton(t)) for label, t in templates]
    return _COMPILED[templates]


def _places(hay: bytes, phrase: bytes) -> list[int]:
    """Byte offsets (in ``hay``, which has a space at both ends) where the words stand."""
    out, needle, at = [], b" " + phrase + b" ", hay.find(b" " + phrase + b" ")
    while at >= 0:
        out.append(at)
        at = hay.find(needle, at + 1)
    return out


def scan_text(text: str | None, templates=TEMPLATES) -> dict:
    """n_words, base places (start word, label) and template matches (label, start, end, mandatory words)."""
    words = alnum_words(text)
    hay = b" " + b" ".join(words) + b" "
    gaps = None

    def word_at(offset):
        nonlocal gaps
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(hay, np.uint8) == 32)
        return int(np.searchsorted(gaps, offset))

    base = [(word_at(at), label) for phrase, label in BASE_PHRASES for at in _places(hay, phrase.encode())]
    matches = []
    for label, automaton in compiled(templates):
        last = -1
        for at in _places(hay, automaton.anchor):
            start = word_at(at)
            if start < last:
                continue                     # inside the match before it
            end = automaton.run(words, start)
            if end > 0:
                matches.append((label, start, end, len(automaton.core)))
                last = end
    return {"n_words": len(words), "base": sorted(base), "matches": matches}


#: Mandatory words at which a match counts as certain.
CERTAIN_WORDS = 12


def score(found: dict) -> float:
    """0 without a match; rises with the mandatory words of the best match, 1 from CERTAIN_WORDS on.
    A base phrase counts as a match of its own words."""
    best = max([m[3] for m in found["matches"]] + [len(p.split()) for p, label in BASE_PHRASES if any(b[1] == label for b in found["base"])], default=0)
    return min(1.0, 0.5 + 0.5 * best / CERTAIN_WORDS) if best else 0.0


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and ``matches`` (array of label, start, end in words).

    Null and empty texts have no words, empty labels and score 0; repeated rows each give a
    row; an empty table gives none; only the two named columns are read. One pass, no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            rows = [scan_text(t) for t in b.column(1).to_pylist()]
            starts = [[s for s, _ in r["base"]] for r in rows]
            base = [sorted({x for _, x in r["base"]}) for r in rows]
            both = [sorted(set(x) | {m[0] for m in r["matches"]}) for x, r in zip(base, rows)]
            yield pa.RecordBatch.from_arrays([
                b.column(0),
                pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array(map(len, starts), pa.int64()),
                pa.array([min(s, default=None) for s in starts], pa.int64()),
                pa.array([max(s, default=None) for s in starts], pa.int64()),
                pa.array(map(",".join, base), pa.string()),
                pa.array(map(",".join, both), pa.string()),
                pa.array(map(score, rows), pa.float64()),
                pa.array([[{"label": m[0], "start": m[1], "end": m[2]} for m in r["matches"]] for r in rows], match_type),
            ], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, matches array<struct<label:string,start:long,end:long>>")

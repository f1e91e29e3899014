"""License scans: template markup compiled into token automata, next to base phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common, words

#: Base phrases and the label of each.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates in markup of its own: [[ ... ]] may be missing, {{n}} stands for one to n words of any wording. Everything
#: else is mandatory, word for word; case and punctuation do not count.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[,]] version 2.0 [[ (the license) ]]",
    "apache-2.0-header": "licensed under the apache license version 2.0 the license you may not use this {{2}} except in compliance with the license "
    "you may obtain a copy of the license at [[ http www apache org licenses license 2 0 ]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-disclaimer": "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-nc-4.0": "licensed under [[ a ]] [[ creative commons ]] cc by nc 4.0 [[ international ]] [[ license ]]",
    "cc-by-sa-4.0": "licensed under [[ a ]] [[ creative commons ]] cc by sa 4.0 [[ international ]] [[ license ]]",
    "gpl-3.0": "licensed under the gnu general public license [[ as published by the free software foundation ]] [[ either ]] version 3",
    "gpl-2.0": "licensed under the gnu general public license [[ as published by the free software foundation ]] [[ either ]] version 2",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu [[ lesser ]] general public license as published by the free software "
    "foundation either version {{2}} of the license or at your option any later version",
    "isc": "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "[[ the software ]] to deal in the software without restriction",
    "reserved-notice": "copyright {{8}} all rights reserved",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
    "from the use of this software",
}

#: One byte table: A-Z to a-z, every byte that belongs to no word to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: bytes) -> bytes:
    return text.translate(_FOLD)


@dataclass(frozen=True)
class Automaton:
    """States 0..accept; step[s] maps a word to the next state, skip[s] are states reached without a word, any states take every word."""

    step: tuple[tuple[bytes, int] | None, ...]
    skip: tuple[tuple[int, ...], ...]
    accept: int

    def closure(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return found

    def longest(self, tokens: list[bytes], start: int) -> int:
        """End of the longest accepted run of tokens from start, or -1."""
        states, end, at = self.closure({0}), -1, start
        while True:
            if self.accept in states:
                end = at
            if at == len(tokens):
                return end
            word = tokens[at]
            moved = {arc[1] for s in states if (arc := self.step[s]) is not None and arc[0] in (b"", word)}
            if not moved:
                return end
            states, at = self.closure(moved), at + 1


def compile_template(markup: str) -> Automaton:
    """Parts in order; an optional part adds a skip over itself, a replaceable part a chain of wildcard steps."""
    step: list[tuple[bytes, int] | None] = [None]
    skip: list[list[int]] = [[]]

    def add(word: bytes) -> None:
        step[-1] = (word, len(step))
        step.append(None)
        skip.append([])

    for optional, span, literal in re.findall(r"\[\[(.*?)\]\]|\{\{(\d+)\}\}|((?:(?!\[\[|\{\{).)+)", markup, re.S):
        if span:
            exits = []
            for _ in range(int(span)):
                add(b"")
                exits.append(len(step) - 1)
            for s in exits[:-1]:
                skip[s].append(exits[-1])
            continue
        first = len(step) - 1
        for word in fold((optional or literal).encode()).split():
            add(word)
        if optional:
            skip[first].append(len(step) - 1)
    return Automaton(tuple(step), tuple(map(tuple, skip)), len(step) - 1)


def opening(markup: str) -> bytes:
    """The words a match begins with: those before the first markup."""
    head = fold(re.split(r"\[\[|\{\{", markup, maxsplit=1)[0].encode()).split()
    if not head:
        raise ValueError(f"a template must begin with mandatory words: {markup!r}")
    return b" ".join(head)


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indices at which phrase stands in joined, a text of words with one space before and after each."""
    if phrase not in joined:
        return []
    needle, out, at = b" " + phrase + b" ", [], -1
    while (at := joined.find(needle, at + 1)) >= 0:
        out.append(at)
    counts, words_before, last = [], 0, 0
    for at in out:
        words_before += joined.count(b" ", last, at)
        counts.append(words_before)
        last = at
    return counts


def scan(text: bytes, phrases: dict[bytes, str], templates: list[tuple[str, bytes, Automaton]]) -> tuple:
    """(n_words, base places as (start, end, label), accepted templates as (start, end, label))."""
    tokens = fold(text).split()
    joined = b" " + b" ".join(tokens) + b" "
    base = [(at, at + phrase.count(b" ") + 1, label) for phrase, label in phrases.items() for at in places(joined, phrase)]
    found = []
    for label, head, automaton in templates:
        found += [(at, end, label) for at in places(joined, head) if (end := automaton.longest(tokens, at)) >= 0]
    return len(tokens), base, found


def _covered(spans: list[tuple[int, int, str]]) -> int:
    total, reach = 0, 0
    for a, b, _ in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _scan_batches(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    folded = {b" ".join(fold(p.encode()).split()): label for p, label in phrases.items()}
    automata = [(label, opening(markup), compile_template(markup)) for label, markup in templates.items()]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    for batch in batches:
        for a, b, buf, offsets in words.text_blocks(batch, "body", 8 << 20):
            whole, rows = buf.tobytes(), []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                n, base, found = scan(whole[i:j], folded, automata)
                rows.append((n, sorted(base), sorted(found), _covered(base + found) / n if n else 0.0))
            dicts = [[[dict(zip(("start", "end", "label"), s)) for s in r[k]] for r in rows] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(a, b - a), pa.array([r[0] for r in rows], pa.int64()), pa.array(dicts[0], span), pa.array(dicts[1], span),
                 pa.array([r[3] for r in rows], pa.float64())],
                ["doc", "n_words", "base", "templates", "score"],
            )


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None
) -> DataFrame:
    """Per row: doc, n_words, base and templates (arrays of start, end, label in words), score.

    Words are runs of ASCII letters and digits and of any non-ASCII code points, A-Z lower-cased. base has every place of every
    phrase; templates has, for each place where a template's opening words stand, the longest run that its automaton
    accepts. score is the share of the words inside either. A null or empty text has no words and score 0. Nothing is shuffled.
    """
    p, t = phrases or BASE_PHRASES, templates or TEMPLATES
    span = "array<struct<start:long,end:long,label:string>>"
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    return d.mapInArrow(lambda it: _scan_batches(it, p, t), f"doc {d.schema['doc'].dataType.simpleString()}, n_words long, base {span}, templates {span}, score double")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_spans(common.table(spark, sf_dir, "documents"))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), named(F.col("base.label")).alias("base_labels"),
        named(F.concat("base.label", "templates.label")).alias("labels"), "score",
    )

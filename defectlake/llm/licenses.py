"""License scans: a fuzzy search for short notices.

A notice that a text holds with at most k edits (characters put in, left out or changed) has at
least one of any k + 1 parts of it unchanged. So each notice is split in k + 1 parts of about equal
length, its seeds; one automaton finds the seeds of all notices in a single pass. A seed says within k
characters where a match begins and ends. The ``regex`` library matches the notice with each run of
whole words between such a beginning and end: without edits first, then with one more at a time. Of runs
that overlap, that with the fewest edits is the match, then the first, then the shortest.

Texts are compared by their words, lower-cased and one space apart. Each row is searched where it lies: nothing is shuffled.
"""

from __future__ import annotations

import functools
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake.llm import text as tx

#: Phrase and label, matched without edits.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notice and label, matched with edits.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("eclipse public license version 2 0", "epl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license version 1 0", "boost"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("all rights reserved", "reserved"),
)
#: Characters of a notice for each edit, and edits at most.
PER_EDIT, MOST_EDITS = 12, 4
#: Runs of words whose edits a task remembers.
REMEMBERED = 1 << 16

FOUND = "array<struct<notice: string, label: string, edits: int, word: long, words: int, start: long, end: long>>"
ARROW_FOUND = pa.list_(pa.struct([("notice", pa.string()), ("label", pa.string()), ("edits", pa.int32()), ("word", pa.int64()), ("words", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def with_edits(notices: tuple, per_edit: int = PER_EDIT, most: int = MOST_EDITS) -> tuple:
    """(notice, label, edits allowed) of notices, by their length."""
    return tuple((notice, label, min(most, len(notice) // per_edit)) for notice, label in notices)


SEARCHED = tuple((phrase, label, 0) for phrase, label in BASE) + with_edits(NOTICES)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """Where each of the ``edits`` + 1 parts of a notice begins, and the part."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(lo, notice[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


@functools.cache
def _pattern(notice: str, edits: int):
    return regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")


@functools.lru_cache(REMEMBERED)
def edits_of(words: str, notice: str, most: int) -> int | None:
    """The fewest edits between some words and a notice, if these are at most ``most``."""
    if words == notice:
        return 0
    return next((n for n in range(1, most + 1) if _pattern(notice, n).fullmatch(words)), None)


class Search:
    """The seeds of some notices, found in one pass over a text."""

    def __init__(self, searched: tuple = SEARCHED):
        self.searched, self.automaton, of = searched, ahocorasick.Automaton(), {}
        for number, (notice, _, edits) in enumerate(searched):
            for at, part in seeds(notice, edits):
                of.setdefault(part, []).append((number, at + len(part)))
        for part, places in of.items():
            self.automaton.add_word(part, places)
        self.automaton.make_automaton()

    def runs(self, text: str, starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text number, notice number, first word, last word) of all runs of words that a seed points at.

        ``text`` has the words of several texts, which begin at ``starts`` and end at ``stops``; ``bounds`` part the texts.
        """
        ends, numbers, aheads = [], [], []
        for last, places in self.automaton.iter(text):
            for number, ahead in places:
                ends.append(last + 1)
                numbers.append(number)
                aheads.append(ahead)
        if not ends:
            return set()
        end, number = np.array(ends), np.array(numbers)
        size, edits = (np.array(x)[number] for x in zip(*[(len(notice), k) for notice, _, k in self.searched]))
        begin, own = end - np.array(aheads), np.searchsorted(bounds, end - 1, "right") - 1
        low, high = bounds[own], bounds[own + 1]
        first = np.searchsorted(starts, np.maximum(begin - edits, low)), np.searchsorted(starts, np.minimum(begin + edits, high - 1), "right")
        last = np.searchsorted(stops, np.maximum(begin + size - edits, low + 1)), np.searchsorted(stops, np.minimum(begin + size + edits, high), "right")
        some = (first[0] < first[1]) & (last[0] < last[1])
        out = set()
        for i, no, k, n, a0, a1, b0, b1 in zip(*[x[some].tolist() for x in (own, number, edits, size, *first, *last)]):
            out.update((i, no, a, b) for a in range(a0, a1) for b in range(max(a, b0), b1) if abs(int(stops[b] - starts[a]) - n) <= k)
        return out

    def found(self, texts: tx.Texts) -> tuple[np.ndarray, list[list[dict]]]:
        """Per text the number of its words, and its matches by place."""
        low = texts.lowered()
        starts, ends, first = tx.word_spans(low, tx.ALNUM)
        at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        body = np.full(at[-1], 0x20, np.uint8)
        in_word = np.ones(len(body), bool)
        in_word[at[1:] - 1] = False
        body[in_word] = low.data[tx.ALNUM[low.data]]
        char = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        begins, stops, normal = char[at[:-1]], char[at[1:]] - 1, body.tobytes().decode()
        out = [[] for _ in range(len(texts))]
        known = []
        for i, number, a, b in self.runs(normal, begins, stops, np.append(begins, len(normal))[first]):
            n = edits_of(normal[begins[a] : stops[b]], *self.searched[number][::2])
            if n is not None:
                known.append((i, number, n, a, b))
        if not known:
            return np.diff(first), out
        code_point = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        taken, of = [], None
        for i, number, n, a, b in sorted(known):
            if of != (i, number):
                taken, of = [], (i, number)
            near = bisect_left(taken, (a,))
            if near < len(taken) and taken[near][0] <= b or near and taken[near - 1][1] >= a:
                continue
            taken.insert(near, (a, b))
            notice, label, _ = self.searched[number]
            begin, end = (int(code_point[x] - code_point[texts.offsets[i]]) for x in (starts[a], ends[b]))
            out[i].append({"notice": notice, "label": label, "edits": n, "word": int(a - first[i]), "words": b - a + 1, "start": begin, "end": end})
        for row in out:
            row.sort(key=lambda m: (m["start"], m["end"], m["notice"]))
        return np.diff(first), out


def clearest(found: list[dict]) -> list[dict]:
    """Without those with edits that overlap one of another label with fewer edits; ``found`` is by place.

    Notices that differ by a letter or two match each other's places; a match is weighed against all, dropped or not.
    """
    out = []
    reach = max((m["words"] for m in found), default=0)
    starts = [m["word"] for m in found]
    for m in found:
        if m["edits"]:
            lo, hi = bisect_left(starts, m["word"] - reach), bisect_left(starts, m["word"] + m["words"])
            if any(o["edits"] < m["edits"] and o["label"] != m["label"] and o["word"] + o["words"] > m["word"] for o in found[lo:hi]):
                continue
        out.append(m)
    return out


def scan(docs: DataFrame, searched: tuple = SEARCHED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, and ``found``: notice, label, edits, first word and number of words, span in code points.

    ``searched`` are (notice, label, edits allowed), each of words one space apart, longer than its edits.

    Defined cases: a null text is empty; a text without words has none and nothing is found in it; rows of
    equal doc_id or text have a result each; a null doc_id is a value like others; places of one notice don't
    overlap, those of different notices may; other columns are ignored; no rows give no rows.
    """

    def run(batches):
        search = Search(searched)
        for batch in batches:
            for lo, hi, part in tx.chunks(tx.column_texts(batch.column(1))):
                n_words, found = search.found(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array([clearest(f) for f in found], ARROW_FOUND)], ["doc_id", "n_words", "found"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, found {FOUND}")


def digest(scanned: DataFrame, base: tuple = BASE) -> DataFrame:
    """The digest columns of a scan; the score is that of the match with the smallest share of edits, 0 without one."""
    own = F.filter("found", lambda m: m["notice"].isin([phrase for phrase, _ in base]))
    words = F.transform(own, lambda m: m["word"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")

    def likeness(m: Column) -> Column:
        return 1 - m["edits"] / F.length(m["notice"])

    return scanned.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), joined(own).alias("base_labels"),
        joined(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", likeness)), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("found", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"], m["edits"])), ",").alias("spans"),
    )

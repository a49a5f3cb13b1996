"""License scans: short notices found with a bounded number of edits.

A text is taken as its words (letters A-Z lowered; digits, ASCII letters and everything beyond
ASCII make words) joined by single spaces.  A notice stands in it where a stretch from a word's
begin to a word's end differs from the notice by at most ``edits`` insertions, deletions and
substitutions of characters.

1. Each notice is split into ``edits + 1`` pieces.  Edits can spoil all but one of them, so a
   stretch that is near the notice holds one of its pieces exactly (pigeonhole).  One automaton
   finds the pieces of all notices in one pass over the text.
2. A piece found says where the notice could begin: at words' begins that are at most
   ``edits`` characters from where it would begin without edits.
3. There the ``regex`` library's bounded-error matching decides and gives the span with the
   fewest edits; of spans of one notice that overlap the one with fewer edits is reported.

Phrases are found exactly, word for word, and reported apart from the notices.

Cases: null, empty and blank texts have no words and no spans; texts of any length are scanned
whole; repeated notices give a span each; repeated rows are scanned alike; an empty table gives
an empty result; columns that clash with the new one make it take another name.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import strings, unused

#: Phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Notices and their labels; the edits that a notice may have follow from its length where none
#: are given (codes that are two letters apart may not pass for each other).
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache-2"),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("dedicated to the public domain under cc0", "cc0"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license version 1 0", "boost-1"),
    ("eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]
LETTERS_PER_EDIT = 10

#: Bytes that words are made of stay, with A-Z lowered; the others become spaces.
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_text(text: str) -> str:
    """The words of a text joined by single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(AS_WORDS).split()).decode("utf-8", "surrogatepass")


def allowed_edits(notice: str) -> int:
    return len(notice) // LETTERS_PER_EDIT


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece) of ``edits + 1`` pieces of about equal length."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds phrases exactly and notices with edits in the words of a text."""

    def __init__(self, phrases=tuple(PHRASES), notices=tuple(NOTICES)):
        import ahocorasick
        self.phrases, self.notices = phrases, notices
        self.exact = [regex.compile(f"(?<![^ ]){regex.escape(p)}(?![^ ])") for p, _ in phrases]
        self.fuzzy, found = [], {}
        for k, (notice, _, *edits) in enumerate(notices):
            edits = edits[0] if edits else allowed_edits(notice)
            if len(notice) <= edits:
                raise ValueError("a notice needs more characters than edits")
            self.fuzzy.append((regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}(?![^ ])"), edits))
            for at, piece in pieces(notice, edits):
                found.setdefault(piece, []).append((k, at))
        for k, (phrase, _) in enumerate(phrases):
            found.setdefault(phrase, []).append((-1 - k, 0))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def _begins(self, text: str) -> tuple[set[int], dict[int, list[int]]]:
        """Phrases that occur somewhere, and the begins of words where each notice could begin."""
        phrases, around = set(), {}
        for last, (size, uses) in self.automaton.iter(text):
            for k, at in uses:
                if k < 0:
                    phrases.add(-1 - k)
                    continue
                at, edits = last + 1 - size - at, self.fuzzy[k][1]
                found = around.setdefault(k, set())
                if at - edits <= 0 <= at + edits:
                    found.add(0)
                space = text.find(" ", max(at - edits - 1, 0), max(at + edits, 0))
                while space >= 0:
                    found.add(space + 1)
                    space = text.find(" ", space + 1, at + edits)
        return phrases, {k: sorted(found) for k, found in around.items()}

    def __call__(self, text: str) -> tuple[list[dict], list[dict]]:
        """Places of the phrases and spans of the notices in a ``word_text``, in order."""
        phrases, begins = self._begins(text)
        places, spans = [], []
        for k in sorted(phrases):
            for m in self.exact[k].finditer(text):
                places.append({"label": self.phrases[k][1], "word": text.count(" ", 0, m.start())})
        for k, begins in begins.items():
            (pattern, edits), (notice, label) = self.fuzzy[k], self.notices[k][:2]
            near = []
            for a in begins:
                b = text.find(" ", a + len(notice) + edits)  # whole words
                m = pattern.match(text, a, len(text) if b < 0 else b)
                if m is not None:
                    near.append((sum(m.fuzzy_counts), a, m.end()))
            taken = []
            for n, a, b in sorted(near):  # of spans that overlap the one with the fewest edits
                if all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
                    spans.append({"label": label, "word": text.count(" ", 0, a), "n_words": text.count(" ", a, b) + 1,
                                  "edits": n, "likeness": 1 - n / len(notice), "text": text[a:b]})
        order = lambda x: (x["word"], x["label"], x.get("n_words", 0))
        return sorted(places, key=order), sorted(spans, key=order)


@functools.lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(phrases, notices)


PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
SPAN = pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64()),
                  ("likeness", pa.float64()), ("text", pa.string())])
SCAN = ("n_words long, places array<struct<label: string, word: long>>, spans array<struct<label: string, word: long, "
        "n_words: long, edits: long, likeness: double, text: string>>")


def scan_column(text: Column, phrases=tuple(PHRASES), notices=tuple(NOTICES)) -> Column:
    """Struct of SCAN: words of each whole text, places of the phrases, spans of the notices."""
    @arrow_udf(SCAN)
    def scanned(texts: pa.Array) -> pa.Array:
        scan, n_words, places, spans = scanner(phrases, notices), [], [], []
        for t in map(word_text, strings(texts)):
            n_words.append(t.count(" ") + 1 if t else 0)
            found = scan(t)
            places.append(found[0])
            spans.append(found[1])
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(places, pa.list_(PLACE)),
                                           pa.array(spans, pa.list_(SPAN))], names=["n_words", "places", "spans"])
    return scanned(text)


def with_licenses(docs: DataFrame, text: str = "text", phrases=tuple(PHRASES), notices=tuple(NOTICES)) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of SCAN; and its name."""
    (name,) = unused(docs, "licenses")
    return docs.withColumn(name, scan_column(F.col(text), tuple(phrases), tuple(notices))), name


def labels_of(*found: Column) -> Column:
    """Distinct labels of places and spans, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in found]))), ",")


def best_likeness(places: Column, spans: Column) -> Column:
    """1 where a phrase stands, else the likeness of the best span, 0 without any."""
    best = F.coalesce(F.array_max(F.transform(spans, lambda x: x["likeness"])), F.lit(0.0))
    return F.when(F.size(places) > 0, F.lit(1.0)).otherwise(best)

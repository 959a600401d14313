"""Licence scans with a positional index of rare tokens.

Each template is a short licence notice. Its words get an inverse document frequency
over all documents, and the index holds, for each template, the positions of its
``RARE`` rarest words. All index words of a file are looked up; a posting at position q met at word p votes that the template
begins at word p - q. Where ``VOTES`` different words agree, one of the template's mandatory key
phrases must stand at its place, ``SLACK`` words off at most. The share of the template's words that stand
at their places is the score. Some phrases are labels by themselves and in the index too: the postings of their
``VOTES`` rarest words, moved back by the words' positions, are intersected, and where all words stand is a place.

Words are runs of digits, a-z and characters from U+0080 up, after A-Z are lower-cased; they
are compared by 64-bit hashes.

Defined cases: null and empty texts have no words, no labels and score 0; repeated
rows give repeated rows; a null id stays null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, words

RARE, VOTES, SLACK = 5, 2, 2

#: Phrases that are labels by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Licence notices (label, notice, mandatory key phrases).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "either version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "either version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
)

_LOWER, _ENDS = words.lower_table(), words.alnum_table()


def hashed(text: str) -> np.ndarray:
    """Hashes of the words of a phrase."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, stop, _ = words.spans(raw, np.array([0, len(raw)]), _ENDS)
    return words.run_hashes(_LOWER[raw], start, stop)


def vocabulary() -> np.ndarray:
    """Sorted hashes of all words of templates and phrases."""
    return np.unique(np.concatenate([hashed(t) for t in (*PHRASES, *(t for _, t, _ in TEMPLATES))]))


def _document_words(column):
    """(first row, rows, hash of each word, its row) for runs of texts."""
    for lo, hi, raw, offs in words.slices(column):
        raw = _LOWER[raw]
        start, stop, row = words.spans(raw, offs, _ENDS)
        yield lo, hi - lo, words.run_hashes(raw, start, stop), row


def _held(own: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, or -1."""
    at = np.searchsorted(vocabulary, own)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == own, at, -1)


def _frequencies(vocabulary: np.ndarray):
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, n, own, row in _document_words(batch.column(0)):
                rows += n
                number = _held(own, vocabulary)
                some = number >= 0
                pairs = np.unique(row[some] * len(vocabulary) + number[some])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.record_batch([pa.array(np.append(np.arange(len(vocabulary)), -1), pa.int32()), pa.array(np.append(total, rows))], schema=schema)

    return run


def rarities(docs: DataFrame, text_col: str = "text") -> dict[int, float]:
    """Inverse document frequency over all rows of each template word, by hash."""
    common.arrow_rows(docs.sparkSession)
    known = vocabulary()
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(_frequencies(known), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each template word
    counts = {r.word: r.n for r in found}
    return {int(h): math.log((counts.get(-1, 0) + 1) / (counts.get(i, 0) + 0.5)) for i, h in enumerate(known)}


class Index:
    """Postings (template, position) of the rare words of the templates, and the rare words of the phrases."""

    def __init__(self, idf: dict[int, float]):
        self.templates = [hashed(t) for _, t, _ in TEMPLATES]
        self.keys = []
        for own, (_, text, phrases) in zip(self.templates, TEMPLATES, strict=True):
            parts = [hashed(p) for p in phrases]
            places = [[q for q in range(len(own) - len(p) + 1) if (own[q : q + len(p)] == p).all()] for p in parts]
            assert all(places), text
            self.keys.append([(q[0], p) for q, p in zip(places, parts, strict=True)])
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.rare = []
        for t, own in enumerate(self.templates):
            rare = sorted(set(own.tolist()), key=lambda h: (-idf.get(h, 0), h))[:RARE]
            self.rare.append(len(rare))
            for h in rare:
                self.postings.setdefault(h, []).extend((t, q) for q in np.flatnonzero(own == np.uint64(h)).tolist())
        self.phrases = []
        for text, label in PHRASES.items():
            own = hashed(text)
            rare = sorted(range(len(own)), key=lambda q: (-idf.get(int(own[q]), 0), q))[:VOTES]
            self.phrases.append((own, label, rare))
        self.words = np.array(sorted({*self.postings, *(int(own[q]) for own, _, rare in self.phrases for q in rare)}), np.uint64)

    def places(self, own: np.ndarray, row: np.ndarray, hits: np.ndarray):
        """(label, places) of each phrase among the words of some files; ``hits`` are the places of index words."""
        number = np.searchsorted(self.words, own[hits])
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(len(self.words) + 1))
        for phrase, label, rare in self.phrases:
            at = None
            for q in rare:
                w = int(np.searchsorted(self.words, phrase[q]))
                moved = hits[order[cuts[w] : cuts[w + 1]]] - q
                at = moved if at is None else np.intersect1d(at, moved, assume_unique=True)
            at = at[(at >= 0) & (at + len(phrase) <= len(own))]
            for j, h in enumerate(phrase):
                at = at[own[at + j] == h]
            yield label, at[row[at] == row[at + len(phrase) - 1]]

    def matches(self, own: np.ndarray, places: np.ndarray) -> dict[str, float]:
        """Score by label of a file, from its word hashes and the places of its index words."""
        by_word: dict[int, list[int]] = {}
        for p in places.tolist():
            by_word.setdefault(int(own[p]), []).append(p)
        votes: dict[tuple[int, int], set[int]] = {}
        for h, found in by_word.items():
            for p in found:
                for t, q in self.postings.get(h, ()):
                    votes.setdefault((t, p - q), set()).add(h)
        out: dict[str, float] = {}
        for (t, at), agree in votes.items():
            if len(agree) < min(VOTES, self.rare[t]) or not all(self._stands(own, at + q, phrase) for q, phrase in self.keys[t]):
                continue
            template = self.templates[t]
            lo, hi = max(0, -at), min(len(template), len(own) - at)
            share = float((own[at + lo : at + hi] == template[lo:hi]).sum()) / len(template)
            label = TEMPLATES[t][0]
            out[label] = max(out.get(label, 0.0), share)
        return out

    @staticmethod
    def _stands(own: np.ndarray, at: int, phrase: np.ndarray) -> bool:
        return any(0 <= at + s and at + s + len(phrase) <= len(own) and (own[at + s : at + s + len(phrase)] == phrase).all() for s in range(-SLACK, SLACK + 1))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scanned(idf: dict[int, float]):
    def run(batches):
        index = Index(idf)
        for batch in batches:
            for lo, n, own, row in _document_words(batch.column(1)):
                size = np.bincount(row, minlength=n)
                first = np.concatenate(([0], np.cumsum(size)))
                base: dict[int, list[tuple[int, str]]] = {}
                hits = np.flatnonzero(_held(own, index.words) >= 0)
                for label, at in index.places(own, row, hits):
                    for r, p in zip(row[at].tolist(), (at - first[row[at]]).tolist(), strict=True):
                        base.setdefault(r, []).append((p, label))
                cuts = np.searchsorted(row[hits], np.arange(n + 1))
                several = np.flatnonzero(np.diff(cuts) >= VOTES)
                found = {r: index.matches(own[first[r] : first[r + 1]], hits[cuts[r] : cuts[r + 1]] - first[r]) for r in several.tolist()}
                out = [[], [], [], [], [], []]
                for r in range(n):
                    places, more = base.get(r, []), found.get(r, {})
                    named = {label for _, label in places}
                    values = (len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted(named)), ",".join(sorted(named | set(more))), max([1.0] * bool(named) + list(more.values()), default=0.0))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(size), *(pa.array(c, t) for c, t in zip(out, _OUT.types[2:], strict=True))], schema=_OUT)

    return run


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    idf = rarities(docs, text_col)
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return base.mapInArrow(_scanned(idf), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def plain_scan(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """(words, places of base phrases) of one text by regular expressions, to test against."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    parts = [(p.split(), label) for p, label in PHRASES.items()]
    return len(own), [(i, label) for i in range(len(own)) for p, label in parts if own[i : i + len(p)] == p]

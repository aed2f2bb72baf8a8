"""Licence scan by a positional rare-token index over licence templates.

Offline, every template word gets an inverse document frequency over the template collection, and each
template chooses its words of highest IDF, among them one of each of its key phrases; only these
have a posting list of (template, position).  For a file, every word with a posting is looked up, however
many a file holds; each pair of an occurrence and a posting proposes an alignment
(template, file position - template position).  A proposed alignment is verified: a mandatory key phrase of the
template must stand in the file at the aligned position, and enough of the template's IDF weight must be in
place.  As each key phrase has a posting, no alignment that would verify is left unproposed.

Base phrases are key phrases too, and their places are all reported, aligned or not.

Rows: a null or empty text has no words and no labels.  Rows are judged one by one, so repeated rows
give repeated results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import text as T

#: Words that a template is looked up by, besides those of its key phrases.
RARE_WORDS = 4

#: Phrases whose every place is reported, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices as they are commonly printed, with the phrases one of which must stand in place.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org licenses"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license see license file in the project root", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ["permission is hereby granted free of charge"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        ["gnu general public license"],
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "this text is available under cc by 4 0", ["cc by"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("reserved", "copyright all rights reserved", ["all rights reserved"]),
]


@dataclass
class Index:
    """The templates' words and postings; words are numbered from 1, 0 stands for any other word."""

    word_hash: np.ndarray
    word_id: np.ndarray
    seen: np.ndarray
    idf: np.ndarray
    posting_first: np.ndarray
    posting_template: np.ndarray
    posting_at: np.ndarray
    words: list[np.ndarray]
    weight: np.ndarray
    labels: list[str]
    keys: list[tuple[int, int, list[int]]]
    base: list[tuple[str, list[int]]]
    ids: dict[str, int] = field(default_factory=dict)


def hash_words(text: str) -> list[int]:
    batch = pa.array([text])
    return [int(h) for c in T.chunks(batch) for h in T.words(c, T.ALNUM, True).hash]


def build_index(templates=None, base=None, rare_share: float = 0.25, rare_words: int = RARE_WORDS) -> Index:
    """Weights of the words that stand in at most ``rare_share`` of the templates, and postings of each
    template's ``rare_words`` words of highest IDF (ties by word) and of the rarest word of each key phrase."""
    templates = TEMPLATES if templates is None else templates
    base = BASE_PHRASES if base is None else base
    split = [t.split() for _, t, _ in templates]
    phrases = [p.split() for _, _, keys in templates for p in keys] + [p.split() for p in base]
    vocabulary = sorted({w for ws in split + phrases for w in ws})
    ids = {w: i + 1 for i, w in enumerate(vocabulary)}
    hashes = np.array([hash_words(w)[0] for w in vocabulary], T.U64)
    order = np.argsort(hashes)
    seen = np.zeros(1 << 16, bool)
    seen[(hashes & T.U64(0xFFFF)).astype(np.int64)] = True
    df = Counter(w for ws in split for w in set(ws))
    idf = np.zeros(len(vocabulary) + 1)
    for w, i in ids.items():
        if df[w] and df[w] <= max(1, rare_share * len(templates)):
            idf[i] = math.log((1 + len(templates)) / df[w])
    rarest_first = lambda ws: sorted(set(ws), key=lambda w: (-idf[ids[w]], w))
    chosen = [set(rarest_first(ws)[:rare_words]) | {rarest_first(p.split())[0] for p in keys_of} for ws, (_, _, keys_of) in zip(split, templates, strict=True)]
    postings = sorted((ids[w], t, at) for t, ws in enumerate(split) for at, w in enumerate(ws) if w in chosen[t])
    table = np.array(postings, np.int64).reshape(-1, 3)
    keys = []
    for t, (_, _, phrases_of) in enumerate(templates):
        for p in phrases_of:
            want = p.split()
            keys += [(t, at, [ids[w] for w in want]) for at in range(len(split[t])) if split[t][at : at + len(want)] == want]
    return Index(
        hashes[order],
        order + 1,
        seen,
        idf,
        np.searchsorted(table[:, 0], np.arange(len(vocabulary) + 2)),
        table[:, 1],
        table[:, 2],
        [np.array([ids[w] for w in ws], np.int64) for ws in split],
        np.array([sum(idf[ids[w]] for w in ws) for ws in split]),
        [label for label, _, _ in templates],
        keys,
        [(label, [ids[w] for w in p.split()]) for p, label in base.items()],
        ids,
    )


def number_words(index: Index, hashes: np.ndarray) -> np.ndarray:
    """Each word's number in the licence vocabulary, 0 for other words."""
    out = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(index.seen[(hashes & T.U64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.word_hash, hashes[maybe]), len(index.word_hash) - 1)
    hit = index.word_hash[at] == hashes[maybe]
    out[maybe[hit]] = index.word_id[at[hit]]
    return out


def stands_at(number: np.ndarray, row: np.ndarray, at: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Whether ``phrase`` stands at word positions ``at`` within one row."""
    last = at + len(phrase) - 1
    ok = (at >= 0) & (last < len(number))
    ok[ok] = row[at[ok]] == row[last[ok]]
    for k, want in enumerate(phrase):
        ok[ok] = number[at[ok] + k] == want
    return ok


def align(index: Index, number: np.ndarray, row: np.ndarray, first: np.ndarray, least: float = 0.3) -> list[tuple[int, int, int, float]]:
    """Verified alignments: (row, template, first word's position in the row, share of the IDF weight in place)."""
    count = index.posting_first[number + 1] - index.posting_first[number]
    places = np.flatnonzero(count)
    if not len(places):
        return []
    # Join the places with the postings of their words.
    count = count[places]
    place = np.repeat(places, count)
    posting = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(index.posting_first[number[places]], count)
    template, start = index.posting_template[posting], place - index.posting_at[posting]
    lead = max(map(len, index.words))
    wide = len(number) + lead
    proposed = np.unique((row[place] * len(index.words) + template) * wide + start + lead)
    found = np.stack([proposed // wide // len(index.words), proposed // wide % len(index.words), proposed % wide - lead], 1)
    verified = np.zeros(len(found), bool)
    for t, at, phrase in index.keys:
        mine = np.flatnonzero(found[:, 1] == t)
        here = stands_at(number, row, found[mine, 2] + at, phrase)
        here[here] = row[found[mine[here], 2] + at] == found[mine[here], 0]
        verified[mine[here]] = True
    out = []
    for r, t, at in found[verified].tolist():
        lo, hi = max(at, first[r]), min(at + len(index.words[t]), first[r + 1])
        want = index.words[t][lo - at : hi - at]
        share = index.idf[want[number[lo:hi] == want]].sum() / index.weight[t]
        if share >= least:
            out.append((r, t, int(at - first[r]), float(min(1.0, share))))
    return out


def scan(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: word count, base places and labels, aligned templates, score.

    ``least`` is the share of a template's IDF weight that must be in place.  ``score`` is the best
    alignment's share, 1 where a base phrase stands.
    """
    index = index or build_index()

    def run(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set] = [set() for _ in range(n)]
        method: list[set] = [set() for _ in range(n)]
        score = np.zeros(n)
        for c in T.chunks(batch.column(1)):
            w = T.words(c, T.ALNUM, True)
            n_words[c.lo : c.hi] = np.diff(w.first)
            number = number_words(index, w.hash)
            for label, phrase in index.base:
                at = np.flatnonzero(number == phrase[0])
                at = at[stands_at(number, w.row, at, phrase)]
                rows, places = c.lo + w.row[at], at - w.first[w.row[at]]
                np.add.at(n_base, rows, 1)
                np.minimum.at(low, rows, places)
                np.maximum.at(high, rows, places)
                score[rows] = 1.0
                for r in set(rows.tolist()):
                    base[r].add(label)
            for r, t, _, share in align(index, number, w.row, w.first, least):
                method[c.lo + r].add(index.labels[t])
                score[c.lo + r] = max(score[c.lo + r], share)
        none = n_base == 0
        return {
            id_col: batch.column(0),
            "n_words": n_words,
            "n_base": n_base,
            "first_word": pa.array(np.where(none, 0, low), mask=none),
            "last_word": pa.array(np.where(none, 0, high), mask=none),
            "base_labels": pa.array([",".join(sorted(x)) for x in base], pa.string()),
            "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(base, method, strict=True)], pa.string()),
            "score": score,
        }

    kind = dict(docs.dtypes)[id_col]
    return T.per_batch(
        docs.select(id_col, text_col),
        run,
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(T.read(spark, sf_dir, "documents"))

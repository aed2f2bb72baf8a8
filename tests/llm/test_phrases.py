"""Phrase mining against plain counting, with samples and maps that force every kind of pass."""

import random
import re
from collections import Counter

import llm_fixtures as X
import pytest

from churnlens.llm import catalog, phrases
from churnlens.llm import text as T

ROWS = X.corpus()


def counts(rows, max_words=3):
    n, f = Counter(), Counter()
    for _, t, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", X.lower(t)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, " ".join(ws[i : i + k])) for k in range(1, max_words + 1) for i in range(len(ws) - k + 1))
    return n, f


def brute(rows, least=10, max_words=3, top=2000):
    n, f = counts(rows, max_words)
    found = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    over = Counter()
    for (lang, phrase), a in found.items():
        ws = phrase.split(" ")
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                key = (lang, " ".join(ws[i : i + size]))
                over[key] = max(over[key], a)
    rows = []
    for (lang, phrase), a in found.items():
        ws = phrase.split(" ")
        score, k = min((10**6 * a * a // (f[lang, " ".join(ws[:k])] * f[lang, " ".join(ws[k:])]), k) for k in range(1, len(ws)))
        if 100 * over[lang, phrase] < 50 * a:
            rows.append((lang, score, a, phrase, f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])]))
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))
        for rank, (_, score, a, phrase, left, right) in enumerate(mine[:top], 1):
            yield (lang, rank, phrase, a, left, right, n[lang], score)


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def prose(seed=5, n=150):
    r = random.Random(seed)
    ws = [f"{a}{b}" for a in ("Al", "be", "ço", "du") for b in ("na", "ri", "", "ß")]
    ends = ["", "", "", "", ".", ",", "\t", "\n", "  "]
    rows = [(i, " ".join(r.choices(ws, range(1, len(ws) + 1))[0] + r.choice(ends) for _ in range(r.randint(0, 40))), r.choice(["en", "fr", None, "und"]), "s") for i in range(n)]
    return rows + [(None, "Al na " * 30, None, None), (None, None, "en", None), (7, "", "fr", "s"), (8, "\x00 \x1c \x85 . ,", "en", "s"), (9, "Twice twice " * 300, "de", "s")] * 2


def test_query(spark, tmp_path):
    for k, rows in enumerate((ROWS, prose())):
        out = catalog.QUERIES["op11_phrases"](spark, X.folder(tmp_path / str(k), spark, rows))
        want = X.as_counter(brute(rows))
        assert want and X.as_counter(out.select(*COLS).collect()) == want


@pytest.mark.parametrize("parts,least,bits,most", [(1, 10, 16, 1 << 20), (3, 2, 16, 1 << 20), (40, 3, 16, 1 << 20), (10**6, 2, 16, 1 << 20), (8, 2, 1, 1 << 6)])
def test_any_sample_and_any_map_give_all_frequent_phrases(spark, parts, least, bits, most):
    rows, log = prose(), []
    found = phrases.frequent_phrases(X.table(spark, rows), sample_parts=parts, sample_count=least, bits_per_phrase=bits, most_bits=most, log=log)
    n, f = counts(rows)
    want = Counter({(lang, len(p.split(" ")), p, a): 1 for (lang, p), a in f.items() if a >= 10})
    assert X.as_counter(found.where("words > 0").select("lang", "words", "phrase", "n").collect()) == want
    assert {r["lang"]: r["n"] for r in found.where("words = 0").collect()} == dict(n)
    if parts == 1:
        assert log == []
    if parts == 10**6:
        assert len(log) == 2


def test_longer_phrases_take_as_many_passes_as_they_need(spark):
    rows = [(i, "one two three four five six", "en", "s") for i in range(12)] + prose()
    log = []
    found = phrases.frequent_phrases(X.table(spark, rows), max_words=5, sample_parts=10**6, log=log)
    got = X.as_counter(phrases.collocations(found, top=50).select(*COLS).collect())
    assert len(log) == 4 and got == X.as_counter(brute(rows, max_words=5, top=50))


ALL = phrases.BitMap(phrases.np.full(64, 2**64 - 1, phrases.np.uint64))


@pytest.mark.parametrize("size,held", [(1, 10), (300, 100), (1 << 20, 10**6)])
def test_phrases_are_counted_once_whatever_the_chunks(spark, size, held):
    rows = prose()
    docs = X.table(spark, rows).select("lang", "text").where("lang is not null")
    _, f = counts([r for r in rows if r[2]])
    for parts in (1, 64):
        got = phrases.count_phrases(docs, [ALL] * 3, [], 1, parts, chunk_bytes=size, held_texts=held)
        assert X.as_counter(got.where("words > 0").select("lang", "words", "phrase", "n").collect()) == Counter({(k[0], len(k[1].split(" ")), k[1], a): 1 for k, a in f.items()})
    for parts in (1, 8, 1 << 12):
        hashes = phrases.count_hashes(docs, [], 3, 2, parts, chunk_bytes=size, held_hashes=held).collect()
        assert Counter((r["words"], r["n"]) for r in hashes) == Counter((len(p.split(" ")), a) for (_, p), a in f.items() if a > 1)


def test_phrases_that_only_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    rows = prose()
    mix = T.mix
    monkeypatch.setattr(T, "mix", lambda x: mix(x) & T.U64(0xFF000000FF))  # few fingerprints, many shared
    (c,) = T.chunks(phrases.pa.array([t for _, t, *_ in rows]))
    t = phrases.tokens(c, [g or "und" for *_, g, _ in rows])
    merged = phrases._merged(list(phrases.chunk_counts(t, [ALL] * 3, [])))
    _, f = counts(rows)
    assert X.as_counter((r["lang"], r["phrase"], r["n"]) for r in merged.to_pylist() if r["phrase"]) == Counter({(*k, a): 1 for k, a in f.items()})


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**15 + 7, 10**15 + 9, 10**15 + 11), (3 * 10**9, 2**62, 3 * 10**9), (10, 10, 10), (10**12, 10**13 + 1, 10**12 + 1)]
    rows = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", phrases.exact_score("a", "l", "r").alias("s")).collect()
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in rows)

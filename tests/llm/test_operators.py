"""Each operator against a brute-force version, on tables with nulls, empty and long texts, ties,
repeated rows and extra columns, and on empty tables."""

import math
import random
import zlib
from collections import Counter

import llm_fixtures as X
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnlens.llm import binary, catalog, decontaminate, jaccard, language, licenses, mixing, quality, rules, suffixes, tokens
from churnlens.llm import text as T

ROWS = X.corpus()
LABELS = [(i, int(bool(t) and "###" not in t), 0) for i, t, *_ in ROWS if i is not None and i % 2 == 0]
ITEMS = [(1, "none of these words stands anywhere"), (2, " ".join((ROWS[3][1]).split()[2:20])), (2, " ".join((ROWS[3][1]).split()[2:20])), (7, ROWS[65][1]), (8, "one two"), (9, None), (10, "!!"), (11, ROWS[64][1].upper())]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    return X.folder(tmp_path_factory.mktemp("llm"), spark, ROWS, LABELS, ITEMS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return X.folder(tmp_path_factory.mktemp("none"), spark, [])


def rows_of(df, *cols):
    return X.as_counter(df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).collect() == []


def test_license_scan(spark, data):
    out = catalog.QUERIES["op1_license_scan"](spark, data)
    assert rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == X.as_counter(X.licenses(ROWS))
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()}
    assert labels[100][0] == "mit" and labels[101][0] == "cc-by" and labels[103][0] == "gpl"
    assert all(0 <= s <= 1 for _, s in labels.values()) and labels[0] == ("", 0.0)


def test_license_alignment_needs_its_key_phrase_in_place():
    index = licenses.build_index()
    for text, want in [("this work is licensed under the apache foo license version 2 0", set()), ("x y licensed under the apache license version 2 0", {"apache"})]:
        (c,) = T.chunks(licenses.pa.array([text]))
        w = T.words(c, T.ALNUM, True)
        assert {index.labels[t] for _, t, _, _ in licenses.align(index, licenses.number_words(index, w.hash), w.row, w.first, 0.3)} == want


def plain_alignments(text, least=0.3):
    """Every template tried at every place: labels and the best share, by the words' IDF over the templates."""
    ws = X.ALNUM_WORD.findall(X.lower(text))
    split = [t.split() for _, t, _ in licenses.TEMPLATES]
    df = Counter(w for t in split for w in set(t))
    idf = {w: math.log((1 + len(split)) / n) if n <= max(1, 0.25 * len(split)) else 0.0 for w, n in df.items()}
    labels, best = set(), 0.0
    for (label, _, keys), t in zip(licenses.TEMPLATES, split, strict=True):
        for at in range(-len(t), len(ws)):
            here = [0 <= at + k < len(ws) and ws[at + k] == w for k, w in enumerate(t)]
            if not any(all(here[k : k + len(p.split())]) for p in keys for k in range(len(t)) if t[k : k + len(p.split())] == p.split()):
                continue
            share = sum(idf[w] for w, ok in zip(t, here, strict=True) if ok) / sum(idf[w] for w in t)
            if share >= least:
                labels.add(label)
                best = max(best, min(1.0, share))
    return labels, best


def test_license_labels_and_scores_equal_every_template_at_every_place(spark):
    r = random.Random(13)
    templates = [t for _, t, _ in licenses.TEMPLATES]
    vocabulary = sorted({w for t in templates for w in t.split()}) + ["x", "y"] * 20
    rows = []
    for i in range(400):
        ws = r.choices(vocabulary, k=r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            t = r.choice(templates).split()
            lo, hi = sorted((r.randint(0, len(t)), r.randint(0, len(t))))
            part = [r.choice(vocabulary) if r.random() < 0.1 else w for w in (t if r.random() < 0.4 else t[lo:hi])]
            at = r.randint(0, len(ws))
            ws[at:at] = part
        rows.append((i, " ".join(ws), "en", "s"))
    got = {x["doc_id"]: x for x in licenses.scan(X.table(spark, rows)).collect()}
    seen = Counter()
    for i, text, *_ in rows:
        labels, share = plain_alignments(text)
        base = {x for x in got[i]["base_labels"].split(",") if x}
        assert got[i]["labels"] == ",".join(sorted(base | labels))
        assert got[i]["score"] == pytest.approx(1.0 if base else share)
        seen.update(labels)
    assert len(seen) > 8


def test_license_notices_stand_out_in_long_texts_and_beside_other_notices(spark):
    plain = "with that it are by has can any may use see file text form program project possible following " * 40
    bsd = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd")
    notices = {label: t for label, t, _ in licenses.TEMPLATES if t.startswith(("licensed under the apache", "released under the mit", "this work is licensed under a creative"))}
    assert len(notices) == 4
    rows = [(10 * k + i, f"{before} x {notice}", "en", "s") for k, before in enumerate((plain, bsd, plain + bsd)) for i, notice in enumerate(notices.values())]
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in licenses.scan(X.table(spark, rows)).collect()}
    for i, label in enumerate(notices):
        assert all(label in got[10 * k + i][0] and got[10 * k + i][1] == pytest.approx(1) for k in range(3))


def test_quality_rules(spark, data):
    out = catalog.QUERIES["op3_quality_rules"](spark, data)
    assert rows_of(out, "doc_id", *rules.STATS, "base_failed") == X.as_counter(X.rules(ROWS))
    assert out.where("base_failed and kept").count() == 0


def test_trees_separate_and_stay_monotone():
    r = np.random.default_rng(0)
    x = r.random((800, len(rules.FEATURES)))
    y = ((x[:, 2] < 0.6) & (x[:, 0] > 0.2)).astype(float)
    trees = rules.fit(x, y)
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.97
    for name in rules.FALLING:
        j = rules.FEATURES.index(name)
        probe = np.repeat(x[:50], 20, 0)
        probe[:, j] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(trees.score(probe).reshape(50, 20), axis=1) <= 1e-12).all()


def test_classifier_covers_whole_texts_and_learns():
    r = random.Random(1)
    plain = lambda k: " ".join(r.choice(["the", "tion", "ou", "re", "lan"]) for _ in range(k))
    texts, labels = [], []
    for k in range(160):
        good = k % 2
        texts.append((plain(40) + ("" if good else " @@## ") + plain(40)).encode())
        labels.append(good)
    net = quality.fit(texts[:120], np.array(labels[:120]), epochs=30, batch=8)

    def score(some):
        return net.score(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))

    assert ((score(texts[120:]) >= 0.5) == np.array(labels[120:])).mean() > 0.9
    at_end = [plain(300).encode() + b" @@##", plain(300).encode()]
    assert score(at_end)[0] < score(at_end)[1]
    assert np.allclose(score([texts[0], b"", texts[1]])[[0, 2]], score(texts[:2]), atol=1e-5)


def plain_score(net, text):
    """The forward pass of one text, chunk by chunk."""
    symbols = list(text) + [quality.PAD] * (-len(text) % quality.STRIDE)
    symbols += [quality.PAD] * max(0, 2 * quality.STRIDE - len(symbols))
    best = np.zeros(quality.FILTERS)
    for k in range(0, len(symbols) - quality.STRIDE, quality.STRIDE):
        halves = [np.concatenate([net.vectors[x] for x in symbols[j : j + quality.STRIDE]]) for j in (k, k + quality.STRIDE)]
        best = np.maximum(best, halves[0] @ net.filters[0] + halves[1] @ net.filters[1] + net.bias)
    return 1 / (1 + np.exp(-float(best @ net.weight + net.offset[0])))


def test_classifier_scores_equal_a_plain_forward_pass_alone_and_in_any_batch(monkeypatch):
    r = np.random.default_rng(2)
    shape = lambda *n: r.standard_normal(n).astype(np.float32)
    net = quality.Network(shape(quality.PAD + 1, quality.DEPTH), shape(2, quality.STRIDE * quality.DEPTH, quality.FILTERS) * 0.3, shape(quality.FILTERS), shape(quality.FILTERS) * 0.2, shape(1)).rounded()
    texts = [r.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in [0, 1, 7, 8, 9, 16, 17, 300, 2000, 5, 0, 33, 8]]
    as_arrays = lambda some: (np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
    want = [plain_score(net, t) for t in texts]
    for piece in (1 << 14, 1, 5):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert np.allclose(net.score(*as_arrays(texts)), want, rtol=0, atol=1e-15)
        assert net.score(*as_arrays(texts)).tolist() == [net.score(*as_arrays([t]))[0] for t in texts] == net.score(*as_arrays(texts[::-1]))[::-1].tolist()


def plain_walk(trees, x):
    total = trees.base
    for node in trees.root.tolist():
        while trees.left[node] != node:
            node = trees.left[node] + int(x[trees.feature[node]] > trees.threshold[node])
        total += trees.value[node]
    return 1 / (1 + math.exp(-total))


def test_flat_trees_equal_a_plain_walk_and_give_the_verdict(spark, data):
    r = np.random.default_rng(4)
    x = r.random((300, len(rules.FEATURES)))
    trees = rules.fit(x, ((x[:, 1] + x[:, 3] > 1) & (x[:, 0] < 0.9)).astype(float))
    assert np.allclose(trees.score(x), [plain_walk(trees, v) for v in x], rtol=0, atol=1e-12)
    docs, labels = T.read(spark, data, "documents"), T.read(spark, data, "labels")
    learned = rules.train(docs, labels)
    values = {v["doc_id"]: v for v in rules.measured(docs, trees=None).collect()}
    for v in rules.judge(docs, learned).collect():
        if v["doc_id"] is not None:
            p = plain_walk(learned, np.array(values[v["doc_id"]]["features"]))
            assert v["score"] == pytest.approx(p, abs=1e-12) and v["kept"] == (not v["base_failed"] and p >= 0.2)


def test_classifier_query(spark, data):
    rows = catalog.QUERIES["op2_quality_classifier"](spark, data).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == X.held_out(r["doc_id"], 5, 0) for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] == 7}
    assert len(same) == 1


@pytest.mark.parametrize("nearest,block", [(2, 2048), (1, 3)])
def test_jaccard_join(spark, data, nearest, block):
    out = jaccard.join(T.read(spark, data, "documents"), nearest=nearest, block=block)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == X.as_counter(X.jaccard(ROWS))


def test_jaccard_join_states_the_ids_it_takes(spark):
    with pytest.raises(TypeError, match="integer ids"):
        jaccard.join(X.table(spark, ROWS[:3]).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_jaccard_join_of_a_chain_family(spark):
    r = random.Random(5)
    ws = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        cut = list(ws)
        for k in range(i % 9):
            cut[(7 * i + 13 * k) % 120] = f"v{i}x{k}"
        rows.append((i, " ".join(cut), "en", "s"))
    out = jaccard.join(X.table(spark, rows), nearest=1)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == X.as_counter(X.jaccard(rows))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "file_bytes": 4000, "bucket_suffixes": 500}])
def test_suffix_dedup(spark, data, options):
    out = suffixes.repeats(T.read(spark, data, "documents"), **options)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == X.as_counter(X.repeats(ROWS))


def indented(n, seed=7):
    """Rows of 20 spaces and 6 random letters, again and again: half of the positions share a head of 8 spaces."""
    r = random.Random(seed)
    return [(i, "".join(" " * 20 + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)), "en", "s") for i in range(n)]


@pytest.mark.parametrize("sample", [True, False])
def test_suffixes_of_one_head_spread_over_the_buckets(sample):
    rows = indented(20)
    block = suffixes.Block(licenses.pa.table({"seq": list(range(20)), "text": [t for _, t, *_ in rows]}))
    length = suffixes.LENGTH - suffixes.V + 1 if sample else suffixes.LENGTH
    at = block.samples(suffixes.LENGTH) if sample else np.flatnonzero(block.starts(length))
    keys, bucket = block.keys(at, length, 16)
    text = block.data.tobytes()
    of = {}
    for p, k, b in zip(at.tolist(), keys.tolist(), bucket.tolist(), strict=True):
        assert of.setdefault(text[p : p + length], (k, b)) == (k, b)
    sizes = np.bincount([b for _, b in of.values()], minlength=16)
    assert len({k for k, _ in of.values()}) == len(of) and sizes.max() < 1.5 * sizes.mean()


def test_suffix_dedup_of_one_head(spark):
    rows = indented(12)
    rows += [(12 + i, rows[i][1][300:500] + t, "en", "s") for i, (_, t, *_) in enumerate(indented(6, 8))]
    out = suffixes.repeats(X.table(spark, rows), block_bytes=4000, file_bytes=9000, bucket_suffixes=300)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == X.as_counter(X.repeats(rows))


def test_order_of_buckets_and_keys():
    r = np.random.default_rng(6)
    for n, buckets, keys in [(0, 4, 9), (1, 1, 9), (5000, 1, 50), (5000, 300, 1 << 62), (5000, 3, 7), (300, 1 << 40, 1 << 62)]:
        k, b = r.integers(0, keys, n).astype(np.uint64), r.integers(0, buckets, n)
        k = np.where(r.random(n) < 0.3, k, k << np.uint64(1 if keys > 99 else 57))
        order = suffixes.in_order(k, b)
        want = np.lexsort((k, b))
        assert sorted(order.tolist()) == list(range(n)) and (k[order] == k[want]).all() and (b[order] == b[want]).all()


def test_entries_that_agree_in_the_packed_bits_are_ordered_by_their_keys():
    r = np.random.default_rng(8)
    n, low = 4000, np.uint64((1 << 12) - 1)  # a place of 12 bits and a bucket of 9 push the keys' last 21 bits out
    k = (r.integers(0, 40, n).astype(np.uint64) << np.uint64(43)) | (r.integers(0, 1 << 30, n).astype(np.uint64) & low)
    b = r.integers(0, 400, n)
    want = np.lexsort((k, b))
    order = suffixes.in_order(k, b)
    assert sorted(order.tolist()) == list(range(n)) and (k[order] == k[want]).all() and (b[order] == b[want]).all()
    assert (k[suffixes.in_order(k)] == np.sort(k)).all()


@pytest.mark.parametrize("n", [0, 1, 700])
def test_distinct_keys_are_those_of_their_buckets(n):
    r = np.random.default_rng(n)
    k, b = r.integers(0, 60, n).astype(np.uint64) << np.uint64(57), r.integers(0, 6, n) * 2 + 1
    order, fresh, keys, buckets = suffixes.distinct(k, b, 16)
    kinds = sorted(set(zip(b.tolist(), k.tolist(), strict=True)))
    assert list(zip(buckets.tolist(), keys.tolist(), strict=True)) == kinds
    assert [kinds[i] for i in np.cumsum(fresh) - 1] == list(zip(b[order].tolist(), k[order].tolist(), strict=True))


def test_block_positions_and_runs_follow_each_document():
    texts = ["", "ab" * 40, None, "x" * 19, "y" * 20, "é" * 700]
    block = suffixes.Block(licenses.pa.table({"seq": list(range(6)), "text": texts}))
    begin, width = block.offsets.tolist(), suffixes.LENGTH - suffixes.V + 1
    want = [a + k for a, z in zip(begin[:-1], begin[1:], strict=True) for k in range(z - a - width + 1) if k % suffixes.V in suffixes.COVER]
    assert block.samples(suffixes.LENGTH).tolist() == want
    assert block.document(np.arange(begin[-1])).tolist() == [d for d in range(6) for _ in range(begin[d], begin[d + 1])]


def test_sorting_a_pass_of_many_suffixes_takes_no_indirect_sort(monkeypatch):
    r = np.random.default_rng(9)
    k, b = r.integers(0, 1 << 62, 20000).astype(np.uint64), r.integers(0, 300, 20000)
    want, sizes, sort = np.lexsort((k, b)), [], np.lexsort
    monkeypatch.setattr(np, "argsort", lambda *a, **kw: pytest.fail("argsort takes seven times as long"))
    monkeypatch.setattr(np, "lexsort", lambda keys: (sizes.append(len(keys[0])), sort(keys))[1])
    assert (suffixes.in_order(k, b) == want).all() and sum(sizes) < 100


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.V))


def test_language_id(spark, data):
    rows = catalog.QUERIES["op6_language_id"](spark, data).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((i, X.held_out(i, 4, 2)) for i, *_ in ROWS)
    told = {r["doc_id"]: r for r in rows}
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 for i in (90, 91, 92, 94))
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in rows)


def plain_bucket(chars, order, buckets=language.BUCKETS):
    h = sum(ord(c) * m for c, m in zip(chars[::-1], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) % 2**32
    h ^= h >> 15
    h = h * (0x2C1B3C6D + 2 * order) % 2**32
    return (h ^ (h >> 13)) % buckets


def plain_ngrams(text):
    low = "  " + "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
    return Counter(plain_bucket(low[i - n + 1 : i + 1], n) for n in language.ORDERS for i in range(2, len(low))), sum(c.isalpha() for c in text.lower())


def plain_bayes(rows):
    """(language, score) of a text by naive Bayes over the labelled rows, written plainly."""
    seen, prior = {}, Counter()
    for i, t, lang, _ in rows:
        if lang is not None and not X.held_out(i, 4, 2):
            prior[lang] += 1
            seen.setdefault(lang, Counter())
            if i is not None:
                seen[lang].update(plain_ngrams(t or "")[0])

    def tell(text):
        grams, letters = plain_ngrams(text or "")
        if not letters:
            return "und", 0.0
        total = {
            g: math.log(prior[g] / sum(prior.values())) + sum(n * math.log((seen[g][b] + 0.5) / (sum(seen[g].values()) + 0.5 * language.BUCKETS)) for b, n in grams.items())
            for g in prior
        }
        best = max(sorted(total), key=total.get)
        scale = min(1.0, language.EVIDENCE / (letters * 3))
        return best, 1 / sum(math.exp((x - total[best]) * scale) for x in total.values())

    return tell


def test_language_id_equals_plain_naive_bayes(spark, data):
    tell = plain_bayes(ROWS)
    texts = {i: t for i, t, *_ in ROWS if i is not None}
    rows = catalog.QUERIES["op6_language_id"](spark, data).collect()
    for r in rows:
        if r["doc_id"] is not None:
            lang, score = tell(texts[r["doc_id"]])
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    r = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], np.log(np.full(3, 1 / 3)), r.normal(-9, 1, (language.BUCKETS, 3)).astype(np.float32), language.ORDERS)
    words = ["da", "x", "", "zu", "Né 1", "12", "é", "long " * 50, None, "ß", "a b", "\U00010400\U00010401"]
    rows = [(i, words[int(k)], None, None) for i, k in enumerate(r.integers(0, len(words), 400))]
    got = {}
    for table in (X.table(spark, rows).coalesce(1), X.table(spark, rows[::-1]).coalesce(1), X.table(spark, [(i, t, None, None) for i, t in enumerate(words)]).repartition(len(words), "doc_id")):
        for x in language.predict(table.select(F.struct("text").alias("k")), model, id_col="k", text_col="k.text").collect():
            assert got.setdefault(x["k"]["text"], (x["lang_pred"], x["score"])) == (x["lang_pred"], x["score"])
    assert set(got) == set(words)


def test_language_sample_is_one_top_k_scan_a_language(spark):
    rows = [(i, "the and" if i % 10 else "der und", "en" if i % 10 else "de", "s") for i in range(500)]
    few, many = (language.train(X.table(spark, rows), limit=k) for k in (5, 10_000))
    assert few.languages == many.languages == ["de", "en"] and np.allclose(few.prior, many.prior)
    assert not np.allclose(few.matrix, many.matrix)


def test_language_id_held_out_accuracy(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(("der", "ung", "sch", "über") if i % 2 else ("the", "tion", "wh", "and")) for _ in range(20)), "de" if i % 2 else "en", "s") for i in range(80)]
    out = catalog.QUERIES["op6_language_id"](spark, X.folder(tmp_path, spark, rows)).where("held_out").collect()
    assert out and all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") for r in out)
    assert language.UND == "und"


def test_mix(spark, data):
    rows = catalog.QUERIES["op7_mix_sources"](spark, data).collect()
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(X.SPACE_WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, free = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(want.values())
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) >= 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    want |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = Counter()
    assert sorted({(r["source_size"], r["target"]) for r in rows}) == [(a, pytest.approx(b)) for a, b in sorted((sizes[s], want[s]) for s in order)]
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s in order:
        assert abs(taken[sizes[s]] - want[s]) <= mixing.BLOCK_WORDS
    again = catalog.QUERIES["op7_mix_sources"](spark, data)
    assert rows_of(again, "doc_id", "size", "source_size", "target", "taken") == X.as_counter(rows)


def highest_quotients(weights, caps, seats):
    best = sorted((-w / (2 * k + 1), s) for s, (w, c) in enumerate(zip(weights, caps, strict=True)) for k in range(c) if w > 0)[:seats]
    return {s: sum(1 for _, x in best if x == s) for s in range(len(weights))}


@pytest.mark.parametrize("ranked", [5000, 3])
def test_seats_are_the_highest_quotients(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)
    r = random.Random(4)
    houses = {
        0: ([r.randint(1, 40) for _ in range(30)], 100),
        1: ([1] * 100 + [1000], 660),  # one large shard: its quotients lie far from its share
        2: ([7] * 20, 33),  # ties only
        3: ([5, 5, 9], 10**6),  # more seats than the caps allow
        4: ([r.random() * 10 ** r.randint(0, 4) for _ in range(12)], 900),
        5: ([3, 4], 0),
        6: ([0.0, 2.5], 3),
    }
    rows, want = [], {}
    for house, (weights, seats) in houses.items():
        caps = [3 * max(1, int(w)) for w in weights]
        rows += [(house, k, float(w), c, seats) for k, (w, c) in enumerate(zip(weights, caps, strict=True))]
        want |= {(house, k): n for k, n in highest_quotients(weights, caps, seats).items()}
    items = spark.createDataFrame(rows, "house int, item long, weight double, cap long, seats long")
    assert {(x["house"], x["item"]): x["quota"] for x in mixing.apportion(items, "house", "item").collect()} == want


def test_mix_between_sources_and_uneven_shards(spark, tmp_path):
    """Several sources of very different size, many shards, null and repeated ids."""
    r = random.Random(12)
    rows = [(None if i % 3 else i // 9, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 3, 20, 300]))), "en", f"s{min(4, int(r.expovariate(0.7)))}") for i in range(300)]
    docs = X.table(spark, rows)
    plan = lambda: mixing.mix(mixing.sized(docs, ["doc_id", "source", "text"]), block_words=7, shard_words=400)
    got = plan().collect()
    sizes, shards = Counter(), {}
    for x in got:
        sizes[x["source"]] += x["_size"]
        if x["_size"]:
            shards.setdefault((x["source_no"], x["shard"]), Counter())["size"] += x["_size"]
    blocks = {k: max(1, (2 * v["size"] + 7) // 14) for k, v in shards.items()}
    target = {x["source_no"]: (x["target"], x["source_size"]) for x in got}
    own = {no: sum(b for (s, _), b in blocks.items() if s == no) for no in target}
    weights = {no: t * own[no] / n for no, (t, n) in target.items() if own[no]}
    order = sorted(weights)
    seats = highest_quotients([weights[no] for no in order], [3 * own[no] for no in order], int(round(sum(weights.values()), 6) + 0.5))
    quota = {}
    for k, no in enumerate(order):
        keys = sorted(x for x in blocks if x[0] == no)
        quota |= {keys[i]: n for i, n in highest_quotients([blocks[x] for x in keys], [3 * blocks[x] for x in keys], seats[k]).items()}
    assert len(blocks) > 20
    assert {(x["source_no"], x["shard"]): x["quota"] for x in got if x["_size"]} == quota
    assert X.as_counter((x["doc_id"], x["text"], x["taken"]) for x in got) == X.as_counter((x["doc_id"], x["text"], x["taken"]) for x in plan().collect())
    spread = Counter(x["shard"] for x in got if x["doc_id"] is None and x["source"] == "s0")
    assert len(spread) > 3 and max(spread.values()) < 0.6 * sum(spread.values())


def test_mixed_documents_hold_the_taken_words(spark, data):
    docs = T.read(spark, data, "documents")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = sum(r["taken"] for r in catalog.QUERIES["op7_mix_sources"](spark, data).collect())
    rows = out.collect()
    assert sum(len(X.SPACE_WORD.findall(r["text"])) for r in rows) == taken
    whole = {r[1] for r in ROWS}
    flat = {w: None for t in whole if t for w in [" ".join(X.SPACE_WORD.findall(t))]}
    assert all(r["text"] in whole or any(X.SPACE_WORD.findall(r["text"])[0] in f for f in flat) for r in rows)


def test_token_counts(spark, data):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in ROWS]
    assert rows_of(catalog.QUERIES["op8_token_counts"](spark, data), "doc_id", "n_bytes", "n_tokens", "over_limit") == X.as_counter(want)


def test_token_counts_of_random_strings():
    counter = tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), remembered=300)
    r = random.Random(6)
    pieces = ["a", "the", " ", "\n", "é", "你", "\t", "  ", "▁", ".", "ing", "<s>", "1", "0x0A", "\r", "T", "\0"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    assert counter.splits
    assert [n for k in range(0, 3000, 100) for n in counter.counts(texts[k : k + 100])] == [len(x) for x in counter.model.encode(texts)]


@pytest.mark.parametrize("mark", ["\t", "😀", "█", "。", "•", "★", "·", "°"])
def test_token_counts_of_long_runs(mark):
    counter = tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), remembered=300)
    run = mark * 5000
    texts = [run, "a" + run, f"the end{run}\n{run}x{run}", f"x\n{run} {run}", run[:-1] + "\t.😀" + run]
    assert counter.splits
    assert counter.counts(texts) == [len(x) for x in counter.model.encode(texts)]
    assert sum(map(len, counter.count[0])) + sum(map(len, counter.count[1])) < 1_000_000


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, data, block_bytes):
    found = decontaminate.matches(T.read(spark, data, "documents"), T.read(spark, data, "benchmark"), block_bytes=block_bytes)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.report(found, ["doc_id"]), *cols) == X.as_counter(X.contamination(ROWS, ITEMS))
    assert rows_of(catalog.QUERIES["op9_decontamination"](spark, data), *cols) == X.as_counter(X.contamination(ROWS, ITEMS))


def test_longest_match_spans_windows(spark):
    words = [f"w{k}" for k in range(40)]
    docs = X.table(spark, [(1, "x " + " ".join(words[5:30]) + " y", "en", "s"), (2, "x", "en", "s")])
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {r["doc_id"]: r["longest"] for r in decontaminate.matches(docs, items).collect()} == {1: 25, 2: 0}


def test_token_files_round_trip(spark, data):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows_of(catalog.QUERIES["op10_token_files"](spark, data), "doc_id", "start", "n_tokens", "ids_crc32") == X.as_counter(want)


def test_sequences_by_random_access(spark, data):
    docs = T.read(spark, data, "documents")
    manifest = binary.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, length=64)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    flat = [x for _, t in rows for x in tokenizer.encode(t, add_special_tokens=False).ids + [2]]
    for shard in manifest.collect():
        n = -(-shard["n_ids"] // 64)
        for k in (0, n // 2, n - 1):
            ids, mask = binary.sequence(shard["folder"], shard["name"], k)
            lo = shard["before"] + 64 * k
            want = flat[lo : min(lo + 64, shard["before"] + shard["n_ids"])]
            assert len(ids) == 64 and ids[mask].tolist() == want and not mask[len(want) :].any()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_on_random_strings(name):
    encoder = binary.WordEncoder(public_tokenizers.path(name), remembered=200)
    assert encoder.splits == (name == "word_bpe_49k.json")
    r = random.Random(7)
    pieces = ["a", "The", "'ll", "'", "-", "#", "~`", "²", "Ø", "×", "÷", "ß", "ÿ", "À", " ", "\n", "é", "É", "你", "\t", ".", "!?", "ing", "'s", "'Re", "d", "1", "٣", "\r", "\x1c", "\u0301", "<|", "<|endoftext|>", "\x7f", "\x00"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    texts += ["".join(r.choice("'srevtlmd a!0É") for _ in range(r.randint(0, 14))) for _ in range(2000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for size in (1, 60, 1 << 20):
        got = []
        for c in T.chunks(licenses.pa.array(texts), size):
            ids, counts = encoder.encode(c)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want


def test_token_files_are_closed_when_they_are_full(spark, data):
    docs = T.read(spark, data, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = binary.write_tokens(docs, path, 2, length=16, file_ids=300, chunk_bytes=500)
    per_shard = Counter(r["shard"] for r in manifest.collect())
    assert max(per_shard.values()) > 1
    cols = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(binary.read_tokens(manifest, "bigint"), *cols) == rows_of(catalog.QUERIES["op10_token_files"](spark, data), *cols)
    shard = manifest.first()
    ids, mask = binary.sequence(shard["folder"], shard["name"], 0)
    assert not ids.flags.owndata and not mask.flags.owndata and mask.dtype == bool


def test_rows_of_one_id_spread_over_files(spark):
    rows = [(None, f"text {i % 40} of nobody", "en", "s") for i in range(400)]
    manifest = binary.write_tokens(X.table(spark, rows), public_tokenizers.path("word_bpe_49k.json"), 2)
    n = [r["n_ids"] for r in manifest.collect()]
    assert len(n) >= 6 and max(n) < sum(n) / 3
    assert binary.read_tokens(manifest, "bigint").count() == 400


def test_folders_under_arrows_names():
    assert binary.arrow_uri("/tmp/x") == "file:///tmp/x" == binary.arrow_uri("file:/tmp/x") == binary.arrow_uri("file:///tmp/x")
    assert binary.arrow_uri("s3a://b/x") == "s3://b/x" and binary.arrow_uri("hdfs://h/x") == "hdfs://h/x"
    with pytest.raises(ValueError, match="dbfs"):
        binary.file_system("dbfs:/x")


def test_components_extended_by_links(spark):
    from churnlens.llm.components import components, extend

    r = random.Random(9)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    want = {x: root(x) for x in parent}
    got = {x["node"]: x["component"] for x in extend(components(frame(edges[:20])), frame(edges[20:])).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_jaccard_join_finds_links_that_no_hub_has(spark):
    """Every n-gram two short documents share stands in a longer one with more copies, their hub, which links to neither."""
    r = random.Random(11)
    ws = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(k, " ".join(ws), "en", "s") for k in (1, 2, 3)]
    rows += [(10 + k, " ".join([*ws[:60], f"x{k}"]), "en", "s") for k in range(4)]
    rows += [(20 + k, " ".join([*ws[100:160], f"y{k}"]), "en", "s") for k in range(2)]
    out = jaccard.join(X.table(spark, rows))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == X.as_counter(X.jaccard(rows))
    assert {r["component_id"] for r in out.collect()} == {1, 10, 20}

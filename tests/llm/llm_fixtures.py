"""Small tables with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as S

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Extra columns whose names the operators use inside.
EXTRA = ["score", "n_words", "id", "component_id", "target", "size", "labels", "text_"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=3, n=60):
    """(doc_id, text, lang, source) rows: plain, near and exact copies, shared passages, odd texts."""
    r = random.Random(seed)
    words = [a + b for a in ("the", "ou", "re", "ti", "an", "ñu", "é") for b in ("n", "sh", "la", "tion", "x", "")]
    make = lambda k: " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(k))
    passage = make(30)
    out = []
    for i in range(n):
        out.append((i, make(r.randint(5, 80)), "en" if i % 3 else "fr", f"s{i % 4}"))
    out += [(n + i, t, "en", "s0") for i, t in enumerate([out[3][1], out[3][1], out[5][1] + " tail", "Start " + out[5][1], passage, make(9) + " " + passage + "\n" + make(12)])]
    for i in range(12):  # a family of near copies, some of which link only through others
        ws = make(90).split() if i == 0 else ws
        cut = list(ws)
        for _ in range(i // 3):
            cut[r.randrange(len(cut))] = r.choice(words).upper()
        out.append((n + 10 + i, " ".join(cut), "fr", "s1"))
    out += [(n + 30, None, "en", "s1"), (n + 31, "", "fr", None), (n + 32, " \n\t ", None, None), (n + 33, "one two", "en", None), (n + 34, "12 34 !! ##", "en", "s2")]
    out += [(n + 35, make(4000), "fr", "s2"), (n + 36, "\x0bodd\x0cspace\x1cunit\x00nul  two  ▁ mark<|endoftext|>İß ÀÉ it's 3²", "en", "s3")]
    out += [out[7], out[7], (None, out[9][1], "fr", "s3"), (None, "no id here at all, none", "en", "s3")]
    out += [(n + 40 + i, t, "en", "s0") for i, t in enumerate(["Released under the MIT License.", "cc by cc by and CC BY", "All  rights\nreserved general public license", "GNU General Public License, version 3", "x!! y ### | $$$ " * 8, "same line\nsame line\nother line\n\nsame line"])]
    return out


def table(spark, rows, extra=()):
    schema = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("lang", S.StringType()), S.StructField("source", S.StringType())])
    df = spark.createDataFrame(rows, schema)
    for k, c in enumerate(extra):
        df = df.selectExpr("*", f"{k} AS {c}")
    return df.repartition(3)


def folder(path, spark, rows, labels=(), benchmark=()):
    table(spark, rows, ["n_chars", *EXTRA]).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return str(path)


def held_out(doc_id, mod, which):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == which


def as_counter(rows):
    return Counter(map(tuple, rows))


def licenses(rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t, *_ in rows:
        ws = ALNUM_WORD.findall(lower(t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        yield (i, len(ws), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


def rules(rows):
    for i, t, *_ in rows:
        ws = SPACE_WORD.findall(t or "")
        grams = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        seen = {j for k in range(len(ws) - 4) if grams[tuple(ws[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if SPACE_WORD.search(x)]
        yield (i, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(seen), len(ws) < 10 or 100 * len(seen) > 20 * len(ws))


def jaccard(rows):
    sets = []
    for _, t, *_ in rows:
        ws = SPACE_WORD.findall(lower(t))
        sets.append({tuple(ws[k : k + 4]) for k in range(len(ws) - 3)} if len(ws) >= 4 else {tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if (sets[a] and rows[a][0] is not None and rows[a][0] == rows[b][0]) or (shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared)):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[root(k)].append(row[0])
    return [(row[0], len(sets[k]), min(least[root(k)], default=None)) for k, row in enumerate(rows)]


def repeats(rows, length=50):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, float("inf")), key(i))
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        yield (i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for item, t in items:
        ws = ALNUM_WORD.findall(lower(t))
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            windows[tuple(ws[k : k + window])].add("" if item is None else str(item))
    sizes = sorted({len(w) for w in windows})
    for i, t, *_ in rows:
        ws = ALNUM_WORD.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        yield (i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))

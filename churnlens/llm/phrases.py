"""Phrase collocations by Toivonen mining.

1. Sample: a hashed share of the documents is mined with a lowered threshold.  The phrases that reach
   it and their negative border (the shortest phrases that do not, though all their parts do) are
   proposed.  A phrase is in either set just when its first and its last words but one are frequent in the
   sample; every single word is in one of them.
2. Full pass: the proposed phrases that occur are counted over all documents.
3. Border failures: where a border phrase turns out frequent, its extensions were not proposed.  Another full
   pass counts the phrases that the larger set of frequent phrases proposes and no earlier pass did, until a
   pass finds nothing that could be extended.  The frequent phrases are then complete.

These passes count 64-bit fingerprints of (language, phrase), which are small to shuffle.  A fingerprint
counts no less than its phrase, so none is lost; a last scan counts the phrases behind the frequent
fingerprints exactly, under their text, and drops those that only shared one.  Where only extensions to the
greatest length are still to be counted, which cannot fail in turn, the last scan counts them too.

The frequent fingerprints that propose are broadcast as bit maps of bounded size.  A false positive of a map
only lets a phrase be counted that need not be.  Tasks pre-aggregate before the shuffle, so a phrase that
stands everywhere is a few rows a task.

Scores are exact (38-digit decimals; counts below 10**16).  Ranks come from the range-sorted candidates, not
from a window over a language.  A null text has no words; a null language is ``und``, together with one of that
name; repeated rows count as often as they stand; a document without an id is mined like others.  Ties of score
and count are ordered by phrase.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.numbering import row_numbers
from churnlens.session import materialize

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
#: A candidate goes if a longer one that holds it has at least so many percent of its count.
COVER_PERCENT = 50
#: One document in so many is in the sample; a phrase is frequent there from SAMPLE_COUNT occurrences.
SAMPLE_PARTS = 8
SAMPLE_COUNT = 2
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 6 << 20
#: Fingerprints, and counted texts, that a task holds before it hands them on.
HELD_HASHES = 1_000_000
#: Text of which one group adds up the fingerprints (about as many bytes as the text).
PART_BYTES = 16 << 20
HELD_TEXTS = 500_000
#: Up to so many languages their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_LANGUAGES = 50_000
#: Bits of a map per phrase, and the most that a map takes.
BITS_PER_PHRASE = 16
MOST_BITS = 1 << 27

#: [.,;:!?\x0A-\x0D] ends a piece, \x20 and \x09 a word.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
IN_WORD = ~SEPARATOR
IN_WORD[[0x20, 0x09]] = False


class BitMap:
    """Set of fingerprints with false positives: two bits each."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @staticmethod
    def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return h & T.U64(bits - 1), (h >> T.U64(32)) & T.U64(bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.probes(h, len(self.cells) * 64):
            out &= (self.cells[(at >> T.U64(6)).astype(np.intp)] >> (at & T.U64(63))) & T.U64(1) == 1
        return out


#: For each pass, the map of frequent phrases of 1, 2, ... words.
Passes = list[list[BitMap]]


def encode(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the number of each one."""
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def strings_hash(values: pa.Array) -> np.ndarray:
    """Fingerprints of an array of strings."""
    (chunk,) = list(T.chunks(values, 1 << 62)) or [T.Chunk(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    return T.span_hash(T.prefix_sums(chunk.data), chunk.offsets[:-1], chunk.offsets[1:])


@dataclass
class Tokens:
    """The words of a chunk: distinct spellings and each word's, distinct languages and each word's, whether
    the next word is of the same piece, and fingerprints of (language, word)."""

    spelled: pa.Array
    word: np.ndarray
    kinds: pa.Array
    kind: np.ndarray
    same: np.ndarray
    hash: np.ndarray


def tokens(chunk: T.Chunk, languages: list[str]) -> Tokens | None:
    data = T.LOWER[chunk.data]
    n = len(data)
    inside = IN_WORD[data]
    cut = np.ones(n + 1, bool)  # between two bytes: a word may not go on there
    cut[1:-1] = inside[1:] != inside[:-1]
    cut[chunk.offsets] = True
    starts = np.flatnonzero(inside & cut[:-1])
    ends = np.flatnonzero(inside & cut[1:]) + 1
    if not len(starts):
        return None
    row = np.repeat(np.arange(len(languages)), np.diff(np.searchsorted(starts, chunk.offsets)))
    piece = np.cumsum(SEPARATOR[data], dtype=np.int32)[starts]
    same = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    spelled, word = encode(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])))
    kinds, of_row = encode(pa.array(languages, pa.string()))
    kind = of_row[row]
    return Tokens(spelled, word, kinds, kind, same, T.mix(strings_hash(spelled)[word] + strings_hash(kinds)[kind]))


def phrases_of(t: Tokens, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: starts of the phrases, their fingerprints, and where each one's first words
    stand among the phrases one shorter (its last words stand next)."""
    at, h = np.arange(len(t.word)), t.hash
    yield 1, at, h, at
    for words in range(2, max_words + 1):
        index = np.flatnonzero(t.same) if words == 2 else np.flatnonzero(at[1:] == at[:-1] + 1)
        at = at[index]
        h = T.mix(h[index] * T.U64(0xA24BAED4963EE407) + t.hash[at + words - 1] + T.U64(words))
        yield words, at, h, index


def proposed(before: np.ndarray, index: np.ndarray, words: int, passes: Passes) -> np.ndarray:
    """Which phrases of ``words`` words the last pass proposes and none before it: those whose first and last
    words but one, fingerprints ``before`` at ``index`` and next to it, its map has.  Where a pass has the map
    of an earlier one, it proposes nothing new."""
    *earlier, last = [m[words - 2] for m in passes]
    if any(m is last for m in earlier):
        return index[:0]
    hit = last.has(before)
    new = np.flatnonzero(hit[index] & hit[index + 1])
    for m in earlier:
        hit = m.has(before)
        new = new[~(hit[index[new]] & hit[index[new] + 1])]
    return new


def proposed_hashes(t: Tokens, passes: Passes, max_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Fingerprints of the phrases that the last pass proposes, by length.  Words are proposed by the first
    pass; without passes everything is."""
    before = t.hash
    for words, _, h, index in phrases_of(t, max_words):
        if words > 1 and passes:
            yield words, h[proposed(before, index, words, passes)]
        elif words > 1 or len(passes) <= 1:
            yield words, h
        before = h


def count_hashes(
    docs: DataFrame, passes: Passes, max_words: int, least: int, parts: int, chunk_bytes: int = CHUNK_BYTES, held_hashes: int = HELD_HASHES
) -> DataFrame:
    """Rows (words, h, n) of the fingerprints of ``docs`` (lang, text) that the passes propose and that
    stand ``least`` times or more.

    A task counts what it holds, sorts it and hands it on in up to ``parts`` (a power of two) ranges of
    fingerprints, each one row of packed numbers; a range's rows meet in one group, which adds them up.
    """
    held = docs.sparkSession.sparkContext.broadcast(passes)
    shift = T.U64(65 - parts.bit_length())

    def run(batches):
        found: dict[int, list] = {k: [] for k in range(1, max_words + 1)}

        def flush(words: int) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(found[words]), return_counts=True)
            found[words] = []
            part = (h >> shift).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(h)]])
            packed = lambda x, size: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(x)])
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, words, np.int32)), packed(h, 8), packed(n.astype(np.uint32), 4)], names=["part", "words", "h", "n"]
            )

        for batch in batches:
            languages = batch.column(0).to_pylist()
            for c in T.chunks(batch.column(1), chunk_bytes):
                t = tokens(c, languages[c.lo : c.hi])
                for words, h in proposed_hashes(t, held.value, max_words) if t else ():
                    found[words].append(h)
                    if sum(map(len, found[words])) > held_hashes:
                        yield flush(words)
        for words in found:
            if sum(map(len, found[words])):
                yield flush(words)

    def add_up(rows: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(rows.column("h").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(rows.column("n").to_pylist()), np.uint32)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        many = n >= least
        words = rows.column("words")[0].as_py()
        return pa.table({"words": pa.array(np.full(many.sum(), words, np.int32)), "h": pa.array(h[first][many].view(np.int64)), "n": pa.array(n[many])})

    return docs.mapInArrow(run, "part long, words int, h binary, n binary").groupBy("words", "part").applyInArrow(add_up, "words int, h long, n long")


def chunk_counts(t: Tokens, maps: list[BitMap], passes: Passes) -> Iterator[pa.Table]:
    """Exact counts of a chunk's phrases that ``maps`` (of 1, 2, ... words) have, and of the longest ones that
    the last of ``passes`` (if any) proposes; under the empty phrase, of all words."""

    def table(kinds: pa.Array, phrases: pa.Array, n: np.ndarray) -> pa.Table:
        return pa.table({"lang": kinds, "phrase": phrases.cast(pa.large_string()), "n": pa.array(n.astype(np.int64))})

    yield table(t.kinds, pa.array([""] * len(t.kinds)), np.bincount(t.kind, minlength=len(t.kinds)))
    before = t.hash
    for words, at, h, index in phrases_of(t, len(maps)):
        mine = maps[words - 1].has(h)
        if passes and words == len(maps):
            mine[proposed(before, index, words, passes)] = True
        before, at = h, at[mine]
        if not len(at):
            continue
        distinct, code = encode(pa.array(t.kind[at] * len(t.spelled) + t.word[at]))
        for k in range(1, words):
            distinct, code = encode(pa.array(code * len(t.spelled) + t.word[at + k]))
        some = np.zeros(len(distinct), np.int64)
        some[code] = at
        parts = [t.spelled.take(pa.array(t.word[some + k])) for k in range(words)]
        phrase = parts[0] if words == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        yield table(t.kinds.take(pa.array(t.kind[some])), phrase, np.bincount(code))


def packed_texts(table: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """A table of counts as rows of (lang, part, phrases, counts): the phrases of one language and range of
    hashes, each ended by a line feed, which stands in none."""
    for lang in table.column("lang").unique().to_pylist():
        mine = table.filter(pc.equal(table.column("lang"), lang))
        phrases = mine.column("phrase").combine_chunks().cast(pa.large_string())
        part = (strings_hash(phrases) & T.U64(parts - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, n = part[order], mine.column("n").to_numpy()[order]
        lines = pc.binary_join_element_wise(phrases.take(pa.array(order)), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :][cuts]
        text = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends.astype(np.int32)), lines.buffers()[2]])
        counts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(n)])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(cuts) - 1), pa.string()), pa.array(part[cuts[:-1]]), text, counts], names=["lang", "part", "phrases", "counts"])


def unpacked_texts(rows: pa.Table) -> pa.Table:
    """All phrases and counts of rows that :func:`packed_texts` made."""
    data = np.frombuffer(b"".join(rows.column("phrases").to_pylist()), np.uint8)
    end = np.flatnonzero(data == 0x0A)
    offsets = np.concatenate([[0], end - np.arange(len(end))])
    phrases = pa.LargeStringArray.from_buffers(len(end), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[data != 0x0A]))
    return pa.table({"phrase": phrases, "n": np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int64)})


def count_phrases(docs: DataFrame, maps: list[BitMap], passes: Passes, least: int, parts: int, chunk_bytes: int = CHUNK_BYTES, held_texts: int = HELD_TEXTS) -> DataFrame:
    """Exact rows (lang, words, phrase, n) of the phrases of ``docs`` (lang, text) that :func:`chunk_counts`
    counts and that stand ``least`` times or more; and of all words, under 0 words.  Texts travel packed, as
    fingerprints do."""
    held = docs.sparkSession.sparkContext.broadcast((maps, passes))

    def run(batches):
        found: list[pa.Table] = []
        size = 0
        for batch in batches:
            languages = batch.column(0).to_pylist()
            for c in T.chunks(batch.column(1), chunk_bytes):
                t = tokens(c, languages[c.lo : c.hi])
                for part in chunk_counts(t, *held.value) if t else ():
                    found.append(part)
                    size += len(part)
                if size > held_texts:
                    merged = _merged(found)
                    found, size = [merged], len(merged)
                    if size > held_texts // 2:
                        yield from packed_texts(merged, parts)
                        found, size = [], 0
        if found:
            yield from packed_texts(_merged(found), parts)

    def add_up(rows: pa.Table) -> pa.Table:
        total = unpacked_texts(rows).group_by("phrase").aggregate([("n", "sum")])
        total = total.filter(pc.or_(pc.greater_equal(total.column("n_sum"), least), pc.equal(total.column("phrase"), "")))
        phrases = total.column("phrase")
        words = pc.if_else(pc.equal(phrases, ""), 0, pc.add(pc.count_substring(phrases, " ").cast(pa.int32()), 1)).cast(pa.int32())
        lang = pa.array([rows.column("lang")[0].as_py()] * len(total), pa.string())
        return pa.table({"lang": lang, "words": words, "phrase": phrases.cast(pa.string()), "n": total.column("n_sum")})

    packed = docs.mapInArrow(run, "lang string, part long, phrases binary, counts binary")
    return packed.groupBy("lang", "part").applyInArrow(add_up, "lang string, words int, phrase string, n long")


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Counts of the same phrase added up."""
    out = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    return out.rename_columns(["lang", "phrase", "n"]).combine_chunks()


def bit_map(hashes: DataFrame, bits_per_phrase: int = BITS_PER_PHRASE, most_bits: int = MOST_BITS) -> BitMap:
    """Map of the column ``h``; past ``most_bits`` it only gets denser."""
    n = hashes.count()
    bits = 1 << min(max(12, (n * bits_per_phrase).bit_length()), most_bits.bit_length() - 1)

    def cells(batch: pa.RecordBatch) -> dict:
        h = np.unique(np.concatenate(BitMap.probes(batch.column(0).to_numpy().view(np.uint64), bits)))
        return {"cell": (h >> T.U64(6)).astype(np.int64), "bits": (T.U64(1) << (h & T.U64(63))).view(np.int64)}

    out = np.zeros(bits // 64, np.uint64)
    found = T.per_batch(hashes.select("h"), cells, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    table = found.toArrow()
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return BitMap(out)


def frequent_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    sample_parts: int = SAMPLE_PARTS,
    sample_count: int = SAMPLE_COUNT,
    bits_per_phrase: int = BITS_PER_PHRASE,
    most_bits: int = MOST_BITS,
    chunk_bytes: int = CHUNK_BYTES,
    log: list | None = None,
) -> DataFrame:
    """All phrases of 1 to ``max_words`` words that stand ``min_count`` times or more in a language of
    ``docs`` (doc_id, lang, text), with their counts; and for each language its number of words, under 0
    words.  ``log`` takes the number of border failures before every further pass."""
    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    rows = docs.select(lang, "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 << max(0, (size // PART_BYTES).bit_length(), (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    with T.small_batches(docs.sparkSession, BATCH_BYTES):
        sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample_parts)) == 0).select(lang, "text")
        maps = lambda found, lengths: {k: bit_map(found.where(F.col("words") == k), bits_per_phrase, most_bits) for k in lengths}
        shorter = range(1, max_words)
        sampled = materialize(count_hashes(sample, [], max_words - 1, sample_count, parts, chunk_bytes))
        known = maps(sampled, shorter)
        passes: Passes = [[known[k] for k in shorter]]
        found = None
        while True:
            new = materialize(count_hashes(rows, passes, max_words, min_count, parts, chunk_bytes))
            found = new if found is None else found.unionByName(new)
            missing = _missing(new.where(F.col("words") < max_words), passes)
            if not missing:
                passes = []
                break
            if log is not None:
                log.append(sum(missing.values()))
            # maps of lengths without a failure stay the same objects, also in the tasks
            known |= maps(found, shorter if len(passes) == 1 else missing)
            passes.append([known[k] for k in shorter])
            if min(missing) == max_words - 1:
                break
        every = maps(found, range(1, max_words + 1))
        return materialize(count_phrases(rows, [every[k] for k in sorted(every)], passes, min_count, parts, chunk_bytes))


def _missing(hashes: DataFrame, passes: Passes) -> dict[int, int]:
    """By length, how many of the frequent phrases no pass knew, so that their extensions were not proposed."""
    held = hashes.sparkSession.sparkContext.broadcast(passes)

    def unknown(batch: pa.RecordBatch) -> dict:
        h, words = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        known = np.zeros(len(h), bool)
        for maps in held.value:
            for k, m in enumerate(maps, 1):
                known[words == k] |= m.has(h[words == k])
        lengths, n = np.unique(words[~known], return_counts=True)
        return {"words": lengths, "n": n}

    counted = T.per_batch(hashes.select("h", "words"), unknown, "words int, n long").groupBy("words").agg(F.sum("n").alias("n"))
    return {r["words"]: r["n"] for r in counted.collect()}


def exact_score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)) of long columns, in 38-digit integers."""
    wide = lambda c: f"cast({c} AS decimal(19, 0))"
    return F.expr(f"(cast(1000000 AS decimal(7, 0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})")


def collocations(found: DataFrame, top: int = TOP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """The first ``top`` phrases of each language from :func:`frequent_phrases`."""
    known = found.where("words > 0").select("lang", "phrase", "n")
    pieces = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(pieces, start, n), " ")
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_rest"))
    left = known.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "_first"]).join(right, ["lang", "_rest"]).withColumn("score", exact_score("a", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    inner = candidates.where("words > 2").withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1)))
    covered = inner.select("lang", part(F.col("_from"), F.col("_size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    left_over = best.join(covered, ["lang", "phrase"], "left").where(F.col("_over").isNull() | (100 * F.col("_over") < cover_percent * F.col("a")))
    flat = left_over.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    numbered = row_numbers(flat, [F.col("lang"), -F.col("score"), -F.col("a"), F.col("phrase")])
    sizes = found.where("words = 0").groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    few = sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    small = F.broadcast if few else (lambda frame: frame)
    firsts = numbered.groupBy(F.col("lang").alias("_lang")).agg(F.min("row_no").alias("_first"))
    per_lang = small(firsts.join(small(sizes), "_lang"))
    ranked = numbered.join(per_lang, F.col("lang") == F.col("_lang")).withColumn("rank", F.col("row_no") - F.col("_first") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(T.read(spark, sf_dir, "documents")))


def _oracle() -> str:
    return rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase),
t AS (SELECT lang, cast(sum(n) AS bigint) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE k > 1 AND n >= {MIN_COUNT}),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.cut, l.n AS l, r.n AS r,
    cast(cast(1000000 AS hugeint) * x.a * x.a // (cast(l.n AS hugeint) * r.n) AS bigint) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
         JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, t.n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE coalesce(100 * most < {COVER_PERCENT} * a, true)
QUALIFY rank <= {TOP}"""


ORACLE = _oracle()

"""Token ids in Arrow files of equal-length sequences, and their way back.

Rows are put in ascending id order by one range shuffle.  Each range is encoded and written as
Arrow IPC files of record batches with a fixed-size-list column of tokens and each sequence's number of
valid ones.  A memory-mapped reader gets sequence k of a batch by slicing, without a copy, and its mask as a
window of one constant array (ones, then zeros), also without a copy.  Rows follow one another without a
gap, each ended by the end id; only a file's last sequence is padded, and its mask is 0 there.  Beside it stands an index file with every row's id, place and length.  A file that
has ``FILE_IDS`` ids is closed and the task goes on with another, so files and their indexes stay bounded.
Token ids are uint16 where the vocabulary allows, else uint32.

A task writes files under names of its own and returns them; the manifest, a Parquet table committed
by Spark, names the files of the tasks that counted, so attempts that were lost or ran twice leave
only files nobody reads.  Files go through the file system their URI names, in the folder of
``spark.checkpoint.dir``; a scheme that Arrow does not know is refused before anything is encoded.

A null or empty text is the end id alone.  Null ids come first; rows with equal ids stand in the order of
their texts' first characters, then of their texts' hashes, and are spread over files by these.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from churnlens.llm import text as T
from churnlens.session import materialize, scratch_folder

SEQUENCE = 2048
BATCH_SEQUENCES = 128
REMEMBERED = 300_000
#: Text encoded at once: the more, the fewer words are looked up again.
CHUNK_BYTES = 2 << 20
#: Ids after which a file is closed.
FILE_IDS = 64 << 20
#: Characters by which rows of one id are put in order first.
HEAD = 32
#: Names of Hadoop's file systems that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Characters that str.split() takes for space and the tokenizer's pattern does not.
NOT_QUITE_SPACE = "\x1c\x1d\x1e\x1f"

# The normaliser and the pattern of the tokenizer files that parts are cut by here.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"

_b = np.arange(256)
_SPACE = np.isin(_b, [*b" \n\r\t"])
_DIGIT = (_b >= 0x30) & (_b <= 0x39)
_SMALL = (_b >= 0x61) & (_b <= 0x7A)
_ASCII = _SPACE | ((_b > 0x20) & (_b < 0x7F))
#: The letters U+00C0 to U+00FF are this byte and one of LATIN.
_LEAD = 0xC3
_LATIN = (_b >= 0x80) & (_b <= 0xBF) & ~np.isin(_b, [0x97, 0xB7])
_CAPITAL = (_b >= 0x80) & (_b <= 0x9E) & (_b != 0x97)
_MARK, _LETTER, _NUMBER = 1, 2, 3
_KIND = np.where(_SPACE, 0, np.where(_DIGIT, _NUMBER, np.where(_SMALL | (_b >= 0x80), _LETTER, _MARK))).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are plain (ASCII and Latin letters, no place for a special string), and of their text,
    lower-cased, the pre-tokens: all their bytes in order, sizes, and how many each row has.

    The pattern takes an apostrophe with s, t, re, ve, m, ll or d after it where a match begins; else a run of
    letters, one digit, or a run of marks.
    """
    n = len(data)
    after_lead = np.concatenate([[False], data[:-1] == _LEAD])[:n]
    strange = ~(_ASCII[data] | (data == _LEAD) | (after_lead & _LATIN[data]))
    strange[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    sums = np.concatenate([[0], np.cumsum(strange)])
    plain = sums[offsets[1:]] == sums[offsets[:-1]]
    low = T.LOWER[data] + (after_lead & _CAPITAL[data]).astype(np.uint8) * np.uint8(0x20)
    kind = _KIND[low] * np.repeat(plain, np.diff(offsets)).astype(np.uint8)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.ones(n + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    change |= edge
    starts = np.flatnonzero((kind > 0) & change[:-1])
    ends = np.flatnonzero((kind > 0) & change[1:]) + 1

    next_start, next_end = np.append(starts[1:], n), np.append(ends[1:], n)
    quote = (low[starts] == ord("'")) & (ends - starts == 1) & (kind[starts] == _MARK) & (next_start == ends) & ~edge[ends] & (np.append(kind[starts[1:]], 0) == _LETTER)
    first, second = low[np.minimum(ends, n - 1)] if n else low, low[np.minimum(ends + 1, n - 1)] if n else low
    pair = (next_end - next_start >= 2) & np.logical_or.reduce([(first == a) & (second == b) for a, b in (b"re", b"ve", b"ll")])
    taken = np.where(quote, np.where(pair, 2, np.isin(first, [*b"stmd"])), 0)
    ends = ends + taken
    starts = starts + np.concatenate([[0], taken[:-1]])[: len(starts)]
    kept = ends > starts
    starts, ends = starts[kept], ends[kept]
    return plain, low[kind > 0], ends - starts, np.diff(np.searchsorted(starts, offsets))


class WordEncoder:
    """Token ids of texts, put together from remembered parts that the tokenizer keeps apart anyway.

    The tokenizer drops white space, and neither its normaliser nor its pattern reaches across it, so
    a text is encoded unit by unit.  In texts of Latin letters and ASCII the parts are the matches of its
    pattern (words, digits, runs of marks); in other texts, and where special strings could stand,
    they are the units between white space.  Only parts not seen lately reach the library.  A file
    with another normaliser, pattern or word end than the fixed values above gets whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.remembered = remembered
        self.splits = self.as_assumed(path)
        #: For words that are normalised and apart already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.parts: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    @staticmethod
    def as_assumed(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        return (
            (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and steps[:1] == split
            and all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
            and spec["model"].get("end_of_word_suffix") == WORD_END
            and all(t["content"].startswith("<|") and not t["normalized"] for t in spec.get("added_tokens") or ())
        )

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def single(self, words: list[str], step: int = 1000) -> list[bytes]:
        """Ids of words that are one pre-token each: many are encoded as one text, and cut apart where a token ends a word."""
        out: list[bytes] = []
        for lo in range(0, len(words), step):
            some = words[lo : lo + step]
            ids = np.array(self.of_words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                out += self.library(some)
                continue
            flat, cuts = ids.tobytes(), (ends * self.kind.itemsize).tolist()
            out += [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def known(self, wanted: Collection[str], memory: str, encode) -> dict[str, bytes]:
        """The memory of that name with all of ``wanted`` in it.  When it holds too many, it starts anew with
        what is wanted now and was known."""
        held = getattr(self, memory)
        missing = [w for w in wanted if w not in held]
        if len(held) + len(missing) > self.remembered:
            held = {w: held[w] for w in wanted if w in held}
            setattr(self, memory, held)
        held.update(zip(missing, encode(missing), strict=True))
        return held

    def other(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the units between white space, or whole."""
        units = [t.split() if self.splits and "<|" not in t and not any(c in t for c in NOT_QUITE_SPACE) else [] for t in texts]
        by_unit = self.known(set().union(*units), "units", self.library)
        whole = iter(self.library([t for t, us in zip(texts, units, strict=True) if not us]))
        return [b"".join(map(by_unit.__getitem__, us)) if us else next(whole) for us in units]

    def encode(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's rows, one after the other, and how many each row has."""
        plain, body, sizes, n_words = word_spans(chunk.data, chunk.offsets)
        if not self.splits:
            plain, body, sizes, n_words = np.zeros_like(plain), body[:0], sizes[:0], np.zeros_like(n_words)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        coded = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)).dictionary_encode()
        # no word holds a line feed: one string is cut, which is quicker than one value after the other
        spelled = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
        words = pc.binary_join(spelled, "\n")[0].as_py().split("\n") if len(sizes) else []
        ids = pa.array(list(map(self.known(words, "parts", self.single).__getitem__, words)), pa.large_binary()).take(coded.indices)
        upto = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // self.kind.itemsize
        of_words = np.frombuffer(ids.buffers()[2] or b"", self.kind)[: upto[-1]]
        first = np.concatenate([[0], np.cumsum(n_words)])
        counts = upto[first[1:]] - upto[first[:-1]]
        rows = np.flatnonzero(~plain)
        if not len(rows):
            return of_words, counts
        rest = self.other([T.span_text(chunk, r).decode() for r in rows])
        counts[rows] = [len(x) // self.kind.itemsize for x in rest]
        out = np.empty(counts.sum(), self.kind)
        by_word = np.repeat(plain, counts)
        out[by_word] = of_words
        out[~by_word] = np.frombuffer(b"".join(rest), self.kind)
        return out, counts


def encoder_of(path: str) -> WordEncoder:
    """This process's encoder for a tokenizer file: what one task has learnt serves the step's next."""
    if path not in T.HELD:
        T.HELD[path] = WordEncoder(path)
    return T.HELD[path]  # type: ignore[return-value]


def windows(length: int) -> np.ndarray:
    """Ones, then zeros: the mask of a sequence with n valid tokens begins at length - n."""
    return np.repeat(np.array([True, False]), length)


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with the end id after each."""
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(ids) + len(counts), ids.dtype)
    here = np.ones(len(out), bool)
    here[ends] = False
    out[here], out[ends] = ids, end_id
    return out, counts + 1


def arrow_uri(folder: str) -> str:
    """The folder under the name that Arrow has for its file system."""
    scheme, colon, rest = folder.partition(":")
    if not colon:
        return f"file://{folder}"
    if scheme == "file":
        return "file://" + "/" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    try:
        return pafs.FileSystem.from_uri(folder)
    except (pa.ArrowException, ValueError) as e:
        raise ValueError(f"token files cannot be written to {folder}: {e}; name a folder of a file, hdfs, s3, gs or abfss file system") from e


class ShardWriter:
    """One file of sequences with its index."""

    def __init__(self, folder: str, kind: np.dtype, length: int):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = uuid.uuid4().hex
        self.path, self.index_path = f"{base}/{self.name}.arrow", f"{base}/{self.name}.index.arrow"
        self.kind, self.length = kind, length
        self.schema = pa.schema({"tokens": pa.list_(pa.from_numpy_dtype(kind), length), "n_valid": pa.int32()})
        self.sink = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.index: list[tuple[pa.Array, np.ndarray]] = []
        self.n_ids = 0

    def add(self, ids: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Rows of these ids, whose ``counts`` token ids follow one another in ``tokens``."""
        self.index.append((ids, counts))
        self.waiting.append(tokens)
        self.n_waiting += len(tokens)
        self.n_ids += len(tokens)
        step = self.length * BATCH_SEQUENCES
        if self.n_waiting >= step:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // step * step
            for lo in range(0, whole, step):
                self.write(flat[lo : lo + step], 0)
            self.waiting, self.n_waiting = [flat[whole:].copy()], len(flat) - whole

    def write(self, flat: np.ndarray, padded: int) -> None:
        valid = np.full(len(flat) // self.length, self.length, np.int32)
        valid[-1] -= padded
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.array(valid)], schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:  # the last batch: every batch before it is full
            flat = np.concatenate(self.waiting)
            padded = -len(flat) % self.length
            self.write(np.concatenate([flat, np.zeros(padded, self.kind)]), padded)
        self.writer.close()
        self.sink.close()
        with self.fs.open_output_stream(self.index_path) as sink:
            kind = self.index[0][0].type
            with pa.ipc.new_file(sink, pa.schema({"id": kind, "start": pa.int64(), "n_tokens": pa.int64()})) as writer:
                start = 0
                for ids, n in self.index:
                    writer.write_batch(pa.record_batch([ids, pa.array(start + np.cumsum(n) - n), pa.array(n)], names=["id", "start", "n_tokens"]))
                    start += int(n.sum())


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int, length: int = SEQUENCE, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Write all rows; returns the manifest: shard and part number, folder, file name, ids before it, ids in it.
    Without a ``folder`` the files are released with the session's other tables."""
    spark = docs.sparkSession
    folder = arrow_uri(folder or scratch_folder(spark))
    file_system(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        encoder = writer = None

        def close(writer: ShardWriter) -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, part, writer.name, writer.n_ids)], names=["shard", "part", "name", "n_ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or encoder_of(tokenizer_path)
            for c in T.chunks(batch.column(1), chunk_bytes):
                writer = writer or ShardWriter(folder, encoder.kind, length)
                writer.add(batch.column(0)[c.lo : c.hi], *ended(*encoder.encode(c), end_id))
                if writer.n_ids >= file_ids:
                    yield close(writer)
                    writer, part = None, part + 1
        if writer:
            yield close(writer)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(id_col), F.substring(text_col, 1, HEAD), F.xxhash64(text_col)]
    rows = docs.select(id_col, text_col).repartitionByRange(n, *keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    manifest = materialize(rows.mapInArrow(run, "shard long, part long, name string, n_ids long"))
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).withColumn("folder", F.lit(folder))


def open_shard(folder: str, name: str):
    """The opened file and its index; memory-mapped where the folder is a local one."""
    fs, base = file_system(folder)
    path, index_path = f"{base}/{name}.arrow", f"{base}/{name}.index.arrow"
    local = isinstance(fs, pafs.LocalFileSystem)
    return tuple(pa.ipc.open_file(pa.memory_map(p) if local else fs.open_input_file(p)) for p in (path, index_path))


def sequence(folder: str, name: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``k`` of a file and its mask, by random access: views of the (memory-mapped) file and of a constant."""
    tokens, _ = open_shard(folder, name)
    batch = tokens.get_batch(k // BATCH_SEQUENCES)
    length, at = batch.schema.field("tokens").type.list_size, k % BATCH_SEQUENCES
    valid = batch.column(1)[at].as_py()
    return batch.column(0).flatten().slice(at * length, length).to_numpy(), windows(length)[length - valid : 2 * length - valid]


def read_tokens(manifest: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """Every row's place and checksum from the files: one task reads whole files, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                yield from rows_of(item)

    def rows_of(item: dict) -> Iterator[pa.RecordBatch]:
        tokens, index = open_shard(item["folder"], item["name"])
        stream = (tokens.get_batch(b) for b in range(tokens.num_record_batches))
        have, at = np.zeros(0, "<u4"), 0  # ids not yet given to a row, and how many of them are used
        for b in range(index.num_record_batches):
            rows = index.get_batch(b)
            sums = []
            for need in rows.column(2).to_pylist():
                crc = 0
                while need:
                    if at == len(have):
                        data = next(stream)
                        # padding stands at the end of the last batch only
                        valid = int(np.asarray(data.column(1)).sum())
                        have, at = np.asarray(data.column(0).flatten())[:valid].astype("<u4"), 0
                    part = have[at : at + need]
                    crc = zlib.crc32(part, crc)
                    at, need = at + len(part), need - len(part)
                sums.append(crc)
            start = np.asarray(rows.column(1)) + item["before"]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(start), rows.column(2), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return T.map_batches(manifest.repartition(n, "shard"), run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode and write ``docs``, read the files back: one row per row of ``docs``."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return read_tokens(write_tokens(docs, path, end_id), dict(docs.dtypes)["doc_id"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(T.read(spark, sf_dir, "documents"))

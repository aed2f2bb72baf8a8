"""Token counts with a whole-token shortcut.

Offline it is proved, for the loaded vocabulary, that
* no piece has the space mark after another character, so no merge crosses from a word into the mark
  that starts the next one, and no piece holds a line feed, so no merge crosses a line feed either:
  a text is a sequence of pre-tokens (space marks followed by other characters) that are encoded
  one by one;
* which pairs of neighbouring characters stand in no piece: no merge crosses between them either, so
  a pre-token may be cut there, such as a word from the comma after it;
* which vocabulary strings, encoded alone, give exactly one token.
Counting then looks pre-tokens up among those strings (one token each) and merges only the rest, by
the library, remembering recent ones.

Texts on which the splitting would not be the library's (a space mark in the text itself, runs of
spaces, a NUL) go to the library whole.  Null or empty texts have 0 tokens.  Vocabularies for which
the proof fails are counted by the library alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T

MARK = "▁"
#: Remembered pre-tokens besides the vocabulary; the memory starts anew beyond.
REMEMBERED = 400_000


class PieceCounter:
    """Token counts of texts for a sentencepiece model."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remembered = remembered
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        special = (self.model.is_control, self.model.is_unknown, self.model.is_byte, self.model.is_unused)
        self.pieces = [p for i, p in enumerate(pieces) if not any(f(i) for f in special)]
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.splits = self.provable()
        #: Pre-tokens after a space mark, and pre-tokens that follow a line feed.
        self.whole: tuple[dict[str, int], dict[str, int]] = ({}, {})
        if self.splits:
            after = [p[1:] for p in self.pieces if p.startswith(MARK) and MARK not in p[1:]]
            bare = [p for p in self.pieces if MARK not in p]
            self.whole = tuple({w: 1 for w, n in zip(ws, self.library(ws, k), strict=True) if n == 1} for k, ws in enumerate((after, bare)))  # type: ignore[assignment]
        self.count: tuple[dict[str, int], dict[str, int]] = tuple(dict(w) for w in self.whole)  # type: ignore[assignment]

    def provable(self) -> bool:
        """Whether no piece has a mark after another character or a line feed, and texts reach the merges as they are."""
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces):
            return False
        tried = ["a  b", " a", "a ", "AÄﬁ", "a\nb", "\n"]
        alone = [[MARK, *x.replace(" ", MARK)] for x in tried]
        return all("".join(self.spelled(x)) == "".join(y) for x, y in zip(tried, alone, strict=True))

    def spelled(self, text: str) -> list[str]:
        """The pieces of a text, with bytes turned back into characters."""
        out = bytearray()
        for i in self.model.encode(text):
            p = self.model.id_to_piece(i)
            out += bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.encode()
        return [out.decode("utf-8", "replace")]

    def library(self, pretokens: list[str], bare: int) -> list[int]:
        """Tokens of pre-tokens, by the library: it puts a mark before each text, and a line feed is always one token."""
        if not pretokens:
            return []
        if bare:
            lead = len(self.model.encode("\n"))
            return [len(x) - lead for x in self.model.encode(["\n" + p for p in pretokens], num_threads=1)]
        # the empty pre-token is a lone mark, which the library only shows before something
        return [len(x) if p else 1 for p, x in zip(pretokens, self.model.encode(pretokens, num_threads=1), strict=True)]

    def look_up(self, pretokens: list[str], bare: int) -> dict[str, int]:
        known = self.count[bare]
        if missing := set(pretokens) - known.keys():
            if len(known) + len(missing) > self.remembered + len(self.whole[bare]):
                known = self.count[bare]
                known.clear()
                known.update(self.whole[bare])
                missing = set(pretokens) - known.keys()
            self.learn(sorted(missing), bare)
        return known

    def learn(self, pretokens: list[str], bare: int) -> None:
        """Count new pre-tokens: the characters at their end that no piece joins to what stands before are cut off first, all at once."""
        known, tails = self.count[bare], self.count[1]
        cut = {}
        for p in pretokens:
            end = len(p)
            while end > 1 and not p[end - 1].isalnum() and p[end - 2 : end] not in self.pairs:
                end -= 1
            if end < len(p):
                cut[p] = end
        alone = sorted({p[: cut.get(p, len(p))] for p in pretokens} - known.keys())
        known.update(zip(alone, self.library(alone, bare), strict=True))
        if cut:
            marks = {p: Counter(p[end:]) for p, end in cut.items()}
            fresh = sorted({m for some in marks.values() for m in some} - tails.keys())
            tails.update(zip(fresh, self.library(fresh, 1), strict=True))
            known.update([(p, known[p[:end]] + sum(tails[m] * n for m, n in marks[p].items())) for p, end in cut.items()])

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        odd: list[int] = []
        marked: list[list[str]] = []
        bare: list[list[str]] = []
        which: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or "  " in text or text[0] == " " or MARK in text or "\0" in text:
                odd.append(k)
                continue
            lines = text.split("\n")
            out[k] = len(lines) - 1
            after: list[str] = lines[0].split(" ")
            first: list[str] = []
            for line in lines[1:]:
                if line:
                    parts = line.split(" ")
                    first.append(parts[0])
                    after += parts[1:]
            which.append(k)
            marked.append(after)
            bare.append([x for x in first if x])
        known = self.look_up([w for ws in marked for w in ws], 0)
        for k, ws in zip(which, marked, strict=True):
            out[k] += sum(map(known.__getitem__, ws))
        known = self.look_up([w for ws in bare for w in ws], 1)
        for k, ws in zip(which, bare, strict=True):
            out[k] += sum(map(known.__getitem__, ws))
        for k, ids in zip(odd, self.model.encode([texts[k] for k in odd], num_threads=1) if odd else [], strict=True):
            out[k] = len(ids)
        return out


def strings(chunk: T.Chunk) -> list[str]:
    """The rows of a chunk as str."""
    data = chunk.data.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, for every row; the model is loaded once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if not batch.num_rows:
                continue
            counter = counter or PieceCounter(model_path)
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for c in T.chunks(batch.column(1)):
                n_bytes[c.lo : c.hi] = np.diff(c.offsets)
                n_tokens[c.lo : c.hi] = counter.counts(strings(c))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(T.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

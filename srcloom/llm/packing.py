"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method: bounded-space online best-fit. Each packing task keeps a fixed number of open sequences, indexed by their free
space; a bitset has one bit for each amount of free space that some open sequence has, so the best fit for a piece is
the lowest set bit at or above its length. When all are open and none fits, the fullest closes.

Documents are tokenised where they are read: texts are cut at ASCII white space, where the tokenizer's own rules (read
from its file) drop that and never join across it, and the ids of each chunk come from a cache in front of the
tokenizer, bounded in bytes and dropped at the end of the task. For files with other rules whole texts are encoded. Only
the small rows (document, piece, length) are dealt for placing, and places come back to pieces by row number: packing tasks take about PIECES_EACH of them, dealt by hash, so
their number grows with the data, no source or copy group lands in one, and each leaves at most OPEN_SEQUENCES partly
filled. Pieces arrive in order of document and piece, not of length, and are placed at once. Both steps depend on nothing
but their input, so a lost executor's tasks give the same rows again.

Null text is empty: one piece holding the end id. Texts over `length` ids are cut into full pieces, each its own
sequence, and the rest. Repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import even_partitions, written
from srcloom.llm.textbytes import give_back

LENGTH, END_ID = 4096, 1
#: Sequences that a packing task keeps open, and pieces that it takes.
OPEN_SEQUENCES = 256
PIECES_EACH = 100_000
#: Bytes that a worker's chunk cache may take (an entry: its texts and about ENTRY_BYTES), and the longest chunk kept there.
CACHE_BYTES, ENTRY_BYTES, LONGEST_CACHED = 128 << 20, 200, 48
#: A word of Latin letters (ASCII, or two bytes of U+00DF to U+00FF without the division sign), then ASCII marks but no apostrophe.
_WORD_AND_MARKS = re.compile(rb"((?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")

#: Byte-level tokenizers spell a byte as its Latin-1 character, and those without a visible one as the characters from U+0100 on.
_UNSEEN = [*range(33), *range(127, 161), 173]
_BYTE_ALPHABET = {byte: 256 + n for n, byte in enumerate(_UNSEEN)}

#: Rules under which chunks between white space are encoded apart, words in lower case, by letters and then marks.
_NORMALIZERS = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, ChunkIds | WholeTextIds] = {}


def encoded_by_chunks(path: str) -> bool:
    """Whether a tokenizer file's rules allow for encoding chunk by chunk."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normalizers = (rules.get("normalizer") or {}).get("normalizers", [])
    splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [(n["type"], n.get("pattern", {}).get("Regex")) for n in normalizers] == _NORMALIZERS
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": _SPLIT}
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
        and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in rules["added_tokens"])
    )


class WholeTextIds:
    """Ids of whole texts, straight from the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: bytes) -> bytes:
        return array.array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        """Nothing is kept between texts."""


class ChunkIds(dict):
    """Chunk (UTF-8, without ASCII white space) to its ids as little-endian bytes, emptied when it reaches its bound."""

    def __init__(self, path: str, most_bytes: int = CACHE_BYTES):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.held, self.most_bytes = 0, most_bytes

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        self.held += len(chunk) + len(ids) + ENTRY_BYTES
        self[chunk] = ids

    def __missing__(self, chunk: bytes) -> bytes:
        parts = _WORD_AND_MARKS.fullmatch(chunk)
        if parts:  # words are in lower case for the tokenizer, and marks after them are tokens of their own
            word, marks = parts.groups()
            stem = word.lower()
            ids = None if stem == chunk else self.get(stem)
            if ids is None:
                ids = self._of_stem(stem)
                if stem != chunk and len(stem) <= LONGEST_CACHED:
                    self._keep(stem, ids)
            if marks:
                ids += self[marks]
        else:
            ids = array.array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        if len(chunk) <= LONGEST_CACHED:
            self._keep(chunk, ids)
        return ids

    def _of_stem(self, stem: bytes) -> bytes:
        """Letters that normalisation leaves alone go to the tokenizer's model at once, spelt in its byte alphabet."""
        return array.array("I", [t.id for t in self.model.tokenize(stem.decode("latin-1").translate(_BYTE_ALPHABET))]).tobytes()

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def encode(self, text: bytes) -> bytes:
        if self.held >= self.most_bytes:
            self.forget()
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> ChunkIds | WholeTextIds:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkIds(path) if encoded_by_chunks(path) else WholeTextIds(path)
    return _encoders[path]


_PIECE = (("row", pa.int64(), "long"), ("doc_id", pa.int64(), "long"), ("piece", pa.int32(), "int"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long"), ("ids", pa.binary(), "binary"))


def tokenised(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Per piece: row (a number of its own), doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian
    unsigned 32-bit). Row numbers hold for one computation, so write the table before using it twice."""
    step = 4 * length
    end = int(end_id).to_bytes(4, "little")
    fields = _PIECE if with_ids else _PIECE[:-1]

    def rows_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, fields, strict=True)], [f[0] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        columns, held = [[] for _ in fields], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer()
                ids = (ids_of.encode(raw.to_pybytes()) if raw is not None else b"") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(columns, (row, doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
                    row += 1
                    held += len(part) * with_ids + 64
                    if held > 4 << 20:
                        yield rows_of(columns)
                        columns, held = [[] for _ in fields], 0
        yield rows_of(columns)
        ids_of.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, _, kind in fields))


class OpenSequences:
    """A fixed number of open sequences in a bitset keyed by free space."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free = 0  # bit f: some open sequence has f places left
        self.closed = 0
        self.at: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        found = self.at[space].pop()
        if not self.at[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The sequence and offset for a piece of `size`, 1 to length."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.closed += 1
            space, sequence = self.length, self.made
            self.made += 1
        left = space - size
        if left:
            self.at[left].append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.length - space


def placed(pieces: DataFrame, length: int = LENGTH, most_open: int = OPEN_SEQUENCES, pieces_each: int = PIECES_EACH) -> DataFrame:
    """row, sequence_id and offset of `pieces` (row, doc_id, piece, length). Counts pieces, so give a written table."""
    tasks = even_partitions(pieces.count(), pieces_each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        bins = OpenSequences(length, most_open)
        for batch in batches:
            sequence, offset = array.array("q"), array.array("q")
            for size in batch.column("length").to_pylist():
                s, o = bins.place(size)
                sequence.append(base + s)
                offset.append(o)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.array(sequence, dtype=np.int64)), pa.array(np.array(offset, dtype=np.int64))], ["row", "sequence_id", "offset"])

    dealt = pieces.select("row", "doc_id", "piece", "length").repartition(tasks, F.xxhash64("row")).sortWithinPartitions("doc_id", "piece", "row")
    return dealt.select("row", "length").mapInArrow(run, "row long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Documents as pieces placed in sequences: doc_id, piece, start, length, ids_crc32, ids (if asked for), sequence_id and offset."""
    pieces = written(tokenised(docs, tokenizer, length, with_ids=with_ids), "pieces")
    return pieces.join(placed(pieces, length), "row").drop("row")

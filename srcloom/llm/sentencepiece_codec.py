"""SentencePiece encoding and decoding by streaming Viterbi.

The encoder finds the segmentation of greatest total piece score (the unigram model over a SentencePiece vocabulary).
It takes every text as a stream of characters and holds those after the last committed boundary, with the best path to
each boundary among them. A position is settled when the pieces that begin there have all been seen to end (the
vocabulary's beginnings tell), so the window ahead is never longer than the longest piece. Whenever the backpointer
paths of all live boundaries run through one boundary, the ids before it are final and are committed, so memory does not
grow with the text.

Between two neighbouring characters that no piece holds side by side every path has a boundary, whatever the scores: at
the beginning of a word, or between most letters and the marks after them. The stream is always committed there. What it
commits between two such boundaries depends on these characters alone, so a worker keeps the ids of committed stretches,
bounded in bytes and dropped at the end of the task, and runs the search on those it has not met.

A vocabulary of kind BPE is used as pieces with scores: ids are those of the best-scoring segmentation, which the library
gives when the same file is read as a unigram model, and not those of BPE merges. Spaces are spelt as the vocabulary
spells them; a U+2581 in the text itself is no space and goes to byte pieces. With byte pieces, as here, decoding gives
back the exact text, also with U+2581 in it; without them uncovered characters are lost in the unknown id.

Null text is empty and has no ids. Repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from srcloom.llm.textbytes import give_back

SPACE = "▁"
#: Bytes that a worker's cache of committed stretches may take, about ENTRY_BYTES an entry besides its ids, and its longest stretch.
CACHE_BYTES, ENTRY_BYTES, LONGEST_CACHED = 192 << 20, 230, 48
#: Characters of a text that the stream takes at once, and settled positions between two looks for a common boundary.
FED, LOOK = 1 << 16, 8

_codecs: dict[str, Codec] = {}


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        #: Pieces as they stand in text, with spaces for the vocabulary's own mark.
        self.ids = {p.replace(SPACE, " "): i for i, p in enumerate(self.pieces) if not special[i] and not model.is_byte(i)}
        self.scores = [model.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = model.unk_id()
        #: What an uncovered character costs: ten below the worst piece.
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        #: Neighbours within some piece. Between two other characters every path has a boundary.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Beginnings of pieces; a whole piece has its id and score, a mere beginning has none.
        self.table: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.ids for k in range(1, len(p) + 1)}
        self.table.update({p: (i, self.scores[i]) for p, i in self.ids.items()})
        self.spelt: list[bytes] = [b""] * n
        for i, p in enumerate(self.pieces):
            if not special[i]:
                self.spelt[i] = bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode()


class StreamingViterbi:
    """Best segmentation of a stream of characters, committed as soon as it is certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.most_held = self.commits = 0
        self.reset()

    def reset(self) -> None:
        self.held = ""  # characters after the last committed boundary
        self.best = [0.0]  # score of the best path to each boundary of `held`
        self.back: list[tuple[int, int]] = [(0, -1)]  # its last piece: where it begins, its id (-1: bytes)
        self.done = 0  # boundaries whose pieces have all been tried

    def feed(self, text: str, ends: bool = False) -> list[int]:
        """Takes more characters; returns the ids that have become final: all, where the stream is known to have a
        boundary after the text (`ends`)."""
        out: list[int] = []
        longest = self.v.longest
        for at in range(0, len(text), longest):
            self.held += text[at : at + longest]
            self._settle(ends and at + longest >= len(text))
            self.most_held = max(self.most_held, len(self.held))
            if self.done >= LOOK or self.done == len(self.held):
                out += self._commit()
        return out

    def flush(self) -> list[int]:
        """Ids of all that is held; the stream starts anew."""
        self._settle(True)
        out = self._commit()
        self.reset()
        return out

    def _settle(self, ends: bool) -> None:
        """Tries the pieces that begin at each next position, up to one whose pieces may go on beyond what is held."""
        held, best, back = self.held, self.best, self.back
        table, longest, worst = self.v.table, self.v.longest, self.v.worst
        size = len(held)
        best += [-np.inf] * (size + 1 - len(best))
        back += [(0, -1)] * (size + 1 - len(back))
        for i in range(self.done, size):
            score = best[i]
            covered = False
            found: tuple[int, float] | bool | None = None
            for j in range(i + 1, min(size, i + longest) + 1):
                found = table.get(held[i:j], False)  # False where no piece begins like this, None for a mere beginning
                if found is None:
                    continue
                if found is False:
                    break
                total = score + found[1]
                if total > best[j]:
                    best[j], back[j] = total, (i, found[0])
                if j == i + 1:
                    covered = True
            if found is not False and i + longest > size and not ends:
                return  # a piece may go on; it will be tried again with more characters
            if not covered and score + worst > best[i + 1]:
                best[i + 1], back[i + 1] = score + worst, (i, -1)
            self.done = i + 1

    def _commit(self) -> list[int]:
        """Ids up to the last boundary that the paths of all live boundaries share; what lies before it is dropped."""
        back, best = self.back, self.best
        live = [j for j in range(self.done, len(best)) if best[j] > -np.inf]
        # walk the farthest of the paths back until one boundary is left
        ahead = set(live)
        while len(ahead) > 1:
            far = max(ahead)
            ahead.remove(far)
            ahead.add(back[far][0])
        cut = ahead.pop() if ahead else 0
        if not cut:
            return []
        self.commits += 1
        ids: list[int] = []
        end = cut
        while end:
            begin, piece = back[end]
            if piece >= 0:
                ids.append(piece)
            elif self.v.byte_ids:
                ids += [self.v.byte_ids[b] for b in reversed(self.held[begin:end].encode())]
            else:
                ids.append(self.v.unknown)
            end = begin
        base = best[cut]
        self.held = self.held[cut:]
        self.best = [b - base for b in best[cut:]]
        self.back = [(max(0, b - cut), p) for b, p in back[cut:]]
        self.done = max(0, self.done - cut)
        return ids[::-1]


class Codec(dict):
    """Streams texts; keeps, as little-endian bytes, the ids of stretches that the stream has committed before."""

    def __init__(self, path: str, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self.vocabulary = Vocabulary(path)
        self.stream = StreamingViterbi(self.vocabulary)
        self.kept, self.most_bytes = 0, most_bytes
        pairs = self.vocabulary.joined
        #: A word begins a stretch unless some piece goes on over a space.
        self.words = re.compile(r" *[^ ]+| +") if not any(p[0] != " " and p[1] == " " for p in pairs) else re.compile(r"(?s).+")

    def __missing__(self, stretch: str) -> bytes:
        """Ids of the characters between two boundaries that every path has."""
        joined = self.vocabulary.joined
        cuts = [k for k in range(1, len(stretch)) if stretch[k - 1 : k + 1] not in joined]
        if cuts:
            ids = b"".join([self[stretch[a:b]] for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)])
        else:
            ids = array.array("I", self.stream.feed(stretch, ends=True)).tobytes()
        if len(stretch) <= LONGEST_CACHED:
            self[stretch] = ids
            self.kept += len(ids) + ENTRY_BYTES
        return ids

    def forget(self) -> None:
        self.clear()
        self.kept = 0

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. A space is put before it, as the model asks."""
        out = []
        held = " " if text else ""
        for at in range(0, len(text), FED):
            if self.kept >= self.most_bytes:
                self.forget()
            stretches = self.words.findall(held + text[at : at + FED])
            held = "" if at + FED >= len(text) else stretches.pop()  # the last one may go on
            out += map(self.__getitem__, stretches)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        spelt = self.vocabulary.spelt
        return b"".join([spelt[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")[1:]


def codec(path: str) -> Codec:
    """The worker's codec of a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            out, held, at = [], 0, 0
            for text in batch.column("text"):
                out.append(c.encode(text.as_py() or ""))
                held += len(out[-1])
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(out)), pa.array(out, pa.binary())], ["doc_id", "ids"])
                    out, held, at = [], 0, at + len(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(out)), pa.array(out, pa.binary())], ["doc_id", "ids"])
        c.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x.as_py() or b"") for x in batch.column("ids")], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as bytes), n_chars of the text decoded from them, and whether it is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            n_ids, crc, chars, same = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                ids = c.encode(text)
                back = c.decode(ids)
                n_ids.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                chars.append(len(back))
                same.append(back == text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_ids, pa.int64()), pa.array(crc, pa.int64()), pa.array(chars, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "n_chars", "round_trip"])
        c.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, round_trip boolean")

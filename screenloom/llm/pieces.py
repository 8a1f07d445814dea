"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model at hand is of the BPE kind: its encoding merges adjacent symbols, best score first.
That encoding is a path through the text: every prefix has one last piece, and a piece may
follow another only if merging the two alone leaves them apart. So the pass keeps one back
pointer for each position, as Viterbi does: the piece that ends here and may follow the piece
that ends where it starts. Future pieces start within the longest piece's length of the text's
end; where the paths from all those positions meet, everything before is final and its ids are
committed. The window kept is what lies after that point.

White space starts pieces and never stands inside one, so paths meet at every word: a run of
white space and the word after it is encoded once and remembered, for a bounded number of
words. Equality with the library is tested.

Defined cases: texts of any length are taken whole; null and empty texts have no ids; repeated rows are encoded row by row; a null
id stays null; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import arrow_rows, staged

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of remembered words and pairs of pieces in a worker, about; beyond that it starts afresh.
MEMO_BYTES = 48 << 20
PAIR_BYTES = 24 << 20
#: What an entry of a dict, its key and its value take besides their characters, about.
ENTRY, PAIR = 230, 160
#: Rows of an Arrow batch of whole texts.
ROWS = 1000
#: Positions between two looks at where paths meet.
LOOK = 64


class Vocabulary:
    """Pieces, scores and byte fallback of a model file."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.texts = [b""] * n
        for piece, i in self.ids.items():
            self.texts[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.texts[i] = bytes([value])
        self.texts[self.unknown] = " ⁇ ".encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has white space inside")
        #: Runs of white space with the word after them; characters of no piece stand alone.
        self.words = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if not any("\n" in p for p in self.ids) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.follows: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo
        self.packed = {p: np.array([i], np.uint32).tobytes() for p, i in self.ids.items()}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merged(self, text: str) -> list[str]:
        """The text's symbols after merging, best score first, leftmost of equals; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k, (a, b) in enumerate(pairwise(parts)):
                score = self.scores.get(a + b)
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether merging leaves the two pieces as they are, side by side."""
        key = (before, piece)
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) * PAIR > PAIR_BYTES:
                self.follows.clear()
            found = self.follows[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def pack(self, piece: str) -> bytes:
        """The id of a piece as 32 bits, or those of the bytes of a character that is none."""
        found = self.packed.get(piece)
        if found is None:
            ids = [self.bytes.get(b, self.unknown) for b in piece.encode()] if self.bytes else [self.unknown]
            found = self.packed[piece] = np.array(ids, np.uint32).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if not text:
            return b""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo, out = self.memo, []
        for word in self.words.findall(SPACE + text.replace(" ", SPACE)):
            ids = memo.get(word)
            if ids is None:
                path = Path(self)
                ids = path.push(word) + path.finish()
                if len(word) <= 64:
                    memo[word] = ids
                    self.held += ENTRY + len(word) + len(ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding puts in front."""
        texts = self.texts
        out = b"".join([texts[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


class Path:
    """A streaming pass: push text in parts of any size, take the ids that are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tail = ""  # the last characters, fewer than the longest piece has
        self.last = [""]  # the piece that ends at each position since the last commit

    def push(self, text: str) -> bytes:
        out, longest = b"", self.v.longest
        for a in range(0, len(text), LOOK):
            self.advance(text[a : a + LOOK])
            end = len(self.last) - 1
            if end >= LOOK:
                out += self.commit({*range(max(0, end - longest + 1), end + 1)})
        return out

    def advance(self, text: str) -> None:
        """The piece that ends at each new position; the vocabulary's automaton names those in question."""
        last, follows, may_follow = self.last, self.v.follows, self.v.may_follow
        buffer = self.tail + text
        known = len(last)  # the first position without a piece
        shift = known - len(self.tail)  # of a match that ends at character e, e + shift is the position
        for e, piece in self.v.automaton.iter(buffer):
            end = e + shift
            if end < known:
                continue
            while known < end:  # a character of no piece
                last.append(buffer[known - shift])
                known += 1
            start = end - len(piece)
            if start >= 0:
                before = last[start]
                fits = follows.get((before, piece))
                if fits or (fits is None and may_follow(before, piece)):
                    last.append(piece)
                    known += 1
        for k in range(known - shift, len(buffer)):
            last.append(buffer[k])
        self.tail = buffer[-self.v.longest :]

    def commit(self, live: set[int]) -> bytes:
        """Ids up to where the paths from all live positions meet."""
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - len(self.last[far]))
        meet = live.pop()
        if meet == 0:
            return b""
        out = self.path(meet)
        # the piece before the meeting point decides what may follow it
        self.last = self.last[meet:]
        return out

    def path(self, end: int) -> bytes:
        parts = []
        while end > 0:
            parts.append(self.v.pack(self.last[end]))
            end -= len(self.last[end])
        return b"".join(reversed(parts))

    def finish(self) -> bytes:
        return self.path(len(self.last) - 1)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text) -> doc_id, ids."""
    v = Vocabulary.of(path)
    for b in batches:
        for a in range(0, b.num_rows, 256):
            part = b.slice(a, 256)
            packed = [v.encode(t or "") for t in part.column("text").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])])
            ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.record_batch(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), ids)], names=["doc_id", "ids"]
            )


def decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, ids) -> doc_id, n_pieces, ids_crc32, text."""
    v = Vocabulary.of(path)
    for b in batches:
        for a in range(0, b.num_rows, 256):
            part = b.slice(a, 256)
            ids = [x.values.to_numpy() for x in part.column("ids")]
            yield pa.record_batch(
                [
                    part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([v.decode(x) for x in ids], pa.string()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "text"],
            )


DECODED = "doc_id long, n_pieces long, ids_crc32 long, text string"


def texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, ids of every document."""
    path = path or model_path()
    return texts(docs, text, id_col).mapInArrow(lambda batches: encoded(batches, path), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, text from a table of ids."""
    path = path or model_path()
    return ids.mapInArrow(lambda batches: decoded(batches, path), DECODED)


def round_trip(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), and the
    SHA-256 of the text decoded from them. Decoding gives the text back, but for the white
    space mark itself, which is read as a space. One worker a task does both, so that an
    executor holds one vocabulary and one memory of words a core; the digests are staged, as
    the size of the batches holds for what is written meanwhile only."""
    path = path or model_path()
    back = texts(docs, text, id_col).mapInArrow(lambda batches: decoded(encoded(batches, path), path), DECODED)
    back = back.select("doc_id", "n_pieces", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
    with arrow_rows(docs.sparkSession, ROWS):
        return staged(back, "round-trip")

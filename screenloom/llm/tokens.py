"""Pre-tokens of a byte-level BPE tokenizer, and token counts without ids.

The pre-token pattern runs in Spark; the tokenizers library then sees every distinct
pre-token instead of every text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import arrow_rows, staged

TOKENIZER = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
#: The byte-level pre-token pattern (fixed values), with Unicode classes.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most frequent pre-tokens, no longer than HEAD_CHARS, are joined by broadcast: at most
#: HEAD * HEAD_CHARS * 4 bytes of strings. All others are joined by a shuffle.
HEAD = 1 << 17
HEAD_CHARS = 64
#: Pre-tokens a worker remembers before it starts afresh.
MEMO = 600_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: Column) -> Column:
    """The text cut into pieces whose encodings, joined, are the text's encoding.

    Special strings are pieces of their own. A text with code points that this Java has no
    category for stays whole: the library decides about it.
    """
    text = F.coalesce(text, F.lit(""))
    pieces = lambda s: F.regexp_extract_all(s, F.lit(PATTERN), F.lit(0))
    parts = F.split(text, r"<\|endoftext\|>")
    joined = F.flatten(
        F.transform(parts, lambda s, i: F.when(i == 0, pieces(s)).otherwise(F.concat(F.array(F.lit(SPECIAL)), pieces(s))))
    )
    uncharted = (F.octet_length(text) > F.length(text)) & text.rlike(r"\p{Cn}")
    return F.when(uncharted, F.array(text)).when(text.contains(SPECIAL), joined).otherwise(pieces(text))


class PieceEncoder:
    """Encodes lists of pieces with the tokenizers library; remembers a bounded number.

    Ids of remembered pieces lie one after another in ``store``; a piece is a slot, with a
    place and a length there. Slot 0 is the end id.
    """

    _loaded: dict[str, PieceEncoder] = {}

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.end_id = end_id
        self.forget()

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """One for each path in a worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.store, self.used, self.chars = np.zeros(1 << 16, np.uint32), 1, 0
        self.store[0] = self.end_id
        self.at, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each piece's place and length in them.

        Pieces of a space and letters stay apart when they are put together, so they are
        encoded as one text, which saves most calls; all others one by one.
        """
        parts, order, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        plain = [i for i, p in enumerate(pieces) if p[:1] == " " and p[1:].isalpha()]
        is_plain = np.zeros(len(pieces), bool)
        for a in range(0, len(plain), 4000):
            at = plain[a : a + 4000]
            found = self.tokenizer.encode("".join([pieces[i] for i in at]), add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(at))
            if len(counts) == len(at):
                parts.append(np.array(found.ids, np.uint32))
                order.append(np.array(at, np.int64))
                lengths.append(counts)
                is_plain[at] = True
        rest = np.flatnonzero(~is_plain)
        for a in range(0, len(rest), 4000):
            at = rest[a : a + 4000]
            found = [e.ids for e in self.tokenizer.encode_batch([pieces[i] for i in at], add_special_tokens=False)]
            parts += [np.array(x, np.uint32) for x in found]
            order.append(at)
            lengths.append(np.array([len(x) for x in found], np.int64))
        where, n = np.concatenate(order), np.concatenate(lengths)
        start, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        start[where], size[where] = np.cumsum(n) - n, n
        return np.concatenate(parts), start, size

    def recall(self, pieces: list[str]) -> np.ndarray:
        """The slots of some distinct pieces; those not remembered are encoded first."""
        if len(self.slots) > MEMO or self.used > 8 * MEMO or self.chars > 64 * MEMO:
            self.forget()
        slots = np.fromiter((self.slots.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(slots < 0)
        if len(new):
            names = [pieces[i] for i in new]
            ids, start, size = self.encode(names)
            if self.used + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(ids)), np.uint32)])
            self.store[self.used : self.used + len(ids)] = ids
            slots[new] = len(self.at) + np.arange(len(new))
            self.at, self.size = np.concatenate([self.at, start + self.used]), np.concatenate([self.size, size])
            self.used += len(ids)
            self.chars += sum(map(len, names))
            self.slots.update(zip(names, slots[new].tolist(), strict=True))
        return slots


def piece_counts(pieces: DataFrame, path: str) -> DataFrame:
    """Adds n_tokens to a table of distinct pieces (piece, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for b in batches:
            _, _, lengths = encoder.encode(b.column(0).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lengths)], names=["piece", "n", "n_tokens"])

    return pieces.select("piece", "n").mapInArrow(count, "piece string, n long, n_tokens long")


def coded(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of a column of lists, the code of every piece, and where lists begin."""
    flat = lists.flatten().dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(), starts


def piece_frequencies(pieces: DataFrame) -> DataFrame:
    """piece, n: the distinct pre-tokens of a column of lists; each batch sends its own once."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten().dictionary_encode()
            n = np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary))
            yield pa.record_batch([flat.dictionary, pa.array(n, pa.int64())], names=["piece", "n"])

    return pieces.mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame) -> dict[str, int]:
    """The most frequent short pieces and their tokens, at most HEAD.

    A histogram over some hundred steps of frequency tells the step from which on there are no
    more than HEAD, so nothing is sorted and no task sends more than it has of them.
    """
    short = counted.filter(F.length("piece") <= HEAD_CHARS).withColumn("step", F.floor(F.log2("n") * 8))
    steps = sorted(short.groupBy("step").count().collect(), reverse=True)
    least, total = None, 0
    for step, n in steps:
        total += n
        if total > HEAD:
            break
        least = step
    if least is None:
        return {}
    return {r.piece: r.n_tokens for r in short.filter(F.col("step") >= least).select("piece", "n_tokens").collect()}


def document_frequencies(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """doc_id, sig, sig2, sure, piece, times: frequencies of the pre-tokens that ``known`` lacks.

    ``sure`` carries the document's tokens from known pre-tokens, once. A document without
    others has one row, with a key that no piece has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        for b in batches:
            names, codes, starts = coded(b.column("pieces"))
            size = np.array([lengths.get(x, -1) for x in names], np.int64)
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            got = size[codes] if len(codes) else np.zeros(0, np.int64)
            sure = np.bincount(doc, weights=np.maximum(got, 0), minlength=len(starts) - 1).astype(np.int64)
            rare = got < 0
            key, times = np.unique(doc[rare] * max(1, len(names)) + codes[rare], return_counts=True)
            at, code = np.divmod(key, max(1, len(names)))
            none = np.setdiff1d(np.arange(len(starts) - 1), at)
            first = np.concatenate([np.diff(at, prepend=-1) != 0, np.ones(len(none), bool)])
            at = np.concatenate([at, none])
            words = [names[c] for c in code] + [f"\0{i}" for i in none]
            yield pa.record_batch(
                [
                    *[b.column(c).take(pa.array(at)) for c in ("doc_id", "sig", "sig2")],
                    pa.array(np.where(first, sure[at], 0)), pa.array(words, pa.string()),
                    pa.array(np.concatenate([times, np.zeros(len(none), np.int64)])),
                ],
                names=["doc_id", "sig", "sig2", "sure", "piece", "times"],
            )

    return docs.select("doc_id", "sig", "sig2", "pieces").mapInArrow(
        split, "doc_id long, sig long, sig2 int, sure long, piece string, times long"
    )


def count_tokens(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    Pieces are counted once per distinct pre-token of the corpus. The frequent head of that
    table, of bounded size, is summed where a text is read; frequencies of all other
    pre-tokens go by a shuffle on the pre-token. Of those only very long ones can be frequent;
    the engine splits such keys of the join.

    Defined cases: texts of any length are taken whole; null and empty texts have 0 tokens; repeated rows each get their count; a
    null id stays null; an empty table gives an empty result.
    """
    path = path or tokenizer_path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # two hashes, 96 bits: rows of one id (all rows without one, say) are told apart by text
    keyed = rows.select("doc_id", F.xxhash64("text").alias("sig"), F.hash("text").alias("sig2"), "text")
    pieces = piece_frequencies(rows.select(pre_tokens(F.col("text")).alias("pieces")))
    with arrow_rows(docs.sparkSession, 4000):
        counted = staged(piece_counts(pieces, path), "piece-counts")
    known = frequent(counted)
    met = document_frequencies(keyed.select("doc_id", "sig", "sig2", pre_tokens(F.col("text")).alias("pieces")), known)
    summed = met.join(counted.select("piece", "n_tokens"), "piece", "left").groupBy("doc_id", "sig", "sig2").agg(
        F.sum(F.col("sure") + F.col("times") * F.coalesce("n_tokens", F.lit(0))).alias("total")
    )
    with arrow_rows(docs.sparkSession, 4000):
        summed = staged(summed, "token-sums")
    # equal rows (same id, same text) were summed together; each has its share
    sizes = keyed.groupBy("doc_id", "sig", "sig2").agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.octet_length("text")).cast("long").alias("n_bytes")
    )
    joined = sizes.join(
        summed.select(F.col("doc_id").alias("s_id"), F.col("sig").alias("s_sig"), F.col("sig2").alias("s_sig2"), "total"),
        F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("sig") == F.col("s_sig")) & (F.col("sig2") == F.col("s_sig2")),
    )
    out = joined.select(
        "doc_id", "n_bytes", (F.col("total") / F.col("copies")).cast("long").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Operator 7, packing: sum-of-squares online packing into windows of a fixed length.

Each task packs the documents of its own input partition, one after the other.  A document is cut
into full windows and a remainder.  Level `l` counts the open windows filled with `l` tokens, and the
remainder goes where the sum of the squared counts is least afterwards: on an open window of some
level, or in a new one.  A full window is written at once.

Open windows are bounded: beyond `max_open` of them, and at the end of the task, they are closed by
cutting pieces of the emptiest to fill the fullest, so a task leaves at most one window that is not
full, and its memory does not grow with its input.  Nothing is shuffled, so hot sources and groups of
copies cost nothing extra, and a lost task is packed again from its own partition.

Sequence ids carry the number of the task in the bits above 32.

Results for odd inputs: null and empty texts consist of the end id alone; very long texts fill
windows of their own; repeated rows are packed as documents of their own; an empty table gives none.
"""

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 1024
END_ID = 0
MAX_OPEN = 2048
CACHED_PIECES = 400_000
CACHED_CHARS = 48

_ID_BYTES = 4
# Fixed value: how byte-level tokenizers of this kind split a text before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Printable ASCII, line breaks, tabs and Latin letters that every version of Unicode has.
_PLAIN = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
_BEFORE_BLANK = re.compile(r"\s ")

_PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class PieceIds(dict):
    """Ids of a blank and the piece that follows it, as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer always begins a new token at white space that follows other
    characters, so a text can be encoded piece by piece there, and frequent pieces only once.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(piece) <= CACHED_CHARS and len(self) < CACHED_PIECES:
            self[piece] = ids
        return ids


def _merge_encoding(path: str):
    """The same vocabulary as merge ranks, for a byte-level tokenizer whose ids are its merge order.

    It gives equal ids faster, but its classes of characters may follow another version of Unicode, so
    it is used for `_PLAIN` texts only.  None for any other tokenizer.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, before = spec["model"].get("vocab"), spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if not plain or before.get("add_prefix_space") or spec.get("normalizer") or spec["model"]["type"] != "BPE":
        return None
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    if any(vocabulary.get(m.replace(" ", "", 1)) != 256 + k for k, m in enumerate(merges)):
        return None
    import tiktoken

    # Byte-level vocabularies write the bytes without a printable character as those from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): k for t, k in vocabulary.items() if t not in special}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of special tokens in a text are text.
        self.tokenizer.encode_special_tokens = True
        self.merges = _merge_encoding(path)
        self.pieces = PieceIds(self._encode)

    def _encode(self, text: str) -> bytes:
        if self.merges and _PLAIN.fullmatch(text):
            ids = self.merges.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        if _BEFORE_BLANK.search(text):
            pieces = _whole(pieces)
        return self._encode(pieces[0]) + b"".join(map(self.pieces.__getitem__, pieces[1:]))


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a worker process, so that its pieces are kept."""
    return TextEncoder(path)


def _whole(pieces: list[str]) -> list[str]:
    """Join pieces where the blank between them follows other white space."""
    out = [pieces[0]]
    for piece in pieces[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(piece)
        elif len(out) == 1:
            out[0] += " " + piece
        else:
            out[-1] += " " + piece
    return out


class Packer:
    """Windows of one task.  A piece is (document, start, ids); `emit(window pieces)` takes full ones."""

    def __init__(self, window: int, max_open: int, emit):
        self.window, self.max_open, self.emit = window, max_open, emit
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def add(self, document, ids: bytes) -> None:
        step = self.window * _ID_BYTES
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.emit([(document, at // _ID_BYTES, ids[at : at + step])])
        if whole < len(ids):
            self._place((document, whole // _ID_BYTES, ids[whole:]), (len(ids) - whole) // _ID_BYTES)

    def _place(self, piece, length: int) -> None:
        level = self._best_level(length)
        if level:
            pieces = self._take(level)
        else:
            pieces = []
        pieces.append(piece)
        if level + length == self.window:
            self.emit(pieces)
            return
        self._put(level + length, pieces)
        if self.n_open > self.max_open:
            self.close(keep_last=True)

    def _best_level(self, length: int) -> int:
        """The level to place on (0: a new window) that makes the sum of squares least."""
        counts = self.counts
        levels = np.flatnonzero(counts[: self.window - length + 1])
        # A window of level l goes to l + length; a full one leaves the array.
        change = np.where(
            levels + length < self.window, 2 * counts[levels + length] + 1, 0
        ) - (2 * counts[levels] - 1)
        best, least = 0, 2 * counts[length] + 1
        if len(levels):
            k = int(change.argmin())
            if change[k] <= least:
                best = int(levels[k])
        return best

    def _put(self, level: int, pieces: list) -> None:
        self.open.setdefault(level, []).append(pieces)
        self.counts[level] += 1
        self.n_open += 1

    def _take(self, level: int) -> list:
        stack = self.open[level]
        pieces = stack.pop()
        if not stack:
            del self.open[level]
        self.counts[level] -= 1
        self.n_open -= 1
        return pieces

    def close(self, keep_last: bool = False) -> None:
        """Fill the fullest windows with pieces cut from the emptiest."""
        fullest = [
            [level, pieces] for level in sorted(self.open, reverse=True) for pieces in self.open[level]
        ]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        i, j = 0, len(fullest) - 1
        while i < j:
            target, source = fullest[i], fullest[j]
            document, start, ids = source[1].pop()
            n = min(len(ids) // _ID_BYTES, self.window - target[0])
            cut = len(ids) - n * _ID_BYTES  # its end moves, its beginning stays
            target[1].append((document, start + cut // _ID_BYTES, ids[cut:]))
            target[0] += n
            source[0] -= n
            if cut:
                source[1].append((document, start, ids[:cut]))
            if not source[0]:
                j -= 1
            if target[0] == self.window:
                self.emit(target[1])
                i += 1
        if i == j:
            if keep_last:
                self._put(fullest[i][0], fullest[i][1])
            else:
                self.emit(fullest[i][1])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    max_open: int = MAX_OPEN,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: its document, place there, sequence and place in the sequence.

    `with_ids` adds the piece's token ids as an array.
    """
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    extra = ", ids array<long>" if with_ids else ""
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL(_PIECES + extra)])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = text_encoder(tokenizer_path)
        rows: list[tuple] = []
        sequence = TaskContext.get().partitionId() << 32

        def emit(pieces):
            nonlocal sequence
            offset = 0
            for (name, tokens), start, ids in pieces:
                n = len(ids) // _ID_BYTES
                row = (name, start, n, zlib.crc32(ids), tokens, sequence, offset)
                rows.append((*row, np.frombuffer(ids, "<u4").tolist()) if with_ids else row)
                offset += n
            sequence += 1

        packer = Packer(window, max_open, emit)
        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6]
            for name, value in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                ids = encode(value) + end
                packer.add((name, len(ids) // _ID_BYTES), ids)
            yield _batch(rows, types, schema.names)
            rows.clear()
        if types:
            packer.close()
            yield _batch(rows, types, schema.names)

    return slim.mapInArrow(run, schema)


def _batch(rows, types, names) -> pa.RecordBatch:
    kinds = [*types, pa.list_(pa.int64())][: len(names)]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
    )

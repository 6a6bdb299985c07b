"""Token ids of texts, with the tokenizers library inside tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Bytes of pieces and ids that a worker remembers, about, in each of two
#: generations; pieces longer than that are encoded each time.
MEMORY_BYTES, LONGEST = 32 << 20, 64
#: What a remembered piece takes besides its characters and ids.
ENTRY_BYTES = 160
#: Bytes of text whose different pieces are looked up and encoded together, and rows of a batch that is given back.
TOGETHER_BYTES, ROWS = 12 << 20, 256
#: Pieces that the library gets as one text, and such texts in a call.
JOINED, CALL = 128, 64
#: A blank before another white space or the end: only there a cut at blanks is not one before a word.
_ODD_BLANK = re.compile(r" (?=\s|$)")
_CUT = re.compile(r"(?= \S)")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the library's
    plain ``encode(text, add_special_tokens=False)`` gives them.

    A byte-level tokenizer never joins across a blank that a word follows: that
    blank begins a new pre-token. So texts are cut there and at the tokenizer's
    added tokens, every different piece is encoded once by the library, and the ids
    are gathered. New pieces are encoded many in one text; as every byte is in
    exactly one token, the byte lengths of the tokens tell where a piece ends. Any
    other tokenizer encodes texts as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        self.by_pieces = (
            told.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
        #: added tokens, pieces of their own
        self.atoms = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        names = sorted(self.atoms, key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # a character of a byte-level token is a byte
        self.token_bytes = np.zeros(max([*vocabulary.values(), *(t["id"] for t in added)], default=0) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        for t in added:
            self.token_bytes[t["id"]] = len(t["content"].encode())
        self._start_anew()

    def _start_anew(self) -> None:
        """A new generation: what is still in use comes over from the older one."""
        self.older = (self.first, self.later) if hasattr(self, "first") else ({}, {})
        self.first: dict[str, bytes] = {}  # pieces that begin a text
        self.later: dict[str, bytes] = {}  # a blank and a word
        self.held = 0

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a blank and a word, so that they can stand one after the other."""
        found: list[bytes] = []
        for at in range(0, len(pieces), JOINED * CALL):
            part = pieces[at:at + JOINED * CALL]
            raw = b"".join(self._encoded(["".join(part[i:i + JOINED]) for i in range(0, len(part), JOINED)]))
            told = np.cumsum(self.token_bytes[np.frombuffer(raw, "<u4")])
            ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in part])
            cut = np.searchsorted(told, ends)
            if not told.size or cut[-1] + 1 != told.size or (told[cut] != ends).any():
                found += self._encoded(part)  # a token that is not of whole bytes
                continue
            cut = ((cut + 1) * 4).tolist()
            found += [raw[i:j] for i, j in zip([0, *cut], cut)]
        return found

    def _ids_of(self, pieces: list[str], again: list[bool], later: bool) -> list[bytes]:
        """Ids of different pieces; those that come again in the texts are remembered."""
        known, old = (self.later, self.older[1]) if later else (self.first, self.older[0])
        found = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = old.get(pieces[i])
        new = [i for i in missing if found[i] is None]
        made = (self._joined if later else self._encoded)([pieces[i] for i in new])
        for i, x in zip(new, made, strict=True):
            found[i] = x
        for i in missing:
            x = pieces[i]
            if again[i] and self.held < MEMORY_BYTES and len(x) <= LONGEST:
                known[x] = found[i]
                self.held += ENTRY_BYTES + 2 * len(x) + len(found[i])
        return found

    def _gathered(self, pieces: pa.Array, starts: np.ndarray) -> list[bytes]:
        """Ids of texts; text i has the pieces from ``starts[i]`` to ``starts[i + 1]``."""
        if self.held >= MEMORY_BYTES:
            self._start_anew()
        told = pieces.dictionary_encode()
        places, different = told.indices.to_numpy(), told.dictionary
        again = np.bincount(places, minlength=len(different)) > 1
        later = pc.starts_with(different, " ").to_numpy(zero_copy_only=False)
        found: list[bytes] = [b""] * len(different)
        different = different.to_pylist()
        for kind in (False, True):
            which = np.flatnonzero(later == kind).tolist()
            ids = self._ids_of([different[i] for i in which], again[which].tolist(), kind)
            for i, x in zip(which, ids, strict=True):
                found[i] = x
        ends = np.cumsum([0, *map(len, found)]) // 4
        table = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4")))
        size = np.diff(ends)[places]
        at = np.concatenate(([0], np.cumsum(size)))[starts].tolist()
        flat = table.take(told.indices).flatten().to_numpy()
        return [flat[i:j].tobytes() for i, j in zip(at, at[1:])]

    def _cut(self, text: str) -> list[str]:
        parts = self.cut_added(text) if self.cut_added else [text]
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else _CUT.split(part))]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text; a null text has none."""
        texts = [t or "" for t in texts]
        if not self.by_pieces:
            return self._encoded(texts)
        odd = [_ODD_BLANK.search(t) is not None or any(x in t for x in self.atoms) for t in texts]
        plain, cut = [t for t, o in zip(texts, odd) if not o], [self._cut(t) for t, o in zip(texts, odd) if o]
        ids = {}
        for kind, group in ((False, plain), (True, cut)):
            if group:
                ids[kind] = iter(self._gathered(*(_at_lists(group) if kind else _at_blanks(group))))
        return [next(ids[o]) for o in odd]

    def __call__(self, text: str | None) -> bytes:
        return self.batch([text])[0]


def _at_lists(lists: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    return pa.array([x for pieces in lists for x in pieces], pa.string()), np.cumsum([0, *map(len, lists)])


def _at_blanks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(pieces, the first piece of every text and their number) of texts cut before every blank."""
    column = pa.array(texts, pa.string())
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int32)[:len(texts) + 1]
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8)[:begins[-1]] == 32) if begins[-1] else np.empty(0, np.int64)
    starts = np.searchsorted(blanks, begins) + np.arange(begins.size)
    edges = np.empty(begins.size + blanks.size, np.int32)
    inner = np.ones(edges.size, bool)
    inner[starts] = False
    edges[starts], edges[inner] = begins, blanks
    return pa.StringArray.from_buffers(edges.size - 1, pa.py_buffer(edges), data), starts


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder per worker process, so that its memory outlives a task."""
    return Encoder(path)


_compress, _decompress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def packed(ids: np.ndarray) -> bytes:
    """Ids compressed for a written table: two bytes each where they fit."""
    wide = ids.size and int(ids.max()) > 0xFFFF
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    return (b"4" if wide else b"2") + _compress(raw)


def unpacked(data: bytes) -> np.ndarray:
    raw = _decompress(data[1:])
    return np.frombuffer(raw, "<u4" if data[:1] == b"4" else "<u2").astype("<u4")


def _by_bytes(batches) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts pass multiples of ``TOGETHER_BYTES``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        turn = np.cumsum(size, dtype=np.int64) // TOGETHER_BYTES
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if j > i:
                yield batch.slice(i, j - i)


def _encode(batches, path: str, end: int, extra) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    tail = np.array([end], "<u4").tobytes()
    for part in _by_bytes(batches):
        told = encoder.batch(part.column("text").to_pylist())
        for at in range(0, part.num_rows, ROWS):
            found = [np.frombuffer(ids + tail, "<u4") for ids in told[at:at + ROWS]]
            columns = [part.column("doc_id").slice(at, ROWS), pa.array([x.size for x in found], pa.int64()),
                       pa.array(map(packed, found), pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if extra:
                columns.append(pa.array(map(extra, found), pa.list_(pa.float32())))
                names.append("vector")
            yield pa.RecordBatch.from_arrays(columns, names)


def token_rows(docs: DataFrame, path: str, end: int, id_column: str, text_column: str, extra=None) -> DataFrame:
    """(doc_id, n_tokens, ids) per row: ids of the text and the end id, packed.
    ``extra``: a function of the ids whose list of floats becomes ``vector``."""
    schema = "doc_id long, n_tokens long, ids binary" + (", vector array<float>" if extra else "")
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    ).mapInArrow(partial(_encode, path=path, end=end, extra=extra), schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

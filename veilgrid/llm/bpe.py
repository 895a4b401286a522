"""Byte-level BPE by backtracking over longest matches.

A token sequence is what the merges produce exactly when every two adjacent tokens
could stand side by side, that is, when undoing their merges never shows a
lower-ranked merge across their border. So each piece of text is encoded by taking
the longest vocabulary match, checking it against the token before, falling back to
its next shorter prefix, and stepping back when none fits. Positions that proved
hopeless are struck out, so every position is tried a bounded number of times and
the work is linear in the piece. Matches come from an Aho-Corasick automaton over
bytes mapped to Latin-1 characters.

Inputs of the DataFrame operator: null texts count as empty and have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.common import map_texts

#: Pieces up to this many bytes are remembered; at most so many of them in a worker.
MEMO_BYTES, MEMO_PIECES, MEMO_PAIRS = 64, 500_000, 500_000


class BytePairCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = dict(sorted((i, t) for t, i in self.ranks.items()))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._pairs: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, bytes] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """For every token its next shorter prefix token and the two tokens its last merge joins."""
        for i, token in self.bytes_of.items():
            self._shorter[i] = next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), -1)
        for i, token in self.bytes_of.items():
            self._halves[i] = (i, i)
            left = self._shorter[i]
            while left != -1:
                right = self.ranks.get(token[len(self.bytes_of[left]) :])
                if right is not None and left < i and right < i and self._compatible(left, right):
                    self._pairs[left, right] = i
                    self._halves[i] = (left, right)
                    break
                left = self._shorter[left]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE may leave ``left`` and ``right`` side by side."""
        halves, pairs = self._halves, self._pairs
        below = 1 << 62
        while True:
            merged = pairs.get((left, right))
            if merged is not None and merged < below:
                return False
            # Undo the later of the two tokens' merges; a merge across the border must have been cheaper to count.
            if left > right:
                below, left = left, halves[left][1]
                if left == below:
                    below, right = right + 1, halves[right][0]
                    if right + 1 == below:
                        return True
            else:
                below, right = right + 1, halves[right][0]
                if right + 1 == below:
                    below, left = left, halves[left][1]
                    if left == below:
                        return True

    def adjacent(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._compatible(left, right)
        return known

    def forget(self) -> None:
        """Workers are used again, so a task leaves nothing behind but the vocabulary."""
        self._memo.clear()
        self._fits.clear()

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece that the merges may not leave."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # later ends are longer matches
        size_of = {}
        alive = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0] if piece else -1
        while token != -1:
            last = out[-1] if out else -1
            while True:
                n = size_of.get(token)
                if n is None:
                    n = size_of[token] = len(self.bytes_of[token])
                if alive[at + n] and (last == -1 or self.adjacent(last, token)):
                    out.append(token)
                    at += n
                    token = longest[at] if at < len(piece) else -1
                    break
                token = self._shorter[token]
                if token == -1:
                    alive[at] = 0
                    if not out:
                        raise ValueError("the vocabulary lacks a single byte")
                    token = out.pop()
                    at -= size_of[token]
                    break
        return out

    def _ids_of(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = np.array(self.encode_piece(raw), "<u4").tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self._memo) >= MEMO_PIECES:
                self._memo.clear()
            self._memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        known = self._memo.get
        return b"".join([known(p) or self._ids_of(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec(path, pattern)


def forget() -> None:
    """Let go the codecs."""
    codec.cache_clear()


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its token ids as little-endian 32-bit bytes, and their decoded bytes.

    Rows pass through one Arrow-batched map without a shuffle. Repeated rows stay
    repeated; a null text gives empty ids; other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for frame in frames:
            ids = [own.encode(t or "") for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": ids, "decoded": [own.decode(x) for x in ids]})
        own.forget()

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, schema)


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode_documents`` with each row's ids and bytes digested in the same pass."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                ids = own.encode(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out.astype({"n_tokens": "int64"})
        own.forget()

    return map_texts(docs.select("doc_id", "text"), each, schema)

"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenized once; only those longer than a sequence are cut, into whole
sequences and a rest. Pieces are dealt at random into blocks of bounded size, and
each block is a packing problem of its own that several islands, rows of their own
in any task, evolve apart. A chromosome is a set of bins: crossover injects whole
well-filled bins of one parent into the other, drops the bins that then hold a piece
twice, and puts the displaced pieces back by best fit, largest first. Generations run
on a core of a block, its badly filled bins and some others, for bins that are full
cannot gain. After each epoch every island crosses its packing with the elite of the
island before it. A block whose bins number ceil(tokens / capacity) is provably
optimal and evolves no further.

Null and empty texts are documents of one token (the end id). Repeated rows and rows
without an id are packed as often as they occur; very long texts are cut, never
dropped; columns of ``docs`` but doc_id and text are not read. An empty table gives an
empty result. No step gathers more than a block, and the counts that set the number of
blocks cover every piece.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.common import Scratch, map_texts, ship

CAPACITY, END_ID = 4096, 1
#: Pieces in a block, islands of a block, epochs between which elites migrate, generations of a core, chromosomes of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 3, 3, 40, 12
#: Cores that an island evolves in an epoch, and the pieces of one.
ROUNDS, CORE = 6, 200
#: Remembered chunks at most, the longest of them, and marks that no letter joins.
MEMO_CHUNKS, MEMO_CHARS, MARKS = 600_000, 48, '.,!?;:*%$&#"()'
#: Characters of texts that are tokenized together.
GROUP_CHARS = 1_000_000
#: Beyond these characters, lower case may change with the neighbours, or characters compose.
_NOT_PLAIN = re.compile("[\u0130\u0250-\U0010ffff]")
#: Marks that end a chunk of letters, and neighbours that may be marks of a longer run.
_ENDING = re.compile(f"(?<=[a-z])[{re.escape(MARKS)}]+(?= |$)")
_RUN = re.compile(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\xbf\xd7\xf7]{2}")


class ChunkTokenizer:
    """Ids of whole texts, by way of their chunks between ASCII blanks.

    The vocabulary's own splitting never joins text across white space, so a chunk
    has the same ids alone as in its text. Nor does it join letters with marks, and it
    ignores case: plain texts are put into lower case and runs of marks become chunks
    of their own. The unknown chunks of many texts are tokenized in one call, where
    every chunk of letters ends with its word-end token. Chunks are remembered, also
    from one task to the next, up to a bounded number; beyond it all are learned anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.limit = MEMO_CHUNKS
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of unknown chunks: those of letters at once, the others one by one."""
        letters = [c for c in chunks if c.isalpha() and (c.isascii() or not _NOT_PLAIN.search(c))]
        found = {}
        if letters:
            ids = self._ids(" ".join(letters))
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(letters):
                raw = ids.tobytes()
                found = {c: raw[4 * a : 4 * b] for c, a, b in zip(letters, [0, *ends], ends)}
        return [found[c] if c in found else self._ids(c).tobytes() for c in chunks]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        lists = [_chunks(t) for t in texts]
        known = self.known
        unknown = list(set().union(*lists).difference(known))
        known.update(zip(unknown, self._learn(unknown)))
        out = [b"".join(map(known.__getitem__, held)) for held in lists]
        for c in unknown:
            if len(c) > MEMO_CHARS:
                del known[c]
        if len(known) > self.limit:
            self.known = {"": b""}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _chunks(text: str) -> list[str]:
    """Parts of a text that are tokenized apart from each other; blanks go, plain ones are in lower case."""
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if not text.isascii() and _NOT_PLAIN.search(text):
        return [x for c in text.split(" ") for x in ([c] if _NOT_PLAIN.search(c) else _apart(c))]
    return _apart(text)


def _apart(text: str) -> list[str]:
    text = text.lower()
    if _RUN.search(text):
        text = _ENDING.sub(r" \g<0>", text)
    else:
        for mark in MARKS:
            if mark in text:
                text = text.replace(mark, f" {mark} ")
    return text.split(" ")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def forget() -> None:
    """Let go the tokenizers with the chunks that they remember."""
    tokenizer.cache_clear()


def _groups(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Texts in groups of about GROUP_CHARS characters; a longer one is a group of its own."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > GROUP_CHARS:
            yield ids[begin:k], texts[begin:k]
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, memo: int = MEMO_CHUNKS) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32. ``memo``: chunks that a Python worker remembers."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )
    end = np.array([END_ID], "<u4").tobytes()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        own.limit = memo
        for frame in frames:
            rows = []
            for docs_, texts in _groups(frame["doc_id"].tolist(), [t or "" for t in frame["text"]]):
                for doc, ids in zip(docs_, own.encode_all(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=schema.names)

    return map_texts(docs.select("doc_id", "text"), each, schema)


class Packer:
    """Grouping genetic algorithm over one block's lengths."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.bound = -(-sum(lengths) // capacity)

    def best_fit(self, items: list[int], bins: list[list[int]]) -> list[list[int]]:
        """Put items into the fullest bin that holds them, largest first; ``bins`` grows in place."""
        lengths, capacity = self.lengths, self.capacity
        by_room: dict[int, list[int]] = {}
        rooms = 0  # bit r: some bin has r tokens of room
        for b, held in enumerate(bins):
            if room := capacity - sum(lengths[i] for i in held):
                by_room.setdefault(room, []).append(b)
                rooms |= 1 << room
        for i in items:
            n = lengths[i]
            fits = rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                same = by_room[room]
                b = same.pop()
                if not same:
                    rooms &= ~(1 << room)
                bins[b].append(i)
            else:
                room, b = capacity, len(bins)
                bins.append([i])
            if left := room - n:
                by_room.setdefault(left, []).append(b)
                rooms |= 1 << left
        return bins

    def decreasing(self, items: list[int], noise: float = 0.0) -> list[int]:
        key = (lambda i: -self.lengths[i] * (1 + noise * self.random.random())) if noise else (lambda i: -self.lengths[i])
        return sorted(items, key=key)

    def fitness(self, bins: list[list[int]]) -> tuple[int, int]:
        """Fewer bins first, then uneven filling, which leaves room that can be emptied."""
        fills = [sum(self.lengths[i] for i in b) for b in bins]
        return len(bins), -sum(f * f for f in fills)

    def crossover(self, host: list[list[int]], donor: list[list[int]]) -> list[list[int]]:
        filled = sorted(donor, key=lambda b: -sum(self.lengths[i] for i in b))
        filled = filled[: max(1, 2 * len(filled) // 3)]
        injected = self.random.sample(filled, max(1, len(filled) // 2))
        inside = {i for b in injected for i in b}
        kept, displaced = [list(b) for b in injected], []
        for b in host:
            if inside.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in inside]
        return self.mutate(kept, displaced)

    def mutate(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Empty the two least filled bins as well, then put everything loose back."""
        bins.sort(key=lambda b: -sum(self.lengths[i] for i in b))
        while len(bins) > 1 and len(loose) < len(self.lengths) and self.random.random() < 0.67:
            loose = loose + bins.pop()
            if len(loose) > 64 and self.random.random() < 0.5:
                break
        return self.best_fit(self.decreasing(loose, self.random.choice((0.0, 0.0, 0.02))), bins)

    def _generations(self, bins: list[list[int]], generations: int, population: int) -> list[list[int]]:
        """The best chromosome after some generations over the pieces of ``bins``, itself one of the first."""
        everyone = [i for b in bins for i in b]
        bound = -(-sum(self.lengths[i] for i in everyone) // self.capacity)
        people = [bins] + [self.best_fit(self.decreasing(everyone, 0.3 * self.random.random()), []) for _ in range(population - 1)]
        people.sort(key=self.fitness)
        for _ in range(generations):
            if len(people[0]) <= bound:
                break
            for _ in range(population // 2):
                a, b = self.random.sample(range(len(people)), 2)
                people.append(self.crossover(people[min(a, b)], people[max(a, b)]))
            people = sorted(people, key=self.fitness)[:population]
        return people[0]

    def _core(self, bins: list[list[int]], size: int) -> tuple[list[list[int]], list[list[int]]]:
        """Bins to work on and the rest: the least filled ones, and as many others by chance."""
        order = sorted(bins, key=lambda b: sum(self.lengths[i] for i in b))
        half, n = len(order), 0
        for k, b in enumerate(order):
            n += len(b)
            if n > size // 2:
                half = k + 1
                break
        others = order[half:]
        self.random.shuffle(others)
        core, n = order[:half], 0
        while others and n < size // 2:
            n += len(others[-1])
            core.append(others.pop())
        return core, others

    def evolve(self, elites: list[list[list[int]]], generations: int, population: int, rounds: int = ROUNDS, core: int = CORE) -> list[list[int]]:
        """The best packing found from ``elites``, or from best fit where there are none.

        Whole packings cross ``population`` times; then every round evolves a core of ``core`` pieces, mostly
        of badly filled bins, while the well-filled rest stays as it is.
        """
        everyone = list(range(len(self.lengths)))
        people = elites or [self.best_fit(self.decreasing(everyone), [])]
        people += [self.crossover(x, y) for x in people for y in people if x is not y for _ in range(population)]
        best = min(people, key=self.fitness)
        for _ in range(rounds):
            if len(best) <= self.bound:
                break
            part, rest = self._core(best, core)
            best = min(best, rest + self._generations(part, generations, population), key=self.fitness)
        return best


def _bins(solution, n: int) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i in range(n):
        bins.setdefault(int(solution[i]), []).append(i)
    return list(bins.values())


def _evolve(blocks: DataFrame, capacity: int, generations: int, population: int) -> DataFrame:
    """Rows (block, island, lengths, elites) -> (block, island, lengths, solution, n_bins, optimal)."""
    schema = "block long, island int, lengths array<int>, solution array<int>, n_bins int, optimal boolean"

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                lengths = [int(x) for x in row.lengths]
                packer = Packer(lengths, capacity, hash((int(row.block), int(row.island), int(row.epoch))))
                best = packer.evolve([_bins(x, len(lengths)) for x in row.elites], generations, population)
                solution = np.zeros(len(lengths), "int32")
                for b, held in enumerate(best):
                    solution[held] = b
                yield pd.DataFrame({"block": [row.block], "island": [row.island], "lengths": [np.array(lengths, "int32")], "solution": [solution], "n_bins": [len(best)], "optimal": [len(best) == packer.bound]}).astype({"island": "int32", "n_bins": "int32"})

    return blocks.mapInPandas(each, schema)


def pack(
    spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION
) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``, which replace columns of these names.

    ``pieces`` need a ``length``; all other columns come along, whatever their names.
    """
    ship(spark)
    scratch = Scratch(spark, "packing")
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    held = scratch.keep(pieces.select(F.monotonically_increasing_id().alias("uid"), F.col("length").cast("long").alias("size"), F.struct(*columns).alias("row")))
    loose = held.filter(F.col("size") < capacity)
    n_blocks = max(1, -(-loose.count() // block))
    blocks = scratch.keep(
        loose.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("uid", "size"))).alias("items"))
    )
    none = F.array().cast("array<array<int>>")
    state = (
        blocks.select("block", F.col("items.size").cast("array<int>").alias("lengths"))
        .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        .select("block", "island", "lengths", none.alias("elites"), F.lit(0).alias("epoch"))
    )
    best = scratch.keep(_evolve(state, capacity, generations, population))
    for epoch in range(1, epochs):
        open_ = best.groupBy("block").agg(F.bool_or("optimal").alias("done")).filter(~F.col("done")).select("block")
        open_ = scratch.keep(best.join(open_, "block"))
        if open_.isEmpty():
            break
        guests = open_.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("solution").alias("guest"))
        moved = open_.join(guests, ["block", "island"]).select("block", "island", "lengths", F.array("solution", "guest").alias("elites"), F.lit(epoch).alias("epoch"))
        evolved = _evolve(moved, capacity, generations, population)
        best = scratch.keep(best.join(open_.select("block").distinct(), "block", "left_anti").unionByName(evolved))
    chosen = best.groupBy("block").agg(F.min_by("solution", F.struct("n_bins", "island")).alias("solution"))
    width = 1 << 20  # more bins than any block has pieces
    placed = (
        blocks.join(chosen, "block")
        .select("block", F.inline(F.arrays_zip("items", F.col("solution").alias("bin"))))
        .select((F.col("block") * width + F.col("bin")).alias("sequence_id"), "items.*")
    )
    before = "sum(size) OVER (PARTITION BY sequence_id ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = placed.select("uid", "sequence_id", F.coalesce(F.expr(before), F.lit(0)).cast("long").alias("offset"))
    whole = held.filter(F.col("size") >= capacity).select("row", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    found = loose.join(placed, "uid").select("row", "sequence_id", "offset").unionByName(whole)
    return found.select("row.*", "sequence_id", "offset")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, memo: int = MEMO_CHUNKS, **options) -> DataFrame:
    """Tokenize and pack whole documents."""
    return pack(spark, token_pieces(docs, path, capacity, memo), capacity, **options)

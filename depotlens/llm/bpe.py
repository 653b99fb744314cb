"""Byte-level BPE: encoding by ranks and decoding, as the rank file's own library does.

Tasks cut the texts of a block into the pattern's matches and number the distinct ones; Spark's higher-order
functions then fold the ranked merges over the bytes of each distinct word of the block (a character stands for a
byte or piece, ordered by rank), looking pairs up in a literal map (pairs of single bytes come with the word, from a
table); tasks put the words' ids back in the places of the texts.  Nothing is shuffled.  Words over ``Settings.fold_bytes`` (rare: the fold's work grows with the square of the
length) are merged with a heap instead, to the same ids.

Defined cases: NULL text counts as empty and has no tokens; rows are never joined, so repeated and NULL ids keep
their rows; an id outside the vocabulary can't be decoded and raises.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.text import give_back, given_back, only, slices, texts_of

LOOKUP_BUCKETS = 1 << 17


@dataclass(frozen=True)
class Settings:
    block_bytes: int = 40_000_000  # text whose distinct words are merged together
    fold_bytes: int = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks from a file of base64 pieces, one a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def compiled(pattern: str):
    """The pattern with Unicode's own blanks: ``\\s`` of the regex module has four control characters more."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def sign(rank: int) -> str:
    """The character that stands for a rank; their order is that of the ranks."""
    return chr(rank + 0x100 if rank + 0x100 < 0xD800 else rank + 0x900)


def ranks_of(signs: str) -> np.ndarray:
    code = np.frombuffer(signs.encode("utf-32-le"), np.uint32).astype(np.int32)
    return code - np.where(code < 0xD800, 0x100, 0x900).astype(np.int32)


# After all signs in order (those of a million ranks): no merge.
END = "\U0010ffff"


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The rank of each pair of pieces that make a piece, as a literal: END and lists of (END, pair, piece) in buckets by crc32.

    A map alone would be searched from end to end.
    """
    buckets = [END] * LOOKUP_BUCKETS  # what a pair finds that is in none
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pair = sign(a) + sign(b)
                buckets[zlib.crc32(pair.encode()) % LOOKUP_BUCKETS] += END + pair + sign(rank)
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"), ensure_ascii=False)), "array<string>")


def folded(word: Column, pairs: Column, ranks: Column) -> Column:
    """Signs of a word's pieces, from those of its bytes and what each pair of neighbours merges to (END: to none).

    The leftmost pair of least rank is merged until no pair has a rank.  A word without pairs is merged already.
    """

    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def merge(pair: Column) -> Column:
        """The sign that the pair merges to; END if it merges to none."""
        bucket = F.get(ranks, (F.crc32(pair.cast("binary")) % LOOKUP_BUCKETS).cast("int"))
        return F.substring(F.call_function("substring_index", bucket, F.concat(F.lit(END), pair), F.lit(-1)), 1, 1)

    def part(text: Column, first: Column, n: Column) -> Column:
        return F.substring(text, first, n)

    def step(state: Column, _: Column) -> Column:
        s, r = state["s"], state["r"]

        def merged(least: Column, at: Column) -> Column:
            before = F.when(at > 1, merge(F.concat(part(s, at - 1, F.lit(1)), least))).otherwise(F.lit(""))
            after = F.when(at < F.length(r), merge(F.concat(least, part(s, at + 2, F.lit(1))))).otherwise(F.lit(""))
            rest = F.length(s)
            return F.struct(
                F.concat(part(s, F.lit(1), at - 1), least, part(s, at + 2, rest)).alias("s"),
                F.concat(part(r, F.lit(1), at - 2), before, after, part(r, at + 2, rest)).alias("r"))

        def placed(least: Column) -> Column:
            done = F.struct(s.alias("s"), F.lit("").alias("r"))
            return F.when(least == END, done).otherwise(let(F.call_function("locate", least, r), lambda at: merged(least, at)))

        return F.when(r == "", state).otherwise(let(F.array_min(F.split(r, "")), placed))

    first = F.struct(word.alias("s"), pairs.alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step, lambda state: state["s"])


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps: a heap of pairs over a linked list."""
    pieces = [word[i:i + 1] for i in range(len(word))]
    after = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(pieces)
        if i >= 0 and j < len(pieces) and (rank := ranks.get(pieces[i] + pieces[j])) is not None:
            heapq.heappush(heap, (rank, i, len(pieces[i]), len(pieces[j])))

    for i in range(len(pieces)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if len(pieces[i]) != a or j >= len(pieces) or len(pieces[j]) != b:
            continue  # one side has grown or gone meanwhile
        pieces[i] += pieces[j]
        pieces[j] = b""
        after[i] = after[j]
        if after[j] < len(pieces):
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[p] for p in pieces if p]


def as_binary(values: array | np.ndarray) -> pa.Array:
    """One cell that holds the array's bytes, not copied."""
    data = pa.py_buffer(values)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(array("i", [0, data.size])), data])


def strings_of(codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of ``sizes`` characters each, from the code points of all of them."""
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def byte_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each byte's sign and of the sign that each pair of bytes merges to."""
    of_byte, of_pair = np.arange(256, dtype=np.uint32), np.full((256, 256), ord(END), np.uint32)
    for piece, rank in ranks.items():
        if len(piece) == 1:
            of_byte[piece[0]] = ord(sign(rank))
        elif len(piece) == 2 and piece[:1] in ranks and piece[1:] in ranks:
            of_pair[piece[0], piece[1]] = ord(sign(rank))
    return of_byte, of_pair


def numbered(found: Iterator[list[str]], most: int = 1 << 18) -> tuple[pa.Array, np.ndarray, array]:
    """Distinct words of the lists, the words' numbers in order and each list's length; ``most`` words or so are held as text of Python's."""
    parts, some, counts = [], [], array("q")
    for words in found:
        counts.append(len(words))
        some += words
        if len(some) >= most:
            parts.append(pa.array(some, pa.string()))
            some = []
    coded = pa.chunked_array([*parts, pa.array(some, pa.string())]).dictionary_encode().combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(), counts


def blocks(docs: DataFrame, ranks: dict[bytes, int], pattern: str, s: Settings) -> DataFrame:
    """One row of each block: the ids of its rows, its distinct words as signs of their bytes and of the bytes' pairs, the words' numbers in order and each text's count."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        cut, (of_byte, of_pair) = compiled(pattern), byte_tables(ranks)

        def signs(words: list[bytes]) -> tuple[pa.Array, pa.Array]:
            """Signs of the words' bytes, and of their pairs."""
            flat = np.frombuffer(b"".join(words), np.uint8)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            inside = np.ones(max(len(flat) - 1, 0), bool)
            inside[np.cumsum(sizes)[:-1] - 1] = False
            return strings_of(of_byte[flat], sizes), strings_of(of_pair[flat[:-1], flat[1:]][inside], sizes - 1)

        def block(part: pa.RecordBatch) -> pa.RecordBatch:
            words, places, counts = numbered(cut.findall(text.as_py()) for text in texts_of(part))
            words = [w.encode() for w in words.to_pylist()]
            whole = np.fromiter((w in ranks or len(w) > s.fold_bytes for w in words), bool, len(words))
            order = np.argsort(whole, kind="stable")  # words that are merged already come last
            place_of = np.empty(len(words), np.int32)
            place_of[order] = np.arange(len(words), dtype=np.int32)
            places = place_of[places]
            n = len(words) - int(whole.sum())
            # Some thousand words at a time: code points take many times a word's bytes.
            made = [signs([words[k] for k in order[a:min(a + 20_000, n)]]) for a in range(0, n, 20_000)]
            merged = ["".join(map(sign, [ranks[w]] if w in ranks else merged_by_heap(w, ranks))) for w in map(words.__getitem__, order[n:])]
            cells = zip(*made, (pa.array(merged, pa.string()), pa.array([""] * len(merged), pa.string())), strict=True)
            own = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.concat_arrays(c)) for c in cells]
            return pa.RecordBatch.from_arrays([own, *lists, as_binary(places), as_binary(counts)], ["id", "words", "pairs", "places", "counts"])

        for batch in batches:
            for part in slices(batch, most=s.block_bytes):
                made = block(part)
                give_back()  # what numbering took isn't held while the words are merged
                yield made

    return docs.mapInArrow(lambda b: given_back(run(b)), f"id array<{kind}>, words array<string>, pairs array<string>, places binary, counts binary")


def encoded_blocks(docs: DataFrame, ranks: dict[bytes, int], pattern: str, s: Settings) -> DataFrame:
    """The blocks with their words merged."""
    merged = F.transform(F.array(rank_map(ranks)), lambda map_: F.zip_with("words", "pairs", lambda w, p: folded(w, p, map_)))
    return blocks(docs, ranks, pattern, s).withColumn("words", F.get(merged, F.lit(0))).drop("pairs")


class MergedBlock:
    """A block whose words are merged: the token ids of its distinct words, and the words of its texts."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        words = batch.column("words")[k].values
        self.sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        self.flat = ranks_of("".join(words.to_pylist()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places = np.frombuffer(batch.column("places")[k].as_buffer(), np.int32)
        self.counts = np.frombuffer(batch.column("counts")[k].as_buffer(), np.int64)
        self.ends, self.ids = np.cumsum(self.counts), batch.column("id")[k].values

    def slices(self, most: int = 1000) -> Iterator[tuple[int, pa.Array]]:
        """The rows' ids, ``most`` rows at a time, and where they begin."""
        for a in range(0, len(self.counts), most):
            yield a, self.ids.slice(a, most)

    def words_of(self, a: int, n: int) -> Iterator[np.ndarray]:
        """Numbers of the words of each of n rows."""
        for end, count in zip(self.ends[a:a + n], self.counts[a:a + n], strict=True):
            yield self.places[end - count:end]

    def ids_of(self, a: int, n: int) -> list[np.ndarray]:
        """Token ids of each of n rows."""
        rows = []
        for own in self.words_of(a, n):
            size = self.sizes[own]
            total = int(size.sum())
            rows.append(self.flat[np.repeat(self.starts[own] - (np.cumsum(size) - size), size) + np.arange(total)] if total else np.zeros(0, np.int32))
        return rows


def merged_blocks(batch: pa.RecordBatch) -> Iterator[MergedBlock]:
    for k in range(batch.num_rows):
        yield MergedBlock(batch, k)


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """(``id_column``, ids array<int>) of every row."""

    def run(batches):
        for batch in batches:
            for block in merged_blocks(batch):
                for a, own in block.slices():
                    yield pa.RecordBatch.from_arrays([own, pa.array(block.ids_of(a, len(own)), pa.list_(pa.int32()))], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return encoded_blocks(only(docs, id=id_column, text="text"), ranks, pattern, s).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def joined_pieces(ids, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids))


def decoded(tokens: DataFrame, ranks: dict[bytes, int], column: str = "ids", to: str = "bytes") -> DataFrame:
    """The rows with ``to``: the pieces of the ids, joined; NULL ids give NULL."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    own = tokens.drop(to)

    def run(batches):
        for batch in batches:
            made = [None if ids is None else joined_pieces(ids, pieces) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, to])

    from pyspark.sql.types import BinaryType, StructField, StructType
    return own.mapInArrow(run, StructType([*own.schema.fields, StructField(to, BinaryType())]))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, s: Settings = Settings(), keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, n_bytes, decoded_sha256[, ids]) of every row: ids and their decoding, each as a digest."""
    size = max(ranks.values(), default=-1) + 1

    def run(batches):
        pieces, written = [b""] * size, [f" {i}" for i in range(size)]
        for piece, rank in ranks.items():
            pieces[rank] = piece
        for batch in batches:
            for block in merged_blocks(batch):
                # Written and decoded once for a distinct word, and joined in the order of the text.
                own = [block.flat[a:b].tolist() for a, b in zip(block.starts, block.starts + block.sizes, strict=True)]
                texts, backs = ["".join(map(written.__getitem__, ids)) for ids in own], [joined_pieces(ids, pieces) for ids in own]
                del own
                for a, ids in block.slices():
                    out = []
                    for at in block.words_of(a, len(ids)):
                        places = at.tolist()
                        back = b"".join(map(backs.__getitem__, places))
                        ids_text = "".join(map(texts.__getitem__, places))[1:].encode()
                        out.append((int(block.sizes[at].sum()), hashlib.sha256(ids_text).hexdigest(), len(back), hashlib.sha256(back).hexdigest()))
                    n, first, size_, second = zip(*out, strict=True)
                    kept = [pa.array(block.ids_of(a, len(ids)), pa.list_(pa.int32()))] if keep_ids else []
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(n, pa.int64()), pa.array(first), pa.array(size_, pa.int64()), pa.array(second), *kept],
                        ["doc_id", "n_tokens", "ids_sha256", "n_bytes", "decoded_sha256", "ids"][:5 + keep_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return encoded_blocks(only(docs, id="doc_id", text="text"), ranks, pattern, s).mapInArrow(
        lambda b: given_back(run(b)), f"doc_id {kind}, n_tokens long, ids_sha256 string, n_bytes long, decoded_sha256 string" + ", ids array<int>" * keep_ids)

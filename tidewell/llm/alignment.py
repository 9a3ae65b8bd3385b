"""Alignment of two tokenizations of the same text by diagonal run skipping.

Both token sequences become arrays of byte offsets where tokens end. The aligner stands at a pair of tokens that start
together and keeps the shift between their indices. It compares stretches of both arrays at that shift, twice as long
each time, and so jumps over tokens that match one to one; when a stretch differs it halves back to the first
difference. The irregular group there is resolved locally, token by token up to the next common end, and the shift is
updated.

Links are all pairs of tokens whose byte ranges overlap. Their corpus-wide counts come from one row per chunk of texts:
the chunk's distinct pairs with their counts, and each link as a number into them, compressed. Counts are added up in
Spark, joined back to the chunks, and resolved there; texts are encoded once, and nothing is gathered beyond a chunk.

Defined cases. Null and empty texts, and texts whose joined tokens differ from a space and the text in either
tokenizer, have no tokens: all numbers are zero and the digest is empty. Special-token strings are plain text. Rows that
repeat an id are rows of their own. Empty input gives no rows. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import SLICE, per_batch, staged
from tidewell.llm.tokens import Encoder

#: Code points of text after which a chunk ends; with 1,024 texts it ends as well.
CHUNK_SIZE = 4 << 20


# --- tokenizers ---------------------------------------------------------------------------------
class ByteTokens:
    """Byte-level BPE file of the tokenizers library over a space and the text."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path, spaced=True)
        self.encoder.tokenizer.encode_special_tokens = True
        # the printable stand-ins of byte-level vocabularies: visible Latin-1 as itself, the rest from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(map(stand_in.__getitem__, token)) if all(c in stand_in for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode([f" {t}" for t in texts])


class PieceTokens:
    """SentencePiece model, which adds the leading space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in enumerate(self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


class Aligner:
    """Both tokenizers of one worker, with tables of token bytes, lengths and decimal numbers."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.sides = ByteTokens(byte_path), PieceTokens(piece_path)
        self.lengths = [np.array([len(b) for b in side.bytes], np.int64) for side in self.sides]
        # as arrays of objects: whole texts are looked up at once
        self.pieces = [_objects(side.bytes) for side in self.sides]
        self.top = max(len(side.bytes) for side in self.sides)
        # decimal numbers of tokens within a group, then of those that begin one side of it
        self.numbers = [_objects([f"{mark}{k}" for mark in marks for k in range(self.top)]) for marks in (",;", ",|")]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides, None for texts without tokens."""
        at = [k for k, t in enumerate(texts) if t]
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        some = [texts[k] for k in at]
        for k, text, *pair in zip(at, some, *(side.encode(some) for side in self.sides), strict=True):
            whole = b" " + text.encode()
            if all(b"".join(pieces[ids].tolist()) == whole for pieces, ids in zip(self.pieces, pair, strict=True)):
                out[k] = tuple(pair)
        return out

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        return np.cumsum(self.lengths[0][a]).tolist(), np.cumsum(self.lengths[1][b]).tolist()


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


@cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per Python worker and pair of files."""
    return Aligner(byte_path, piece_path)


# --- one text -----------------------------------------------------------------------------------
def skip_run(ends_a: list[int], ends_b: list[int], i: int, j: int) -> int:
    """How many tokens match one to one from (i, j) on, both of which start at the same byte."""
    done, step = 0, 1
    while (x := ends_a[i + done : i + done + step]) and x == ends_b[j + done : j + done + step]:
        done += len(x)
        step *= 2
    while step > 1:  # the next difference lies within the last stretch
        step //= 2
        x = ends_a[i + done : i + done + step]
        if x and x == ends_b[j + done : j + done + step]:
            done += len(x)
    return done


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[int], list[int]]:
    """Runs (i, j, length) and irregular groups (i, i end, j, j end) in turn, and the links (i, j) of the irregular ones.

    A run may be empty; one run comes before each irregular group and one after the last.
    """
    runs, groups, link_a, link_b = [], [], [], []
    i = j = 0
    n = len(ends_a)
    while True:
        done = skip_run(ends_a, ends_b, i, j)
        runs.append((i, j, done))
        i, j = i + done, j + done
        if i >= n:
            return runs, groups, link_a, link_b
        p, q = i, j
        x, y = ends_a[p], ends_b[q]
        while True:
            link_a.append(p)
            link_b.append(q)
            if x < y:
                p += 1
                x = ends_a[p]
            elif y < x:
                q += 1
                y = ends_b[q]
            else:
                break
        groups.append((i, p + 1, j, q + 1))
        i, j = p + 1, q + 1


def groups_of(a: list[int], b: list[int], ends: tuple[list[int], list[int]]) -> list[tuple[list[int], list[int]]]:
    """Ids of both sides, group by group."""
    runs, groups, *_ = align(*ends)
    out = []
    for k, (i, j, n) in enumerate(runs):
        out += [([a[i + x]], [b[j + x]]) for x in range(n)]
        if k < len(groups):
            p, p_end, q, q_end = groups[k]
            out.append((a[p:p_end], b[q:q_end]))
    return out


def _digest(tool: Aligner, a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> str:
    """Digest of the groups as text, given where each begins on both sides (in any order)."""
    begins_a, begins_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    begins_a[starts_a], begins_b[starts_b] = True, True
    edges_a, edges_b = np.append(np.flatnonzero(begins_a), len(a)), np.flatnonzero(begins_b)
    # a token of a lies behind the b side of all groups before its own, a token of b behind its own group's a side too
    parts = np.empty(len(a) + len(b), object)
    parts[np.arange(len(a)) + edges_b[np.cumsum(begins_a) - 1]] = tool.numbers[0][a + tool.top * begins_a]
    parts[np.arange(len(b)) + edges_a[np.cumsum(begins_b)]] = tool.numbers[1][b + tool.top * begins_b]
    return hashlib.sha256("".join(parts.tolist())[1:].encode()).hexdigest()


# --- the corpus ---------------------------------------------------------------------------------
_CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
)
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, compressed; small numbers leave empty planes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = flat.reshape(4, len(flat) // 4)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _chunk(tool: Aligner, chunk: int, ids: list, texts: list[str | None]) -> dict:
    """One row for some texts."""
    row: dict[str, list] = {c: [0] * len(ids) for c in _COUNTS} | {"groups_sha256": [""] * len(ids)}
    found = []
    for k, pair in enumerate(tool.tokens(texts)):
        if pair is None:
            continue
        a, b = pair
        runs, groups, link_a, link_b = align(*tool.ends(a, b))
        first = np.array(runs, np.int64)
        first = first[first[:, 2] > 0]
        length = first[:, 2]
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        run_a, run_b = np.repeat(first[:, 0], length) + within, np.repeat(first[:, 1], length) + within
        at_a, at_b = np.concatenate([run_a, np.array(link_a, np.int64)]), np.concatenate([run_b, np.array(link_b, np.int64)])
        heads = np.array(groups, np.int64).reshape(-1, 4)
        row["groups_sha256"][k] = _digest(
            tool, a, b, np.concatenate([run_a, heads[:, 0]]), np.concatenate([run_b, heads[:, 2]])
        )
        row["n_a"][k], row["n_b"][k] = len(a), len(b)
        row["n_groups"][k], row["n_links"][k] = int(length.sum()) + len(groups), len(at_a)
        found.append((a[at_a].astype(np.int64) << 32) | b[at_b])
    codes = np.concatenate(found) if found else np.empty(0, np.int64)
    pairs, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    common = np.argsort(-n, kind="stable")  # frequent pairs get small numbers
    number = np.empty(len(pairs), np.int64)
    number[common] = np.arange(len(pairs))
    return row | {
        "chunk": chunk, "doc_id": ids, "links": _packed(number[at]),
        "pair_a": (pairs[common] >> 32).astype(np.int32), "pair_b": (pairs[common] & 0xFFFFFFFF).astype(np.int32), "pair_n": n[common],
    }


def align_chunks(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: numbers of its texts, their links, and the distinct linked id pairs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(_CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            made = _chunk(tool, number, ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in out], schema=out)

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(value)
                size += len(value or "")
                if size >= CHUNK_SIZE or len(ids) >= SLICE:
                    yield flushed()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield flushed()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _CHUNK)


def count_pairs(chunks: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each id pair in the corpus, and whether no other pair of that b has more."""
    counts = _pair_rows(chunks).groupBy("a", "b").agg(F.sum("n").alias("n"))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _pair_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("k", "p")).select(
        "chunk", "k", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n")
    )


def align_corpus(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks = staged(align_chunks(docs, byte_path, piece_path, doc_id, text), "aligned")
    counts = staged(count_pairs(chunks.select("chunk", "pair_a", "pair_b", "pair_n")), "link-counts")
    known = (
        _pair_rows(chunks).drop("n").join(counts, ["a", "b"])
        .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("k", "n", "best"))).alias("known"))
        .select("chunk", F.col("known.n").alias("pair_count"), F.col("known.best").alias("pair_best"))
    )

    def work(columns: dict[str, pa.Array]) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")}
        for k in range(len(columns["chunk"])):
            numbers = _unpacked(columns["links"][k].as_py())
            n_links = columns["n_links"][k].values.to_numpy()
            edges = np.concatenate([[0], np.cumsum(n_links)])
            for name, kind in (("n_best", "pair_best"), ("count_sum", "pair_count")):
                values = columns[kind][k].values
                table = np.asarray(values.to_numpy(zero_copy_only=False), np.int64) if values is not None else np.zeros(1, np.int64)
                running = np.concatenate([[0], np.cumsum(table[numbers])])
                out[name].append(running[edges[1:]] - running[edges[:-1]])
            for name in ("doc_id", *_COUNTS, "groups_sha256"):
                out[name].append(columns[name][k].values)
        return {
            name: np.concatenate(v) if isinstance(v[0], np.ndarray) else pa.concat_arrays(v) for name, v in out.items()
        }

    rows = chunks.drop("pair_a", "pair_b", "pair_n").join(known, "chunk", "left")
    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return per_batch(rows, work, schema)


def align_groups(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ``groups``, the ids of both sides group by group."""

    def work(columns: dict[str, pa.Array]) -> dict:
        tool = aligner(byte_path, piece_path)
        out = []
        for pair in tool.tokens(columns["text"].to_pylist()):
            found = groups_of(*(ids.tolist() for ids in pair), tool.ends(*pair)) if pair else []
            out.append([{"a": a, "b": b} for a, b in found])
        return {"doc_id": columns["doc_id"], "groups": out}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(rows, work, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")

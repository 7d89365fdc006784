"""Byte-level BPE by backtracking from longest matches, and decoding.

Bytes become Latin-1 characters, so that pyahocorasick finds every token inside
a pre-token in one pass. From the longest match at each place the encoder walks
on while neighbouring tokens are compatible (their bytes together would encode
to just them), takes shorter matches where they aren't, and never visits a dead
end twice. That reproduces the merges exactly, in time linear in the bytes.

Defined results: null and empty texts have no ids (the hash of nothing);
repeated rows and null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import texts_of
from .pretokens import Encoder
from .ragged import take_runs
from .scratch import ship

ENDLESS = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Tokens of a rank file with what the backtracking needs of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = {token.decode("latin-1"): r for token, r in ranks.items()}
        self.token = {r: t for t, r in self.rank.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.match = ahocorasick.Automaton()
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        usable = set()
        for token, r in sorted(self.rank.items(), key=lambda x: len(x[0])):
            if len(token) > 1:
                parts = self._merged(token, r)
                if len(parts) != 2:
                    continue  # merges never produce it
                self.halves[r] = (self.rank[parts[0]], self.rank[parts[1]])
            usable.add(token)
            self.match.add_word(token, (r, len(token)))
            self.shorter[r] = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), None)
        self.match.make_automaton()
        self.usable = usable

    def _merged(self, token: str, below: int) -> list[str]:
        """The parts that merges of a rank under ``below`` leave."""
        parts = list(token)
        while len(parts) > 2:
            found = [(self.rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            r, i = min(found)
            if r >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both together encode to (left, right)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later merge at either side of the border, back to bytes. The
        # two neighbours at each time must not merge before they are consumed;
        # at equal rank, the merge further left goes first.
        before = ENDLESS
        while True:
            r = self.rank.get(self.token[left] + self.token[right])
            if r is not None and r < before:
                return False
            a = left if left in self.halves else -1
            b = right if right in self.halves else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.halves[a][1]
            else:
                before, right = b + 1, self.halves[b][0]

    def encode(self, raw: bytes) -> list[int]:
        text = raw.decode("latin-1")
        if text in self.usable:
            return [self.rank[text]]
        n = len(text)
        longest: list[tuple[int, int]] = [(0, 0)] * n
        for end, (r, size) in self.match.iter(text):
            at = end - size + 1
            if size > longest[at][1]:
                longest[at] = (r, size)
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, r = 0, longest[0][0] if n else None
        while at < n:
            if r is None:  # nothing fits here: take back the last token and shorten it
                alive[at] = 0
                r = out.pop()
                at -= len(self.token[r])
            elif alive[at + len(self.token[r])] and (not out or self.compatible(out[-1], r)):
                out.append(r)
                at += len(self.token[r])
                r = longest[at][0] if at < n else None
                continue
            r = self.shorter[r]
        return out


def rank_encoder(path: str) -> tuple[Encoder, Merges]:
    merges = Merges(read_ranks(path))
    return Encoder(lambda tokens: [merges.encode(t.encode()) for t in tokens]), merges


def pool_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size


def spelled(ids: np.ndarray, edge: np.ndarray, pool: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[memoryview, np.ndarray]:
    """The pieces of ids, joined, and where each text's begin and end."""
    raw, first, size = pool
    long = size[ids]
    ends = np.concatenate([[0], np.cumsum(long)])
    return memoryview(take_runs(raw, first[ids], long)), ends[edge]


def encode_and_decode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of their decoded bytes."""

    def run(batches):
        encoder, merges = rank_encoder(ranks)
        size = max(merges.token) + 1
        numbers = pool_of([b"%d " % i for i in range(size)])
        tokens = pool_of([merges.token.get(i, "").encode("latin-1") for i in range(size)])
        for batch in batches:
            counts, id_sums, byte_sums = [], [], []
            for ids, edge in encoder.encode(texts_of(batch)):
                counts += np.diff(edge).tolist()
                for pool, drop, sums in ((numbers, 1, id_sums), (tokens, 0, byte_sums)):
                    raw, ends = spelled(ids, edge, pool)
                    at = ends.tolist()
                    sums += [hashlib.sha256(raw[a : max(a, b - drop)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(byte_sums, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Problem 8: exact byte-pair encoding in linear time by backtracking.

An Aho-Corasick automaton over the vocabulary gives every token that occurs in
a stretch of text. From the left the longest token is taken; it must be
compatible with the one before it, that is, byte-pair merging of the two
together must give just these two. If it isn't, the next shorter token at that
place is tried, and if none is left the token before is taken back. Places found
to be dead ends are remembered, so each is entered once.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits a text before the merges of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Stretches kept with their ids in each worker; only saves time.
REMEMBERED = 100_000


class BytePairEncoder:
    """Encoder and decoder of a rank vocabulary, the bytes of a `.tiktoken` file."""

    def __init__(self, ranks: bytes):
        self.bytes = {}
        for line in ranks.split(b"\n"):
            if line.strip():
                token, rank = line.split()
                self.bytes[int(rank)] = base64.b64decode(token)
        self.rank = {t: r for r, t in self.bytes.items()}
        self.longest = max(map(len, self.rank))
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}
        # Decoding: token r is blob[start[r] : start[r + 1]].
        top = max(self.bytes) + 1
        sizes = [len(self.bytes.get(r, b"")) for r in range(top)]
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.blob = b"".join(self.bytes.get(r, b"") for r in range(top))

    def merged(self, data: bytes, below: int) -> list[bytes]:
        """Byte-pair merging with the merges of rank less than `below`, for single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for one that is no merge."""
        if token not in self.halves:
            parts = self.merged(self.bytes[token], token)
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether byte-pair merging of both together leaves exactly the two.

        The right edge of `left` grows by merges at certain ranks, as does the
        left edge of `right`. A merge across the border happens if an edge pair
        is itself a token whose rank comes before both edges grow further.
        """
        got = self.fits.get((left, right))
        if got is not None:
            return got
        rs, ls = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        ok = True
        while True:
            (a, a_until), (b, b_until) = rs[i], ls[j]
            cross = self.rank.get(self.bytes[a] + self.bytes[b])
            # At equal rank the leftmost merge goes first: the growth of the left side, then the border.
            if cross is not None and cross < a_until and cross <= b_until:
                ok = False
                break
            if i == len(rs) - 1 and j == len(ls) - 1:
                break
            if a_until <= b_until:
                i += 1
            else:
                j += 1
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    @lru_cache(maxsize=200_000)  # noqa: B019 - one encoder a worker
    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one edge from the single byte up to `token`, each with the rank at which it grows."""
        chain = [(token, float("inf"))]
        while (h := self.half(chain[-1][0])) is not None:
            chain.append((h[side], chain[-1][0]))
        return chain[::-1]

    def encode_stretch(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None and self.half_ok(whole):
            return [whole]
        n = len(data)
        at: list[list[int]] = [[] for _ in range(n)]
        for end, (size, r) in self.automaton.iter(data.decode("latin-1")):
            at[end - size + 1].append(r)  # at each start, from short to long
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, turn = [0], [len(at[0])]
        while pos[-1] < n:
            p = pos[-1]
            t = turn[-1] - 1
            options = at[p]
            while t >= 0:
                r = options[t]
                q = p + len(self.bytes[r])
                if not dead[q] and (not out or self.compatible(out[-1], r)):
                    break
                t -= 1
            turn[-1] = t
            if t >= 0:
                out.append(r)
                pos.append(q)
                turn.append(len(at[q]) if q < n else 0)
            else:
                if len(pos) == 1:
                    raise ValueError("a byte is missing from the vocabulary")
                dead[p] = 1
                pos.pop()
                turn.pop()
                out.pop()
        return out

    def half_ok(self, token: int) -> bool:
        """Whether merging makes `token` of its own bytes."""
        return len(self.bytes[token]) == 1 or self.half(token) is not None

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null text. Strings like special tokens are ordinary text."""
        if not text:
            return []
        known = self.known
        stretches = self.split.findall(text)
        lists = list(map(known.get, stretches))
        if None in lists:
            for k, ids in enumerate(lists):
                if ids is None:
                    s = stretches[k]
                    lists[k] = ids = known.get(s) or self.encode_stretch(s.encode("utf-8", "replace"))
                    if len(known) < REMEMBERED and len(s) < 64:
                        known[s] = ids
        return list(chain.from_iterable(lists))

    def decode(self, ids) -> str:
        return b"".join(self.blob[self.start[i] : self.start[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> BytePairEncoder:
    return BytePairEncoder(ranks)


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file's bytes, read once on the driver; public ones are below 2 MB."""
    data = Path(path).read_bytes()
    if len(data) > 32 << 20:
        raise ValueError("the vocabulary is too large to ship")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(documents: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """`documents` with the list of token ids; an empty and a null text give an empty list.

    Other columns pass through, one named like `out` is replaced.
    """
    kept = [c for c in documents.columns if c not in (text, out)]
    box = _vocabulary(documents, path)
    types = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = "".join(f"`{c}` {types[c]}, " for c in kept) + f"`{out}` array<int>"

    def run(batches):
        enc = _encoder(box.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(text).to_pylist()]
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists], names=[*kept, out])

    return documents.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """`encoded` with the text of the ids by the offset table; a null list gives an empty text."""
    kept = [c for c in encoded.columns if c not in (ids, out)]
    box = _vocabulary(encoded, path)
    types = {f.name: f.dataType.simpleString() for f in encoded.schema}
    schema = "".join(f"`{c}` {types[c]}, " for c in kept) + f"`{out}` string"

    def run(batches):
        enc = _encoder(box.value)
        for b in batches:
            texts = pa.array([enc.decode(i or ()) for i in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), texts], names=[*kept, out])

    return encoded.select(*kept, ids).mapInArrow(run, schema)


def count_tokens(documents: DataFrame, text: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """`documents` with the number of tokens of `text` in place of the text."""
    return encode(documents, text, "_ids", path).withColumn(out, F.size("_ids")).drop("_ids")

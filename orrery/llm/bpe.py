"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

The tree's leaf at a position holds the rank of the pair that begins there (with the position in the low
bits, so that a minimum is the leftmost of the least); its root is the next merge. A merge changes three
leaves (the pair itself, the pair before, and the one that vanishes), each a logarithmic update. Pieces of
up to `LOCKSTEP` bytes are merged many at once, each with a tree of its own, one merge of every piece per
step; longer pieces one by one. A piece that was merged is remembered, in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm.common import bounded_batches, frees, table, utf8

LOCKSTEP = 64
#: Pieces that a worker remembers, and bytes of text that it splits at once.
REMEMBERED, SLICE = 400_000, 1 << 20
_NONE = np.int64(1) << np.int64(62)
_SHIFT = 32


class BytePairEncoder:
    """Ranks (bytes to id) and the pattern that splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("every byte needs a rank")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << _SHIFT | b] = rank
        self.merges = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        #: Ids of the pieces met, joined by commas, and the bytes that those ids decode to.
        self.known: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.plain, self.fast = _latin(pattern)

    @classmethod
    def from_tiktoken(cls, data: bytes, pattern: str) -> BytePairEncoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, pattern)

    def pieces(self, text: str) -> list[str]:
        return self.fast(text) if self.fast and self.plain(text) else self.pattern.findall(text)

    def encode_pieces(self, texts: list[str]) -> list[list[str]]:
        """For each text its pieces' ids, a string of decimal numbers joined by commas for every piece."""
        split = [self.pieces(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = set(chain.from_iterable(split))
            new = sorted(new)
            for piece, ids in zip(new, self._encode_pieces([p.encode() for p in new]), strict=True):
                self.known[piece] = name = ",".join(map(str, ids))
                self.decoded[name] = b"".join(map(self.tokens.__getitem__, ids))
        return [list(map(self.known.__getitem__, p)) for p in split]

    def forget(self) -> None:
        self.known.clear()
        self.decoded.clear()

    def decode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.decoded.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.encode_pieces([text])[0] for i in p.split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list = [(r,) if (r := self.ranks.get(p)) is not None else None for p in pieces]
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if out[i] is None:
                if len(p) > LOCKSTEP:
                    out[i] = self._one(p)
                else:
                    classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            for a in range(0, len(members), 8192):
                part = members[a : a + 8192]
                for i, ids in zip(part, self._together([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _one(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none, get = int(_NONE), self.merges.get
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = get(ids[i] << _SHIFT | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << _SHIFT | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i, value):
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a < b else b
                if tree[i] == value:
                    break
                tree[i] = value

        def pair(i):
            j = after[i]
            rank = get(ids[i] << _SHIFT | ids[j]) if j < n else None
            put(i, none if rank is None else rank << _SHIFT | i)

        while tree[1] != none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i] = tree[1] >> _SHIFT
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, none)
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no merge; ids of -1 have none."""
        key = (a << np.int64(_SHIFT)) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at] << np.int64(_SHIFT), _NONE)

    def _together(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """The same on many pieces of at most `size` bytes (a power of two) at once."""
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        place = np.arange(size)
        ids = np.where(place < lengths[:, None], self.single[raw], -1)
        ids = np.hstack([ids, np.full((n, 1), -1)])  # the last column stands for the end
        after = np.where(place + 1 < lengths[:, None], place + 1, size)
        before = np.broadcast_to(place - 1, (n, size)).copy()
        before = np.hstack([before, np.full((n, 1), -1)])
        tree = np.full((n, 2 * size), _NONE)
        ranks = self._rank(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(n, size - 1)
        tree[:, size : 2 * size - 1] = np.where(ranks == _NONE, _NONE, ranks | place[: size - 1])
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

        def put(rows, leaf, value):
            leaf = leaf + size
            tree[rows, leaf] = value
            while leaf[0] > 1:
                leaf = leaf >> 1
                tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & np.int64(0xFFFFFFFF)
            j = after[rows, i]
            ids[rows, i] = top >> np.int64(_SHIFT)
            ids[rows, j] = -1
            k = after[rows, j]
            after[rows, i] = k
            before[rows, k] = i
            put(rows, j, _NONE)
            r = self._rank(ids[rows, i], ids[rows, k])
            put(rows, i, np.where(r == _NONE, _NONE, r | i))
            h = before[rows, i]
            some = h >= 0
            if some.any():
                at, h, i = rows[some], h[some], i[some]
                r = self._rank(ids[at, h], ids[at, i])
                put(at, h, np.where(r == _NONE, _NONE, r | h))
            rows = rows[tree[rows, 1] != _NONE]
        ids = ids[:, :size]
        alive = ids >= 0
        flat = ids[alive].tolist()
        ends = np.cumsum(alive.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _latin(pattern: str):
    """For patterns of letters, numbers and white space: a test for texts of Latin characters only, and a splitter
    for them by Python's faster `re`, whose classes are written out from the Unicode categories; else nothing."""
    if not all(x in pattern for x in (r"\p{L}", r"\p{N}")) or re.search(r"\\[^pPsS]|\(\?[^!]", pattern.replace(r"\p{L}", "").replace(r"\p{N}", "")):
        return None, None
    chars = [c for c in map(chr, range(0x250)) if c not in "\x1c\x1d\x1e\x1f\x85"]
    letters = "".join(c for c in chars if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in chars if unicodedata.category(c)[0] == "N")
    own = pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
    in_class = own.replace(f"{letters}+", f"[{letters}]+").replace(f"{numbers}+", f"[{numbers}]+").replace(f"[^\\s[{letters}]", f"[^\\s{letters}")
    in_class = in_class.replace(f"{letters}[{numbers}]+", f"{letters}{numbers}]+") if f"{letters}[{numbers}]+" in in_class else in_class
    safe = re.compile("[" + "".join(map(re.escape, chars)) + "]*")
    return (lambda t: safe.fullmatch(t) is not None), re.compile(in_class).findall


_ENCODERS: dict[bytes, BytePairEncoder] = {}


def _encoder(data: bytes, pattern: str) -> BytePairEncoder:
    """One encoder per worker process, kept between tasks (without the pieces met)."""
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BytePairEncoder.from_tiktoken(data, pattern)
    return _ENCODERS[key]


def _forget() -> None:
    """Drop the pieces met; a worker waits beside later stages with the ranks only."""
    for bpe in _ENCODERS.values():
        bpe.forget()


def encode(docs: DataFrame, ranks_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """docs' columns but text, with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (columns of these names go).

    Every match of the pattern in the whole text is encoded by itself, without special tokens; the ids are
    decoded again and the bytes hashed. Null and empty texts have no tokens; bytes that aren't UTF-8 are
    read as U+FFFD. The rank file (of fixed size) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(ranks_file, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), pattern))
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    base = docs.select(*own, utf8("text").alias("__text"))

    def run(batches):
        try:
            yield from encoded(batches)
        finally:
            _forget()

    def encoded(batches):
        for batch in batches:
            bpe = _encoder(*shared.value)
            texts = [t.decode("utf-8", "replace") for t in batch.column(len(own)).to_pylist()]
            counts, ids_sha, bytes_sha, ids = [], [], [], []
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= SLICE):
                    held += len(texts[end])
                    end += 1
                for x in bpe.encode_pieces(texts[at:end]):
                    joined = ",".join(x)
                    counts.append(joined.count(",") + 1 if x else 0)
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    bytes_sha.append(hashlib.sha256(bpe.decode_pieces(x)).hexdigest())
                    if keep_ids:
                        ids.append(np.fromstring(joined, np.int32, sep=","))
                at = end
            extra = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            extra += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*own, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *[("ids", T.ArrayType(T.IntegerType()))] * keep_ids]
    return base.mapInArrow(frees(run), T.StructType([*base.drop("__text").schema.fields, *(T.StructField(*x) for x in added)]))


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *public_ranks(), keep_ids=False)

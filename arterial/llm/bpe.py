"""Byte-level BPE encoding and decoding.

A pretoken's symbols sit in a segment tree keyed by the rank of each adjacent
pair; the root gives the lowest rank, leftmost first, and a merge is three point
updates, so a pretoken of n symbols takes O(n log n) however long it is.  New short
pretokens of a batch are merged in step, one row of a numpy array being one tree.

Defined results: null counts as empty; an empty text has no ids; a special token's
string inside a text is that token's id, as the vocabulary file says; extra columns
pass through, and columns of the output names are replaced; repeated rows and
empty tables need no care.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernels import mapped

#: Fixed value: how byte-level BPE vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pretokens remembered by a worker; the memory is emptied when full.
REMEMBERED = 100_000
#: Pretokens of up to this many bytes are merged many at a time.
SHORT = 33
_NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: visible Latin-1 characters stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: Sequence[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Codec:
    """Encoder and decoder of one vocabulary, given as the file's JSON text."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = {
            "not a BPE model": model.get("type", "BPE") != "BPE",
            "a normaliser": bool(spec.get("normalizer")),
            "another pre-tokeniser than byte-level": before.get("type") != "ByteLevel" or bool(before.get("add_prefix_space")) or not before.get("use_regex", True),
            "prefixes or suffixes of pieces, dropout, or words that skip merges": any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")),
            "special tokens that take blanks or whole words": any(x.get(y) for x in spec.get("added_tokens", []) for y in ("lstrip", "rstrip", "single_word")),
        }
        if any(odd.values()):
            raise ValueError(f"this vocabulary is not supported: {', '.join(k for k, v in odd.items() if v)}")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        named = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [named.get(i, b"") for i in range(max(named, default=-1) + 1)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = (as_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[x], self.ids[y]] = rank, self.ids[x + y]
        order = sorted(self.merges)
        self.codes = np.array([x << 32 | y for x, y in order] + [_NONE])
        self.rank_of = np.array([self.merges[p][0] for p in order] + [0])
        self.made = np.zeros(len(order) + 1, dtype=np.int64)
        for rank, made in self.merges.values():
            self.made[rank] = made
        self.single = np.array([self.ids[bytes([b])] for b in range(256)])
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: packed ids, so that a text's are joined without making numbers of them
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pretoken: repeatedly merge the leftmost pair of lowest rank."""
        whole = [self.ids[data[i : i + 1]] for i in range(len(data))]
        n = len(whole)
        if n < 2:
            return tuple(whole)
        merges = self.merges
        ranks = [merges.get((whole[i], whole[i + 1]), (_NONE,))[0] for i in range(n - 1)]
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        # a node holds rank * 2**32 + place, so the least value is the leftmost lowest rank
        tree = [_NONE] * (2 * leaves)
        for i, r in enumerate(ranks):
            if r != _NONE:
                tree[leaves + i] = r << 32 | i
        for i in range(leaves - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += leaves
            tree[i] = value
            while i > 1:
                a, b = tree[i], tree[i ^ 1]
                i >>= 1
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != _NONE:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            whole[i] = merges[whole[i], whole[j]][1]
            whole[j] = -1
            after[i] = k = after[j]
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
                found = merges.get((whole[i], whole[k]))
                put(i, found[0] << 32 | i if found else _NONE)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                found = merges.get((whole[h], whole[i]))
                put(h, found[0] << 32 | h if found else _NONE)
        return tuple(x for x in whole if x >= 0)

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where it never merges or an id is -1."""
        code = x << 32 | y
        at = np.searchsorted(self.codes, code)
        at[at >= len(self.codes)] = 0
        return np.where((self.codes[at] == code) & (x >= 0) & (y >= 0), self.rank_of[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many short pretokens."""
        return [tuple(np.frombuffer(x, dtype="<u4").tolist()) for x in self.merge_packed(words)]

    def merge_packed(self, words: list[bytes]) -> list[bytes]:
        """merge() of many short pretokens in step, as little-endian 32-bit ids; words of like length share an array of trees."""
        out = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(max(1, 1 << (len(w) - 2).bit_length()) if len(w) > 1 else 0, []).append(i)
        for leaves, rows in by.items():
            if not leaves:
                for i in rows:
                    out[i] = _packed([self.ids[words[i][j : j + 1]] for j in range(len(words[i]))])
                continue
            m = len(rows)
            lengths = np.array([len(words[i]) for i in rows])
            ids = np.full((m, leaves + 3), -1, dtype=np.int64)
            ids[np.arange(leaves + 3) < lengths[:, None]] = self.single[np.frombuffer(b"".join([words[i] for i in rows]), dtype=np.uint8)]
            place = np.arange(leaves)
            tree = np.full((m, 2 * leaves), _NONE, dtype=np.int64)
            first = self.ranks(ids[:, :leaves].ravel(), ids[:, 1 : leaves + 1].ravel()).reshape(m, leaves)
            tree[:, leaves:] = np.where(first == _NONE, _NONE, first << 8 | place)
            for node in range(leaves - 1, 0, -1):
                np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
            after = np.tile(np.arange(1, leaves + 4), (m, 1))
            before = np.tile(np.arange(-1, leaves + 2), (m, 1))
            np.minimum(after, lengths[:, None], out=after)

            def put(r: np.ndarray, i: np.ndarray, value) -> None:
                node = i + leaves
                tree[r, node] = value
                while leaves > 1 and node[0] > 1:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

            live = np.flatnonzero(tree[:, 1] != _NONE)
            while len(live):
                root = tree[live, 1]
                i = root & 255
                j = after[live, i]
                k = after[live, j]
                made = self.made[root >> 8]
                ids[live, i], ids[live, j] = made, -1
                after[live, i], before[live, k] = k, i
                inner = j < leaves
                if inner.any():
                    put(live[inner], j[inner], _NONE)
                for at, x, y in ((i, made, ids[live, k]), (before[live, i], None, made)):
                    ok = (at >= 0) & (at < leaves)
                    if x is None:
                        x = ids[live, np.maximum(at, 0)]
                    rank = self.ranks(x, y)
                    if ok.any():
                        put(live[ok], at[ok], np.where(rank == _NONE, _NONE, rank << 8 | at)[ok])
                live = live[tree[live, 1] != _NONE]
            kept = ids >= 0
            flat, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            begin = 0
            for i, end in zip(rows, ends):
                out[i] = flat[begin:end]
                begin = end
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split, special = self.split.findall, self.special
        parts = [self.cut.split(x) if self.cut else [x] for x in texts]
        tokens = [[[p] if p in special else split(p) for p in own] if len(own) > 1 else split(own[0]) for own in parts]
        tokens = [list(chain.from_iterable(t)) if len(own) > 1 else t for own, t in zip(parts, tokens)]
        known = self.known
        new = {t for own in tokens for t in own if t not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {t for own in tokens for t in own}
        raw = {t: t.encode("utf-8", "replace") for t in new if t not in special}
        short = [t for t, b in raw.items() if len(b) <= SHORT]
        known.update(zip(short, self.merge_packed([raw[t] for t in short])))
        known.update((t, _packed(self.merge(b))) for t, b in raw.items() if len(b) > SHORT)
        known.update((t, _packed([special[t]])) for t in new if t in special)
        of = known.__getitem__
        out = [np.frombuffer(b"".join(map(of, own)), dtype="<u4") for own in tokens]
        for t in new:
            if len(t) > 256:  # long ones are not worth keeping
                del known[t]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        of, most = self.bytes_of, len(self.bytes_of)
        ids = ids.tolist()
        if ids and not 0 <= min(ids) <= max(ids) < most:
            ids = [i for i in ids if 0 <= i < most]
        return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, text_col: str, vocabulary_path: str, ids_col: str = "ids", exact_col: str | None = None) -> DataFrame:
    """Add the token ids of each text as array<int>; with ``exact_col`` also whether they decode to the text, told in the same pass.

    The vocabulary, a few MB whatever the input, is read on the driver and broadcast.
    """
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(exact_col, T.BooleanType())] if exact_col else [])]

    def run(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
        ids = codec.encode_batch([x or "" for x in texts])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
        return [lists, *([pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts)])] if exact_col else [])]

    return _mapped(docs, text_col, vocabulary_path, fields, run)


def decode(tokens: DataFrame, ids_col: str, vocabulary_path: str, text_col: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null ids give an empty text."""
    return _mapped(tokens, ids_col, vocabulary_path, [T.StructField(text_col, T.StringType())], lambda codec, rows: [pa.array([codec.decode(np.array([i for i in x or [] if i is not None], dtype=np.int64)) for x in rows], pa.string())])


def round_trip(docs: DataFrame, text_col: str, vocabulary_path: str) -> DataFrame:
    """Replace the text by n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 (of the text decoded from those ids) without moving ids between processes."""

    def digest(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
        n, a, b = [], [], []
        for ids in codec.encode_batch([x or "" for x in texts]):
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            b.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _mapped(docs, text_col, vocabulary_path, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], digest)


def _mapped(docs: DataFrame, col: str, vocabulary_path: str, fields: list[T.StructField], run) -> DataFrame:
    new = {f.name for f in fields}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = [i for i, c in enumerate(docs.columns) if c not in new]
    place = docs.columns.index(col)
    shared = docs.sparkSession.sparkContext.broadcast(_read(vocabulary_path))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *run(codec, part.column(place).to_pylist())], names=[*(f"c{i}" for i in kept), *(f"n{i}" for i in range(len(fields)))])

    schema = T.StructType([*(T.StructField(f"c{i}", rows.schema[i].dataType) for i in kept), *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields))])
    out = mapped(rows, over, schema)
    return out.toDF(*(docs.columns[i] for i in kept), *(f.name for f in fields))

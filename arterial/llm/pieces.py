"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of symbols.  It is cut into words wherever two
neighbouring characters occur together in no piece, since no merge can cross such a
place; each distinct word is merged once.  In a round every word's least pair rank (a
segmented minimum) is found, its leftmost pair is merged in all words at once, and the
arrays are compacted; words without a pair leave.  In a long word a round takes all pairs
of the least rank from the left, up to the first whose merge makes a pair that would come
before the others; block minima keep a round from reading the whole word.

A word's merges are those of a priority queue by score, leftmost first, whatever the
scores: ranks need not grow along a chain of merges.

Defined results: null counts as empty, an empty text has only the begin and end ids;
characters outside the vocabulary are their UTF-8 bytes; bytes that are no UTF-8 (in ids
given to decode) become one U+FFFD each; control pieces are no text, an unknown id in a
list is skipped; extra columns pass through, columns of the output names are replaced;
repeated rows and empty tables need no care.  A model that needs a character map, removes
blanks, has user-defined or unused pieces or no byte fallback, or is no BPE model, is
refused with an error.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkernels import mapped, runs

#: Fixed values of the model format: the visible blank, piece types, the model type of BPE.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Words of up to this many symbols are merged together, one merge a word and round.
SHORT = 64
#: Symbols of a long word that share a kept minimum.
BLOCK = 512
_NONE = np.int64(1 << 40)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; fixed-size and nested values are bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value = message[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """Encoder and decoder of one model, given as the file's bytes."""

    def __init__(self, model: bytes):
        pieces, trainer, normal = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode("utf-8"), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        types = [t for _, _, t in pieces]
        refused = {
            "not a BPE model": trainer.get(3, 1) != BPE,
            "a character map": bool(normal.get(2)),
            "blanks are removed": bool(normal.get(4, 1)),
            "blanks are not escaped": not normal.get(5, 1),
            "blanks as suffixes": bool(trainer.get(24, 0)),
            "user-defined or unused pieces": USER_DEFINED in types or UNUSED in types,
            "no byte fallback": not trainer.get(35, 0) or types.count(BYTE) != 256,
        }
        if any(refused.values()):
            raise ValueError(f"this model is not supported: {', '.join(k for k, v in refused.items() if v)}")
        self.prefix = BLANK if normal.get(3, 1) else ""
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        byte_of = {i: int(s[3:-1], 16) for i, (s, _, t) in enumerate(pieces) if t == BYTE}
        surface = trainer.get(44, " ⁇ ".encode())
        shown = {NORMAL: lambda i, s: s.replace(BLANK, " ").encode(), BYTE: lambda i, s: bytes([byte_of[i]]), CONTROL: lambda i, s: b"", UNKNOWN: lambda i, s: surface}
        self.shown = pa.array([shown[t](i, s) for i, (s, _, t) in enumerate(pieces)], pa.large_binary())
        self.types = np.array(types)
        self.leads = np.array([t == NORMAL and s.startswith(BLANK) for s, _, t in pieces])
        self.byte_ids = np.zeros(256, dtype=np.int64)
        self.byte_ids[list(byte_of.values())] = list(byte_of)
        # symbols are pieces, then characters that occur in pieces only, then one for all other characters
        symbol = {s: i for i, (s, _, t) in enumerate(pieces) if t == NORMAL}
        scores = {s: v for s, v, t in pieces if t == NORMAL}
        for c in sorted({c for s in scores for c in s} - symbol.keys()):
            symbol[c] = len(pieces) + len(symbol)
        self.size = len(pieces)
        self.other = max(symbol.values(), default=-1) + 1
        rank = {v: i for i, v in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = sorted((symbol[s[:i]] << 32 | symbol[s[i:]], rank[v], symbol[s]) for s, v in scores.items() for i in range(1, len(s)) if s[:i] in symbol and s[i:] in symbol)
        self.codes, self.ranks, self.makes = (np.array(c, dtype=np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, dtype=np.int64),) * 3
        chars = sorted((ord(s), i) for s, i in symbol.items() if len(s) == 1)
        self.chars, self.char_symbols = (np.array(c, dtype=np.int64) for c in zip(*chars)) if chars else (np.zeros(0, dtype=np.int64),) * 2
        self.together = np.array(sorted({ord(a) << 21 | ord(b) for s in scores for a, b in zip(s, s[1:])}), dtype=np.int64)
        blank = ord(BLANK)
        self.cuts_at_blanks = not any(x & 0x1FFFFF == blank and x >> 21 != blank for x in self.together.tolist())

    def pair(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made symbol) of neighbours x and y; rank _NONE where they do not merge."""
        if not len(self.codes):
            return np.full(len(x), _NONE), np.zeros(len(x), dtype=np.int64)
        code = x << 32 | y
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return np.where(hit, self.ranks[at], _NONE), self.makes[at]

    def merge_short(self, symbols: np.ndarray, starts: np.ndarray, final: np.ndarray, at: np.ndarray) -> None:
        """Merge words that begin at ``starts``; results go to ``final`` at places ``at``, -1 where a symbol was taken in."""
        lengths = np.diff(starts, append=len(symbols))
        last = np.zeros(len(symbols), dtype=bool)
        last[starts + lengths - 1] = True
        rank, made = (np.concatenate((c, [0])) for c in self.pair(symbols[:-1], symbols[1:]))
        rank[last] = _NONE
        while len(starts):
            place = np.arange(len(symbols))
            least = np.minimum.reduceat(rank << 22 | place, starts)
            live = least >> 22 != _NONE
            i = least[live] & ((1 << 22) - 1)
            if not len(i):
                return
            new = made[i]
            symbols[i], final[at[i]], final[at[i + 1]] = new, new, -1
            last[i] = last[i + 1]
            # ranks of the pairs that the new symbol is in
            rank[i] = _NONE
            right = i[~last[i]]
            rank[right], made[right] = self.pair(symbols[right], symbols[right + 2])
            left = i[~np.isin(i, starts, assume_unique=True)] - 1
            rank[left], made[left] = self.pair(symbols[left], symbols[left + 1])
            stays = np.repeat(live, lengths)
            stays[i + 1] = False
            lengths = lengths[live] - 1
            symbols, at, rank, made, last = (c[stays] for c in (symbols, at, rank, made, last))
            starts = np.cumsum(lengths) - lengths

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of one long word, merged."""
        n = len(symbols)
        blocks = -(-n // BLOCK)
        rank, made = np.full(blocks * BLOCK, _NONE), np.zeros(blocks * BLOCK, dtype=np.int64)
        rank[: n - 1], made[: n - 1] = self.pair(symbols[:-1], symbols[1:])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        dead = np.zeros(n, dtype=bool)
        symbols = np.append(symbols, -1)
        table = rank.reshape(blocks, BLOCK)
        least = table.min(axis=1)
        while (r := least.min()) != _NONE:
            rows = np.flatnonzero(least == r)
            row, col = np.nonzero(table[rows] == r)
            i = rows[row] * BLOCK + col
            # of pairs that overlap, every second one, counted from the left
            follows = np.append(False, after[i[:-1]] == i[1:])
            run = np.arange(len(i)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(i))))
            i = i[run % 2 == 0]
            j = after[i]
            k = after[j]
            new = made[i]
            # the neighbours as they are when merges go from left to right
            h = before[i]
            touches = np.append(False, k[:-1] == i[1:])
            on_left = np.where(touches, np.roll(new, 1), symbols[h])
            rank_left, made_left = self.pair(on_left, new)
            rank_left[h < 0] = _NONE
            rank_right, _ = self.pair(new, symbols[k])
            early = np.flatnonzero((rank_left <= r) | (rank_right <= r))
            if len(early):
                i, j, k, new, h, touches = (c[: early[0] + 1] for c in (i, j, k, new, h, touches))
            symbols[i] = new
            dead[j] = True
            h = np.where(touches, np.roll(i, 1), h)
            after[i] = k
            inner = k < n
            before[k[inner]] = i[inner]
            rank[i] = rank[j] = _NONE
            left = h[h >= 0]
            changed = np.unique(np.concatenate((i[inner], left)))
            rank[changed], made[changed] = self.pair(symbols[changed], symbols[after[changed]])
            rows = np.unique(np.concatenate((i, j, changed)) // BLOCK)
            least[rows] = table[rows].min(axis=1)
        return symbols[:n][~dead]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each of some words, given as UTF-8 without blanks but BLANK."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + n + 1]
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4").astype(np.int64)
        begins = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets - offsets[0]]
        near = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.together, near), max(len(self.together) - 1, 0))
        cut = np.append(True, self.together[at] != near) if len(self.together) else np.ones(len(points), dtype=bool)
        cut[begins[:-1]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(points))
        known = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        symbols = np.where(self.chars[known] == points, self.char_symbols[known], self.other)
        final = symbols.copy()
        small = (lengths > 1) & (lengths <= SHORT)
        # places take 22 bits in merge_short
        order, sizes = np.flatnonzero(small), lengths[small]
        groups = np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // (1 << 20) + 1) << 20, side="left") + 1
        for part in np.split(order, groups):
            if len(part):
                own = lengths[part]
                first = np.cumsum(own) - own
                at = np.repeat(starts[part] - first, own) + np.arange(int(own.sum()))
                self.merge_short(symbols[at], first, final, at)
        for s, m in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist()):
            merged = self.merge_long(symbols[s : s + m])
            final[s : s + m] = -1
            final[s : s + len(merged)] = merged
        # characters outside the vocabulary become their bytes
        count = (final >= 0).astype(np.int64)
        lost = np.flatnonzero(final >= self.size)
        spelt = [chr(c).encode("utf-8") for c in points[lost].tolist()]
        count[lost] = [len(b) for b in spelt]
        ends = np.append(0, np.cumsum(count))
        ids = np.empty(ends[-1], dtype=np.int64)
        plain = (final >= 0) & (final < self.size)
        ids[ends[:-1][plain]] = final[plain]
        if len(lost):
            own = count[lost]
            put = np.repeat(ends[lost] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            ids[put] = self.byte_ids[np.frombuffer(b"".join(spelt), dtype=np.uint8)]
        return ids, ends[begins]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them), without begin and end ids."""
        texts = texts.fill_null("").cast(pa.large_string())
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
        plain = pc.replace_substring(texts, " ", BLANK)
        if self.prefix:
            empty = pc.equal(pc.binary_length(texts), 0)
            plain = pc.binary_join_element_wise(pc.if_else(empty, pa.scalar("", pa.large_string()), pa.scalar(self.prefix, pa.large_string())), plain, pa.scalar("", pa.large_string()))
        n = len(plain)
        if plain.buffers()[2] is None:
            return np.zeros(0, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + n + 1]
        raw = np.frombuffer(plain.buffers()[2], dtype=np.uint8)
        starts = np.unique(offsets)
        if self.cuts_at_blanks:
            a, b, c = BLANK.encode()
            blank = np.flatnonzero((raw[:-2] == a) & (raw[1:-1] == b) & (raw[2:] == c))
            blank = blank[np.append(True, np.diff(blank) != 3)] if len(blank) else blank
            starts = np.unique(np.concatenate((blank[(blank >= offsets[0]) & (blank < offsets[-1])], offsets)))
        if len(starts) < 2:
            return np.zeros(0, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), plain.buffers()[2]])
        coded = words.dictionary_encode()
        ids, ends = self.encode_words(coded.dictionary)
        which = coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(ends)[which]
        upto = np.append(0, np.cumsum(sizes))
        flat = ids[np.repeat(ends[:-1][which] - upto[:-1], sizes) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without begin and end ids."""
        return self.encode_batch(pa.array([text]))[0].tolist()

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes | memoryview]:
        """UTF-8 of each list of ids."""
        known = (ids >= 0) & (ids < self.size)
        if not known.all():
            offsets = np.append(0, np.cumsum(known))[offsets]
            ids = ids[known]
        shown = self.shown.take(pa.array(ids, pa.int64()))
        where = np.frombuffer(shown.buffers()[1], dtype=np.int64)[shown.offset : shown.offset + len(shown) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
        data = memoryview(shown.buffers()[2]) if len(ids) and shown.buffers()[2] is not None else memoryview(b"")
        kinds = self.types[ids]
        holds_bytes = np.append(0, np.cumsum(kinds == BYTE))
        silent = np.flatnonzero(kinds == CONTROL)
        spoken = np.append(np.flatnonzero(kinds != CONTROL), len(ids))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            first = spoken[np.searchsorted(spoken, a)]
            # the blank put before a text goes again
            skip = int(bool(self.prefix) and first < b and self.leads[ids[first]])
            own = data[where[a] + skip : where[b]] if b > a else memoryview(b"")
            if holds_bytes[a] != holds_bytes[b]:
                # no character goes across a control piece
                within = where[silent[np.searchsorted(silent, a) : np.searchsorted(silent, b)]] - where[a] - skip
                limits = [0, *np.unique(within[(within > 0) & (within < len(own))]).tolist(), len(own)]
                own = b"".join(_spelt(bytes(own[x:y])) for x, y in zip(limits, limits[1:]))
            out.append(own)
        return out

    def decode(self, ids: list[int]) -> str:
        return str(self.decode_batch(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0], "utf-8")


def _spelt(raw: bytes) -> bytes:
    """``raw`` with each byte that is part of no character replaced by U+FFFD."""
    out = []
    while raw:
        try:
            raw.decode("utf-8")
            out.append(raw)
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start], "�".encode()]
            raw = raw[e.start + 1 :]
    return b"".join(out)


@lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return Model(data)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _with_ends(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    longer = offsets + 2 * np.arange(n + 1)
    out = np.empty(longer[-1], dtype=np.int64)
    out[longer[:-1]], out[longer[1:] - 1] = model.begin, model.end
    out[np.repeat(2 * np.arange(n) + 1, np.diff(offsets)) + np.arange(len(ids))] = ids
    return out, longer


def encode(docs: DataFrame, text_col: str, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Add the ids of each text, begin and end ids included, as array<int>.

    The model, under a MB whatever the input, is read on the driver and broadcast.
    """

    def run(model: Model, texts: pa.Array) -> list[pa.Array]:
        ids, offsets = _with_ends(model, *model.encode_batch(texts))
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _mapped(docs, text_col, model_path, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], run)


def decode(tokens: DataFrame, ids_col: str, model_path: str, text_col: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null lists and null ids give nothing."""

    def run(model: Model, lists: pa.Array) -> list[pa.Array]:
        own = [[i for i in x or [] if i is not None] for x in lists.to_pylist()]
        offsets = np.append(0, np.cumsum([len(x) for x in own]))
        ids = np.array([i for x in own for i in x], dtype=np.int64)
        return [pa.array([str(b, "utf-8") for b in model.decode_batch(ids, offsets)], pa.string())]

    return _mapped(tokens, ids_col, model_path, [T.StructField(text_col, T.StringType())], run)


def round_trip(docs: DataFrame, text_col: str, model_path: str) -> DataFrame:
    """Add n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 (of the text decoded from those ids) without moving ids between processes."""

    def run(model: Model, texts: pa.Array) -> list[pa.Array]:
        ids, offsets = _with_ends(model, *model.encode_batch(texts))
        packed = memoryview(ids.astype("<u4").tobytes())
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        digests = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in spans]
        decoded = [hashlib.sha256(b).hexdigest() for b in model.decode_batch(ids, offsets)]
        return [pa.array(np.diff(offsets)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(docs, text_col, model_path, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], run)


def _mapped(docs: DataFrame, col: str, model_path: str, fields: list[T.StructField], run) -> DataFrame:
    """``docs`` with new columns, computed by ``run(model, column)`` for some rows at a time; column names may repeat or hold any character."""
    new = {f.name for f in fields}
    kept = [i for i, c in enumerate(docs.columns) if c not in new]
    place = docs.columns.index(col)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    shared = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            texts = batch.column(place)
            for first, n in runs(texts) if pa.types.is_string(texts.type) else [(0, batch.num_rows)]:
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *run(model, part.column(place))], names=[*(f"c{i}" for i in kept), *(f"n{i}" for i in range(len(fields)))])

    schema = T.StructType([*(T.StructField(f"c{i}", rows.schema[i].dataType) for i in kept), *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields))])
    return mapped(rows, over, schema).toDF(*(docs.columns[i] for i in kept), *(f.name for f in fields))

"""Token ids as binary shards, with a minimal perfect hash index for keyed access.

Documents are range-partitioned and sorted by id, repeated ids by text. Each task
streams its documents through the tokenizer into ``.bin`` files that hold nothing
but little-endian ids (two bytes each if the vocabulary allows, else four), and
closes a shard after ``shard_ids`` ids. Beside each shard an ``.idx`` file holds
the ids of its documents, their offsets, and the index.

The index is a minimal perfect hash of the shard's n distinct keys: level by
level, keys are hashed into a bit array; those alone in their cell set its bit,
the others go to the next level. A key's slot is the number of bits set before
its own: 0 to n - 1, each once; that number is stored for every eighth word of
bits. A slot holds a 32-bit fingerprint, by which foreign keys are refused, and
the first record with that key. The manifest has each shard's least and greatest
key, so a lookup opens the shards that can hold the key and reads a few cells of
their files, whatever the size of shard and corpus.

File names hold a random part, and the manifest (a written table with a row a
shard) lists only the files of tasks that ended well: what a lost or repeated
task leaves is never read.

Defined results: a null or empty text is a document of only the end id; records
with a repeated id are all written, in text order, and found together, also if
they lie in several shards; a null id sorts first and is in the shard but not in
the index; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.common import new_dir, open_fs, written

SHARD_IDS, MAGIC = 1 << 26, b"FLTOKIX2"
READ_BYTES = 8 << 20
#: Bytes of text handled at once; pieces and ids remembered before the table starts anew.
BLOCK, MAX_PIECES, MAX_POOL = 1 << 19, 1 << 19, 1 << 23


# --- tokenizing -------------------------------------------------------------

OPEN, LETTER, NUMBER, SPACE, OTHER = range(5)
#: Bytes of a piece that its key holds; longer pieces are not remembered.
KEY = 24


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point below U+20000; OPEN where versions of Unicode, or of patterns, may differ."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.zeros(0x20000, np.uint8)
    for c in range(len(out)):
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        kind = kinds.get(now[0], OTHER)
        out[c] = kind if now not in ("Cn", "Cs") and kind == kinds.get(then[0], OTHER) else OPEN
    out[9:14] = SPACE
    out[[*range(0x1C, 0x20), 0x85]] = OPEN
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character each UTF-8 byte belongs to."""
    table = classes()
    out = table[np.where(data < 0x80, data, 0)]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        after = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        b, c, d, e = (after[high + k] for k in range(4))
        c, d, e = c & 0x3F, d & 0x3F, e & 0x3F
        code = np.where(b < 0xE0, (b & 0x1F) << 6 | c, np.where(b < 0xF0, (b & 0x0F) << 12 | c << 6 | d, (b & 0x07) << 18 | c << 12 | d << 6 | e))
        kind = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], OPEN)
        for k, least in enumerate((0, 0, 0xE0, 0xF0)):
            out[high[b >= least] + k] = kind[b >= least]
    return out


def piece_starts(data: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pattern begin; firsts: where texts begin.

    A piece is a run of letters, of numbers or of other signs, with one space in
    front if there is one; a run of white space without its last character, if
    something follows; that character, if it is no space; or an apostrophe with
    one of seven endings, if nothing is joined to the apostrophe in front.
    """
    n = len(data)
    first = np.zeros(n + 4, bool)
    first[firsts] = first[n:] = True
    start = first[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    spaces = (kinds[runs] == SPACE) & ~first[ends]
    last = ends[spaces] - 1
    for _ in range(3):
        last = np.where(data[last] & 0xC0 == 0x80, last - 1, last)
    start[last] = True
    words = runs[(kinds[runs] != SPACE) & ~first[runs]]
    start[words[data[words - 1] == 0x20]] = False
    at = np.flatnonzero((data == 0x27) & start)
    if len(at):
        at = at[~first[at + 1]]
        at = at[kinds[at + 1] == LETTER]
        b = data[at + 1]
        c = np.where(first[at + 2], 0, data[np.minimum(at + 2, n - 1)])
        one = np.isin(b, np.frombuffer(b"stmd", np.uint8))
        two = (b == ord("r")) & (c == ord("e")) | (b == ord("v")) & (c == ord("e")) | (b == ord("l")) & (c == ord("l"))
        start[at[one | two] + 1] = False
        behind = np.concatenate([at[one] + 2, at[two] + 3])
        start[behind[behind < n]] = True
    return np.flatnonzero(start)


class PieceTable:
    """The ids of pieces of up to ``KEY`` bytes: open addressing over exact keys, all steps on whole arrays.

    A row holds the piece's bytes (three words, zero-filled) and, in one word, its
    length, the number of its ids and their place in the pool.
    """

    MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(KEY + 1)], np.uint64)

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.rows, self.n = np.zeros((1 << 16, 4), np.uint64), 0
        self.pool, self.used = np.zeros(1 << 18, self.kind), 0

    def keys(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(piece, 4): the words and the length; data ends with KEY spare bytes."""
        word = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
        out = np.empty((len(at), 4), np.uint64)
        for k in range(3):
            out[:, k] = word[at + 8 * k] & self.MASKS[length, k]
        out[:, 3] = length
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (keys[:, 1] + keys[:, 3]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - (len(self.rows).bit_length() - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The last word of each key's row, 0 for keys that are not there."""
        out, at = np.zeros(len(keys), np.uint64), self.slots(keys)
        todo = np.arange(len(keys))
        while len(todo):
            rows = self.rows[at]
            same = (rows[:, :3] == keys[:, :3]).all(axis=1) & (rows[:, 3] & np.uint64(0xFF) == keys[:, 3])
            out[todo[same]] = rows[same, 3]
            on = ~same & (rows[:, 3] != 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.rows) - 1)
        return out

    def put(self, rows: np.ndarray) -> None:
        """Add rows with distinct keys that are not there."""
        self.n += len(rows)
        if 4 * self.n > 3 * len(self.rows):
            rows = np.concatenate([self.rows[self.rows[:, 3] != 0], rows])
            self.rows = np.zeros((1 << (2 * self.n - 1).bit_length(), 4), np.uint64)
        keys = rows.copy()
        keys[:, 3] &= np.uint64(0xFF)
        at = self.slots(keys)
        while len(rows):
            free = self.rows[at, 3] == 0
            self.rows[at[free]] = rows[free]
            on = self.rows[at, 3] != rows[:, 3]  # places in the pool differ, so this tells rows apart
            rows, at = rows[on], (at[on] + 1) & (len(self.rows) - 1)

    def store(self, ids: list[int]) -> tuple[int, int]:
        """Put ids into the pool; their place and number."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids), len(ids)


class Encoder:
    """A tokenizers file; where pieces are encoded apart from each other, a piece seen before needs no work.

    A byte-level tokenizer that splits by its own pattern never merges across
    pieces. The pieces of a block of texts are found on its bytes, looked up in a
    table, and the new ones go to the library's model. A text with a character
    whose class is open, or with the string of the end token, goes to the library
    as a whole, as do all texts of other kinds of tokenizers. A piece always
    begins at a space between two ASCII letters, so long texts are cut there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        made = self.tokenizer = Tokenizer.from_file(path)
        pre = json.loads(made.pre_tokenizer.__getstate__()) if made.pre_tokenizer else {}
        added = list(made.get_added_tokens_decoder().values())
        plain = all(t.special and not t.lstrip and not t.rstrip and not t.single_word and " " not in t.content for t in added)
        self.by_piece = plain and made.normalizer is None and made.truncation is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        self.added = [t.content.encode() for t in added]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.table = PieceTable(self.kind)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        return self.encode_array(pa.array(texts, pa.string()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The same for an Arrow array of strings; null is empty."""
        if not self.by_piece:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or ends[0] == ends[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        held, size = [], 0
        has = (np.diff(ends) > 0) & texts.is_valid().to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(has).tolist():
            for part in self.parts(data[ends[i] : ends[i + 1]]):
                if size + len(part) > BLOCK and held:
                    self.block(held, out)
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
        if held:
            self.block(held, out)
        return [b"".join(x) for x in out]

    @staticmethod
    def parts(text: np.ndarray) -> Iterator[np.ndarray]:
        """The text, cut at spaces between letters into parts of about BLOCK bytes."""
        while len(text) > BLOCK:
            near = text[: BLOCK + 1] | 0x20
            letter = (near >= ord("a")) & (near <= ord("z")) & (text[: BLOCK + 1] >= 0x41)
            cuts = np.flatnonzero((text[1:BLOCK] == 0x20) & letter[:-2] & letter[2:])
            if not len(cuts):
                break
            yield text[: cuts[-1] + 1]
            text = text[cuts[-1] + 1 :]
        yield text

    def block(self, held: list[tuple[int, np.ndarray]], out: list[list[bytes]]) -> None:
        """Append the ids of each part to its text's."""
        lengths = np.array([len(x) for _, x in held])
        firsts = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        data = np.concatenate([*[x for _, x in held], np.zeros(KEY + 8, np.uint8)])
        kinds = byte_classes(data[:n])
        slow = set((np.searchsorted(firsts, np.flatnonzero(kinds == OPEN), "right") - 1).tolist())
        raw = data[:n].tobytes()
        for word in self.added:
            at = raw.find(word)
            while at >= 0:
                slow.add(int(np.searchsorted(firsts, at, "right")) - 1)
                at = raw.find(word, at + 1)
        if slow:
            part: dict[int, list[bytes]] = {k: [] for k in range(len(held))}
            for k in slow:
                part[k].append(np.array(self.tokenizer.encode(held[k][1].tobytes().decode(), add_special_tokens=False).ids, self.kind).tobytes())
            if fast := [(k, x) for k, (_, x) in enumerate(held) if k not in slow]:
                self.block(fast, part)
            for k, (i, _) in enumerate(held):
                out[i] += part[k]
            return
        at = piece_starts(data[:n], kinds, firsts)
        places, counts = self.looked_up(data, raw, at, np.append(at[1:], n) - at)
        ends = np.cumsum(counts)
        total = int(ends[-1])
        ids = self.table.pool[np.arange(total) + np.repeat(places - (ends - counts), counts)]
        before = np.concatenate([[0], ends])[np.append(np.searchsorted(at, firsts), len(at))].tolist()
        for (i, _), a, b in zip(held, before, before[1:], strict=False):
            out[i].append(ids[a:b].tobytes())

    def looked_up(self, data: np.ndarray, raw: bytes, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each piece."""
        table = self.table
        if table.n > MAX_PIECES or table.used > MAX_POOL:
            table.clear()
        places, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for i in np.flatnonzero(length > KEY).tolist():
            places[i], counts[i] = table.store(self.ids(raw[at[i] : at[i] + length[i]]))
        todo = np.flatnonzero(length <= KEY)
        keys = table.keys(data, at[todo], length[todo])
        got = table.find(keys)
        while not got.all():
            new = np.flatnonzero(got == 0)
            one = new[np.unique(keys[new, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[new, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[new, 2] + keys[new, 3], return_index=True)[1]]
            rows = keys[one]
            stored = [table.store(self.ids(raw[a : a + b])) for a, b in zip(at[todo[one]].tolist(), length[todo[one]].tolist(), strict=True)]
            rows[:, 3] |= np.array([place << 32 | n << 8 for place, n in stored], np.uint64)
            table.put(rows)
            got[new] = table.find(keys[new])
        places[todo], counts[todo] = got >> np.uint64(32), got >> np.uint64(8) & np.uint64(0xFF)
        return places, counts

    def ids(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- minimal perfect hash ---------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mix of integer keys; another function for each seed."""
    z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


class PerfectHash:
    """levels: cells of each level; bits: all levels' cells, end to end, packed; ranks: bits set before every eighth word of 64 cells."""

    LEVELS, LOAD, FINGER = 48, 2.0, 1 << 20

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels.astype(np.uint64), bits.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.levels)]).astype(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])[: max(1, len(self.bits)) : 8]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, found = keys, [], []
        while len(left):
            if len(levels) == cls.LEVELS:
                raise ValueError("keys must be distinct")
            cells = -(-max(64, int(cls.LOAD * len(left))) // 64) * 64
            at = mixed(left, len(levels)) % np.uint64(cells)
            alone = np.bincount(at.astype(np.int64), minlength=cells) == 1
            found.append(np.packbits(alone, bitorder="little").view("<u8"))
            levels.append(cells)
            left = left[~alone[at.astype(np.int64)]]
        return cls(np.array(levels, np.uint64), np.concatenate(found) if found else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that no level holds (others may be foreign: compare fingerprints)."""
        return find_slots(keys, self.levels, lambda word: self.bits[word], lambda group: self.ranks[group])


def find_slots(keys: np.ndarray, levels: np.ndarray, bits, ranks) -> np.ndarray:
    """Slots by way of ``bits`` (words by number) and ``ranks`` (bits set before each eighth word), held or read from a file."""
    out = np.full(len(keys), -1, np.int64)
    todo, start = np.arange(len(keys)), 0
    for level, cells in enumerate(levels.tolist()):
        if not len(todo):
            break
        at = start + (mixed(keys[todo], level) % np.uint64(cells)).astype(np.int64)
        start += cells
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        own = bits(word)
        hit = (own >> shift & np.uint64(1)).astype(bool)
        rank = np.bitwise_count(own[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))).astype(np.int64)
        for back in range(1, 8):
            inside = (word[hit] & 7) >= back
            rank[inside] += np.bitwise_count(bits(word[hit][inside] - back)).astype(np.int64)
        out[todo[hit]] = rank + ranks(word[hit] >> 3).astype(np.int64)
        todo = todo[~hit]
    return out


def fingers(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, PerfectHash.FINGER) >> np.uint64(32)).astype(np.uint32)


# --- shards -----------------------------------------------------------------


class ShardWriter:
    def __init__(self, folder: str, name: str, kind: np.dtype):
        self.fs, self.at = open_fs(f"{folder}/{name}")
        self.path, self.kind = f"{folder}/{name}", kind
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.at + ".bin")
        self.keys: list[int | None] = []
        self.ends: list[int] = []
        self.n = 0

    def add(self, key: int | None, raw: bytes, end_id: bytes) -> None:
        self.out.write(raw)
        self.out.write(end_id)
        self.n += (len(raw) + len(end_id)) // self.kind.itemsize
        self.keys.append(key)
        self.ends.append(self.n)

    def close(self) -> dict:
        self.out.close()
        has = np.array([k is not None for k in self.keys], bool)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        offsets = np.array([0, *self.ends], np.uint64)
        first = np.flatnonzero(has & np.concatenate([[True], (keys[1:] != keys[:-1]) | ~has[:-1]]))
        distinct = keys[first]
        index = PerfectHash.build(distinct)
        slots = index.slots(distinct)
        records, finger = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
        records[slots], finger[slots] = first, fingers(distinct)
        parts = {"keys": keys, "has": has.astype(np.uint8), "offsets": offsets, "levels": index.levels, "bits": index.bits, "ranks": index.ranks, "records": records, "fingers": finger}
        head = json.dumps({"kind": self.kind.str, "parts": [[n, a.dtype.str, len(a)] for n, a in parts.items()]}).encode()
        with self.fs.open_output_stream(self.at + ".idx") as out:
            out.write(MAGIC + struct.pack("<I", len(head)) + head)
            for a in parts.values():
                out.write(a.tobytes())
        return {"path": self.path, "n_docs": len(keys), "n_ids": self.n, "least_key": int(distinct[0]) if len(distinct) else None, "greatest_key": int(distinct[-1]) if len(distinct) else None}


class ShardReader:
    """Keyed and sequential access to one shard; ``held``: the index is read whole, else a few cells for each key."""

    def __init__(self, path: str, held: bool = True):
        self.fs, self.at = open_fs(path)
        self.idx, self.bin = self.fs.open_input_file(self.at + ".idx"), self.fs.open_input_file(self.at + ".bin")
        front = self.idx.read_at(len(MAGIC) + 4, 0)
        if front[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path}: not an index")
        head = json.loads(self.idx.read_at(struct.unpack("<I", front[len(MAGIC) :])[0], len(front)))
        at = len(front) + struct.unpack("<I", front[len(MAGIC) :])[0]
        self.parts, self.cache = {}, {}
        for name, kind, size in head["parts"]:
            self.parts[name] = at, np.dtype(kind), size
            at += np.dtype(kind).itemsize * size
        self.kind, self.n = np.dtype(head["kind"]), self.parts["keys"][2]
        if held:
            self.cache = {name: self.read(name, 0, size) for name, (_, _, size) in self.parts.items()}

    def read(self, name: str, first: int, last: int) -> np.ndarray:
        """Cells first to last - 1 of a part of the index."""
        if name in self.cache:
            return self.cache[name][first:last]
        at, kind, _ = self.parts[name]
        return np.frombuffer(self.idx.read_at((last - first) * kind.itemsize, at + first * kind.itemsize), kind)

    def cells(self, name: str, at: np.ndarray) -> np.ndarray:
        if name in self.cache:
            return self.cache[name][at]
        return np.concatenate([np.zeros(0, self.parts[name][1]), *[self.read(name, i, i + 1) for i in at.tolist()]])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First record of each key, -1 for keys that are not in the shard."""
        out = find_slots(keys, self.read("levels", 0, self.parts["levels"][2]), lambda w: self.cells("bits", w), lambda g: self.cells("ranks", g))
        in_use = np.flatnonzero(out >= 0)
        known = in_use[self.cells("fingers", out[in_use]) == fingers(keys[in_use])]
        records = self.cells("records", out[known]).astype(np.int64)
        out[:] = -1
        own = self.cells("keys", records) == keys[known]
        out[known[own]] = records[own]
        return out

    def ids(self, first: int, last: int) -> np.ndarray:
        """All ids of records first to last - 1, end to end."""
        w = self.kind.itemsize
        a, b = (int(self.read("offsets", i, i + 1)[0]) * w for i in (first, last))
        return np.frombuffer(self.bin.read_at(b - a, a), self.kind)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every record with this key."""
        first = int(self.find(np.array([key], np.int64))[0])
        out = []
        while 0 <= first < self.n and self.read("has", first, first + 1)[0] and self.read("keys", first, first + 1)[0] == key:
            out.append(self.ids(first, first + 1))
            first += 1
        return out


MANIFEST = "part int, seq int, path string, n_docs bigint, n_ids bigint, least_key bigint, greatest_key bigint"


def _write(folder: str, tokenizer: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        part = TaskContext.get().partitionId()
        shard, rows, tag = None, [], uuid.uuid4().hex
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                keys = piece.column(0).to_pylist()
                for key, raw in zip(keys, enc.encode_array(piece.column(1)), strict=True):
                    if shard and shard.n >= shard_ids:
                        rows.append(shard.close())
                        shard = None
                    if not shard:
                        shard = ShardWriter(folder, f"part-{part:06d}-{len(rows):04d}-{tag}", enc.kind)
                    shard.add(key, raw, end)
        if shard:
            rows.append(shard.close())
        columns = {"part": pa.array([part] * len(rows), pa.int32()), "seq": pa.array(range(len(rows)), pa.int32()), "path": pa.array([r["path"] for r in rows], pa.string())}
        yield pa.RecordBatch.from_pydict(columns | {n: pa.array([r[n] for r in rows], pa.int64()) for n in ("n_docs", "n_ids", "least_key", "greatest_key")})

    return run


def write_tokens(docs: DataFrame, *, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards; the manifest: part, seq, path, n_docs, n_ids, least_key, greatest_key, and start (ids in front of the shard).

    Rows with one id are dealt by the front of their text, so an id with many rows doesn't fill a task.
    The prefix sum runs over the manifest, which has a row a shard.
    """
    folder = folder or new_dir(docs.sparkSession, "tokens")
    used = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    dealt = used.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    manifest = written(dealt.mapInArrow(_write(folder, tokenizer, end_id, shard_ids), MANIFEST), "tokens-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record of the listed shards, found by its key where it has one."""
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = ShardReader(path)
            n, keys, has, offsets = shard.n, shard.cache["keys"], shard.cache["has"].astype(bool), shard.cache["offsets"].astype(np.int64)
            known = keys[has]
            runs = np.concatenate([[True], known[1:] != known[:-1]])[: len(known)]
            if not np.array_equal(shard.find(known), np.maximum.accumulate(np.where(runs, np.flatnonzero(has), 0))):
                raise ValueError(f"{path}: the index doesn't find its own keys")
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_BYTES // shard.kind.itemsize, "right")) - 1)
                ids = shard.ids(at, to)
                cuts = (offsets[at : to + 1] - offsets[at]).tolist()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[at:to], pa.int64(), mask=~has[at:to]), "start": pa.array(offsets[at:to] + start, pa.int64()), "n_tokens": pa.array(np.diff(offsets[at : to + 1]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                at = to


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record in the shards of ``manifest``."""
    listed = manifest.withColumn("at", (F.row_number().over(Window.orderBy("part", "seq")) - 1).cast("int"))
    n = max(1, manifest.count())
    return listed.repartitionById(n, "at").select("path", "start").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the given documents; opens only shards whose key range holds one, and reads a few cells of each."""
    found: dict[int, list[np.ndarray]] = {}
    asked = manifest.sparkSession.createDataFrame([(int(k),) for k in set(keys)], "key bigint")
    holds = manifest.join(F.broadcast(asked), F.col("key").between(F.col("least_key"), F.col("greatest_key")))
    for row in holds.select("part", "seq", "path", "key").orderBy("part", "seq").toLocalIterator():
        if got := ShardReader(row["path"], held=False).get(row["key"]):
            found.setdefault(row["key"], []).extend(got)
    return found

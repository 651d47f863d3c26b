"""Token ids in directly addressable codes.

Texts are encoded with a tokenizer of the ``tokenizers`` library, the end id
is appended, and the ids are written in ascending id order into segments of
about ``segment_tokens`` tokens.  A segment splits every id into chunks of
CHUNK bits: level 0 holds the lowest chunk of every id, a continuation bitmap
marks the ids that go on, and level 1 holds the next chunk of those only, and
so on.  A rank directory (ones before every 512 bits) turns position i of a
level into its position on the next, so any token is read from a few bytes
without decoding a block.

Segment layout (little endian): magic, tokens, documents, levels (int64 each);
document ids, their null flags and start positions; per level: count, chunks,
bitmap words, rank directory.

Documents are range-partitioned and sorted by id and a digest of the text
(nulls first), so different texts of one id are spread over tasks; each task writes files of its own and returns their
segments, so a task that is run again leaves only unused files behind.

Defined cases: a null text is empty (its only token is the end id); repeated
rows are repeated; an empty table gives no segment.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import KEPT, Hasher, keep_only, slices
from ._tables import cut, join_path, open_store, shared_folder, text_key

CHUNK = 8
SEGMENT_TOKENS = 1 << 20
SLOTS, MAX_BYTES = 1 << 20, 64 << 20
MAGIC = int.from_bytes(b"DACSEG01", "little")
SEGMENT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                     ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
SEGMENT_DDL = "part int, seg int, file string, offset long, length long, n_docs long, n_tokens long"
READ_DDL = "doc_id long, local long, n_tokens long, ids_crc32 long, part int, seg int"


class Level:
    """One level: chunks, continuation bitmap and rank directory."""

    def __init__(self, chunks: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.chunks, self.words, self.ranks = chunks, words, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        padded = np.zeros(-(-len(more) // 512) * 64, np.uint8)
        bits = np.packbits(more, bitorder="little")
        padded[:len(bits)] = bits
        words = padded.view(np.uint64)
        ones = np.bitwise_count(words).reshape(-1, 8).sum(axis=1, dtype=np.uint64) if len(words) else np.zeros(0, np.uint64)
        return cls(chunks, words, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))

    def goes_on(self, lo: int, hi: int) -> np.ndarray:
        bits = np.unpackbits(self.words[lo >> 6:(hi + 63) >> 6].view(np.uint8), bitorder="little")
        return bits[lo & 63:(lo & 63) + hi - lo].astype(bool)

    def rank(self, i: int) -> int:
        """Ones before position i."""
        block = i >> 9
        n = int(self.ranks[block])
        w = self.words[block << 3:i >> 6]
        n += int(np.bitwise_count(w).sum())
        if i & 63:
            n += int(self.words[i >> 6] & np.uint64((1 << (i & 63)) - 1)).bit_count()
        return n


def pack(ids: np.ndarray) -> list[Level]:
    rest, out = ids.astype(np.uint64), []
    while True:
        high = rest >> np.uint64(CHUNK)
        more = high > 0
        out.append(Level.of((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8), more))
        rest = high[more]
        if not len(rest):
            return out


class Segment:
    """A segment in memory; any token or run of tokens is read directly."""

    def __init__(self, doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray, levels: list[Level]):
        self.doc_ids, self.nulls, self.starts, self.levels = doc_ids, nulls, starts, levels

    def to_bytes(self) -> bytes:
        parts = [np.array([MAGIC, self.starts[-1], len(self.doc_ids), len(self.levels)], np.int64), self.doc_ids.astype(np.int64),
                 self.nulls.astype(np.int64), self.starts.astype(np.int64)]
        for x in self.levels:
            chunks = np.zeros(-(-len(x.chunks) // 8) * 8, np.uint8)
            chunks[:len(x.chunks)] = x.chunks
            ranks = np.zeros(-(-len(x.ranks) // 2) * 2, np.uint32)
            ranks[:len(x.ranks)] = x.ranks
            parts += [np.array([len(x.chunks)], np.int64), chunks, x.words, ranks]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Segment:
        magic, _, docs, levels = np.frombuffer(raw, np.int64, 4)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = 32

        def take(dtype, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, dtype, n, at)
            at += x.nbytes
            return x

        head = [take(np.int64, docs), take(np.int64, docs), take(np.int64, docs + 1)]
        out = []
        for _ in range(levels):
            n = int(take(np.int64, 1)[0])
            chunks = take(np.uint8, -(-n // 8) * 8)[:n]
            words = take(np.uint64, -(-n // 512) * 8)
            ranks = take(np.uint32, -(-(-(-n // 512) + 1) // 2) * 2)
            out.append(Level(chunks, words, ranks))
        return cls(*head, out)

    def token(self, i: int) -> int:
        value = 0
        for k, x in enumerate(self.levels):
            value |= int(x.chunks[i]) << (CHUNK * k)
            if not int(x.words[i >> 6]) >> (i & 63) & 1:
                return value
            i = x.rank(i)
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Ids of positions lo..hi; touches only their bytes on every level."""
        out = np.zeros(hi - lo, np.uint32)
        at = np.arange(hi - lo)
        for k, x in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= x.chunks[lo:hi].astype(np.uint32) << np.uint32(CHUNK * k)
            more = x.goes_on(lo, hi)
            lo, n = x.rank(lo), int(more.sum())
            hi, at = lo + n, at[more]
        return out


class Encoder:
    """Whole texts to ids, remembering the ids of pieces in flat arrays.

    Texts are cut into pieces where the byte-level pre-tokenizer always cuts:
    before a single blank or line break between two other characters, and
    before a mark that follows a Latin letter.  (Near characters that might be
    Unicode blanks there is no cut, which is always right.)  A piece is named
    by the 64-bit hash of its bytes; distinct pieces are encoded once by the
    tokenizer - plain words by its model, the rest as a whole - and their ids
    stay in a pool behind an open-addressing table.  The table is emptied when
    it takes over MAX_BYTES, between slices; it doubles before it is over half full,
    so one text may have any number of pieces.
    """

    _MARKS = b".,;:!?)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = [b for b in range(256) if b not in set(plain)]
        self.symbols = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.is_mark, self.is_letter = np.zeros(256, bool), np.zeros(256, bool)
        self.is_mark[list(self._MARKS)] = True
        self.is_letter[65:91] = self.is_letter[97:123] = True
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.entry = np.full(SLOTS, -1, np.int32)
        self.n = 0
        self.at, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.entry, self.at, self.len, self.pool))

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """First bytes of the pieces."""
        n = len(data)
        p = np.flatnonzero((data == 0x20) | (data == 0x0A) | self.is_mark[data])
        p = p[(p > 0) & (p < n - 1)]
        d = data
        before, after = d[p - 1], d[p + 1]
        mark = self.is_mark[d[p]]
        letter = self.is_letter[before] | ((d[np.maximum(p - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        b2, b3, a2 = d[np.maximum(p - 2, 0)], d[np.maximum(p - 3, 0)], d[np.minimum(p + 2, n - 1)]
        odd_before = ((b2 == 0xC2) & ((before == 0x85) | (before == 0xA0))) | (((b3 == 0xE1) | (b3 == 0xE2) | (b3 == 0xE3)) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A)))
        odd_after = ((after == 0xC2) & ((a2 == 0x85) | (a2 == 0xA0))) | (((after == 0xE1) | (after == 0xE2) | (after == 0xE3)) & ((a2 == 0x80) | (a2 == 0x81) | (a2 == 0x9A)))
        blank = (before > 0x20) & (after > 0x20) & ~odd_before & ~odd_after
        first = np.zeros(n, bool)
        first[p[np.where(mark, letter, blank)]] = True
        edge = off[:-1][np.diff(off) > 0]
        first[edge] = True
        # a blank or line break at the end of a text is not between two characters of that text
        last = off[1:][np.diff(off) > 0] - 1
        tail = last[((d[last] == 0x20) | (d[last] == 0x0A)) & ~np.isin(last, edge)]
        first[tail] = False
        return np.flatnonzero(first)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        todo, slot = np.arange(len(h)), (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(todo):
            e = self.entry[slot]
            hit = (e >= 0) & (self.keys[slot] == h[todo])
            out[todo[hit]] = e[hit]
            on = (e >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """Distinct new pieces."""
        m = len(h)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(len(flat), len(self.pool)), np.uint32)])
        if self.n + m > len(self.at):
            more = np.zeros(max(m, len(self.at)), np.int64)
            self.at, self.len = np.concatenate([self.at[:self.n], more]), np.concatenate([self.len[:self.n], more])
        self.pool[self.used:self.used + len(flat)] = flat
        self.at[self.n:self.n + m] = self.used + np.cumsum(size) - size
        self.len[self.n:self.n + m] = size
        entry = np.arange(self.n, self.n + m, dtype=np.int32)
        self.used, self.n = self.used + len(flat), self.n + m
        if 2 * self.n > len(self.keys):
            held = self.entry >= 0
            old, size = (self.keys[held], self.entry[held]), 1 << (2 * self.n - 1).bit_length()
            self.keys, self.entry = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._put(*old)
        self._put(h, entry)

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(entry):
            free = np.flatnonzero(self.entry[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.entry[slot[put]], self.keys[slot[put]] = entry[put], h[put]
            left = np.ones(len(entry), bool)
            left[put] = False
            h, entry, slot = h[left], entry[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))]).tobytes()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of whole pieces: words of Latin letters by the model, others by the whole tokenizer."""
        out: list[bytes | None] = []
        for p in pieces:
            body = p[1:] if p[0] in " \n" else p
            if body.isalpha() and max(body) < "\u0250":
                out.append(self._model("\n") + self._model(body) if p[0] == "\n" else self._model(p))
            else:
                out.append(None)
        hard = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([pieces[i] for i in hard], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        s = self._starts(data, off)
        h = Hasher(data, lower=False).ranges(s, np.r_[s[1:], len(data)])
        if self.nbytes > MAX_BYTES:
            self.reset()
        found = self._find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            names, first = np.unique(h[new], return_index=True)
            raw, ends = data.tobytes(), np.r_[s[1:], len(data)]
            self._add(names, self._encode([raw[s[i]:ends[i]].decode() for i in new[first]]))
            found[new] = self._find(h[new])
        size = self.len[found]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[found] - (total - size), size) + np.arange(total[-1])]
        row = np.searchsorted(off, s, side="right") - 1
        return ids, np.bincount(row, weights=size, minlength=rows).astype(np.int64)


_ENCODERS: dict[str, Encoder] = KEPT.setdefault("tokens", {})


def encoder(path: str) -> Encoder:
    """One encoder a Python worker: later tasks find its pieces, until another operator takes the worker."""
    keep_only("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, folder: str | None = None,
          segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encode and write all rows in ascending id order; returns the segments."""
    folder = folder or shared_folder(df.sparkSession, "tokens")
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumn("key", text_key(F.col("text"))).repartitionByRange("id", "key").sortWithinPartitions("id", "key").select("id", "text"))

    def put(batches):
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, at, seg, out = f"part-{part:06d}-{uuid.uuid4().hex}.dac", 0, 0, None
        encode = encoder(tokenizer_path)
        held: list[tuple] = []  # (document ids, ids of all texts, number of ids of each)

        def flush():
            nonlocal at, seg, out, held
            if out is None:
                out = fs.open_output_stream(join_path(root, name), compression=None)
            ids, n = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[2] for x in held])
            starts = np.concatenate([[0], np.cumsum(n + 1)])
            tokens = np.full(starts[-1], end_id, np.uint32)
            inside = np.ones(len(tokens), bool)
            inside[starts[1:] - 1] = False
            tokens[inside] = np.concatenate([x[1] for x in held])
            raw = Segment(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), starts, pack(tokens)).to_bytes()
            out.write(raw)
            row = {"part": part, "seg": seg, "file": name, "offset": at, "length": len(raw), "n_docs": len(n), "n_tokens": len(tokens)}
            at, seg, held = at + len(raw), seg + 1, []
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT)

        try:
            for batch in batches:
                for lo, hi, data, off in slices(batch.column(1)):
                    held.append((batch.column(0).slice(lo, hi - lo), *encode(data, off)))
                    if sum(len(x[1]) for x in held) >= segment_tokens:
                        yield flush()
            if held:
                yield flush()
        finally:
            if out is not None:
                out.close()

    return cut(rows.mapInArrow(put, SEGMENT_DDL), "token-segments").withColumn("folder", F.lit(folder))


def read(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def get(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = open_store(row["folder"])
                with fs.open_input_file(join_path(root, row["file"])) as f:
                    f.seek(row["offset"])
                    x = Segment.from_bytes(f.read(row["length"]))
                crc = [zlib.crc32(x.tokens(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(x.starts[:-1], x.starts[1:])]
                n = len(x.doc_ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(x.doc_ids, pa.int64(), mask=x.nulls.astype(bool)), pa.array(x.starts[:-1]), pa.array(np.diff(x.starts)),
                    pa.array(np.array(crc, np.int64)), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seg"], np.int32))],
                    names=["doc_id", "local", "n_tokens", "ids_crc32", "part", "seg"])

    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = segments.repartition(tasks, "file", "seg").select("part", "seg", "folder", "file", "offset", "length").mapInArrow(get, READ_DDL)
    files = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a file
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_tokens")
    base = cut(segments.select("part", "seg", inside.alias("inside")).join(before, "part")
               .select("part", "seg", (F.col("before") + F.col("inside")).alias("base")), "token-bases")
    return docs.join(base, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

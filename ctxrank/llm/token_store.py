"""Token-id files with canonical length-limited Huffman coding (operator 9).

encode_ids tokenizes documents in ascending doc_id order (ties: by text) into parts; the global counts of all
ids give code lengths of at most `limit` bits (package-merge), and the lengths alone give the canonical codes.
write() stores blocks of consecutive documents: first id's position, document ids and lengths, the coded
bits, and the bit offset of every STEP-th id. read() decodes blocks independently by table; all stretches
between checkpoints of a block advance together. The blocks are rows of Parquet files, so any file system
that Spark writes to can hold them and a lost task is simply run again.

Defined results: a null or empty text has only the end id; repeated rows are documents of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BYTE_CHARS, Memo
from .common import free, keyed_text, materialize, ship, small_batches, trimmed

VOCAB = "word_bpe_49k.json"
END = 1
LIMIT = 16
STEP = 256
BLOCK_IDS = 1 << 19
RULES = (["NFC", "Replace", "Lowercase"], [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel"])
#: Letters and digits of Latin-1 after lower-casing; what ODD finds is not split here.
LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
WORD = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{DIGITS}]|[^ \\t-\\r{LETTERS}{DIGITS}]+")  # no letter begins another branch
ODD = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\xff]")
SCHEMA = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
SHOWN = {c: "".join(BYTE_CHARS[b] for b in chr(c).encode()) for c in range(256)}

_tokenizers: dict[str, WordIds] = {}


class WordIds:
    """Ids by the tokenizers library, with equal words encoded once.

    A file with the rules RULES splits text into runs of letters, single digits and runs of other marks, after
    lower-casing. For texts within Latin-1 (normal form and lower case are then plain) the same split is made here and
    the library's model encodes each distinct word; all other texts, those that hold an added token's content in any case,
    and files with other rules, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        normal = [x.get("type") for x in (rules["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex", x["type"]) for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.plain = (normal, split) == RULES and not any(c.isspace() for t in self.added for c in t)
        self.memo = Memo(self._words, 400_000)

    def _words(self, words: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        return [b"".join([t.id.to_bytes(4, "little") for t in tokenize(w if w.isascii() and w.isprintable() else w.translate(SHOWN))]) for w in words]

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if self.plain and not ODD.search(text):
            low = text.lower()
            if not any(t in low for t in self.added):
                return b"".join(self.memo.many(WORD.findall(low)))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits, by package-merge; ties by id."""
    if len(counts) <= 1:
        return dict.fromkeys(counts, 1)
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} ids do not fit codes of {limit} bits")
    ids = sorted(counts, key=lambda i: (counts[i], i))
    weights = np.array([counts[i] for i in ids], dtype=np.float64)
    n = len(ids)
    # Each level's list is leaves and packages in order of weight; only the sources need to be kept.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order)
        merged = merged[order]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    depth, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for order in reversed(levels):
        used = order[:take]
        depth[used[used < n]] += 1
        take = 2 * int((used >= n).sum())
    return dict(zip(ids, depth.tolist()))


class Code:
    """Canonical code: shorter codes first, ids ascending within a length."""

    def __init__(self, lengths: dict[int, int], limit: int = LIMIT):
        self.limit = limit
        size = max(lengths, default=0) + 1
        self.lens, self.codes = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.symbol, self.width = np.zeros(1 << limit, dtype=np.uint32), np.zeros(1 << limit, dtype=np.uint8)
        code, last = 0, 0
        for i in sorted(lengths, key=lambda i: (lengths[i], i)):
            n = lengths[i]
            code <<= n - last
            last = n
            self.lens[i], self.codes[i] = n, code
            at = code << (limit - n)
            self.symbol[at : at + (1 << (limit - n))] = i
            self.width[at : at + (1 << (limit - n))] = n
            code += 1

    def pack(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """Bits of all codes one after the other, and the bit offset of each step-th id."""
        if not len(ids):
            return b"", np.empty(0, dtype=np.int64)
        group = 64 // self.limit
        lens, codes = self.lens[ids], self.codes[ids]
        starts = np.cumsum(lens) - lens
        checkpoints = starts[::step].astype(np.int64)
        total = int(starts[-1] + lens[-1])
        if pad := -len(ids) % group:
            lens, codes = np.pad(lens, (0, pad)), np.pad(codes, (0, pad))
        lens, codes = lens.reshape(-1, group), codes.reshape(-1, group)
        word, width = codes[:, 0], lens[:, 0]
        for k in range(1, group):
            word, width = (word << lens[:, k]) | codes[:, k], width + lens[:, k]
        at = np.cumsum(width) - width
        # A group's bits lie in one or two 64-bit words; the bits of different groups never overlap.
        slot, free = (at >> np.uint64(6)).astype(np.int64), np.uint64(64) - (at & np.uint64(63))
        over = width > free
        left = np.where(over, word >> np.where(over, width - free, 0).astype(np.uint64), word << np.where(over, 0, np.minimum(free - width, 63)).astype(np.uint64))
        out = np.zeros(total // 64 + 2, dtype=np.uint64)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        out[slot[first]] |= np.bitwise_or.reduceat(left, first)
        rest = np.flatnonzero(over)
        out[slot[rest] + 1] |= word[rest] << (np.uint64(64) - (width[rest] - free[rest]))
        return out.astype(">u8").tobytes()[: (total + 7) // 8], checkpoints

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        if not n:
            return np.empty(0, dtype="<u4")
        raw = np.frombuffer(bits + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.zeros((step, len(checkpoints)), dtype="<u4")
        at, full = checkpoints.astype(np.int64).copy(), n % step or step
        shift = np.uint32(32 - self.limit)
        for k in range(step):
            live = at if k < full else at[:-1]
            key = (window[live >> 3] << (live & 7).astype(np.uint32)) >> shift
            out[k, : len(live)] = self.symbol[key]
            live += self.width[key]
        return out.T.reshape(-1)[:n]


def encode_ids(docs: DataFrame, vocab_path: str | None = None, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (part, seq, doc_id, begin, n, ids): documents in order; begin counts ids before it in its part.

    The last row of a part, of seq -1, has the part's ids in n and in ids how often each occurs there.
    """
    path = vocab_path or public_tokenizers.path(VOCAB)
    spark = docs.sparkSession
    ship(spark)
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, words, begin, seq, total = TaskContext.get().partitionId(), word_ids(path), 0, 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = [words.encode_bytes(x.as_py()) + tail for x in batch.column("text")]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            begins = begin + np.cumsum(n) - n
            got = np.bincount(np.frombuffer(b"".join(ids), dtype="<u4"))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
            narrow = [np.frombuffer(x, dtype="<u4") for x in ids]
            narrow = [x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else b"\1" + x.tobytes() for x in narrow]
            rows = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, part)), pa.array(np.arange(seq, seq + rows)), batch.column("doc_id"), pa.array(begins), pa.array(n), pa.array(narrow, pa.binary())], ["part", "seq", "doc_id", "begin", "n", "ids"])
            begin, seq = begin + int(n.sum()), seq + rows
        if seq:
            used = np.flatnonzero(total)
            counts = np.stack([used, total[used]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": -1, "doc_id": None, "begin": 0, "n": begin, "ids": counts}], SCHEMA)

    ordered = keyed_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(spark, 512):
        return materialize(ordered.mapInArrow(trimmed(run), "part bigint, seq bigint, doc_id bigint, begin bigint, n bigint, ids binary"), "ids")


def widen(raw: bytes) -> np.ndarray:
    """Ids of a row of encode_ids: two bytes each, or a mark and four bytes each."""
    return np.frombuffer(raw, dtype="<u2").astype("<u4") if len(raw) % 2 == 0 else np.frombuffer(raw, dtype="<u4", offset=1)


def id_counts(encoded: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                used, n = np.frombuffer(raw.as_py(), dtype="<i8").reshape(-1, 2).T
                if len(used) and used[-1] >= len(total):
                    total = np.pad(total, (0, int(used[-1]) + 1 - len(total)))
                total[used] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = encoded.where("seq < 0").select("ids").mapInArrow(trimmed(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {int(i): int(n) for i, n in counted.toArrow().to_pandas().itertuples(index=False)}


def write(encoded: DataFrame, lengths: dict[int, int], block_ids: int = BLOCK_IDS) -> DataFrame:
    """The written block files: (part, begin, doc_ids, n, checkpoints, bits)."""
    limit = max([LIMIT, *lengths.values()])

    def run(batches):
        code, held = Code(lengths, limit), []

        def block():
            part, begin = held[0][:2]
            bits, checkpoints = code.pack(np.concatenate([widen(x[4]) for x in held]))
            row = ([part], [begin], [[x[2] for x in held]], [[x[3] for x in held]], [checkpoints.tolist()], [bits])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["part", "begin", "doc_ids", "n", "checkpoints", "bits"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "doc_id", "n", "ids"))):
                # A block ends with its part, at a gap, or when it is full.
                if held and (held[-1][0] != row[0] or held[-1][1] + held[-1][3] != row[1] or size >= block_ids):
                    yield block()
                    size = 0
                held.append(row)
                size += row[3]
        if held:
            yield block()

    return materialize(encoded.where("seq >= 0").select("part", "begin", "doc_id", "n", "ids").mapInArrow(trimmed(run), "part bigint, begin bigint, doc_ids array<bigint>, n array<bigint>, checkpoints array<bigint>, bits binary"), "blocks")


def read(blocks: DataFrame, lengths: dict[int, int], offsets: dict[int, int], keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the block files; offsets: ids before each part."""
    limit = max([LIMIT, *lengths.values()])

    def run(batches):
        code = Code(lengths, limit)
        for batch in batches:
            for part, begin, doc_ids, n, checkpoints, bits in zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "doc_ids", "n", "checkpoints", "bits"))):
                n = np.array(n, dtype=np.int64)
                ends = np.cumsum(n)
                ids = code.unpack(bits, np.array(checkpoints, dtype=np.int64), int(ends[-1]))
                parts = [ids[e - k : e].tobytes() for e, k in zip(ends, n)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(offsets[part] + begin + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * keep_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    return blocks.mapInArrow(trimmed(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def store(docs: DataFrame, vocab_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Encodes, writes the coded files and reads them back: (doc_id, start, n_tokens, ids_crc32[, ids])."""
    encoded = encode_ids(docs, vocab_path)
    lengths = code_lengths(id_counts(encoded))
    totals = {r.part: r.n for r in encoded.where("seq < 0").select("part", "n").collect()}  # one row a part
    offsets, total = {}, 0
    for part in sorted(totals):
        offsets[part], total = total, total + totals[part]
    blocks = write(encoded, lengths)
    free(encoded)
    return read(blocks, lengths, offsets, keep_ids)

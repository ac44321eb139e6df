"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches (operator 1).

A rank file lists byte strings with their ids. The merges are all splits of a token into two other tokens,
ordered by the token's rank, which makes the library's BPE give the ids that the ranks define. Bytes stand
as printable characters inside the library (BYTE_CHARS) and are mapped back when decoding.

Defined results: a null text counts as empty and has no ids; equal texts have equal ids; repeated rows stay
as they are; other columns are ignored. Texts of any length are encoded whole. Decoding joins the bytes of
all tokens before reading UTF-8, so a character that is split over several tokens comes out whole; ids that
end inside a character decode to its bytes (decode_bytes) or to U+FFFD (decode).
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import keyed_text, ship, trimmed

RANKS = "byte_bpe_multi_50k.tiktoken"
#: White space other than the ASCII kinds: texts that hold it are encoded in one piece.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
CHUNK = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")


def byte_chars() -> dict[int, str]:
    """Byte -> character: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)}


BYTE_CHARS = byte_chars()


class Memo:
    """Ids of text pieces as bytes; at most `most` pieces of at most `longest` characters are kept, the first ones or (clears) the last."""

    def __init__(self, encode_batch, most: int = 200_000, longest: int = 48, clears: bool = True):
        self.encode_batch, self.most, self.longest, self.clears, self.known = encode_batch, most, longest, clears, {}

    def many(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            new = list({p for p, f in zip(pieces, found) if f is None})
            got = dict(zip(new, self.encode_batch(new)))
            found = [got[p] if f is None else f for p, f in zip(pieces, found)]
            if len(known) + len(got) > self.most and self.clears:
                known.clear()
            if len(known) + len(got) <= self.most:
                known.update((p, x) for p, x in got.items() if len(p) <= self.longest)
        return found


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, rank_path: str, pattern: str = public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        shown = {b: "".join(BYTE_CHARS[x] for x in b) for b in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            cuts = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown[token[:i]], shown[token[i:]]) for *_, i in sorted(cuts)]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[b]: r for b, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in BYTE_CHARS.items()}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in self.tokenizer.get_vocab().items():
            self.bytes_of[rank] = bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.by_words = pattern == public_tokenizers.PATTERN
        self.memo = Memo(self._batch)

    def _batch(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No match of the pattern goes on from a character that is no white space to one that is, so a text
        can be cut there and equal pieces need to be encoded once.
        """
        if not text:
            return b""
        if not self.by_words or ODD_SPACE.search(text):
            return self._batch([text])[0]
        return b"".join(self.memo.many(CHUNK.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point and the one after the last that each token has bytes of."""
        ends = np.cumsum(self.lengths[ids])
        char_of_byte = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
        return char_of_byte[ends - self.lengths[ids]], char_of_byte[ends - 1] + 1

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_pieces(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text as parts of the ids come; bytes of a character that is not yet whole wait for the next part."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield reader.decode(self.decode_bytes(ids))
        yield reader.decode(b"", True)


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """One per worker process."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def encode(docs: DataFrame, vocab_path: str | None = None, with_offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, n_tokens, ids_sha256, decoded_sha256[, starts, ends]) for each document.

    ids holds little-endian unsigned 32-bit integers; starts and ends are code points (end exclusive).
    """
    path = vocab_path or public_tokenizers.path(RANKS)
    ship(docs.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            rows, starts, ends = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                raw = bpe.encode_bytes(text)
                ids = np.frombuffer(raw, dtype="<u4")
                rows.append((raw, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode_bytes(ids.tolist())).hexdigest()))
                if with_offsets:
                    a, b = bpe.offsets(text, ids)
                    starts.append(a.tolist())
                    ends.append(b.tolist())
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            out = [batch.column("doc_id"), pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_offsets:
                out += [pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(out, names)

    more = ", starts array<bigint>, ends array<bigint>" if with_offsets else ""
    return keyed_text(docs, id_col, text_col).mapInArrow(trimmed(run), f"doc_id bigint, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def decode(encoded: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """(doc_id, text) from rows with doc_id and ids; null ids give an empty text."""
    path = vocab_path or public_tokenizers.path(RANKS)
    ship(encoded.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id bigint, text string")

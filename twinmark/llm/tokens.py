"""Byte-level BPE: encoders from local files, whole-text encoding in bounded pieces, raw-byte decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, texts

#: Characters of text that one call of the encoder gets at most, where a safe boundary allows it.
PIECE_CHARS = 1 << 18

#: A place between a character that is no white space and one that is: every match of the pattern ends there.
SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def rank_encoder(rank_path: str, pattern: str):
    """A tiktoken encoder from a local file of ``base64 rank`` lines, without special tokens."""
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes, by the published rule:
    printable Latin-1 bytes stand for themselves, the others take the code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def vocabulary_tokenizer(json_path: str):
    """The ``tokenizers`` object of a local file, as the library reads it: added tokens inside a text keep their ids."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@functools.lru_cache(maxsize=4)
def added_tokens(json_path: str):
    """A pattern of the added tokens of a ``tokenizers`` file, which only the library itself finds; none if it has none."""
    with open(json_path, encoding="utf-8") as file:
        found = [x["content"] for x in json.load(file).get("added_tokens") or [] if x["content"]]
    return re.compile("|".join(map(re.escape, found))) if found else None


@functools.lru_cache(maxsize=4)
def vocabulary_encoder(json_path: str, pattern: str):
    """A fast encoder with the vocabulary of a ``tokenizers`` file, whose ids order its merges; it knows no added tokens."""
    import tiktoken

    with open(json_path, encoding="utf-8") as file:
        spec = json.load(file)
    symbols, special = byte_symbols(), {x["content"] for x in spec.get("added_tokens", []) if x.get("special")}
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: the pattern that the byte-level pre-tokenizer of ``tokenizers`` splits by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def same_ids(json_path: str, pattern: str) -> bool:
    """Whether ``vocabulary_encoder`` gives the library's ids for every text without an added token, proven from the file.

    Both repeat the lowest-ranked merge.  The library merges listed pairs only, in the order of the list; the encoder
    merges whatever two neighbours make a token, in the order of ids.  They agree if the file splits texts by ``pattern``
    and changes them in no other way, knows all bytes, lists merges in the order of the ids they make, and its merges
    alone turn the text of every token into that token.  For the first merge in which they differed would join two
    neighbours to a token whose own text the listed merges leave in those two parts.
    """
    from tokenizers import Tokenizer

    with open(json_path, encoding="utf-8") as file:
        spec = json.load(file)
    model, symbols, special = spec["model"], byte_symbols(), {x["content"] for x in spec.get("added_tokens") or []}
    split = spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")) and not any(spec.get(x) for x in ("normalizer", "truncation", "padding"))
    bytewise = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and pattern == BYTE_LEVEL
    vocab = {token: i for token, i in model["vocab"].items() if token not in special}
    if not (plain and bytewise and all(s in vocab for s in symbols) and all(c in symbols for token in vocab for c in token)):
        return False
    made = [vocab.get("".join(pair.split(" ") if isinstance(pair, str) else pair), -1) for pair in model["merges"]]
    if made != sorted(set(made)) or -1 in made:
        return False
    found = Tokenizer(vocabulary_tokenizer(json_path).model).encode_batch(list(vocab), add_special_tokens=False)
    return all(x.ids == [i] for x, i in zip(found, vocab.values(), strict=True))


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts a long text where every encoding has a boundary anyway; a stretch without one stays whole.

    No match of the pattern goes on from a character that is no white space into white space, and nothing
    looks behind, so encoding the pieces one by one gives the ids of the whole.
    """
    start = 0
    while len(text) - start > most:
        found = SAFE.search(text, start + most)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(encoder, text: str | None) -> list[int]:
    """Ids of a whole text; null counts as empty."""
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids += encoder.encode_ordinary(piece)
    return ids


def id_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def decode(encoder, ids) -> bytes:
    """Raw bytes of ids; no text decoding, so ids that split a character survive."""
    return encoder.decode_bytes(list(ids))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns one row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, ids
    (array<int>) and decoded (binary).  Null and empty texts give zero tokens and the digests of nothing.
    A null doc_id is passed through; repeated rows give repeated results; other columns are ignored.
    The work is one narrow pass: no shuffle, memory bounded by an Arrow batch.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(rank_path, pattern)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                ids = encode(encoder, text.as_py())
                raw = decode(encoder, ids)
                row = (len(ids), hashlib.sha256(id_bytes(ids)).hexdigest(), hashlib.sha256(raw).hexdigest(), ids, raw)
                for column, value in zip(columns, row if keep_ids else row[:3], strict=False):
                    column.append(value)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_slices(texts(docs, id_col, text_col), run, schema)

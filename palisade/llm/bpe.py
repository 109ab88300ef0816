"""BPE encoding and decoding of whole texts through a table of distinct words.

A word is a run of white space with the run of other characters after it. A byte-level
BPE of this kind never merges across the end of such a run, nor does its splitting look
past it, so a text's ids are those of its words end to end. Each distinct word is encoded
once; documents get the ids back by position. Decoding looks every id up in the table of pieces,
whose size the vocabulary fixes, and joins the bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bucket, text_or_empty
from .dictionary import BUCKET_WORDS, Ragged, distinct_words, look_up, word_table

_WORDS = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")
#: White space beyond ASCII, in UTF-8 and as characters: it may not end a word before more white space.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = " \t-\r\x85\xa0  -     　"
_WIDE_WORDS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+\\Z")


def words(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8; joined they give it back."""
    if _WIDE.search(raw):
        return [x.encode() for x in _WIDE_WORDS.findall(raw.decode("utf-8", "replace"))]
    return _WORDS.findall(raw)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_model(path: str) -> None:
    """Raises where the tokenizer's words could depend on what stands before or after them."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    stray = [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])]
    if not plain or stray:
        raise ValueError("only byte-level tokenizers without normalizer, prefix space or reaching added tokens can be encoded by words")


def pieces(path: str) -> Ragged:
    """The bytes of each id, in order of ids: the table that decoding joins with."""
    from tokenizers import Tokenizer

    model, byte_of = Tokenizer.from_file(path), _byte_of()
    rows = []
    for i in range(model.get_vocab_size(with_added_tokens=True)):
        piece = model.id_to_token(i) or ""
        rows.append(bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode())
    return Ragged.of(rows, np.uint8)


def encode_decode(df: DataFrame, path: str, text: str = "text", words_per_bucket: int = BUCKET_WORDS, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256 (UTF-8) of every row.

    Null texts count as empty: no ids. Repeated rows each get their row; other columns are not read. ``path``
    names the tokenizer's file, which all workers can read.
    """
    check_model(path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    raw = df.select("doc_id", text_or_empty(text).cast("binary").alias("text"))
    buckets = bucket(distinct_words(raw.select("text"), bytes.split), words_per_bucket)  # near enough, for how many buckets there are

    def ids_of(found: list[bytes], _) -> Ragged:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = _tokenizer(path)
        rows = [e.ids for i in range(0, len(found), 2048) for e in model.encode_batch([w.decode("utf-8", "replace") for w in found[i : i + 2048]], add_special_tokens=False)]
        return Ragged.of(rows)

    table = word_table(raw.select("text"), words, ids_of, buckets)
    piece_table = df.sparkSession.sparkContext.broadcast(pieces(path))

    def prepare():
        return lambda texts, questions: ([words(x) for x in texts], [0.0] * len(texts))

    def finish():
        by_id = piece_table.value

        def end(doc_ids, numbers, codes, answers):
            counts, hashes, texts = [], [], []
            for at in codes:
                ids = answers.take(at).flat
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded = by_id.take(ids.astype(np.int64)).flat.tobytes()
                texts.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return end

    return look_up(
        raw, table, buckets, prepare, finish,
        f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", **how,
    )


_LOADED: dict = {}


def _tokenizer(path: str):
    """The tokenizer of this worker; truncation and padding off."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        _LOADED[path] = model
    return _LOADED[path]

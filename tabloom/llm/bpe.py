"""Byte-level BPE: encoding with tiktoken and a local rank file, decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_of

#: Code points that one call of the tokenizer gets, unless no safe place to cut comes.
PIECE = 50_000
#: Longest run of white space that the pattern sees; longer ones are cut by hand.
RUN = 10_000
#: Between a letter or digit and ASCII white space or punctuation other than an
#: apostrophe, no match of the pattern goes on, and none looks back.
SAFE = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ一-鿿ぁ-ゖァ-ヺ가-힣](?=[ \n\t.,;:!?)\]}、。])")
LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN},}}")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text whose encodings, one after the other, are the encoding of the text."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode(encoding: tiktoken.Encoding, text: str) -> Iterator[list[int]]:
    """Ids of a text, part by part.

    A very long run of white space would exhaust the pattern engine's backtracking. The
    pattern takes all of it but the last character, which stays for what follows, as one
    match (all of it at the end of the text), so that match is encoded directly.
    """
    for part in pieces(text):
        start = 0
        for run in LONG_RUN.finditer(part):
            end = run.end() if run.end() == len(part) else run.end() - 1
            yield encoding.encode_ordinary(part[start : run.start()])
            yield encoding._encode_single_piece(part[run.start() : end])
            start = end
        yield encoding.encode_ordinary(part[start:])


def encode_documents(
    df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, with_digests: bool = True
) -> DataFrame:
    """One row per row of ``df``: key, n_tokens, digests of ids and decoded bytes.

    ``ranks`` is a rank file on the driver; its content (about a megabyte: one line for
    each of the vocabulary's entries) goes to the tasks as a broadcast, so executors need
    no file. Without special tokens: their strings in a text are ordinary text. With
    ``with_ids`` the ids are added as an array. The ids are decoded to bytes and the
    bytes' digest returned; a lone byte of a character stays as it is.

    Null or empty text: no token, digests of nothing. Null keys and repeated rows: kept,
    one row each. Other columns are ignored. Long texts are cut at places where
    the pattern's matches end anyway; memory is that of the longest text.
    """
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(Path(ranks).read_bytes())
    kind = df.schema[key].dataType
    fields = f"{key} {kind.simpleString()}, n_tokens long" + ", ids_sha256 string, decoded_sha256 string" * with_digests + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(content.value, pattern)
        for batch in batches:
            # A few rows at a time: one batch may hold many long texts.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, of_ids, of_bytes, ids = [], [], [], []
                for value in part.column(1):
                    n, all_ids, first = 0, [], True
                    a, b = hashlib.sha256(), hashlib.sha256()
                    for some in encode(encoding, value.as_py()):
                        if not some:
                            continue
                        n += len(some)
                        if with_digests:
                            a.update(("" if first else ",").encode() + ",".join(map(str, some)).encode())
                            b.update(encoding.decode_bytes(some))
                        if with_ids:
                            all_ids += some
                        first = False
                    counts.append(n)
                    of_ids.append(a.hexdigest())
                    of_bytes.append(b.hexdigest())
                    ids.append(all_ids)
                out = [part.column(0), pa.array(counts, pa.int64())]
                out += [pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())] * with_digests
                out += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
                names = [key, "n_tokens", *["ids_sha256", "decoded_sha256"] * with_digests, *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select(F.col(f"`{key}`").alias(key), text_of(text).alias("_tl_text")).mapInArrow(work, fields)


def decode_documents(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, payload): the raw bytes of an id array; null or empty ids give no bytes.

    Raises on an id that the rank file lacks.
    """
    content = df.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(content.value, pattern)
        for batch in batches:
            out = pa.array([encoding.decode_bytes(x.as_py() or []) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, "payload"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").cast("array<int>").alias("_tl_ids")).mapInArrow(work, f"{key} {kind}, payload binary")

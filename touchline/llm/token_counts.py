"""Token counts: batch encoding inside an Arrow function that returns lengths only.

A task gathers texts until the next would take a batch above ``batch_bytes`` of UTF-8
and encodes the batch at once. Texts above ``piece_chars`` are cut at safe boundaries,
so one very long text neither fills a batch beyond its bound nor is cut short.

A cut is safe in front of a space that follows another character than a space. No
piece of the vocabulary holds a space mark behind another character (this is checked
when the model is loaded), so no merge ever crosses such a place. The cut drops that
space, because the encoder puts one space mark in front of each text it is given. A
text without such a space stays whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
MARK = "▁"


def load_model(model: str):
    """``model`` is a path, or a name that ``public_tokenizers`` knows."""
    import sentencepiece

    if not os.path.exists(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    encoder = sentencepiece.SentencePieceProcessor(model_file=model)
    inner = re.compile(f"[^{MARK}]{MARK}")
    encoder.can_split = not any(
        inner.search(encoder.id_to_piece(i)) for i in range(encoder.get_piece_size())
    )
    return encoder


def pieces(text: str, piece_chars: int) -> Iterator[str]:
    """The text cut at safe boundaries, each part at least ``piece_chars`` long but the
    last; the parts' token counts add up to that of the text."""
    start = 0
    while len(text) - start > piece_chars:
        cut = text.find(" ", start + piece_chars)
        while cut != -1 and text[cut - 1] in (" ", MARK):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut == len(text) - 1:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:] if start else text


def batches(texts: Iterator[str | None], can_split: bool, batch_bytes: int, piece_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """(places of the texts, parts of them) to be encoded at once: at most ``batch_bytes``
    of UTF-8 together, unless a single part is larger. Null and empty texts have no part."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for part in pieces(text, piece_chars) if can_split else (text,):
            size = len(part) if part.isascii() else len(part.encode())
            if parts and held + size > batch_bytes:
                yield owners, parts
                owners, parts, held = [], [], 0
            owners.append(i)
            parts.append(part)
            held += size
    if parts:
        yield owners, parts


def token_counts(
    docs: DataFrame,
    model: str = MODEL,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 20,
    piece_chars: int = 1 << 15,
) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens), without begin, end or other added tokens.

    Null and empty texts have no bytes and no tokens. A null id stays null. Repeated
    rows are counted each. An empty table gives an empty result. Other columns of the
    input are not read, whatever their names.
    """
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_model(model)
        for rows in tables:
            n_bytes = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
            n_tokens = [0] * rows.num_rows
            texts = (value.as_py() for value in rows.column(1))
            for owners, parts in batches(texts, encoder.can_split, batch_bytes, piece_chars):
                for owner, ids in zip(owners, encoder.encode(parts, num_threads=1), strict=True):
                    n_tokens[owner] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    n_bytes,
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(count, schema)

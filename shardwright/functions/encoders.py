"""Token encoders and decoders as column expressions.

The default ``byte`` encoder maps a text to its UTF-8 bytes (ids 0..255) and
runs entirely in the JVM: ``hex`` of the UTF-8 encoding, split into pairs,
``conv`` back to integers.  Any other encoder is a Python callable
``str -> list[int]`` applied with an Arrow-batched pandas UDF (the encoder is
built once per Python worker).  Special tokens are never interpreted.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BOS_ID

SLICE_BYTES = 1 << 21  # UTF-8 of texts that are encoded together


def byte_length(text: Column) -> Column:
    """Number of byte tokens of a text (without the delimiter)."""
    return F.octet_length(text)


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes of ``text`` as array<int> (JVM only, linear time)."""
    n = F.octet_length(text)
    pairs = F.split(F.hex(F.encode(text, "UTF-8")), r"(?<=\G..)")
    # the split leaves one empty trailing element; keep exactly n pairs
    pairs = F.slice(pairs, 1, n)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def with_delimiter(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(BOS_ID)), tokens)


def encode_document(text: Column, encoder: str | Callable = "byte") -> Column:
    """Delimiter first, then the text tokens."""
    if encoder == "byte":
        return with_delimiter(byte_tokens(text))
    return with_delimiter(python_encoder_udf(encoder)(text))


def python_encoder_udf(encode: Callable[[str], list[int]]):
    """Wrap a per-text encoder in an Arrow-batched pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.IntegerType(), containsNull=False))
    def _enc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: list(encode(s)))

    return _enc


def byte_decode(tokens: Column) -> Column:
    """Inverse of the byte encoder: array<int> -> string.

    Bytes that are not valid UTF-8 (a span cut inside a character) give null,
    never a silently altered text.
    """
    hexed = F.concat_ws("", F.transform(tokens, lambda t: F.lpad(F.hex(t), 2, "0")))
    return F.try_validate_utf8(F.unhex(hexed).cast("string"))


def text_slices(texts, most_bytes: int = SLICE_BYTES):
    """Consecutive slices of an Arrow string column, of at most ``most_bytes`` of UTF-8 or one text.

    Yields (first row, rows, byte offsets of the slice's texts from 0, their bytes); null is empty.
    What is made from a slice is bounded however many or long the texts of a batch are.
    """
    import numpy as np
    import pyarrow as pa

    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n, (_, at, data) = len(texts), texts.buffers()
    if not n:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, count=texts.offset + n + 1)[texts.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        stop = max(int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1, first + 1)
        yield first, stop - first, offsets[first:stop + 1] - offsets[first], raw[offsets[first]:offsets[stop]]
        first = stop


def byte_tokenize_frame(df, text_col: str = "text", out_col: str = "tokens", drop_text: bool = True):
    """Byte encoder over Arrow batches (``mapInArrow``), a bounded slice of texts at a time.

    The UTF-8 bytes of a string column already sit in the Arrow data buffer,
    and its offsets are the document borders; the delimiter is inserted in
    front of every document with one vectorised ``numpy.insert``.  No per-row
    Python, no per-character JVM work.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = [f for f in df.schema.fields if not (drop_text and f.name == text_col)]
    out_schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.IntegerType(), False))])
    keep_names = [f.name for f in keep]

    def run(batches):
        for b in batches:
            for first, n, rel, raw in text_slices(b.column(b.schema.get_field_index(text_col))):
                if len(raw) + n > np.iinfo(np.int32).max:
                    raise ValueError(f"a text of {len(raw)} tokens; an Arrow list holds {np.iinfo(np.int32).max}")
                toks = np.insert(raw.astype(np.int32), rel[:-1], BOS_ID)
                new_offs = (rel + np.arange(n + 1)).astype(np.int32)
                cols = [b.column(b.schema.get_field_index(c)).slice(first, n) for c in keep_names]
                cols.append(pa.ListArray.from_arrays(pa.array(new_offs, pa.int32()), pa.array(toks, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=keep_names + [out_col])

    return df.mapInArrow(run, out_schema)


def byte_decode_frame(df, tokens_col: str = "tokens", out_col: str = "text", drop_tokens: bool = True):
    """Byte decoder over whole Arrow batches: the token list's values are the
    bytes and its offsets the borders.  A row that is not valid UTF-8 (a
    span cut inside a character) or holds an id that is no byte becomes null,
    never an altered text."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = [f for f in df.schema.fields if not (drop_tokens and f.name == tokens_col)]
    out_schema = T.StructType(keep + [T.StructField(out_col, T.StringType())])
    keep_names = [f.name for f in keep]

    def run(batches):
        for b in batches:
            lst = b.column(b.schema.get_field_index(tokens_col))
            n = len(lst)
            offs = np.asarray(lst.offsets, dtype=np.int64)
            vals = np.asarray(lst.values.fill_null(0), dtype=np.int64) if len(lst.values) else np.zeros(0, np.int64)
            vals = vals[offs[0]:offs[-1]]
            raw = vals.astype(np.uint8).tobytes()
            rel = (offs - offs[0]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(rel.tobytes()), pa.py_buffer(raw)])
            try:
                text = binary.cast(pa.string())
            except (pa.ArrowInvalid, UnicodeDecodeError):
                out = []
                for v in binary.to_pylist():
                    try:
                        out.append(v.decode("utf-8"))
                    except UnicodeDecodeError:
                        out.append(None)
                text = pa.array(out, pa.string())
            odd = np.searchsorted(rel, np.flatnonzero((vals < 0) | (vals > 255)), "right") - 1
            no_text = np.asarray(lst.is_null()).copy()
            no_text[odd] = True
            if no_text.any():
                text = pa.compute.if_else(pa.array(no_text), pa.scalar(None, pa.string()), text)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep_names]
            yield pa.RecordBatch.from_arrays(cols + [text], names=keep_names + [out_col])

    return df.mapInArrow(run, out_schema)

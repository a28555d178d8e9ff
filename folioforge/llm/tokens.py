"""Sizes of texts in tokens of a public tokenizer, whose files stay where they are."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import spread

TOKENIZERS = "/opt/tokenizers"
_LOADED: dict[str, object] = {}


def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level tokenizer of ``folder/name``, loaded once a process."""
    path = f"{folder}/{name}"
    if path not in _LOADED:
        import tiktoken

        spec = importlib.util.spec_from_file_location("_tokenizer_files", f"{folder}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _LOADED[path] = tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_sizes(df: DataFrame, id_col: str, text_col: str, keep: list[str] = (), folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, keep..., n_tokens) of every row; null and empty texts have 0 tokens."""
    cols = [id_col, *keep]
    rows = spread(df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)], F.col(text_col).cast("string").alias("text")))
    names = [f"k{i}" for i in range(len(cols))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64())], [*names, "n_tokens"])

    sized = rows.mapInArrow(size, f"{schema}, n_tokens long")
    return sized.select(*[F.col(n).alias(c) for n, c in zip(names, cols)], "n_tokens")

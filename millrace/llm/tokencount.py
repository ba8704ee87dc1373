"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Each token covers a range of the text's bytes; sections are consecutive ranges
of the same text. Both lists are sorted, so they are joined by one binary search per token. A token that lies across a
boundary goes to one section by an explicit rule:

    first  the section of its first byte (default)
    last   the section of its last byte
    most   the section with most of its bytes; of equal shares the earlier

So section counts always add up to the document's count. A token that ends inside a character (byte-level tokens may) is
placed by bytes, without rounding. Offsets in results are in characters.

Sections of a document are its lines with their newline, or given fields joined by a newline. Null and empty texts are
one empty section with no tokens. Very long texts are encoded whole. Rows that repeat an id, or have none, are counted each.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")

SCHEMA = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
_NAMES = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]


@cache
def encoder(path: str):  # noqa: ANN201
    """The encoding of a rank file, and each id's number of bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("millrace", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section. `ends` are the tokens' byte ends, `bounds` the sections' ends."""
    count = bounds.size
    if not ends.size:
        return np.zeros(count, np.int64), np.zeros(count, np.int64)
    starts = np.append(0, ends[:-1])
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    own = last if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for k in crossing.tolist():
            s = np.arange(first[k], last[k] + 1)
            lo = np.maximum(starts[k], np.append(0, bounds)[s])
            own[k] = s[np.argmax(np.minimum(ends[k], bounds[s]) - lo)]
    return np.bincount(own, minlength=count), np.bincount(own[crossing], minlength=count)


def _sections(docs: DataFrame, path: str, rule: str) -> DataFrame:
    """`docs` has doc_id, text and cuts: null for lines, else the sections' byte ends but the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(path)
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in _NAMES]
                for key, text, cuts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "cuts")), strict=True):
                    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                    inner = np.flatnonzero(raw == 10) + 1 if cuts is None else np.array(cuts, np.int64)
                    if cuts is None and inner.size and inner[-1] == raw.size:
                        inner = inner[:-1]
                    bounds = np.append(inner, raw.size)
                    ids = encoding.encode_ordinary(text)
                    counts, crossing = attribute(np.cumsum(sizes[ids]) if ids else np.zeros(0, np.int64), bounds, rule)
                    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[bounds]
                    columns = (np.full(bounds.size, 0), np.arange(bounds.size), np.append(0, chars[:-1]), chars, counts, crossing)
                    for column, values in zip(out, columns, strict=True):
                        column.append(values)
                    out[0][-1] = [key] * bounds.size
                if out[0]:
                    ids_column = pa.array([k for keys in out[0] for k in keys], pa.int64())
                    rest = [pa.array(np.concatenate(c)) for c in out[1:]]
                    yield pa.record_batch([ids_column, rest[0].cast(pa.int32()), *rest[1:]], _NAMES)

    return docs.mapInArrow(run, SCHEMA)


def section_counts(docs: DataFrame, path: str | None = None, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of each document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lit(None).cast("array<bigint>").alias("cuts")
    )
    return _sections(rows, path or public_tokenizers.path(VOCABULARY), rule)


def field_counts(df: DataFrame, fields: list[str], path: str | None = None, rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """A row for each field, numbered in the given order; fields are joined by a newline, which belongs to the earlier one."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    sizes = [F.octet_length(t) + 1 for t in texts[:-1]]
    cuts = [sum(sizes[1 : k + 1], sizes[0]).cast("bigint") for k in range(len(sizes))]
    rows = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.concat_ws("\n", *texts).alias("text"), (F.array(*cuts) if cuts else F.array().cast("array<bigint>")).alias("cuts")
    )
    return _sections(rows, path or public_tokenizers.path(VOCABULARY), rule)

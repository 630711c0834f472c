"""Token counts of sections by offset mapping (operator 8).

A whole document is encoded once.  The character span of every token follows
from the byte lengths of the ids, and an interval join of token spans with
section spans (both sorted, so two binary searches a token) says which sections
a token touches.  Counting sections by encoding them alone would give other
tokens at the edges; here every token of the document is counted exactly once.

Rule for a token that touches several sections, or a section and the text
outside: ``majority`` gives it to the section with most of its characters (the
earlier on ties), ``start`` to the first that it touches, ``end`` to the last.  A
token that touches no section is outside.  A token that holds part of a
character's bytes has that character in its span.

Sections are given as an array of (start, end) code point offsets, disjoint, or,
by default, are the non-empty lines of the text.  Defined results: a null text
has no tokens; null sections are none; a section beyond the text's end is cut
there; empty and reversed sections get no tokens but keep their place; sections
that overlap fail the job.  Repeated rows give repeated rows; further columns are
ignored; the table may be empty.  A text is one row and never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.byte_bpe import codec, read_ranks, serialise_model
from lodestar.llm.common import as_bytes, column, ship_library, steps, table

RULES = ("majority", "start", "end")


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point spans [start, end) of tokens of those byte lengths, and the code point index of each byte."""
    ends = np.cumsum(lengths)
    index = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) - 1
    return index[ends - lengths], index[ends - 1] + 1, index


def line_spans(raw: bytes, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty lines, without their line feeds."""
    feeds = index[np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)]
    starts, ends = np.concatenate([[0], feeds + 1]), np.concatenate([feeds, [index[-1] + 1 if len(index) else 0]])
    return starts[ends > starts], ends[ends > starts]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """The section of each token (-1: outside), and how many tokens cross an edge.  Sections: sorted, disjoint, not empty."""
    if not len(starts):
        return np.full(len(first), -1), 0
    lo = np.searchsorted(ends, first, side="right")  # the first section that ends after the token's start
    hi = np.searchsorted(starts, last, side="left")  # after the last section that starts before its end
    touched = hi - lo
    inside = (touched == 1) & (starts[np.minimum(lo, len(starts) - 1)] <= first) & (last <= ends[np.minimum(lo, len(ends) - 1)])
    out = np.where(touched <= 0, -1, np.where(rule == "end", hi - 1, lo))
    if rule == "majority":
        for t in np.flatnonzero(touched > 1):
            s = np.arange(lo[t], hi[t])
            common = np.minimum(ends[s], last[t]) - np.maximum(starts[s], first[t])
            out[t] = s[np.argmax(common)]
    return out, int(((touched > 0) & ~inside).sum())


def section_tokens(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "majority") -> DataFrame:
    """id, n_tokens, n_sections, n_crossing, n_outside, section_tokens (array<long>, in the order of the sections).

    A map over the rows: no shuffle.  ``sections_col``: array of structs with start and end.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship_library(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))
    id_type = df.schema[id_col].dataType.simpleString()
    given = [f"transform(`{sections_col}`, s -> named_struct('start', CAST(s.start AS LONG), 'end', CAST(s.end AS LONG))) AS sections"] if sections_col else []

    def run(batches):
        c = codec(model.value, pattern)
        for b in steps(batches, "text"):
            encoded = c.encode([t or "" for t in column(b, "text").to_pylist()])
            asked = column(b, "sections").to_pylist() if sections_col else [None] * b.num_rows
            rows = [_count(raw or b"", c.lengths[np.frombuffer(ids, dtype="<u4")], sections, bool(sections_col), rule) for raw, ids, sections in zip(as_bytes(b, "text"), encoded, asked)]
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([column(b, "id"), *counts, pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names)

    names = ["id", "n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens"]
    cols = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", *given)
    schema = f"id {id_type}, n_tokens long, n_sections long, n_crossing long, n_outside long, section_tokens array<long>"
    return cols.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _count(raw: bytes, lengths: np.ndarray, sections: list | None, given: bool, rule: str) -> tuple:
    first, last, index = token_spans(raw, lengths)
    if given:
        n_chars = int(index[-1]) + 1 if len(index) else 0
        spans = [(0, 0) if s is None or s["start"] is None or s["end"] is None else (max(0, s["start"]), min(n_chars, s["end"])) for s in sections or []]
        order = [i for i in sorted(range(len(spans)), key=lambda i: spans[i]) if spans[i][1] > spans[i][0]]
        starts, ends = np.array([spans[i][0] for i in order], dtype=np.int64), np.array([spans[i][1] for i in order], dtype=np.int64)
        if (starts[1:] < ends[:-1]).any():
            raise ValueError("sections overlap")
        n, place = len(spans), np.array(order, dtype=np.int64)
    else:
        starts, ends = line_spans(raw, index)
        n, place = len(starts), np.arange(len(starts))
    section, crossing = attribute(first, last, starts, ends, rule)
    counts = np.zeros(n, dtype=np.int64)
    counts[place] = np.bincount(section[section >= 0], minlength=len(starts))
    return len(lengths), n, crossing, int((section < 0).sum()), counts.tolist()


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as pt

    return section_tokens(table(spark, sf_dir, "documents"), pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN)


QUERIES = {"op8_token_counts": op8_token_counts}

"""Token counts per section by offset mapping.

A document is encoded once, whole.  Token character spans are then joined with
the document's sections (character intervals) by their order: spans and sections
of a document sit in the same row, so the interval join is a binary search in
the task that encoded it and shuffles nothing.

A token that crosses a section border is allocated by ``rule``:

* ``first``: to the section that holds its first character;
* ``most``: to the section with most of its characters, the earlier one on ties;
* ``share``: to every section by its share of the token's covered characters.

Tokens outside all sections, and tokens of no characters, count for section -1.
Defined results: a null text has no tokens and only empty sections; sections
must be sorted and disjoint (``line_sections`` and ``field_sections`` are),
empty ones get 0; repeated rows are counted one by one; an empty table gives an
empty result; the other columns pass through.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_slices, session_of, text_slices
from .token_files import WordEncoder

#: Texts whose spans are worked on together have about so many bytes.
SPAN_BYTES = 4 << 20
RULES = ("first", "most", "share")
SECTION = "array<struct<start: int, stop: int>>"


def line_sections(text: Column) -> Column:
    """Sections of the lines of a text (a line keeps its line break)."""
    lengths = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.char_length(x) + 1)
    ends = F.aggregate(lengths, F.array().cast("array<int>"),
                       lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    return F.transform(F.arrays_zip(ends.alias("e"), lengths.alias("n")),
                       lambda x: F.struct((x["e"] - x["n"]).alias("start"), x["e"].alias("stop"))).cast(SECTION)


def field_sections(*fields: Column, glue: str = "\n") -> tuple[Column, Column]:
    """One text made of several fields, and the sections of its fields."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    sections, at = [], F.lit(0)
    for p in parts:
        sections.append(F.struct(at.alias("start"), (at + F.char_length(p)).alias("stop")))
        at = at + F.char_length(p) + len(glue)
    return F.concat_ws(glue, *parts), F.array(*sections).cast(SECTION)


def allocate(starts: np.ndarray, stops: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section (the last entry: none) from sorted token spans and disjoint sections."""
    n = len(sections)
    out = np.zeros(n + 1)
    if not len(starts):
        return out
    if not n:
        out[-1] = len(starts)
        return out
    lo, hi = sections[:, 0], sections[:, 1]
    first = np.searchsorted(hi, starts, "right")  # the first section that ends behind the token's start
    if rule == "first":
        safe = np.minimum(first, n - 1)
        home = np.where((first < n) & (lo[safe] <= starts) & (stops > starts), safe, n)
        return np.bincount(home, minlength=n + 1).astype(float)
    last = np.searchsorted(lo, stops, "left") - 1  # the last section that begins before its end
    whole = first >= last
    safe = np.minimum(first, n - 1)
    cover = np.minimum(stops, hi[safe]) - np.maximum(starts, lo[safe])
    out += np.bincount(np.where((first < n) & (cover > 0), safe, n)[whole], minlength=n + 1)
    for k in np.flatnonzero(~whole):  # tokens over a border: few
        at = np.arange(first[k], last[k] + 1)
        cover = np.maximum(0, np.minimum(stops[k], hi[at]) - np.maximum(starts[k], lo[at]))
        if not cover.sum():
            out[-1] += 1
        elif rule == "most":
            out[at[np.argmax(cover)]] += 1
        else:
            out[at] += cover / cover.sum()
    return out


class WordSpans(WordEncoder):
    """Token character spans of whole texts, each distinct word encoded once (see ``WordEncoder``)."""

    PER_TOKEN = 2

    def _held(self, ids: np.ndarray, spans: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return spans - np.repeat(starts, counts)[:, None].astype(np.int32)

    def joined_spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans in the texts joined by line breaks (one behind each), first token and first character of each text."""
        inside, per_word, borders, blank = self.gathered(texts)
        chars = joined_characters(texts)
        sizes = pc.utf8_length(texts.fill_null("")).to_numpy().astype(np.int64) + 1
        begins = np.concatenate([[0], np.cumsum(sizes)])
        space = (chars == 32) | (chars >= 9) & (chars <= 13)
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(chars) else chars
        spans = inside.astype(np.int64) + np.repeat(starts, per_word[~blank])[:, None]
        ends = np.concatenate([[0], np.cumsum(per_word)])[borders]
        self._check(texts, lambda k: (spans[ends[k]:ends[k + 1]] - begins[k]).tobytes(),
                    lambda t: self.whole_spans([t])[0].tobytes())
        return spans, ends, begins

    def spans(self, texts: list[str | None]) -> list[np.ndarray]:
        spans, ends, begins = self.joined_spans(pa.array(texts, pa.string()))
        return [spans[a:b] - at for a, b, at in zip(ends, ends[1:], begins)]

    def whole_spans(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.offsets, np.int64).reshape(-1, 2)
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def joined_characters(texts: pa.Array) -> np.ndarray:
    """Code points of all texts, a line break behind each."""
    return np.frombuffer("".join(f"{t or ''}\n" for t in texts.to_pylist()).encode("utf-32-le"), "<u4")


#: The coder of the last definition, kept from task to task while Spark reuses the worker.
_KEPT: dict[str, WordSpans] = {}


def _coder(definition: str) -> WordSpans:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if definition not in _KEPT:
        _KEPT.clear()
        _KEPT[definition] = WordSpans(definition)
    return _KEPT[definition]


def _counted(rows: pa.Array, definition: str, rule: str, word_by_word: bool) -> pa.Array:
    coder, spans, at = _coder(definition), rows.field("sections"), 0
    borders = spans.offsets.to_numpy()
    pairs = np.stack([spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
    totals, sizes, number, bounds, counts = [], [], [], [], []
    for texts in text_slices(rows.field("text")):
        tokens = coder.spans(texts) if word_by_word else coder.whole_spans([t or "" for t in texts])
        for k, found in enumerate(tokens, at):
            own = pairs[borders[k]:borders[k + 1]]
            shares = allocate(found[:, 0], found[:, 1], own, rule)
            rest = int(shares[-1] > 0)
            totals.append(len(found))
            sizes.append(len(own) + rest)
            number.append(np.concatenate([np.arange(len(own)), np.full(rest, -1)]))
            bounds.append(np.concatenate([own, np.full((rest, 2), -1)]))
            counts.append(shares[:len(own) + rest])
        at += len(texts)
    join = lambda parts, empty: np.concatenate(parts) if parts else empty
    number, counts = join(number, np.empty(0)).astype(np.int32), join(counts, np.empty(0))
    bounds = join(bounds, np.empty((0, 2))).astype(np.int32)
    none = number < 0
    entries = pa.StructArray.from_arrays(
        [pa.array(number), pa.array(bounds[:, 0], mask=none), pa.array(bounds[:, 1], mask=none), pa.array(counts)],
        ["section", "start", "stop", "tokens"])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), entries)],
                                      ["n_tokens", "section_tokens"])


def _line_rows(batches: Iterator[pa.RecordBatch], definition: str, rule: str,
               word_by_word: bool) -> Iterator[pa.RecordBatch]:
    """A row per line of every text, and one of section -1 where a text has tokens outside its lines."""
    coder = _coder(definition)
    for batch in batches:
        done = 0
        for texts in array_slices(batch.column(0), SPAN_BYTES):
            if word_by_word:
                spans, ends, begins = coder.joined_spans(texts)
            else:
                found = coder.whole_spans([t or "" for t in texts.to_pylist()])
                sizes = pc.utf8_length(texts.fill_null("")).to_numpy().astype(np.int64) + 1
                begins, ends = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, [len(f) for f in found]))
                spans = np.concatenate([f + at for f, at in zip(found, begins)])
            breaks = np.flatnonzero(joined_characters(texts) == 10) + 1  # the lines of all texts are lines of the joined text
            lines = np.stack([np.concatenate([[0], breaks[:-1]]), breaks], 1)
            counts = allocate(spans[:, 0], spans[:, 1], lines, rule)[:-1]
            owner = np.searchsorted(begins, lines[:, 0], "right") - 1
            first = np.searchsorted(lines[:, 0], begins[:-1])
            number, bounds = np.arange(len(lines)) - first[owner], lines - begins[owner][:, None]
            n_tokens = np.diff(ends)
            spare = n_tokens - np.bincount(owner, counts, len(texts))
            rest = np.flatnonzero(spare > 0.5)  # tokens of no characters
            owner = np.concatenate([owner, rest])
            outside = np.concatenate([np.zeros(len(lines), bool), np.ones(len(rest), bool)])
            column = lambda x, fill: np.concatenate([x, np.full(len(rest), fill)]).astype(np.int32)
            at = pa.array(owner + done, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[1:]), pa.array(n_tokens[owner], pa.int64()),
                 pa.array(column(number, -1)), pa.array(column(bounds[:, 0], 0), mask=outside),
                 pa.array(column(bounds[:, 1], 0), mask=outside), pa.array(np.concatenate([counts, np.round(spare[rest])]))],
                [*batch.schema.names[1:], "n_tokens", "section", "start", "stop", "tokens"])
            done += len(texts)


def _definition(docs: DataFrame, tokenizer: str, rule: str) -> Broadcast:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(tokenizer, encoding="utf-8") as f:
        return session_of(docs).sparkContext.broadcast(f.read())


def line_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", rule: str = "most",
                word_by_word: bool = False) -> DataFrame:
    """A row per line of every document: (key, n_tokens, section, start, stop, tokens).

    The same as exploding ``section_tokens`` of ``line_sections``, but line borders and rows are made by the task that
    encodes the text, which it does once.
    """
    definition = _definition(docs, tokenizer, rule)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(lambda b: _line_rows(b, definition.value, rule, word_by_word),
                              f"key {kind}, n_tokens bigint, section int, start int, stop int, tokens double")
    return counted.withColumnRenamed("key", key)


def section_tokens(docs: DataFrame, tokenizer: str, sections: Column, text: str = "text",
                   rule: str = "most", word_by_word: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``section_tokens``, an array of (section, start, stop, tokens).

    ``tokenizer`` is the path of a tokenizers JSON file, read on the driver.
    ``word_by_word`` is for tokenizers that drop white space and never join
    across it: the spans are the same, but each distinct word is encoded once.
    """
    definition = _definition(docs, tokenizer, rule)
    shape = ("struct<n_tokens: bigint, section_tokens: "
             "array<struct<section: int, start: int, stop: int, tokens: double>>>")
    udf = F.arrow_udf(lambda rows: _counted(rows, definition.value, rule, word_by_word), shape)
    udf = udf.asNondeterministic()  # else a filter above (such as of explode) would encode the texts again
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "section_tokens")]
    given = F.coalesce(sections, F.array().cast(SECTION))
    return (docs.withColumn("section_tokens", udf(F.struct(F.col(f"`{text}`").alias("text"), given.alias("sections"))))
            .select(*own, F.col("section_tokens.n_tokens").alias("n_tokens"),
                    F.col("section_tokens.section_tokens").alias("section_tokens")))

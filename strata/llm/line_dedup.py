"""Line dedup with a segment-partition edit join, in DataFrame operations only.

Two lines are near copies if their edit distance is at most ``edits``.  A line is
dropped if an equal line, or a near copy, comes earlier in the corpus (by doc_id,
text hash and line number); the first one stays.

The edit join: a line of length l is cut into ``edits + 1`` segments.  After at
most ``edits`` edits one segment is untouched, so a line finds all its near
copies of length l (down to ``edits`` shorter) by probing an index on (length,
segment number, segment) with its substrings; of these only the starts that some
alignment of at most ``edits`` edits allows are probed (a handful per segment).
The join's own condition drops pairs whose letter counts differ by more than the
edits can explain.  What is left is compared by a banded bit-parallel automaton:
per number of errors one register of ``2 * edits + 1`` bits, one bit per diagonal.

Bare keys are counted first: only keys of a segment that two lines probe can make
a pair, and only their rows carry ids, lines and letter counts on.  Verdicts need
no pairs: a line is looked up until its first earlier near copy is found.

Shorter lines have smaller bounds (two edits would make any two short lines equal):
``edits`` from ``min_chars`` characters, one less below that, down to half of it, and
so on; with the defaults 2 from 20 characters, 1 from 10, and only equal lines below.
The shorter line of a pair decides.  Lines of white space are neither counted nor
dropped.  Defined results: a null text has no lines; rows equal in id and text
are one document and share the verdict; null ids sort first; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flagged, folded, materialise, unfolded

EDITS = 2
MIN_CHARS = 20
#: Letters whose counts (8 bits each, eight to a BIGINT) form the signature of a line.
LETTERS = ("etaoinsr", "lhdcumfp")


def places(edits: int, probing: bool) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift): a line's own segments, or all substrings that it probes."""
    if not probing:
        return [(0, i, 0) for i in range(edits + 1)]
    return [(shorter, i, shift) for shorter in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)]


def segment_keys(lines: DataFrame, edits: int, probing: bool) -> DataFrame:
    """``lines`` (with ``line`` and its length ``l``), a row per place: ``key`` and whether it is a segment of the line's ``own``.

    A place is one number that the key is worked out from, so that the compiled code stays small whatever ``edits`` is.
    Characters of a line without others than ASCII are its bytes, which are found without counting.
    """
    coded = F.array(*[F.lit((shorter << 16) + (i << 8) + shift + edits) for shorter, i, shift in places(edits, probing)])
    c = F.col("_place")
    rows = lines.withColumn("_bytes", F.col("line").cast("binary")).select("*", F.explode(coded).alias("_place")).select(
        "*", (F.col("l") - F.shiftright(c, 16)).alias("_other"), F.shiftright(c, 8).bitwiseAND(F.lit(255)).alias("_i"),
        (c.bitwiseAND(F.lit(255)) - edits).alias("_shift"))
    i, shift, parts = F.col("_i"), F.col("_shift"), edits + 1
    base = F.floor(F.col("_other") / parts).cast("int")
    first_longer = F.lit(parts) - (F.col("_other") - base * parts)  # the last segments are one longer
    start = base * i + F.greatest(F.lit(0), i - first_longer) + 1 + shift
    size = base + F.when(i >= first_longer, 1).otherwise(0)
    key = F.when(F.octet_length("line") == F.col("l"), F.xxhash64("_other", "_i", F.substring("_bytes", start, size))).otherwise(
        F.xxhash64("_other", "_i", F.substring("line", start, size)))
    own = (F.col("_other") == F.col("l")) & (shift == 0)
    return rows.select(*lines.columns, key.alias("key"), own.alias("own"))


def letter_counts(line: Column) -> Column:
    """Counts of sixteen common letters, modulo 256, in two BIGINTs."""
    def packed(letters: str) -> Column:
        counts = [F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).cast("bigint")
                              .bitwiseAND(F.lit(255)), 8 * k) for k, c in enumerate(letters)]
        return reduce(lambda a, b: a.bitwiseOR(b), counts)

    return F.struct(*[packed(letters).alias(f"s{k}") for k, letters in enumerate(LETTERS)])


def _count_gap(a: Column, b: Column) -> Column:
    """Sum over the letters of how far the counts are apart (modulo 256: never too large)."""
    gaps = []
    for part in range(len(LETTERS)):
        x, y = a.getField(f"s{part}"), b.getField(f"s{part}")
        for k in range(8):
            d = F.abs(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(y, 8 * k).bitwiseAND(F.lit(255)))
            gaps.append(F.least(d, F.lit(256) - d))
    return reduce(lambda x, y: x + y, gaps)


def characters(line: Column) -> Column:
    return F.filter(F.split(line, ""), lambda c: c != "")


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two lines is at most ``edits``: a banded bit-parallel automaton.

    The lines come as arrays of characters, in columns of a table: an expression
    would be evaluated again at every step.

    Register e (bits e*w .. e*w+w-1 of the state, w = 2*edits+1) has bit j set if
    the first i characters of ``b`` are within e edits of the first
    ``i + j - edits`` characters of ``a``.
    """
    w = 2 * edits + 1
    full = (1 << w) - 1
    start = sum(sum(1 << (edits + p) for p in range(e + 1)) << (e * w) for e in range(edits + 1))

    def step(state: Column, i: Column) -> Column:
        here = F.try_element_at(b, i + 1)
        same = reduce(lambda x, y: x + y, [
            F.when((i + j - edits >= 0) & (F.try_element_at(a, F.greatest(i + j - edits + 1, F.lit(1))) == here),
                   F.lit(1 << j)).otherwise(F.lit(0)) for j in range(w)])
        before = None
        old = F.lit(0)
        out = F.lit(0).cast("bigint")
        for e in range(edits + 1):
            now = F.shiftright(state, e * w).bitwiseAND(F.lit(full))
            after = now.bitwiseAND(same)
            if e:
                after = (after.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1))
                         .bitwiseOR(F.shiftleft(before, 1).bitwiseAND(F.lit(full))))
            out = out.bitwiseOR(F.shiftleft(after.cast("bigint"), e * w))
            before, old = after, now
        return F.when(state == 0, state).otherwise(out)  # more errors than allowed: it stays so

    n, m = F.size(b), F.size(a)
    # i runs over 0..n-1; an empty line leaves the start state
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(positions, F.lit(start).cast("bigint"), step)
    place = F.greatest(F.lit(0), F.lit(edits * w + edits) + m - n)
    return (F.abs(m - n) <= edits) & (F.getbit(end, place) == 1)


def corpus_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with a word: (doc, text_hash, place, line, h1, h2)."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(t).alias("text_hash"),
                       F.posexplode(F.split(t, "\n")).alias("place", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h1", F.xxhash64("line")).withColumn(
        "h2", F.xxhash64(F.lit(1), "line"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each different line once, with its first place: (h1, h2, line, n, first)."""
    return lines.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"),
                                         F.min(F.struct("doc", "text_hash", "place")).alias("first"))


def useful_keys(long: DataFrame, edits: int) -> DataFrame:
    """(id): keys of a segment of some line that are probed twice or more, the only ones that can make a pair.

    Bare keys are counted; the lowest bit tells the line's own segments, which it probes as well.
    """
    bare = F.shiftleft(F.shiftright("key", 1), 1).bitwiseOR(F.col("own").cast("bigint"))
    keys = segment_keys(long.select("line", "l"), edits, True).select(bare.alias("k"))
    seen = keys.groupBy(F.shiftright("k", 1).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("k").bitwiseAND(F.lit(1))).alias("segment"))
    return seen.where("n > 1 AND segment = 1").select("id")


def _long(distinct: DataFrame, min_chars: int, max_chars: int | None) -> DataFrame:
    length = F.char_length("line")
    fits = (length >= min_chars) if max_chars is None else (length >= min_chars) & (length <= max_chars)
    return distinct.where(fits).withColumn("l", length)


def _sides(long: DataFrame, edits: int, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Index and probe rows (key, columns, sign; prefixed i_ and p_) of the useful keys.

    They are chosen by a bitmap of fixed size, then exactly by the join itself.
    """
    useful = materialise(long.sparkSession, useful_keys(long, edits), "line-keys")
    carried = dict.fromkeys((*columns, "line", "l"))

    def keyed(probing: bool, side: str) -> DataFrame:
        rows = segment_keys(long.select(*carried), edits, probing)
        marked = flagged(rows, F.shiftright("key", 1), useful, "some").where("some")
        return marked.select(F.col("key").alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in columns],
                             letter_counts(F.col("line")).alias(f"{side}_sign"))

    return keyed(False, "i"), keyed(True, "p")


def _may_be_near(edits: int, names: tuple[str, ...] = ("h1",)) -> Column:
    """Whether an index and a probe row, of lines that differ in ``names``, have a key and nearly all letters in common."""
    differ = reduce(lambda x, y: x | y, [F.col(f"i_{c}") != F.col(f"p_{c}") for c in names])
    return (F.col("i_key") == F.col("p_key")) & differ & (_count_gap(F.col("i_sign"), F.col("p_sign")) <= 2 * edits)


def near_lines(distinct: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, max_chars: int | None = None) -> DataFrame:
    """Pairs of different lines within ``edits``: (a_h1, a_h2, b_h1, b_h2), each pair once.

    Lines of ``min_chars`` to ``max_chars`` characters take part.
    """
    spark = distinct.sparkSession
    index, probe = _sides(_long(distinct, min_chars, max_chars), edits, ("h1",))
    pairs = materialise(spark, index.join(probe, _may_be_near(edits)).select(
        F.least("i_h1", "p_h1").alias("a"), F.greatest("i_h1", "p_h1").alias("b")).distinct(), "line-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = materialise(spark, flagged(distinct.select("h1", "h2", "line"), F.col("h1"), ids, "asked")
                        .where("asked").drop("asked").join(ids, F.col("h1") == F.col("id"), "left_semi")
                        .select("h1", "h2", characters(F.col("line")).alias("chars")), "line-texts")
    side = lambda s: texts.select(*[F.col(c).alias(f"{s}_{c}") for c in ("h1", "h2", "chars")])
    return (pairs.join(side("a"), F.col("a") == F.col("a_h1")).join(side("b"), F.col("b") == F.col("b_h1"))
            .where(within_edits(F.col("a_chars"), F.col("b_chars"), edits)).select("a_h1", "a_h2", "b_h1", "b_h2"))


def _levels(edits: int, min_chars: int) -> list[tuple[int, int, int | None]]:
    """(edits, least and most characters): ``edits`` for lines of ``min_chars`` and more, one less for every halving."""
    out, low, most = [], min_chars, None
    for allowed in range(edits, 0, -1):
        out.append((allowed, low, most))
        most, low = low - 1 + (allowed - 1), low // 2
    return out


def near_pairs(distinct: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs of near copies: ``edits`` for lines of ``min_chars`` and more, one less for every halving of that length.

    The shorter line of a pair decides; each level is a join of its own over the lines that it can concern.
    """
    return reduce(DataFrame.union, [near_lines(distinct, *level) for level in _levels(edits, min_chars)]).distinct()


def late_lines(distinct: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, max_chars: int | None = None) -> DataFrame:
    """(h1, h2) of the lines with a near copy at an earlier first place; a line may come twice.

    A line is done with at its first earlier near copy: the semi joins stop there, and no pair ever becomes a row, so a
    group of n near copies makes n rows, not n^2.
    """
    index, probe = _sides(_long(distinct, min_chars, max_chars), edits, ("h1", "h2", "first", "line"))
    # the characters are cut once a pair: as a column of the lambda they are not evaluated again at every step
    lines = F.array(F.struct(characters(F.col("i_line")).alias("a"), characters(F.col("p_line")).alias("b")))
    near = F.exists(lines, lambda x: within_edits(x.getField("a"), x.getField("b"), edits))
    like = _may_be_near(edits, ("h1", "h2"))  # both joins read every column of both sides: each side is shuffled once
    late = probe.join(index, like & (F.col("i_first") < F.col("p_first")) & near, "left_semi")
    late_too = index.join(probe, like & (F.col("p_first") < F.col("i_first")) & near, "left_semi")
    return late.select(F.col("p_h1").alias("h1"), F.col("p_h2").alias("h2")).union(late_too.select("i_h1", "i_h2"))


def late_copies(distinct: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of the lines that have an earlier near copy, under the bounds of ``near_pairs``."""
    return reduce(DataFrame.union, [late_lines(distinct, *level) for level in _levels(edits, min_chars)]).distinct()


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS,
                  min_chars: int = MIN_CHARS) -> DataFrame:
    """Per different document (doc, text_hash): ``kept``, the sorted numbers of the lines that stay.

    Also ``first_places``: how many lines are the first of their kind (kept or near copies of earlier ones).
    """
    spark = docs.sparkSession
    distinct = materialise(spark, distinct_lines(corpus_lines(docs, doc_id, text)), "lines")
    late = materialise(spark, late_copies(distinct, edits, min_chars).withColumn("near", F.lit(True)), "near-lines")
    judged = distinct.select("h1", "h2", "first").join(late, ["h1", "h2"], "left").select(
        "first.doc", "first.text_hash", "first.place", F.coalesce("near", F.lit(False)).alias("near"))
    return judged.groupBy("doc", "text_hash").agg(
        F.array_sort(F.collect_list(F.when(~F.col("near"), F.col("place")))).alias("kept"),
        F.count(F.lit(1)).alias("first_places"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the dropped lines cut out of the text; all other columns unchanged."""
    t = F.col(f"`{text}`")
    rows = folded(docs, id=F.col(f"`{doc_id}`"), hash=F.xxhash64(t))
    verdicts = line_verdicts(docs, doc_id, text, edits, min_chars)
    marked = rows.join(verdicts, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    lines = F.filter(F.split(F.col("all").getField(text), "\n"),
                     lambda x, i: F.array_contains(kept, i) | ~x.rlike(r"[^\x20\x09-\x0D]"))
    return unfolded(marked, docs.columns, **{text: F.array_join(lines, "\n")})


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document row: (doc_id, n_lines, n_exact, n_near, n_kept, kept): dropped as copies, as near copies, and kept lines."""
    t = F.col(f"`{text}`")
    has_word = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("text_hash"),
                       F.coalesce(F.when(t.isNull(), F.lit(0)).otherwise(has_word), F.lit(0)).cast("bigint").alias("n_lines"))
    v = line_verdicts(docs, doc_id, text, edits, min_chars)
    joined = rows.join(v, rows["doc_id"].eqNullSafe(v["doc"]) & (rows["text_hash"] == v["text_hash"]), "left")
    n_kept = F.coalesce(F.size("kept"), F.lit(0)).cast("bigint")
    n_first = F.coalesce("first_places", F.lit(0)).cast("bigint")
    return joined.select("doc_id", "n_lines", (F.col("n_lines") - n_first).alias("n_exact"),
                         (n_first - n_kept).alias("n_near"), n_kept.alias("n_kept"),
                         F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))

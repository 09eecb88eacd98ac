"""Merkle manifest, chosen-path join, hard negatives and token counts per line against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import chosen_path, hard_negatives, merkle, token_counts
from strata.llm.queries import QUERIES, word_tokenizer


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """Root, and per node the siblings (before, behind) of every level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8:k // 8 * 8 + 8]
            proofs[i].append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        at = [k // 8 for k in at]
        nodes = [h("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], proofs


def expected_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(enc(*r)))):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = [tree([h(enc(*r)) for r in groups[g]]) for g in order]
    if not order:
        return []
    root, tops = tree([s[0] for s in subs])
    out = []
    for g, (subroot, proofs), top in zip(order, subs, tops):
        for r, proof in zip(groups[g], proofs):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = h(enc(*r[:4], lowered(r[4]) if tampered else r[4]))
            for before, behind in proof + top:
                node = h(before + node + behind)
            out.append((r[0], h(enc(*r)), subroot, root, h("".join(a + b for a, b in proof + top)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_of(spark, tmp_path, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    df.repartition(partitions).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).select(*COLUMNS)
    return sorted(map(tuple, got.collect()), key=str)


def test_manifest_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet")
            .select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op11_merkle_manifest"](spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected_manifest(rows)


@pytest.mark.parametrize("levels", [0, 1])
def test_butterfly_with_ragged_subtrees(spark, tmp_path, monkeypatch, levels):
    """Partitions of one or eight leaves: several rounds, last subtrees of all shapes."""
    monkeypatch.setattr(merkle, "manifest", partial(merkle.manifest, levels=levels))
    rows = [(k, "s", lang, k, f"Text {k}") for lang, n in ((None, 1), ("a", 8), ("b", 9), ("c", 73), ("d", 150)) for k in range(n)]
    assert manifest_of(spark, tmp_path, rows) == expected_manifest(rows)


def test_manifest_of_odd_rows(spark, tmp_path):
    """Nulls everywhere, equal ids, repeated rows, empty and long texts, more groups than one run of the top tree."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "s", "de", 1, ""), (1, "s", "de", 2, "A"),
            (1, "s", "de", 2, "A"), (1, "s", "de", 2, "B"), (2, "", "", 0, ""), (3, "s", "é", 4, "É A \U0001f600" * 9999)]
    rows += [(k, "s", f"l{k}", k, "x") for k in range(20)]
    assert manifest_of(spark, tmp_path, rows) == expected_manifest(rows)


def test_manifest_of_nothing_and_of_clashing_names(spark, tmp_path):
    assert manifest_of(spark, tmp_path, []) == []
    names = ["grp", "key", "leaf", "carry", "place", "part", "n", "node", "sides", "_row", "_in", "_part", "root", "low"]
    df = spark.createDataFrame([tuple(f"v{k}{c}" for c in names) for k in range(20)], ", ".join(f"`{c}` string" for c in names))
    got = merkle.manifest(df, F.col("grp").substr(1, 1), F.col("key"), merkle.leaf(F.col("leaf")), part=F.col("part")).collect()
    assert len(got) == 20 and len({r["root"] for r in got}) == 1 and {r["part"] for r in got} == {f"v{k}part" for k in range(20)}


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def expected_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(rng, n, length, vocabulary, edits):
    words = [f"{vocabulary}{rng.randint(0, 500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"x{rng.randint(0, 10 ** 9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limit", [64, 6])
def test_chosen_path_matches_brute_force(spark, monkeypatch, limit):
    """Groups of near copies around the threshold; with a limit of 6 nodes are large, branch, and end in block pairs."""
    monkeypatch.setattr(chosen_path, "LIMIT", limit)
    rng = random.Random(limit)
    texts = near_copies(rng, 60, 60, "a", 5) + near_copies(rng, 40, 60, "b", 2) + near_copies(rng, 30, 120, "c", 9)
    texts += [" ".join(f"r{rng.randint(0, 40)}" for _ in range(30)) for _ in range(60)] + near_copies(rng, 3, 30, "d", 0)
    rng.shuffle(texts)
    rows = [(5 * k + 3, t) for k, t in enumerate(texts)]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected_components(rows)


def test_chosen_path_edges(spark):
    long = " ".join(f"word{k % 5000} of" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, "Same text"), (4, "same TEXT"), (3, "same text"), (7, long), (6, long + " end"),
            (8, " \n\t "), (9, "é 中文 \U0001f600 \x00 end"), (10, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("content", "sign", "rep", "node", "root", "doc", "n", "tree", "comp"):
        df = df.withColumn(c, F.lit("x"))
    got = chosen_path.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=str) == expected_components(rows)
    assert chosen_path.near_duplicates(df.where("false")).count() == 0
    none = chosen_path.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "z y")],
                                                             "doc_id long, text string")).collect()
    assert sorted(map(tuple, none), key=str) == sorted([(None, 2, 5, False), (5, 2, 5, True), (None, 1, None, True)], key=str)


def test_trees_and_least_values_keep_the_recall():
    assert chosen_path.trees_needed(0.8, 0.9999) == 2 and chosen_path.trees_needed(1.0, 0.9) == 1
    assert chosen_path.least_equal(1.0) == chosen_path.VALUES
    rng = np.random.default_rng(1)
    draws = (rng.random((200_000, chosen_path.VALUES)) < 0.8).sum(1)
    assert (draws < chosen_path.least_equal(0.8)).mean() < 1e-4


def expected_negatives(rows):
    used = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in {(i, label, tuple(v)) for i, label, v in used if i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a[2], v)), i, label) for i, label, v in used)
        for p, positive, _ in [s for s in scored if s[2] == a[1] and s[1] != a[0]][:5]:
            ok = [s for s in scored if s[2] != a[1] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a[0], positive, k + 1, i, -p, -n) for k, (n, i, _) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [1024, 2])
def test_hard_negatives_match_brute_force(spark, chunk):
    """Ties, repeated rows and vectors, nulls, non-finite components, shorter vectors, clashing names."""
    rng = np.random.default_rng(2)
    rows = [(int(k), int(rng.integers(0, 4)), [float(x) for x in rng.integers(-2, 4, 5) / 4]) for k in range(0, 700, 2)]
    rows += [(100, 1, [0.5] * 5), (100, 1, [0.5] * 5), (101, 2, [1.0, 1.0]), (103, 2, []), (None, 1, [1.0] * 5),
             (200, None, [1.0] * 5), (201, 1, None), (203, 1, [None, 1.0, 1.0, 1.0, 1.0]), (205, 1, [float("nan")] * 5),
             (207, 2, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (209, 3, [1e9, -1e9, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for c in ("id", "vector", "anchor", "place", "score", "rank", "chunk"):
        df = df.withColumn(c, F.lit("x"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 100 == 0, label=moved, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == expected_negatives(rows)
    assert hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_strassen_is_exact():
    rng = np.random.default_rng(3)
    for shape in ((1, 1, 1), (17, 65, 33), (40, 64, 100), (0, 64, 5), (33, 0, 40)):
        for size in (1000, 1 << 40, 1 << 62):
            a, b = rng.integers(-size, size, shape[:2]), rng.integers(-size, size, shape[1:])
            assert (hard_negatives.strassen(a, b) == a @ b).all()


def test_heaps_merge():
    rng = np.random.default_rng(4)
    w, s, i = rng.integers(0, 5, 900), rng.integers(0, 9, 900), rng.permutation(900)
    whole, parts = hard_negatives.Heaps(5, 7), hard_negatives.Heaps(5, 7)
    whole.push(w, s, i)
    for k in range(0, 900, 100):
        part = hard_negatives.Heaps(5, 7)
        part.push(w[k:k + 100], s[k:k + 100], i[k:k + 100])
        parts.push(part.window, part.score, part.id)
    assert all((a == b).all() for a, b in ((whole.window, parts.window), (whole.score, parts.score), (whole.id, parts.id)))


@pytest.mark.parametrize("by_word", [True, False])
@pytest.mark.parametrize("rule", ["first", "most"])
def test_line_tokens_match_the_offsets_of_the_library(spark, by_word, rule):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(word_tokenizer())
    texts = [None, "", "\n", "one line", "two\nlines here\n", " \n\n lead and\ttrail \r\n x", "Café 中文\n\U0001f600 it's",
             "<|endoftext|>\nx<|startoftext|> y", "a\x1cb \x85\xa0c\nd", "supercalifragilistic" * 2000, "\n" * 3000 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_counts.line_tokens(rows.repartition(2), word_tokenizer(), rule=rule, word_by_word=by_word).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["stop"], r["tokens"], r["n_tokens"]))
    for k, t in enumerate(texts):
        spans, lines, at = coder.encode(t or "", add_special_tokens=False).offsets, [], 0
        for line in (t or "").split("\n"):
            lines.append((at, at + len(line) + 1))
            at += len(line) + 1
        count = [0] * len(lines)
        for a, b in spans:
            cover = [min(b, y) - max(a, x) for x, y in lines]
            count[cover.index(max(cover)) if rule == "most" else next(i for i, (x, y) in enumerate(lines) if x <= a < y)] += 1
        assert sorted(got[k]) == [(i, x, y, c, len(spans)) for i, ((x, y), c) in enumerate(zip(lines, count))], repr(t)[:40]


def test_texts_are_encoded_once(spark, sf):
    plan = QUERIES["op2_token_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan

"""Line dedup, periodic runs and token alignment against plain Python."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoloom.llm import alignment, hot, line_dedup, periodic
from chronoloom.llm.catalog import QUERIES
from chronoloom.session import cut
from tests.llm.test_native import WORD, empty, odd, odd_rows  # noqa: F401

NAMES = ["op11_cross_tokenizer_alignment", "op12_periodic_runs", "op13_line_dedup"]
FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):  # noqa: F811
    assert QUERIES[name](spark, empty).collect() == []


# ---- hot keys ------------------------------------------------------------------------------------
def test_hot_keys_are_joined_without_meeting(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"), "id")
    counts = cut(rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 != 0"))
    split, whole = hot.join_counted(rows, counts, ["k"], "n", limit=64), hot.join_counted(rows, counts, ["k"], "n")
    assert "Union" in split._jdf.queryExecution().toString() and "Union" not in whole._jdf.queryExecution().toString()
    for got in (split, whole):
        assert sorted(map(tuple, got.select("k", "id", "n").collect())) == sorted(map(tuple, rows.join(counts, "k").select("k", "id", "n").collect()))


# ---- lines ---------------------------------------------------------------------------------------
def lines_by_hand(rows, min_docs=10, min_chars=1):
    """rows: (id, text) -> (id, n_lines, n_dropped, digest) of each."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    places = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            places[key(line)].add(i if i is not None else ("null", t))
    shared = {k for k, docs in places.items() if len(k) >= min_chars and len(docs) >= min_docs}
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in shared]
        out[i, len(lines), len(lines) - len(kept), digest("\n".join(kept))] += 1
    return out


def shared_line_rows():
    rnd = random.Random(5)
    pool = ["Home", " home\t", "HOME \r", "É accent", "é accent", "", "  ", " x ", "a b", "#", "Copyright 2020", "\x0bcopyright 2020"]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own {i} {j}" for j in range(rnd.randint(0, 9)))) for i in range(120)]
    rows += [(7, "once\nonce")] * 12                                       # repeated rows are one document
    rows += [(None, f"nobody {i % 11}\nnobody's line") for i in range(22)] + [(None, None), (None, ""), (500, None)]
    rows += [(600 + i, "nine times") for i in range(9)] + [(700 + i, "ten times\nkept") for i in range(10)]
    return rows + [(800, "\n".join(["Home", "x"] * 20000))]


@pytest.mark.parametrize("limit", [None, 64])
def test_lines(spark, monkeypatch, limit):
    if limit:  # neither table of hashes may be broadcast whole
        whole = hot.join_counted
        monkeypatch.setattr(line_dedup, "join_counted", lambda *a: whole(*a, limit=limit))
    rows = shared_line_rows()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "k bigint, text string, _r1 string, n_lines string")
    out = line_dedup.drop_shared_lines(docs, "k", "text")
    assert out.columns == ["k", "text", "_r1", "n_lines", "n_dropped"] and out.where("_r1 <> 'x'").count() == 0
    got = collections.Counter((r.k, r.n_lines, r.n_dropped, digest(r.text or "")) for r in out.collect())
    assert got == lines_by_hand(rows)
    out = line_dedup.drop_shared_lines(docs, "k", "text", min_docs=2, min_chars=6)
    got = collections.Counter((r.k, r.n_lines, r.n_dropped, digest(r.text or "")) for r in out.collect())
    assert got == lines_by_hand(rows, 2, 6)


def test_lines_of_the_tables(spark, odd):  # noqa: F811
    for root in ("/root/testdata/sf0.01", odd):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
        got = QUERIES["op13_line_dedup"](spark, root).collect()
        assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == lines_by_hand(rows)


def test_no_python_in_line_dedup(spark, small):
    plan = QUERIES["op13_line_dedup"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- periodic runs -------------------------------------------------------------------------------
def runs_by_hand(w):
    """All periods, all stretches, and the smallest period by trying the smaller ones."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 7)), max_size=6), min_size=1, max_size=4))
def test_runs_against_brute_force(parts):
    texts = [[x for unit, times in doc for x in unit * times] for doc in parts]
    counts, runs, kept = periodic._runs_of([" ".join(w).encode() for w in texts])
    for w, n, found, left in zip(texts, counts, runs, kept):
        assert n == len(w) and found == runs_by_hand(w) and left.decode() == collapsed_by_hand(w, found)


def test_runs_by_definition():
    for w, want in (("a a a a a a", [(0, 6, 1)]), ("a a a a a", []), ("a b a b a b", []), ("a b a b a b a b x", [(0, 8, 2)]),
                    ("x a b c a b c a b c a b c", [(1, 12, 3)]), ("a a a a a a b b b b b b", [(0, 6, 1), (6, 6, 1)]),
                    ("a a a a a a b a a a a a a b a a a a a a b a a a a a a b", [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)])):
        counts, runs, _ = periodic._runs_of([b"q q q", w.encode(), w.encode()])
        assert runs == [[], want, want] and want == runs_by_hand(w.split())


def test_long_texts_of_one_word():
    for w, period in ((["the"] * 300_000, 1), (["a", "b", "c"] * 100_000, 3)):
        _, runs, kept = periodic._runs_of([" ".join(w).encode()])
        assert runs == [[(0, 300_000, period)]] and kept == [" ".join(w[:period]).encode()]


def test_runs_emit_when_their_diagonal_ends():
    places, lags = periodic.earlier_occurrences(__import__("numpy").array([1, 1, 1, 1, 1, 1, 2, 3, 4, 5]))
    seen = []

    def events():
        for e in zip(places.tolist(), lags.tolist()):
            seen.append(e)
            yield e
        yield 50, 1
        seen.append("end")

    assert next(periodic.diagonal_runs(events())) == (0, 6, 1) and "end" not in seen


def test_runs_keep_columns_and_slices(spark, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_BYTES", 20)
    rows = [(1, None, "x"), (2, "", "x"), (3, "a " * 9, "x"), (3, "a " * 9, "x"), (4, "a b a b", "x"), (5, " \n\t", None)]
    out = periodic.find_runs(spark.createDataFrame(rows, "k int, t string, runs string").coalesce(1), "t")
    assert out.columns == ["k", "t", "n_words", "runs", "collapsed"]
    got = [(r.k, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert got == [(1, 0, [], ""), (2, 0, [], ""), (3, 9, [(0, 9, 1)], "a"), (3, 9, [(0, 9, 1)], "a"), (4, 2, [], "a b a b"), (5, 0, [], "")]


def planted_by_hand(doc_id, text):
    w = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("which", ["small", "odd"])
def test_run_query(spark, request, which):
    root = request.getfixturevalue(which)
    want = collections.Counter()
    for d in spark.read.parquet(f"{root}/documents.parquet").collect():
        w = planted_by_hand(d.doc_id, d.text)
        # Long texts without a period are left to the tests above; here the brute force would be cubic.
        runs = runs_by_hand(w) if len(w) < 1500 else periodic._runs_of([" ".join(w).encode()])[1][0]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[d.doc_id, len(runs), *shown, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed_by_hand(w, runs))] += 1
    rows = QUERIES["op12_periodic_runs"](spark, root).collect()
    assert want == collections.Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows)
    assert which == "odd" or sum(r.n_runs > 0 for r in rows) > 10


# ---- alignment -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def by_hand():
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def aligned(t):
        """n_a, n_b, n_groups, n_links, groups, links by id pair; every pair of tokens is looked at."""
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = b.encode(t or "")
        as_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        as_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or not b"".join(as_a) == b"".join(as_b) == b" " + t.encode():
            return 0, 0, 0, 0, "", {}
        ends_a, ends_b = ([sum(map(len, x[:i + 1])) for i in range(len(x))] for x in (as_a, as_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        group = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi)
        shown = ";".join(f"{group(ids_a, ends_a, lo, hi)}|{group(ids_b, ends_b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        links = collections.Counter((i, j) for i, e, x in zip(ids_a, ends_a, as_a) for j, f, y in zip(ids_b, ends_b, as_b) if e - len(x) < f and f - len(y) < e)
        return len(ids_a), len(ids_b), len(cuts), sum(links.values()), shown, dict(links)

    return aligned


ODD_TEXTS = [None, "", " ", "  ", "a", "a ", "a  b ", "▁x", "É ü\tx\n\n y \x0b z", "<|endoftext|> hi", "日本語テキスト🙂🙂", "a" * 700, "\x00\x01b", "<unk><s></s>",
             "x̀ y​", "<0x41>", "🇩🇪" * 20, "﻿abc\r\n", "𐍈" * 50, "é ﬁ ½ Ⅷ ²", "don't I'LL we've x", "ᲀ ꟑ Ა", "word " * 400]


def test_alignment_by_hand(spark, by_hand, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    rows = [(i, t, "x") for i, t in enumerate(ODD_TEXTS)]
    out = alignment.align(spark.createDataFrame(rows, "k int, t string, groups string").coalesce(2), "t", *FILES)
    got = {r.k: r for r in out.collect()}
    for i, t in enumerate(ODD_TEXTS):
        want, r = by_hand(t), got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == want[:5], t
        assert {(p // alignment.PAIR, p % alignment.PAIR): n for p, n in zip(r.pairs, r.times)} == want[5], t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_alignment_of_any_text(by_hand, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    made = [c.to_pylist() for c in alignment._aligned(texts, alignment.sides(*FILES))]
    slow = [c.to_pylist() for c in alignment._aligned(texts, alignment.Sides(*FILES[:2], None))] if len(texts) == 3 else made
    assert made == slow
    for t, *r in zip(texts, *made):
        assert tuple(r[:5]) == by_hand(t)[:5]


def test_fast_and_whole_encodings_agree(spark, small):
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [t or "" for t in ODD_TEXTS]
    fast, whole = alignment.sides(*FILES), alignment.Sides(*FILES[:2], None)
    assert fast.by_word and fast.encode(texts) == whole.encode(texts)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_alignment_query(spark, request, by_hand, which):
    root = request.getfixturevalue(which)
    docs = [(r.doc_id, (r.text or "")[:3000] if r.text else r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    made = {t: by_hand(t) for t in {t for _, t in docs}}
    counts = collections.Counter(p for _, t in docs for p in made[t][5])
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = collections.Counter()
    for i, t in docs:
        n_a, n_b, groups, links, shown, pairs = made[t]
        want[i, n_a, n_b, groups, links, sum(n for p, n in pairs.items() if counts[p] == most[p[0]]),
             sum(n * counts[p] for p, n in pairs.items()), shown] += 1
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    out = alignment.score_links(alignment.align(rows, "text", *FILES)).drop("text")
    assert want == collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.collect())


def test_alignment_query_digests(spark, tmp_path, by_hand):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.groups_sha256 for r in QUERIES["op11_cross_tokenizer_alignment"](spark, str(tmp_path)).collect()}
    assert got == {i: digest(s) if (s := by_hand(t)[4]) else "" for i, t in rows}


def test_odd_rows_are_all_there(spark, odd):  # noqa: F811
    for name in NAMES:
        assert len(QUERIES[name](spark, odd).collect()) == len(odd_rows())

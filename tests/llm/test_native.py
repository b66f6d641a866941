"""Native operators against plain Python on small tables and on rows with nulls, empties, ties and repeats."""

import collections
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import fingerprints as fp
from chronoloom.llm import mixing, native_queries, near_dup, quality, url_filter
from chronoloom.llm.catalog import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(20000))
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (3, long + " x", "en", "a", 1),
            (4, "One two THREE four five", "en", "b", 1), (5, "one two three four five", "de", "b", 1), (None, "one two three", "de", None, 1),
            (6, "É\u00a0ü\tx\n\n y \x0b z", "fr", "c", 1), (7, "a" * 30000, "fr", "c", 1), (8, "same line here\nsame line here\n\n#|%", "es", "c", 1)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), ODD).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, None, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "", ""), (2, "x.com/en", ""), (3, "HTTP://A.Example.COM:80/en/x?q#r", ""), (3, "HTTP://A.Example.COM:80/en/x?q#r", ""),
                           (4, "a://WWW.example.com/en/", ""), (5, "a://example.net/es/1", ""), (6, "a://notexample.com", ""), (7, "://com/#x", ""),
                           (8, "a://" + "h" * 20000 + ".com/", "")], "page_id bigint, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], ODD).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_fingerprints", "op4_simhash_near_dedup", "op5_mixing", "op7_quality_rules"])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def by_key(rows, key="doc_id"):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


def judged_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for action, rule in native_queries.URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


@pytest.mark.parametrize("which", ["small", "odd"])
def test_url_rules(spark, request, which):
    root = request.getfixturevalue(which)
    pages = spark.read.parquet(f"{root}/pages.parquet").collect()
    got = collections.Counter((r.page_id, r.host, r.path, r.rule) for r in QUERIES["op1_url_filters"](spark, root).collect())
    assert got == collections.Counter((p.page_id, *judged_by_hand(p.url)[:3]) for p in pages)
    for r in QUERIES["op1_url_filters"](spark, root).collect():
        assert r.verdict in ("allow", "block")


def test_url_tokens_are_whole(spark):
    assert url_filter.rule_tokens("spam-*/") == ["spam"]
    assert url_filter.rule_tokens("example.com/en") == ["example", "com"]
    rows = spark.createDataFrame([(1, "a://x.spam-farm.org/"), (2, "a://antispam-farm.org/"), (3, "a://b.org/english")], "k int, u string")
    out = {r.k: (r.rule, r.verdict) for r in url_filter.judge_urls(rows, "k", "u", [("block", "b.org/en"), ("block", "*farm*/x")]).collect()}
    assert out == {1: (None, "block"), 2: (None, "allow"), 3: ("b.org/en", "block")}
    assert [r.verdict for r in url_filter.judge_urls(rows, "k", "u", [], []).collect()] == ["allow"] * 3


def counts_by_hand(text):
    t = text or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    seen = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(seen)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_quality_counts(spark, request, which):
    root = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{root}/documents.parquet").collect()
    want = collections.Counter((d.doc_id, *(c := counts_by_hand(d.text)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for d in docs)
    rows = QUERIES["op7_quality_rules"](spark, root).collect()
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_decision_list_finds_a_planted_rule(spark):
    rows = [(i, 100 + i % 7, 500, 60 if i % 4 == 0 else 1, 0, 0, 5, 3, 0) for i in range(600)]
    names = "doc_id int, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, n_marks bigint"
    stats = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(600)], "doc_id int, quality int")
    rules = quality.learn_decision_list(stats, "doc_id", labels)
    assert len(rules) == 1 and rules[0][0][:2] == ("symbols_per_word", True) and "symbols_per_word >=" in quality.describe(rules)[0]
    hit = stats.withColumn("rule", quality.as_case(rules)).where("rule = 1").select("doc_id").collect()
    assert {r.doc_id for r in hit} == set(range(0, 600, 4))


def labelled(spark, kinds):
    """(statistics, labels) of rows whose features sit on given values: kinds of (feature values, bad rows, good rows)."""
    rows, plain = [], {"n_words": 100, "word_chars": 450, "n_symbols": 0, "n_repeat_words": 0, "n_dup_lines": 0, "n_lines": 100, "n_capitals": 0, "n_marks": 0}
    for values, bad, good in kinds:
        rows += [{**plain, **values, "doc_id": len(rows) + i, "quality": int(i >= bad)} for i in range(bad + good)]
    df = spark.createDataFrame(rows)
    return df.drop("quality"), df.select("doc_id", "quality")


def test_covering_goes_on_past_eight_kinds(spark):
    kinds = [{"n_symbols": 15}, {"n_symbols": 95}, {"n_repeat_words": 15}, {"n_repeat_words": 95}, {"n_dup_lines": 15}, {"n_dup_lines": 95},
             {"n_capitals": 150}, {"n_capitals": 440}, {"n_marks": 150}, {"n_marks": 440}, {"n_words": 7, "word_chars": 32}, {"word_chars": 1300}]
    # Between the bad places of a feature there are good ones, so that no threshold takes two of them.
    between = [{"n_symbols": 40}, {"n_repeat_words": 40}, {"n_dup_lines": 40}, {"n_capitals": 270}, {"n_marks": 270}]
    stats, labels = labelled(spark, [({}, 0, 300), *[(k, 90, 0) for k in kinds], *[(k, 0, 150) for k in between]])
    rules = quality.learn_decision_list(stats, "doc_id", labels)
    judged = stats.join(labels, "doc_id").groupBy("quality").agg(F.avg(quality.as_case(rules).isNotNull().cast("double")).alias("hit"))
    assert len(rules) > 8 and {r.quality: r.hit for r in judged.collect()} == {0: 1.0, 1: 0.0}
    assert len(quality.learn_decision_list(stats, "doc_id", labels, max_rules=2)) == 2


def test_an_imprecise_kind_does_not_end_the_search(spark):
    stats, labels = labelled(spark, [({}, 0, 600), ({"n_symbols": 95}, 300, 100), ({"n_marks": 440}, 60, 0)])
    rules = quality.learn_decision_list(stats, "doc_id", labels)
    assert [[c[0] for c in r] for r in rules] == [["mark_share"]]
    assert stats.where(quality.as_case(rules).isNotNull()).count() == 60



def test_quality_list_agrees_with_labels(spark):
    root = "/root/testdata/sf0.1"
    out = QUERIES["op7_quality_rules"](spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id")
    r = out.where("not base_failed or quality = 0").agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"),
                F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r.good > 0.99 and r.bad < 0.1


def test_mixing_targets_and_repeats(spark, odd):
    root = "/root/testdata/sf0.01"
    rows = QUERIES["op5_mixing"](spark, root).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op5_mixing"](spark, root).collect()))
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "source").collect()
    source = {d.doc_id: d.source for d in docs}
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.001 * t + 2 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3
    odds = QUERIES["op5_mixing"](spark, odd).collect()
    assert len(odds) == len(odd_rows()) and all(r.taken <= 2 * r.size for r in odds)
    nulls = [r for r in odds if r.doc_id is None]
    assert nulls[0].source_size == 3


def test_water_filling_redistributes(spark):
    s = spark.createDataFrame([("a", 10, 3), ("b", 100, 1), ("c", 1000, 2), ("d", 0, 2)], "sid string, size bigint, weight int")
    got = {r.sid: r.target for r in mixing.water_fill(s, F.sum("size") * 0 + F.lit(900.0), 2).collect()}
    assert got["a"] == 20 and got["d"] == 0 and got["b"] == 200 and got["c"] == pytest.approx(680)
    whole = {r.sid: r.target for r in mixing.water_fill(s, F.sum("size") * 9, 2).collect()}
    assert whole == {"a": 20, "b": 200, "c": 2000, "d": 0}


def test_mix_keeps_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumn("size", F.lit(1)).withColumn("bucket", F.lit(2))
    out = mixing.mix(docs, "doc_id", "source", "text", mixing.cyclic_weights([3, 1, 2]))
    assert out.columns == docs.columns and out.count() > 0


def shingle_print(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints):
    rows, label = list(prints), list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    best = {}
    for (key, _), at in zip(rows, label, strict=True):
        if key is not None:
            best[at] = min(key, best.get(at, key))
    return [(k, f"{f:016x}", best.get(at)) for (k, f), at in zip(rows, label, strict=True)]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_simhash_components(spark, request, which):
    root = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{root}/documents.parquet").collect()
    want = components_by_hand([(d.doc_id, shingle_print(d.text)) for d in docs])
    got = [tuple(r) for r in QUERIES["op4_simhash_near_dedup"](spark, root).select("doc_id", "fingerprint", "component_id").collect()]
    assert collections.Counter(got) == collections.Counter(want)


@pytest.mark.parametrize("posting", [256, 2])
def test_links_equal_brute_force(spark, monkeypatch, posting):
    import random
    monkeypatch.setattr(near_dup, "POSTING", posting)
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << p for p in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(12)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = sorted((r.u, r.v) for r in near_dup.links(spark.createDataFrame([(x,) for x in signed], "fingerprint bigint")).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    assert got == want and len(set(got)) == len(got)


def fingerprint_by_hand(text):
    def signed(x):
        return x.to_bytes(8, "little")
    w = WORD.findall(text or "")
    votes = [0] * 128
    for a, b in zip(w, [*w[1:], None], strict=True):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)
        x = h << 64 | xxhash.xxh64_intdigest(signed(h), 42)
        weight = min(16, len(a) + len(b or ""))
        for i in range(128):
            votes[i] += weight if x >> i & 1 else -weight
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def test_fingerprints_by_hand(spark, small):
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{small}/documents.parquet").collect())[:]
    got = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, small).collect()}
    assert len(got) == len(docs)
    for i, (key, text) in enumerate(docs[:40]):
        after = docs[i - 1][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == f"{fingerprint_by_hand(text):032x}" and r.edited_fingerprint == f"{fingerprint_by_hand(edited):032x}"
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    edited, following = [sum(getattr(r, c) for r in got.values()) / len(got) for c in ("near_edited", "near_next")]
    assert edited > following + 0.2


def test_fingerprint_odd_rows(spark, odd):
    rows = QUERIES["op2_fingerprints"](spark, odd).collect()
    assert len(rows) == len(odd_rows())
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"0" * 32}
    assert all((r.n_within is None) == (r.doc_id is None or r.doc_id % 50 != 0) for r in rows)


def test_search_within_radius(spark):
    import random
    rnd = random.Random(3)
    base = [rnd.getrandbits(128) for _ in range(20)]
    prints = sorted({b ^ sum(1 << p for p in rnd.sample(range(128), rnd.randint(0, 5))) for b in base for _ in range(10)})

    def halves(x):
        return [y - (1 << 64) if y >> 63 else y for y in (x >> 64, x & ((1 << 64) - 1))]
    df = spark.createDataFrame([halves(x) for x in prints], "hi bigint, lo bigint")
    for radius in (0, 3, 5):
        got = fp.within_radius(df, df, radius).collect()
        want = sum((a ^ b).bit_count() <= radius for a in prints for b in prints)
        assert len(got) == want == len(set(map(tuple, got)))

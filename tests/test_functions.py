"""Scalar rules with worked values."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import gaze as G
from chronoloom.functions import grading as M
from chronoloom.functions import text as X
from chronoloom.functions import timekeys as K
from chronoloom.operators import extraction as E
from chronoloom.operators import stats as S
from chronoloom.sources.gaze import header_roles


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_time_keys(spark):
    r = one(spark, k=K.ts_key(F.lit("DAY12"), F.lit("930000")), d=K.ts_display(F.lit(111094300)), s=K.ts_display(F.lit(42)),
            w=K.week_seconds(F.lit("Day3"), F.lit("20222516")), c=K.clock_carry(F.lit(11593000 + 3000)))
    assert (r["k"], r["d"], r["s"], r["w"], r["c"]) == (1200930000, "DAY1 11:09:43", "42", 332545.16, 12000000)


def test_target_points(spark):
    none = F.array().cast("array<string>")
    r = one(spark, a=K.target_points(F.lit("DAY1"), F.lit("11152408"), none),
            b=K.target_points(F.lit("DAY1"), F.lit(None).cast("string"), F.array(F.lit("13394908"), F.lit("13512718"))),
            c=K.target_points(F.lit("DAY4"), F.lit("17044917DAY4_20593813DAY6_19483807"), none),
            e=K.target_points(F.lit("DAY4"), F.lit(""), none), l=K.target_span_legacy(F.lit("DAY4"), F.lit("17044917DAY4_20593813DAY6_19483807")))
    assert r["a"] == [126924.08] and len(r["b"]) == 2 and len(r["c"]) == 3 and r["e"] == []
    assert r["l"]["start"] == r["c"][0] and r["l"]["end"] == r["c"][1]


def test_ranges(spark):
    r = one(spark, ok=K.time_range(F.lit("day 1 9:09:43 - DAY2 11:09:58")), bad=K.time_range(F.lit("DAY1 11:09:43")),
            w=K.window_parts(F.lit("DAY1 17:25:51-17:25:53")), n=K.window_parts(F.lit("soon")))
    assert (r["ok"]["start"], r["ok"]["end"]) == (109094300, 211095800) and r["bad"] is None and r["n"] is None
    assert tuple(r["w"]) == (1, 62751, 62753)


def test_gap_bins(spark):
    got = [r[0] for r in spark.createDataFrame([(3, 3), (3, 4), (3, 2), (9, 2), (3, None)], "q int, t int").select(K.gap_bin("q", "t")).collect()]
    assert got == ["0", "0", "1", "2+", "na"]


def test_text(spark):
    r = one(spark, e=X.entity_normalize(F.lit("  Café-Bar #2 ")), a=X.answer_normalize(F.lit("The  cat, a (big) one.")),
            u=X.unicode_normalize(F.lit("“a”—b″ … c­\u000bd\u0001")), t=X.title_text(F.lit("Title. "), F.lit("body")),
            t0=X.title_text(F.lit(""), F.lit("body")), n=X.speaker_name(F.lit("P1_ANNA")),
            f=X.first_person(F.lit("Anna: I saw Anna's cup. ANNA left, Annas did not"), F.lit("Anna")),
            q=X.nfkc_squeeze(F.lit("ﬁne　 \n x")), p=X.file_stem(F.lit("/a/b.c/DAY1_X_11343000.mp4")), s=X.clip_start_seconds(F.lit("x_11343019.mp4")))
    assert r["e"] == "caf  bar  2" and r["a"] == "cat big one"
    assert r["u"] == "\"a\"-b'' ... c d"
    assert (r["t"], r["t0"], r["n"]) == ("Title. body", "body", "Anna")
    assert r["f"] == "I saw my cup. I left, Annas did not"
    assert r["q"] == " ".join(unicodedata.normalize("NFKC", "ﬁne　 \n x").split())
    assert (r["p"], r["s"]) == ("DAY1_X_11343000", 41670.19)


def test_grading(spark):
    rows = [("B. Bryan", "B", True, True), ("(c)", "C", True, True), ("dumplings.", "C", True, True), ("I pick C, no, I must pick B", "B", False, True),
            ("Surely **C. Dumplings** it is", "C", False, True), ("nothing", "A", False, False), ("There was soup here", "A", False, True)]
    df = spark.createDataFrame(rows, "r string, g string, strict boolean, soft boolean").withColumn(
        "c", M.choice_map(F.lit("soup"), F.lit("Bryan"), F.lit("Dumplings"), F.lit("")))
    for x in df.select("*", M.is_correct("r", "g", "c").alias("s"), M.is_correct_lenient("r", "g", "c").alias("l"), F.size("c").alias("n")).collect():
        assert (x["s"], x["l"], x["n"]) == (x["strict"], x["soft"], 3), x


def test_crop_box_rounds_half_to_even(spark):
    r = one(spark, **G.crop_box(101, 100, F.lit(0.5), F.lit(0.45), 0.5))
    assert (r["x0"], r["y0"]) == (round(0.5 * 101 - 25), round(0.45 * 100 - 25))
    assert r["x1"] - r["x0"] == 50


def test_linspace(spark):
    import numpy as np
    for total, n in ((5, 8), (100, 16), (31, 16), (1, 4), (0, 4), (17, 16)):
        got = one(spark, i=G.linspace_indices(F.lit(total), n))["i"]
        assert got == (list(range(total)) if total <= n else np.linspace(0, total - 1, n, dtype=int).tolist())


def test_axis_changes(spark):
    x, y = G.turn(F.lit(0.2), F.lit(0.7), "rot90cw+flipx")
    r = one(spark, x=x, y=y)
    assert (r["x"], r["y"]) == (pytest.approx(0.7), pytest.approx(0.2))


def test_worked_statistics(spark):
    for a, b, p in ((0, 3, .25), (0, 4, .125), (0, 6, .03125), (2, 2, 1.0), (0, 0, 1.0), (17, 38, .006)):
        assert round(one(spark, p=S.exact_paired_p(F.lit(a), F.lit(b)))["p"], 3) == round(p, 3)
    assert 0 < one(spark, p=S.exact_paired_p(F.lit(4000), F.lit(4400)))["p"] < 1e-4
    assert round(one(spark, c=S.chance_recall(F.lit(1), F.lit(2489), 3))["c"], 4) == 0.0012
    assert round(one(spark, c=S.chance_recall(F.lit(21), F.lit(2489), 50))["c"], 3) == 0.348
    assert one(spark, c=S.chance_recall(F.lit(3), F.lit(3), 1))["c"] == 1.0


def test_repair():
    import json
    assert json.loads(E.close_cut('{"t": [["a", "b", "c"], ["d", "e }')) == {"t": [["a", "b", "c"], ["d"]]}
    assert json.loads(E.close_cut('{"a": "x \\" [", "b": 1, "c')) == {"a": 'x " [', "b": 1}


def test_response_outcomes(spark):
    df = spark.createDataFrame([(1, '{"triples": [["a","b","c"]]}'), (2, '{"triples": [["a","b","c"],["d","e"'), (3, "sorry"), (4, None)], "k int, r string")
    got = {x["k"]: (x["outcome"], x["parsed"]["triples"] if x["parsed"] else None) for x in E.repaired(df, "k", "r", E.TRIPLES).collect()}
    assert got == {1: ("clean", [["a", "b", "c"]]), 2: ("repaired", [["a", "b", "c"], ["d"]]), 3: ("rejected", None), 4: ("rejected", None)}


def test_decisions_and_ids(spark):
    r = one(spark, a=E.decision(F.lit('```json\n{"decision": "search", "memory": "visual", "query": "q"}\n```')), b=E.decision(F.lit("what?")),
            i=E.id_list(F.lit("[3, 1, 3]")), j=E.id_list(F.lit("ids 7 and 2, 7")))
    assert (r["a"]["decision"], r["a"]["memory"], r["b"]["decision"], r["i"], r["j"]) == ("search", "visual", "answer", [3, 1], [7, 2])


def test_decisions_inside_other_text(spark):
    nested = '{"decision": "Search", "reason": "a {brace}", "selected_memory": {"memory_type": "Visual", "search_query": " red cup "}}'
    texts = {
        "prose": "I think {so}: " + nested + ' like {"decision": "answer"}', "nested": nested,
        "cut": nested[:-2].replace('"reason"', '"why": "x, "reason"'), "cut query": nested[:-8], "answer": '{"decision": "answer", "memory": "visual"}',
        "unknown": '{"decision": "wait"}', "deep": '{"decision": "search", "more": {"a": {"b": 1}}, "memory_type": "semantic", "search_query": "q"}',
        "none": None, "empty": ""}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r["k"]: tuple(r["d"]) for r in df.select("k", E.decision("t").alias("d")).collect()}
    found, plain = ("search", "visual", "red cup"), ("answer", None, None)
    assert got == {"prose": found, "nested": found, "cut": found, "cut query": ("search", None, None), "answer": plain, "unknown": plain,
                   "deep": ("search", "semantic", "q"), "none": plain, "empty": plain}


def test_valid_triples_keep_first(spark):
    df = spark.createDataFrame([([["a", "b", "c"], ["x", "y"], ["a", "b", "c"], ["p", "q", "r"]], [["1"], ["2"], ["3"], ["4"]])], "t array<array<string>>, e array<array<string>>")
    r = df.select(E.valid_triples("t").alias("v"), E.valid_with_evidence("t", "e").alias("w")).first()
    assert r["v"] == [["a", "b", "c"], ["p", "q", "r"]] and [x["evidence"] for x in r["w"]] == [["1"], ["4"]]


def test_header_roles_take_the_first_alias():
    roles = header_roles(["u", " Gaze_X ", "PY", "note", "frame", "time_s"])
    assert (roles["x"], roles["y"], roles["time"], roles["depth"]) == (" Gaze_X ", "PY", "time_s", None)
    assert set(header_roles([]).values()) == {None}

"""Many triples with few different vectors: each vector is multiplied once, and results are those of all pairs."""

import numpy as np

from chronoloom.operators import consolidate as C
from chronoloom.operators import neighbours as N


def make_encoder():
    def encoder(texts):
        return [np.array([1.0, int(t[1]) % 3, int(t.split()[2][1:]) % 2, 0.0], np.float32) for t in texts]
    return encoder


def by_hand(rows, top, least, encoder):
    """(s, o) -> (evidence, opened, closed) by all pairs of texts."""
    import hashlib
    held, out = [], []
    for ts in sorted({r[0] for r in rows}):
        fresh = [[s, o, {e}, ts, None] for t, s, o, e in rows if t == ts]
        texts = sorted({f"{s} p {o}" for s, o, *_ in held}, key=lambda t: hashlib.md5(t.encode()).hexdigest())
        closed = []
        for f in fresh:
            v = encoder([f"{f[0]} p {f[1]}"])[0].astype(float)
            scores = []
            for i, t in enumerate(texts):
                w = encoder([t])[0].astype(float)
                scores.append((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 9), i, t))
            near = {t for score, _, t in sorted(scores)[:top] if -score >= least}
            for h in held:
                if h[0] == f[0] and f"{h[0]} p {h[1]}" in near:
                    f[2] = f[2] | h[2]
                    closed.append(h)
        for h in closed:
            h[4] = ts
        held = [h for h in held if h[4] is None] + fresh
        out += fresh
    return sorted((s, o, tuple(sorted(e)), a, b) for s, o, e, a, b in out)


def test_equal_vectors_are_multiplied_once(spark, monkeypatch):
    rows = [(str(i % 3), f"s{i % 5}", f"o{i % 7}{i}", f"e{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "ts string, s string, o string, e string").selectExpr("ts", "s", "'p' AS p", "o", "array(e) AS evidence")
    met, search = [], N.nearest_above

    def counted(queries, rows_, *a, **b):
        met.append((queries.count(), rows_.count()))
        return search(queries, rows_, *a, **b)

    monkeypatch.setattr(N, "nearest_above", counted)
    got = C.consolidate_versions(df, encoder=make_encoder(), top=4, least=0.7).collect()
    assert sorted((r.s, r.o, tuple(r.evidence), r.valid_from, r.valid_to) for r in got) == by_hand(rows, 4, 0.7, make_encoder())
    assert len(met) == 2 and max(max(m) for m in met) <= 6

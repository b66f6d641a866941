"""Removing repeated passages: every byte under a `width`-byte string that also starts in a document with a smaller id.

Sparse, exact, and in five Spark steps over one shuffle of the texts (buckets of documents, `src`) and one of the strings
(buckets of anchors, `dst`):

1. Every window of `width` bytes is filed under its anchor, the least hash among its `GRAM`-byte strings. Equal windows
   have equal anchors, and neighbouring windows mostly share one. A source bucket sends its anchors, not its text.
2. Anchors that two documents have go back to the source buckets that sent them.
3. There, the runs of windows under such anchors are cut out, equal ones folded, with their smallest and largest id.
4. The suffixes that start at the windows are put into classes of equal ones, in the manner of deep-shallow sorting:
   multikey quicksort on characters of eight bytes down to a shallow depth, then blind tries for the groups that still
   agree. No order of suffixes is formed. Windows that agree to `width` bytes are equal; each learns the smallest id, which goes back to the senders of its run.
5. The source buckets remove what those windows cover.

Equal runs of a bucket travel once, so a passage that a third of all documents share is sent once per bucket. Wrong
matches of the short hashes only cost work: strings are compared byte by byte. The number of buckets follows the
bytes of the input. Null texts are empty; a null id counts as larger than all others, and equal ids do not remove each
other's text. Rows are dealt by id and text, so one id may have very many. Repeated rows come back repeated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism

GRAM = 26
BUCKET_BYTES = 32 << 20
SHALLOW = 16
LAST = (1 << 63) - 1

# --- Fixed values: odd multipliers of the rolling hash ------------------------------------------------
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)
# ------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all `size`-byte strings, by doubling."""
    first, base, last = (np.uint64(m) for m in MULTIPLIERS)
    mask = (1 << 64) - 1
    level, span, power, out, done = (data.astype(np.uint64) + np.uint64(1)) * first, 1, int(base), None, 0
    while True:
        if size & span:
            n = len(data) - done - span + 1
            out = level[:n].copy() if out is None else level[:n] * np.uint64(pow(int(base), done, 1 << 64)) + out[span:span + n]
            done += span
        if done == size:
            break
        level = level[:-span] * np.uint64(power) + level[span:]
        power = power * power & mask
        span *= 2
    out ^= out >> np.uint64(29)
    out *= last
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, window after the last) of every run of windows with one anchor."""
    if len(data) < width:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    anchor = sliding_min(gram_hashes(data, min(GRAM, width)), width - min(GRAM, width) + 1)
    edges = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
    return anchor[edges[:-1]], edges[:-1], edges[1:]


def placed(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit key of anchors; both come from different bits."""
    return ((anchors >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), anchors.astype(np.uint32)


def _documents(group: pa.Table) -> list[tuple[int, bytes, int]]:
    """(order, text, row), in an order that does not depend on how the group was fetched."""
    order, texts = group["o"].to_pylist(), group["t"].to_pylist()
    return sorted((o, t, i) for i, (o, t) in enumerate(zip(order, texts, strict=True)))


def _by_bucket(dst: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of a sorted bucket array."""
    if not len(dst):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(dst[1:] != dst[:-1]) + 1, [len(dst)]])
    return [(int(dst[a]), slice(int(a), int(b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({n: pa.array(columns.get(n, []), type=schema.field(n).type) for n in schema.names}, schema=schema)


ANCHORS = pa.schema([("src", pa.int32()), ("dst", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
SHARED = pa.schema([("b", pa.int32()), ("dst", pa.int32()), ("keys", pa.binary())])
CONTENT = pa.schema([("src", pa.int32()), ("dst", pa.int32()), ("keys", pa.binary()), ("ends", pa.binary()),
                     ("low", pa.binary()), ("high", pa.binary()), ("data", pa.binary())])
FOUND = pa.schema([("b", pa.int32()), ("dst", pa.int32()), ("item", pa.binary()), ("first", pa.binary()), ("after", pa.binary()),
                   ("low", pa.binary())])


def send_anchors(group: pa.Table, width: int, buckets: int) -> pa.Table:
    """Distinct anchors of a source bucket, and whether several of its documents have them."""
    each = [np.unique(runs(np.frombuffer(t, dtype=np.uint8), width)[0]) for _, t, _ in _documents(group) if len(t) >= width]
    every = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
    # The short form is made distinct, so that a clash only marks an anchor as shared.
    dst, key = placed(every, buckets)
    short, counts = np.unique(dst.astype(np.uint64) << np.uint64(32) | key, return_counts=True)
    out: dict[str, list] = {n: [] for n in ANCHORS.names}
    for to, at in _by_bucket((short >> np.uint64(32)).astype(np.int32)):
        for name, value in zip(ANCHORS.names, (group["b"][0].as_py(), to, short[at].astype(np.uint32).tobytes(),
                                               np.packbits(counts[at] > 1).tobytes()), strict=True):
            out[name].append(value)
    return _table(out, ANCHORS)


def shared_anchors(group: pa.Table) -> pa.Table:
    """For every source bucket, its anchors that more than one document has."""
    keys = [np.frombuffer(k, dtype=np.uint32) for k in group["keys"].to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(k)) for m, k in zip(group["many"].to_pylist(), keys, strict=True)]
    known, at, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    wanted = counts > 1
    wanted[at[np.concatenate(many).astype(bool)]] = True
    out: dict[str, list] = {n: [] for n in SHARED.names}
    begin = 0
    for src, k in zip(group["src"].to_pylist(), keys, strict=True):
        mine = k[wanted[at[begin:begin + len(k)]]]
        begin += len(k)
        if len(mine):
            for name, value in zip(SHARED.names, (src, group["dst"][0].as_py(), mine.tobytes()), strict=True):
                out[name].append(value)
    return _table(out, SHARED)


def cut_out(documents, shared: dict[int, np.ndarray], width: int, buckets: int):
    """Yields (document, [(bucket, number of the run's text in that bucket, first window)]) and, at last, the folded
    runs per bucket: {bucket: {text: [number, key, smallest id, largest id]}}."""
    wanted = np.sort(np.concatenate([np.uint64(d) << np.uint64(32) | k.astype(np.uint64) for d, k in sorted(shared.items())])
                     if shared else np.zeros(0, dtype=np.uint64))
    folded: dict[int, dict[bytes, list]] = {}
    uses = []
    for order, text, row in documents:
        anchor, first, after = runs(np.frombuffer(text, dtype=np.uint8), width)
        mine = []
        if len(anchor) and len(wanted):
            dst, key = placed(anchor, buckets)
            full = dst.astype(np.uint64) << np.uint64(32) | key
            at = np.minimum(np.searchsorted(wanted, full), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == full)
            for begin, to, end, short in zip(first[hit].tolist(), dst[hit].tolist(), (after[hit] + (width - 1)).tolist(), key[hit].tolist(), strict=True):
                content = text[begin:end]
                bucket = folded.setdefault(to, {})
                entry = bucket.get(content)
                if entry is None:
                    entry = bucket[content] = [len(bucket), short, order, order]
                elif order > entry[3]:           # documents come by id, so the first id stays the smallest
                    entry[3] = order
                mine.append((to, entry[0], begin))
        uses.append(mine)
    return uses, folded


def _shared(group: pa.Table) -> dict[int, np.ndarray]:
    return {d: np.frombuffer(k, dtype=np.uint32) for d, k in zip(group["dst"].to_pylist(), group["keys"].to_pylist(), strict=True)}


def send_runs(documents: pa.Table, shared: pa.Table, width: int, buckets: int) -> pa.Table:
    out: dict[str, list] = {n: [] for n in CONTENT.names}
    if documents.num_rows and shared.num_rows:
        src = documents["b"][0].as_py()
        _, folded = cut_out(_documents(documents), _shared(shared), width, buckets)
        for to, texts in folded.items():
            entries = list(texts.values())
            values = (src, to, np.array([e[1] for e in entries], dtype=np.uint32).tobytes(),
                      np.cumsum([len(t) for t in texts]).astype(np.int64).tobytes(),
                      np.array([e[2] for e in entries], dtype=np.int64).tobytes(),
                      np.array([e[3] for e in entries], dtype=np.int64).tobytes(), b"".join(texts))
            for name, value in zip(CONTENT.names, values, strict=True):
                out[name].append(value)
    return _table(out, CONTENT)


def _characters(data: np.ndarray, starts: np.ndarray, offset: int) -> np.ndarray:
    """The eight bytes from `offset` of every suffix, as one character in byte order."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[starts + offset]).view(">u8").ravel().astype(np.uint64)


def equal_suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A class per suffix; suffixes share one if their first `depth` bytes agree. `data` has `depth` bytes from each start."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    group = np.zeros(len(starts), dtype=np.int64)
    active = np.arange(len(starts))
    shallow = min(SHALLOW, depth) // 8 * 8
    fresh = 1
    # Multikey quicksort: by one character at a time, and only where the ones before were equal.
    for offset in range(0, shallow, 8):
        char = _characters(padded, starts[active], offset)
        order = np.lexsort((char, group[active]))
        active, char = active[order], char[order]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (char[1:] != char[:-1]) | (group[active][1:] != group[active][:-1])
        number = np.cumsum(new) - 1
        group[active] = fresh + number
        fresh += int(number[-1]) + 1 if len(number) else 0
        sizes = np.bincount(number)
        active = active[sizes[number] > 1]
    # Blind tries: a group's first suffix is its trie's path; another one leaves the path where it first differs,
    # by the byte that it has there, and those that leave at one place by one byte form a trie of their own.
    tail = depth - shallow
    if tail:
        view = np.lib.stride_tricks.sliding_window_view(padded, tail)
    while tail and len(active):
        order = np.argsort(group[active], kind="stable")
        active = active[order]
        new = np.ones(len(active), dtype=bool)
        new[1:] = group[active][1:] != group[active][:-1]
        path = active[np.flatnonzero(new)][np.cumsum(new) - 1]
        leaves, place = [], []
        for i in range(0, len(active), 1 << 18):
            a, p = active[i:i + (1 << 18)], path[i:i + (1 << 18)]
            mine = view[starts[a] + shallow]
            differs = mine != view[starts[p] + shallow]
            off = differs.any(axis=1)
            where = differs[off].argmax(axis=1)
            leaves.append(a[off])
            place.append(where * 256 + mine[off][np.arange(len(where)), where])
        leaving, at = np.concatenate(leaves), np.concatenate(place)
        if not len(leaving):
            break
        _, number = np.unique(np.stack([group[leaving], at]), axis=1, return_inverse=True)
        number = number.ravel()
        group[leaving] = fresh + number
        fresh += int(number.max()) + 1
        active = leaving[np.bincount(number)[number] > 1]
    return group


def smallest_ids(group: pa.Table, width: int) -> pa.Table:
    """For every run sent here, the windows that a smaller id than the run's largest one has, with that id."""
    numbers: dict[bytes, int] = {}
    keys, lows, sent = [], [], []
    for src, k, e, lo, hi, data in zip(*(group[n].to_pylist() for n in ("src", "keys", "ends", "low", "high", "data")), strict=True):
        k, ends = np.frombuffer(k, dtype=np.uint32), np.frombuffer(e, dtype=np.int64).tolist()
        lo = np.frombuffer(lo, dtype=np.int64).tolist()
        mine, begin = [], 0
        for i, end in enumerate(ends):
            n = numbers.setdefault(data[begin:end], len(numbers))
            begin = end
            if n == len(keys):
                keys.append(k[i])
                lows.append(lo[i])
            elif lo[i] < lows[n]:
                lows[n] = lo[i]
            mine.append(n)
        sent.append((src, np.array(mine, dtype=np.int64), np.frombuffer(hi, dtype=np.int64)))
    texts = list(numbers)
    low = np.array(lows, dtype=np.int64)
    count = np.array([len(t) - width + 1 for t in texts], dtype=np.int64)
    # Runs alone under their key have nothing to be compared with; all their windows have the run's smallest id.
    _, at, several = np.unique(np.array(keys, dtype=np.uint32), return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(several[at] > 1)
    owner, first, after, ids = np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64), count.copy(), low.copy()
    if len(mixed):
        size = np.array([len(texts[i]) for i in mixed], dtype=np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(texts[i] for i in mixed), dtype=np.uint8)
        n = count[mixed]
        own = np.repeat(np.arange(len(mixed)), n)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        of = equal_suffixes(data, begin[own] + offset, width)
        best = np.full(int(of.max()) + 1, LAST, dtype=np.int64)
        np.minimum.at(best, of, low[mixed][own])
        value = best[of]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
        edge = np.flatnonzero(new)
        alone = several[at] == 1
        owner = np.concatenate([owner[alone], mixed[own[edge]]])
        first = np.concatenate([first[alone], offset[edge]])
        after = np.concatenate([after[alone], offset[np.append(edge[1:], len(own)) - 1] + 1])
        ids = np.concatenate([ids[alone], value[edge]])
    order = np.argsort(owner, kind="stable")
    owner, first, after, ids = owner[order], first[order], after[order], ids[order]
    begins, ends = np.searchsorted(owner, np.arange(len(texts))), np.searchsorted(owner, np.arange(len(texts)), side="right")
    out: dict[str, list] = {c: [] for c in FOUND.names}
    for src, mine, high in sent:
        n = ends[mine] - begins[mine]
        item = np.repeat(np.arange(len(mine)), n)
        part = np.repeat(begins[mine], n) + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        useful = ids[part] < high[item]
        item, part = item[useful], part[useful]
        if len(item):
            values = (src, group["dst"][0].as_py(), item.astype(np.uint32).tobytes(), first[part].astype(np.int64).tobytes(),
                      after[part].astype(np.int64).tobytes(), ids[part].tobytes())
            for name, value in zip(FOUND.names, values, strict=True):
                out[name].append(value)
    return _table(out, FOUND)


def _keep(documents: pa.Table, messages: pa.Table, width: int, buckets: int, key_type: pa.DataType) -> pa.Table:
    schema = pa.schema([("key", key_type), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
    if not documents.num_rows:
        return _table({}, schema)
    rows = _documents(documents)
    asked = messages.filter(pa.compute.is_valid(messages["keys"])) if messages.num_rows else messages
    told = messages.filter(pa.compute.is_valid(messages["item"])) if messages.num_rows else messages
    uses, _ = cut_out(rows, _shared(asked), width, buckets) if told.num_rows else ([[] for _ in rows], None)
    answers = {}
    for dst, item, *parts in zip(*(told[n].to_pylist() for n in ("dst", "item", "first", "after", "low")), strict=True):
        item = np.frombuffer(item, dtype=np.uint32)
        answers[dst] = (item, *(np.frombuffer(p, dtype=np.int64) for p in parts))
    texts = [t for _, t, _ in rows]
    merged = _merged_spans([len(t) for t in texts], np.array([o for o, _, _ in rows], dtype=np.int64), uses, answers, width)
    out: dict[str, list] = {"key": [None] * len(rows), "spans": [[]] * len(rows), "kept": [b""] * len(rows)}
    keys = documents["k"].to_pylist()
    for text, (_, _, row), spans in zip(texts, rows, merged, strict=True):
        edges = [0, *(e for span in spans for e in span), len(text)]
        out["key"][row], out["spans"][row] = keys[row], spans
        out["kept"][row] = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text
    return _table(out, schema)


def _merged_spans(sizes: list[int], order: np.ndarray, uses: list[list[tuple[int, int, int]]], answers: dict, width: int) -> list[list[list[int]]]:
    """The maximal byte ranges of every document that windows of smaller ids cover. All documents lie on one line, a byte apart."""
    base = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)])
    owner = np.repeat(np.arange(len(uses)), [len(u) for u in uses])
    flat = np.array([use for mine in uses for use in mine], dtype=np.int64).reshape(-1, 3)
    begins, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    by_bucket = np.argsort(flat[:, 0], kind="stable")
    for dst, at in _by_bucket(flat[by_bucket, 0]):
        if dst not in answers:
            continue
        item, first, after, low = answers[dst]
        mine = by_bucket[at]
        a, b = np.searchsorted(item, flat[mine, 1]), np.searchsorted(item, flat[mine, 1], side="right")
        n = b - a
        use = np.repeat(mine, n)
        part = np.repeat(a, n) + np.arange(len(use)) - np.repeat(np.cumsum(n) - n, n)
        smaller = low[part] < order[owner[use]]
        use, part = use[smaller], part[smaller]
        start = base[owner[use]] + flat[use, 2]
        begins.append(start + first[part])
        ends.append(start + after[part] + width - 1)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    by_begin = np.argsort(begin, kind="stable")
    begin, end = begin[by_begin], np.maximum.accumulate(end[by_begin])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(begin)) - 1 if len(begin) else np.zeros(0, dtype=np.int64)
    begin, end = begin[new], end[last]
    document = np.searchsorted(base, begin, side="right") - 1
    spans: list[list[list[int]]] = [[] for _ in sizes]
    for d, x, y in zip(document.tolist(), (begin - base[document]).tolist(), (end - base[document]).tolist(), strict=True):
        spans[d].append([x, y])
    return spans


def remove_repeats(docs: DataFrame, key: str, text: str, width: int = 50, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, spans, kept): the removed byte ranges and the bytes that are left, a row per row of `docs`.

    `key` is an integer column. Buckets hold about `bucket_bytes` of text."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(parallelism(docs.sparkSession), math.ceil(total / bucket_bytes))
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(LAST))
    rows = docs.select(F.pmod(F.xxhash64(order, raw), F.lit(buckets)).cast("int").alias("b"), F.col(key).cast("bigint").alias("k"),
                       order.alias("o"), raw.alias("t"))
    plain = {"binary": "binary", "int32": "int"}

    def ddl(schema: pa.Schema) -> str:
        return ", ".join(f"{f.name} {plain[str(f.type)]}" for f in schema)

    anchors = rows.groupBy("b").applyInArrow(lambda g: send_anchors(g, width, buckets), ddl(ANCHORS))
    shared = anchors.groupBy("dst").applyInArrow(shared_anchors, ddl(SHARED))
    content = rows.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(lambda d, s: send_runs(d, s, width, buckets), ddl(CONTENT))
    found = content.groupBy("dst").applyInArrow(lambda g: smallest_ids(g, width), ddl(FOUND))
    messages = shared.unionByName(found, allowMissingColumns=True)
    kept = rows.groupBy("b").cogroup(messages.groupBy("b")).applyInArrow(
        lambda d, m: _keep(d, m, width, buckets, pa.int64()), "key bigint, spans array<array<bigint>>, kept binary")
    return kept.select(F.col("key").alias(key), "spans", "kept")

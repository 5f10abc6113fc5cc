"""Manifest, suffix deduplication and zone-map negatives against brute force and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsense.llm import merkle, suffix_dedup, zone_negatives
from tests.llm.test_operators import prose

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, pos string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---------------------------------------------------------------- 11 manifest

def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_leaf(r):
    return sha(*[cell(v) for v in r[:5]])


def brute_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 3 * 3
            p.append(("".join(nodes[run:at[i]]), "".join(nodes[at[i] + 1:run + 3])))
            at[i] //= 3
        nodes = [sha(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    """(id, leaf, subroot, root, proof, folded root) with the line breaks of even rows gone."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    subs, members = [], []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        sub, paths = brute_tree([brute_leaf(r) for r in own])
        subs.append(sub)
        members.append((own, paths))
    root, tops = brute_tree(subs)
    out = []
    for sub, (own, paths), top in zip(subs, members, tops):
        for r, p in zip(own, paths):
            text = r[4]
            if text and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = brute_leaf((*r[:4], text))
            for left, right in p + top:
                node = sha(left, node, right)
            out.append((r[0], brute_leaf(r), sub, root,
                        sha(*[x for step in p + top for x in step]), node))
    return sorted(out, key=str)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = merkle.manifest(docs, {"text": F.when(even, F.replace(
        "text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded"])
                   for r in out.select("*", merkle.proof_digest(F.col("path")).alias("proof"),
                                       merkle.folded(F.col("claimed"), F.col("path"))
                                       .alias("folded")).collect()), key=str)


def test_manifest_against_brute_force_and_odd_rows(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 6 + ["é", "b", None, "one" if i == 7 else "b"]), "en", i,
             f"a{i}\nb") for i in rnd.sample(range(1000), 120)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "hot", None, 3, "tie"),
             (5, "hot", None, 3, "other tie"), (5, "hot", None, 3, "tie"),
             (-1, "only", "en", None, "\n" * 50_000), (2, "", "", 0, "")]
    assert manifest(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_manifest_of_every_small_shape(spark, n):
    rows = [(i, "s", "en", 1, "t\n") for i in range(n)]
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_finds_a_changed_row_and_is_empty_for_an_empty_table(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], None, 1, f"t{i}", 1, "x") for i in range(20)],
                                 DOCS)
    out = merkle.manifest(docs, {"text": F.when(F.col("doc_id") == 6, "changed")
                                 .otherwise(F.col("text"))})
    bad = out.where(merkle.folded(F.col("claimed"), F.col("path")) != F.col("root"))
    assert [r["id"] for r in bad.collect()] == [6]
    assert merkle.manifest(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- 12 suffixes

def test_suffix_order_equals_sorting(spark):
    rnd = random.Random(3)
    for _ in range(12):
        base = bytes(rnd.choice(b"ab") for _ in range(300))
        data = b"".join(base[rnd.randrange(200):][:rnd.randrange(20, 200)] for _ in range(30))
        data += b"z" * 150 + bytes(rnd.choice(b"\x00\xff") for _ in range(200))
        whole = data + bytes(120)
        order, new = suffix_dedup.suffix_order(
            np.frombuffer(whole, np.uint8), np.arange(len(data)))
        keys = [whole[i:i + 100] for i in order]
        assert keys == sorted(keys)
        assert all((a != b) == n for a, b, n in zip(keys[1:], keys, new[1:]))


def brute_repeats(rows, length):
    """{row: (spans, kept)} of (id, text) rows."""
    raw = [(-1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in raw:
        gone, seen = bytearray(len(b)), set()
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if least[w] < i or w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        out.append((len(b), "".join(map(str, gone)).replace("0", " ").split(),
                    bytes(x for x, g in zip(b, gone) if not g)))
    return out


def suffix_rows(seed):
    rnd = random.Random(seed)
    passage = [prose(rnd, n) for n in (40, 25, 60)]
    rows = [(None, passage[0]), (None, None), (1, ""), (2, "é" * 99), (3, "é" * 120), (3, "é" * 120),
            (4, "x" * 5000), (5, "ab" * 1500 + passage[1]), (5, "other text " + passage[1]),
            (-9, prose(rnd, 80)), (900, prose(rnd, 3000))]
    for i in range(60):
        t = prose(rnd, rnd.randint(0, 30))
        if i % 3:
            t = f"{t} {rnd.choice(passage)} {prose(rnd, rnd.randint(0, 9))}"
        if i % 7 == 0:
            t = rnd.choice(rows)[1] or t
        rows.append((100 + rnd.randrange(500) if i % 10 else 50, t))
    return rows


def same_as_brute(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows],
                                 "doc_id long, text string, at int, spans string").repartition(4)
    got = sorted(((r["id"], r["n_bytes"], [x["end"] - x["begin"] for x in r["spans"]],
                   bytes(r["kept"])) for r in suffix_dedup.deduplicate(docs, **kw).collect()),
                 key=str)
    want = sorted(((i, n, [len(x) for x in spans], kept) for (i, _), (n, spans, kept)
                   in zip(rows, brute_repeats(rows, kw.get("length", 100)))), key=str)
    assert got == want
    return sum(len(x[2]) for x in got)


def test_repeats_against_brute_force_and_odd_rows(spark):
    assert same_as_brute(spark, suffix_rows(5)) > 30


def test_hot_anchors_and_large_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "_HOT_LEAST", 1)
    monkeypatch.setattr(suffix_dedup, "_HOT_SHARE", 1 << 30)
    assert same_as_brute(spark, suffix_rows(6)) > 30        # every repeated anchor is hot
    assert same_as_brute(spark, suffix_rows(7), cap=1) > 30  # and every group too large


def test_large_groups_without_hot_anchors_and_another_length(spark):
    assert same_as_brute(spark, suffix_rows(8), cap=1) > 30
    assert same_as_brute(spark, suffix_rows(9), length=40, gram=12) > 30


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    text = prose(rnd, 900)
    rows = [(1, text), (2, "first " + text[700:2400] + " last"), (3, text + text[:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = [(len(b), [len(x) for x in s], k) for b, s, k in
            ((t.encode(), s, k) for (_, t), (_, s, k) in zip(rows, brute_repeats(rows, 100)))]
    for block in (1 << 20, 333):
        rows_ = docs.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("mark"),
                            "text").toPandas()
        batch = pa.RecordBatch.from_pandas(rows_, preserve_index=False)
        monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
        starts = {d: set() for d in (1, 2, 3)}
        for out in suffix_dedup._segment_rows(100, 20)([batch]):
            for r in out.to_pylist():
                lo = (r["at"] >> 8) & 0xFFFFFFFF
                new = set(range(lo, lo + (r["at"] & 255)))
                assert not new & starts[r["doc"]]
                starts[r["doc"]] |= new
        assert {d: len(s) for d, s in starts.items()} == {
            i: len(t.encode()) - 99 for i, t in rows}      # every window, once
    monkeypatch.undo()
    got = {r["id"]: (r["n_bytes"], [x["end"] - x["begin"] for x in r["spans"]], bytes(r["kept"]))
           for r in suffix_dedup.deduplicate(docs).collect()}
    assert [got[i] for i, _ in rows] == want


def test_nothing_to_remove_from_an_empty_table(spark):
    assert suffix_dedup.deduplicate(
        spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---------------------------------------------------------------- 13 zones

VECS = "vec_id long, embedding array<float>, label int, id int, q string"


def brute_negatives(rows):
    """The contract, row by row; equal rows count once."""
    seen, pts = set(), []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(
                x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        if (i, lab, q) not in seen:
            seen.add((i, lab, q))
            pts.append((i, lab, q))
    out = []
    for a in pts:
        if a[0] % 100:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))
        near = sorted(((-score(b), b[0]) for b in pts if b is not a and b[1] == a[1]))[:5]
        for s, i in near:
            fit = sorted((-score(b), b[0]) for b in pts if b[1] != a[1]
                         and 80 * -s <= 100 * score(b) <= 100 * -s)[:5]
            out += [(a[0], i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECS).repartition(4)
    return sorted(tuple(r) for r in zone_negatives.mine(df, F.col("label")).collect())


def vectors(seed, n, dim):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(0, 0.3, (6, dim))
    return [(i, [float(x) for x in centre[i % 6] + rnd.normal(0, 0.2, dim)], int(i % 4))
            for i in range(n)]


@pytest.mark.parametrize("dim, units", [(8, 64), (3, 16), (70, 4096)])
def test_negatives_against_brute_force(spark, monkeypatch, dim, units):
    monkeypatch.setattr(zone_negatives, "UNIT_ROWS", units)
    monkeypatch.setattr(zone_negatives, "BLOCK_ROWS", 8)
    rows = vectors(dim, 700, dim)
    want = brute_negatives(rows)
    assert len(want) > 20 and mined(spark, rows) == want


def test_negatives_of_odd_rows(spark):
    rows = vectors(4, 260, 4)
    same = rows[7][1]
    rows += [(1000 + i, same, i % 3) for i in range(60)]          # one vector in many rows
    rows += [(400, [0.1] * 4, 1)] * 3 + [(500, [0.0] * 4, 2), (600, [0.2, 0.1], 0),
             (None, same, 1), (700, None, 1), (701, same, None), (702, [0.1, None, 0.1, 0.1], 1),
             (800, [float("nan")] * 4, 1), (801, [float("inf"), 0.0, 0.0, 0.0], 1),
             (900, [], 3), (-100, same, 77)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_an_empty_table(spark):
    assert mined(spark, []) == []


def test_bounds_hold_every_product_and_prune(spark):
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(-90, 90, (30, 6)), rnd.integers(-90, 90, (400, 6)) // 9
    low, high = zone_negatives.bounds(a.astype(float), b.min(0)[None].astype(float),
                                      b.max(0)[None].astype(float))
    s = a @ b.T
    assert (low[:, 0] <= s.min(1)).all() and (high[:, 0] >= s.max(1)).all()


def test_the_curve_visits_every_cell_in_unit_steps():
    for dim, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dim), -1).reshape(-1, dim)
        keys = zone_negatives.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_far_blocks_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(zone_negatives, "UNIT_ROWS", 32)
    monkeypatch.setattr(zone_negatives, "BLOCK_ROWS", 8)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.eye(4)[i % 4] * 3 + rnd.normal(0, 0.02, 4)], int(i % 2))
            for i in range(800)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECS)
    blocks = zone_negatives.Blocks(zone_negatives.quantised(
        df, "vec_id", "embedding", F.col("label")), 100, 5)
    units = blocks.units.count()

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])] * 5,
                                             names=["uid", "anchor_id", "row", "id", "score"])
    pairs = sum(r["uid"] for r in blocks.search(None, None, counted).collect())
    groups = blocks.anchors.count()
    assert pairs < units * groups / 2
    assert mined(spark, rows) == brute_negatives(rows)

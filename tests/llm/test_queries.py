"""Registered text queries against their SQL, and the pipeline against brute force."""

import collections
import hashlib
import math
import random

import pytest

import corpus_pipeline
from tabsense.llm.oracle import ORACLE
from tabsense.llm.queries import QUERIES
from tests.llm.test_operators import brute_classes, brute_hits, prose
from tests.oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert ok, msg


def test_queries_without_sql_are_the_fitted_or_iterated_ones():
    assert set(QUERIES) - set(ORACLE) == {
        "op1_sharding", "op2_prob_minhash", "op3_ordinal", "op4_line_crf", "op8_language",
        "op9_toxicity", "op12_suffix_dedup"}
    assert len(QUERIES) == 13


def letters(text):
    return text.translate(str.maketrans("0123456789", "abcdefghij"))


def corpus():
    rnd = random.Random(21)
    items = [(i, letters(prose(rnd, 14))) for i in range(4)]
    rows, labels = [], []
    for i in range(240):
        t = letters(prose(rnd, rnd.randint(15, 60)))
        toxic = i % 6 == 0
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), "zork" + rnd.choice(["a", "en", "il"]))
            t = " ".join(w)
        labels.append((i, 1, int(toxic)))
        rows.append((i, t, "en", "big" if i % 4 else "small"))
    for i in range(40):                                     # near and exact copies
        w = rows[rnd.randrange(240)][1].split()
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append((300 + i, " ".join(w), "en", "big"))
    for i in range(12):                                     # benchmark passages
        t = letters(prose(rnd, 30))
        rows.append((400 + i, f"{t}. {items[i % 4][1].upper()}! {letters(prose(rnd, 5))}", "en",
                     "small"))
    rows += [(500, None, None, None), (501, "", "en", "big"), (502, "", "en", "big")]
    return rows, labels, items


def poisson(rate, seed, identity):
    if rate <= 0:
        return 0
    parts = math.ceil(rate / 8)
    total = 0
    for part in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}|{part}|{identity}".encode()).hexdigest()[:13], 16)
             + 0.5) / 2 ** 52
        k, term = 0, math.exp(-rate / parts)
        cdf = term
        while cdf < u:
            k += 1
            term *= rate / parts / k
            cdf += term
        total += k
    return total


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, "
                                 "n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if "zork" not in (r[1] or "")]
    names = brute_classes(left)
    left = [r for i, r in enumerate(left) if r[1] is None or names[i] == r[0]]
    left = [r for r in left if not brute_hits(r[1], items)[1]]
    n = collections.Counter(r[3] for r in left)
    want = collections.Counter()
    for r in left:
        copies = poisson(len(left) / len(n) / n[r[3]], 7, r[0])
        if copies:
            want[r[0]] = copies
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == want
    load = collections.Counter()
    text = {r[0]: r[1] for r in rows}
    homes = collections.defaultdict(set)
    for r in out:
        load[r["shard"]] += r["size"]
        if text[r["doc_id"]] is not None:
            homes[text[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 16
    assert all(len(s) == 1 for s in homes.values()) and len(load) <= corpus_pipeline.SHARDS


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dedup", "decontamination", "source_mix", "shards"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_tool_calls_of_the_query_need_the_topological_order(spark):
    rows = [r for r in QUERIES["op7_tool_calls"](spark, "/root/testdata/sf0.01").collect()
            if r["record"] is not None]
    placed = collections.defaultdict(list)
    for r in rows:
        placed[r["conv_id"]].append(r)
    moved = sum(r["position"] is not None and r["position"] != i for conv in placed.values()
                for i, r in enumerate(sorted(conv, key=lambda r: r["turn"])))
    assert moved > 20
    assert sum(r["position"] is None for r in rows) > 5          # on or behind a cycle
    assert max(r["level"] or 0 for r in rows) >= 2 and sum(r["errors"] != "" for r in rows) > 50
    assert {e for r in rows for e in r["errors"].split(",")} >= {
        "missing:prompt", "type:words", "unknown:note", "unknownTool"}

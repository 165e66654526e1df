"""Vectors and pages: components by HNSW, exact top-k, WARC round trips; components of graphs."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import graph, hnsw, pivot_search, vectors, warc
from cadastra.runtime import Workspace

VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, 0) for i, v in rows], VECTORS)


def odd_vectors():
    return [(900, None), (901, []), (902, [0.0, 0.0]), (903, [1.0, None]), (904, [1.0, float("nan")]), (905, [float("inf"), 1.0]), (906, [1.0, 2.0, 3.0]), (907, [2.0, 4.0, 6.0])]


def test_hnsw_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([c + rng.normal(size=(n, 16)) * 0.22 for c, n in zip(centres, [120, 60, *[5] * 28], strict=True)] + [rng.normal(size=(60, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(800 + k, x[k].tolist()) for k in range(20)] + [(820, (x[3] * 2).tolist())]
    vectors = table(spark, rows + odd_vectors())
    got = {r.vec_id: r for r in hnsw.near_duplicates(vectors.withColumn("n", F.lit(1)), Workspace(spark, "t")).collect()}
    ids = [i for i, _ in rows]
    data = np.array([v for _, v in rows], dtype=np.float64)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    reach = np.linalg.matrix_power((linked | np.eye(len(ids), dtype=bool)).astype(float), 1) > 0
    while True:
        wider = (reach.astype(float) @ reach.astype(float)) > 0
        if (wider == reach).all():
            break
        reach = wider
    found, total = sum(got[i].n_links for i in ids), int(linked.sum())
    assert 0.99 * total <= found <= total
    for n, i in enumerate(ids):
        assert got[i].component_id == min(np.array(ids)[reach[n]])
        assert got[i].kept == (got[i].component_id == i)
    for i in range(900, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[906].n_links, got[907].component_id) == (1, 906)


def test_hnsw_graph_survives_packing():
    rng = np.random.default_rng(2)
    unit = hnsw.unit_rows(rng.normal(size=(300, 8)))
    made = hnsw.Hnsw(unit)
    again = hnsw.Hnsw.unpacked(unit, *made.packed())
    q = unit[7].astype(np.float32)
    assert sorted(made.query(q, 10)) == sorted(again.query(q, 10)) and max(again.query(q, 10))[1] == 7


def test_hnsw_finds_rare_links():
    rng = np.random.default_rng(6)
    unit = hnsw.unit_rows(rng.normal(size=(3000, 64)))
    queries = hnsw.unit_rows(rng.normal(size=(600, 64)))
    # one query in twenty, none of the evenly spread ones of the audit, has one partner at a cosine of 0.92
    audited = np.linspace(0, 599, 48).astype(int)
    near = np.setdiff1d(np.arange(600), audited)[::20]
    partners = rng.choice(3000, len(near), replace=False)
    aside = rng.normal(size=(len(near), 64))
    aside = hnsw.unit_rows(aside - (aside * unit[partners]).sum(1, keepdims=True) * unit[partners])
    queries[near] = 0.92 * unit[partners] + np.sqrt(1 - 0.92**2) * aside
    truth = (queries @ unit.T) >= 0.9
    assert not truth[audited].any()
    # a graph of few links, so that a beam of 16 misses as it does in a large shard
    graph = hnsw.Hnsw(unit, neighbours=3, build_beam=6)
    found = hnsw.shard_links(unit, queries, graph, 0.9)
    rows = found[0] if isinstance(found, tuple) else found
    assert sum(len(r) for r in rows) >= 0.99 * truth.sum()


@pytest.mark.parametrize("size", [1, 40, 100])
@pytest.mark.parametrize("in_order", [False, True])
def test_hnsw_finds_groups_by_its_graph(size, in_order):
    rng = np.random.default_rng(size)
    unit = hnsw.unit_rows(np.repeat(rng.normal(size=(1000 // size, 32)), size, axis=0) + 0.05 * rng.normal(size=(1000 // size * size, 32)))
    unit = unit if in_order else unit[rng.permutation(len(unit))]
    graph, truth = hnsw.Hnsw(unit), (unit @ unit.T) >= 0.9
    # a beam that is narrower than the groups, and no audit, which alone looks at all rows
    found = hnsw.shard_links(unit, unit[:200], graph, 0.9, beam=32)
    assert sum(len(r) for r in found) >= 0.995 * truth[:200].sum()


def test_hnsw_reaches_every_node():
    unit = hnsw.unit_rows(np.repeat(np.eye(8), 60, axis=0) + 1e-3 * np.random.default_rng(5).normal(size=(480, 8)))
    graph = hnsw.Hnsw(unit, neighbours=3, build_beam=4)
    assert len(graph.query(unit[0].astype(np.float32), len(unit))) == len(unit)


def test_hnsw_of_nothing(spark):
    assert hnsw.near_duplicates(table(spark, []), Workspace(spark, "t")).count() == 0
    rows = hnsw.near_duplicates(table(spark, odd_vectors()[:2]), Workspace(spark, "t")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [(900, 0, 900), (901, 0, 901)]


def test_pivot_search_is_exact(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 12)), 1).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist()) for i in range(60)] + odd_vectors() + [(950, [3e30] * 12)]
    table(spark, rows).withColumn("rank", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in pivot_search.op7_pivot_topk(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)}
    limit = 2**63 - 1
    for q in (i for i in usable if i % 50 == 0):
        scores = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(usable[q], v, strict=True)))), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert set(got) == {i for i in usable if i % 50 == 0}


@pytest.mark.parametrize("huge", [1e30, 1e160, 1e300])
def test_pivot_search_with_values_whose_squares_overflow(spark, tmp_path, huge):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-3, 3), rng.uniform(-3, 3)]) for i in range(1, 140)] + [(150, [huge, -huge]), (151, [huge, 1.0]), (200, [-huge, 2.0]), (201, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {i: [math.floor(256 * x) if abs(256 * x) < 2**62 else int(256 * x) for x in v] for i, v in rows}
    score = lambda a, b: pivot_search.held(sum(x * y for x, y in zip(a, b, strict=True)))
    expected = {(q, n, c, s) for q in whole if q % 50 == 0 for n, (s, c) in enumerate(sorted(((score(whole[q], v), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))[:5], 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.op7_pivot_topk(spark, str(tmp_path)).collect()} == expected


def test_blocks_are_bounded_in_bytes(spark):
    frame = spark.createDataFrame([(i, [float(i)] * (1000 if i % 2 else 3)) for i in range(60)], "id long, values array<double>").coalesce(1)
    sizes = {(r.dim, r.size) for r in vectors.blocks(frame, 25, 80_000).collect()}
    assert sizes == {(1000, 10), (3, 25), (3, 5)}


def test_pivot_search_of_nothing(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert pivot_search.op7_pivot_topk(spark, str(tmp_path)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, int(n)) for n in rng.integers(501, 560, 80)] + [(7, 7), (3, 2), (2, 3)]
    rows = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long"), Workspace(spark, "t")).collect()}
    assert {rows[n] for n in range(100, 161)} == {100} and rows[3] == rows[2] == 2 and 7 not in rows
    assert all(rows[n] == 500 for n in rows if n >= 500)
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long"), Workspace(spark, "t")).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rows = [(i, f"https://Host{i % 5}.Example.org:80/p{i % 7}?q={i % 3}", f"<p>text {i % 11}</p>") for i in range(200)]
    rows += [(300, None, None), (301, "not a url \t\n", ""), (302, "http://a.b", "é" * 100_000), (303, "http://a.b", "é" * 100_000), (5, rows[5][1], rows[5][2]), (None, "http://c.d", "lone"), (None, "http://c.d", "<p>text 3</p>")]
    frame = pages(spark, rows).withColumn("digest", F.lit("x"))
    workspace = Workspace(spark, "t")
    ranges = warc.write_index(warc.write_archive(warc.plan_captures(frame), workspace), workspace, block=7)
    queries = frame.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    got = sorted((tuple(r) for r in warc.read_captures(queries, ranges, workspace).collect()), key=str)
    winner = {}
    for number, _, html in rows:
        if number is not None:
            winner[html or ""] = max(winner.get(html or "", -1), number)
    expected = []
    for number, _, html in rows:
        data = (html or "").encode()
        best = winner.get(html or "")
        response = best is None or number == best
        expected.append((number, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else best))
    assert got == sorted(expected, key=str)
    missing = spark.createDataFrame([("org,nowhere)/ -",)], "key string")
    assert warc.read_captures(missing, ranges, workspace).count() == 0


def test_warc_records_are_wellformed_gzip_members():
    raw = warc.record(7, "org,a)/ 7", "http://a.org/\r\nX: y", b"<p>hi</p>", 9, "ABC", None)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and b"\r\nX: y" not in raw.split(b"\r\n\r\n")[0]
    assert warc.parse_record(raw)["payload"] == b"<p>hi</p>"
    again = warc.parse_record(warc.record(8, "k", "u", None, 9, "ABC", 7))
    assert again["warc-type"] == "revisit" and again["payload_bytes"] == 9 and again["payload"] == b""


def test_warc_of_nothing(spark, tmp_path):
    pages(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op2_warc(spark, str(tmp_path)).count() == 0


def test_surt(spark):
    urls = ["http://user@WWW.Example.com:8080/a?b#c", "https://example.com", "mailto:x", None, "http:///x"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", warc.surt(F.col("u")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == ["com,example,www)/a?b#c", "com,example)/", "mailto:x", "", "http:///x"]


@pytest.mark.parametrize("shards", [1, 2, 5, 6])
def test_any_two_shards_meet_once(spark, shards):
    rows = spark.range(shards).select(F.col("id").cast("int").alias("of")).select("of", F.explode(hnsw._searched(shards)).alias("shard")).collect()
    met = [frozenset((r.of, r["shard"])) for r in rows]
    assert len(met) == len(set(met)) == shards * (shards + 1) // 2
    # no shard's graph is searched by more than half of the others, and one
    assert max(sum(r["shard"] == s for r in rows) for s in range(shards)) <= shards // 2 + 1


def test_links_between_shards_count_at_both_ends(spark):
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(size=(20, 16)), 12, axis=0)
    data = centres + 0.05 * rng.normal(size=centres.shape)
    # equal vectors are one node with a count
    data[1::12] = data[0::12]
    unit = hnsw.unit_rows(data)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(frame, Workspace(spark, "t")).collect()}
    assert got == dict(enumerate(links.tolist()))

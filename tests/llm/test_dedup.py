import random

import numpy as np
import pytest
import xxhash

from tests.compare import same
from tests.conftest import SF_ORACLE
from tidelog.llm import embedding_dedup, exact_dedup, queries, simhash
from tidelog.llm.common import Workspace, connected_components, table
from tidelog.llm.numpy_links import Blocks


class Groups:
    """Components by brute force."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_duckdb(spark, duck, name):
    same(queries.QUERIES[name](spark, SF_ORACLE), duck(SF_ORACLE).sql(queries.SQL[name]))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(30)]
    links += [(7, 7), (None, 3), (3, None), links[0]]
    want = Groups()
    for a, b in links:
        if a is not None and b is not None and a != b:
            want.link(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(Workspace(spark, "t"), df).collect()}
    assert got == {x: want.root(x) for x in want.up}


def test_components_of_nothing(spark):
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_components():
    rng = np.random.default_rng(0)
    for n in (1, 5, 80):
        a, b = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        found, want = Blocks(n), Groups()
        found.add(a, b)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            want.link(x, y)
        assert found.root.tolist() == [want.root(i) if i in want.up else i for i in range(n)]


# Exact


EXACT = "doc_id long, text string, kept string, n long, __x int"


def test_exact_dedup_cases(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (9, ""), (None, "a"), (4, "a "), (7, "x" * 300_000), (8, "x" * 300_000), (10, "é"), (10, "é"), (None, None)]
    df = spark.createDataFrame([(i, t, "other", 3, 1) for i, t in rows], EXACT).repartition(3)
    got = sorted(map(tuple, exact_dedup.dedup(df, Workspace(spark, "t")).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    want = [
        (1, 5, 4, False), (5, 5, 4, True), (3, 5, 4, False), (None, 5, 4, False), (2, 9, 3, False), (9, 9, 3, True), (None, 9, 3, False), (4, 4, 1, True),
        (7, 8, 2, False), (8, 8, 2, True), (10, 10, 2, True), (10, 10, 2, False),
    ]
    assert got == sorted(want, key=str)
    kept = exact_dedup.keepers(exact_dedup.sorted_runs(df, Workspace(spark, "t")))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 8, 9, 10]
    assert exact_dedup.dedup(df.limit(0), Workspace(spark, "t")).count() == 0


def test_a_large_group_is_split_and_joined_again(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat('t', id), 'same') as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = exact_dedup.sorted_runs(df, Workspace(spark, "t"))
        assert runs.rows.where("text = 'same'").select(runs.part).distinct().count() > 1
        assert runs.rows.where(f"{runs.edge} is not null").count() <= 2 * runs.rows.select(runs.part).distinct().count()
        kept = exact_dedup.keepers(runs)
        assert kept.where("text = 'same'").collect()[0].doc_id == 2999 and kept.count() == 1001
        got = exact_dedup.dedup(df, Workspace(spark, "t"))
        assert {tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(2999, 2000)}
        assert got.where("kept").count() == 1001 and got.count() == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


#: Names that the operators themselves take where they are free, of types that they don't have.
CLASHING = {"__part": "x", "__run": 1.5, "__head": "no", "__SHA256": 7, "__edge": 1, "__lead": 3, "__fp": 5, "__row": "r", "__on": True, "__group": "g", "a.b": 2, "key": 9}


def clashing(spark, rows):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` {kinds[type(v)]}" for c, v in CLASHING.items())
    return spark.createDataFrame([(*r, *CLASHING.values()) for r in rows], schema).repartition(3)


def test_any_other_column_is_passed_on(spark):
    docs = clashing(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, None), (4, "f g h i j k")])
    for got, ids in (
        (exact_dedup.keepers(exact_dedup.sorted_runs(docs, Workspace(spark, "t"))), [2, 3, 4]),
        (simhash.one_of_each(docs, Workspace(spark, "t")), [1, 3, 4]),
    ):
        assert got.schema == docs.schema
        assert sorted(r.doc_id for r in got.collect()) == ids
        assert all(tuple(r)[2:] == tuple(CLASHING.values()) for r in got.collect())
    assert exact_dedup.dedup(docs, Workspace(spark, "t")).count() == simhash.simhash(docs, Workspace(spark, "t")).count() == 4


def test_runs_that_cross_tasks_are_compared_in_full(spark, monkeypatch):
    """With a digest that is the same for all texts, only full comparisons tell them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.substring(F.lit("same digest"), 1, 11))
    monkeypatch.setattr(exact_dedup, "SPLITTER_BYTES", 1)
    rows = [(i, "x" + "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = exact_dedup.sorted_runs(df, Workspace(spark, "t"))
        assert runs.rows.select(runs.part).distinct().count() > 1
        assert {r.all_n for r in runs.ends(runs.rows.groupBy(F.col(runs.part).alias("part"), F.col(runs.run).alias("run")).agg(F.count("*").alias("n"), F.max("doc_id").alias("id"))).collect()} <= set(range(1, 201))
        got = exact_dedup.dedup(df, Workspace(spark, "t")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    texts = dict(rows)
    assert all(texts[r.doc_id] == texts[r.keep_id] for r in got)


# SimHash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps):
    want = Groups()
    items = list(fps.items())
    for i, (a, x) in enumerate(items):
        want.root(a)
        for b, y in items[i:]:
            if (x ^ y).bit_count() <= 4:
                want.link(a, b)
    return {a: want.root(a) for a in fps}


def test_simhash_by_brute_force(spark):
    docs = table(spark, SF_ORACLE, "documents").where("doc_id < 400")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash(docs, Workspace(spark, "t")).collect()}
    groups = slow_groups(fps)
    assert got == {d: (f"{fps[d]:016x}", groups[d]) for d in texts}
    assert len(set(groups.values())) < len(groups)


def test_simhash_tiles_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 4)
    monkeypatch.setattr(simhash, "SIDE", 3)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    for _ in range(60):
        x = rng.choice(fps)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "__fp long")
    got = {r["__fp"]: r["__group"] for r in simhash.with_group(df.distinct(), simhash.near_groups(df, Workspace(spark, "t"))).collect()}
    want = slow_groups({x: x & (1 << 64) - 1 for x in set(signed)})
    assert got == want


def test_simhash_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(4, None), (2, ""), (9, " \t\n"), (5, "A b C"), (1, "a B c"), (3, "a b c d e"), (7, long), (8, long + " end"), (8, long), (None, "a b c"), (6, "Ä x y z q")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fingerprint int, component_id string").repartition(3)
    got = [tuple(r) for r in simhash.simhash(df, Workspace(spark, "t")).collect()]
    assert len(got) == len(rows)
    by_id = {i: (f, c) for i, f, c in got}
    assert by_id[4][0] == "0" * 16 and [by_id[i][1] for i in (4, 2, 9)] == [2, 2, 2]
    assert by_id[5] == by_id[1] == by_id[None] and by_id[5][1] == 1
    assert by_id[7][1] == by_id[8][1] == 7
    assert all(f == f"{slow_fingerprint(t):016x}" for (i, f, _) in got for j, t in rows if i == j and i != 8)
    kept = simhash.one_of_each(df, Workspace(spark, "t"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 7]
    assert simhash.simhash(df.limit(0), Workspace(spark, "t")).count() == 0


# Embeddings


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def slow_links(x):
    s = unit(x.astype(np.float64)) @ unit(x.astype(np.float64)).T
    np.fill_diagonal(s, 0)
    return s >= 0.9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_by_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 50)
    rng = np.random.default_rng(4)
    base = unit(rng.standard_normal((700, 32)))
    near = embedding_dedup.at_radius(base[:150], 0.93, 5)
    crowd = embedding_dedup.at_radius(np.repeat(base[200:201], 120, 0), 0.97, 6)
    x = np.concatenate([base, near, crowd, base[300:320], base[300:310] * 3]).astype(np.float32)
    links = slow_links(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {r.vec_id: r for r in embedding_dedup.near_dedup(df, Workspace(spark, "t")).collect()}
    assert len(got) == len(x)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.95 * links.sum()
    want = Groups()
    for a, b in zip(*np.nonzero(links), strict=True):
        want.link(int(a), int(b))
    same_group = [got[i].component_id == (want.root(i) if i in want.up else i) for i in range(len(x))]
    assert np.mean(same_group) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("n, dim", [(1500, 16), (4000, 16), (3000, 64)])
def test_recall_is_measured_without_a_vector_itself(spark, n, dim):
    """Planted neighbours near the edge: what the index says of its recall holds, and what it
    finds is at least 0.9 of all links."""
    rng = np.random.default_rng(n + dim)
    base = unit(rng.standard_normal((n, dim)))
    x = np.concatenate([base, embedding_dedup.at_radius(base[::3], 0.91, 8)]).astype(np.float32)
    links = slow_links(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ws = Workspace(spark, "t")
    _, distinct, _ = embedding_dedup.distinct_vectors(df, ws)
    index = embedding_dedup.fit(distinct, "<f4", 0.9, embedding_dedup.RECALL)
    assert 0 < index.pairs < 3 * embedding_dedup.QUERIES and index.recall >= embedding_dedup.RECALL
    found = sum(r.n_links for r in embedding_dedup.near_dedup(df, ws).collect())
    assert found >= 0.9 * links.sum()


def test_no_neighbours_no_pairs(spark):
    x = unit(np.random.default_rng(1).standard_normal((300, 32)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, distinct, _ = embedding_dedup.distinct_vectors(df, Workspace(spark, "t"))
    index = embedding_dedup.fit(distinct, "<f8", 0.9, 0.98)
    assert index.pairs == slow_links(x)[: embedding_dedup.QUERIES].sum() == 0 and index.limit > 0


def test_traversal_goes_outward():
    rng = np.random.default_rng(0)
    index = embedding_dedup.MultiIndex.fit(unit(rng.standard_normal((500, 16))), 6)
    moves, home = index.moves(unit(rng.standard_normal((20, 16))))
    index.limit = 0.3
    for i in range(20):
        cells = list(index.visit(moves[0][i], moves[1][i]))
        far = index.order([m[[i] * len(cells)] for m in moves], np.arange(len(cells)), np.array(cells))
        assert cells[0] == home[i] and (np.diff(far) >= -1e-12).all() and len(set(cells)) == len(cells)
        every = index.order([m[[i] * 36] for m in moves], np.arange(36), np.arange(36))
        assert sorted(cells) == np.flatnonzero(every <= 0.3).tolist()


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(5, v), (3, [2.0, 0.0, 0.0, 0.0]), (8, v), (1, w), (2, None), (4, [0.0] * 4), (6, [nan, 0.0, 0.0, 1.0]), (7, [inf, 0.0, 0.0, 0.0]), (9, [None, 1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, []), (12, [1e-30, 0.0, 0.0, 0.0]), (1, w), (None, w)]
    df = spark.createDataFrame([(i, x, 0, "k") for i, x in rows], "vec_id long, embedding array<float>, n_links int, key string")
    got = sorted((tuple(r) for r in embedding_dedup.near_dedup(df, Workspace(spark, "t")).collect()), key=str)
    group = [(5, 3, 3, False), (3, 3, 3, True), (8, 3, 3, False), (12, 3, 3, False), (1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)]
    assert got == sorted(group + [(i, 0, i, True) for i in (2, 4, 6, 7, 9, 10, 11)], key=str)
    for none in (df.limit(0), df.where("vec_id = 4")):
        assert all(r.n_links == 0 for r in embedding_dedup.near_dedup(none, Workspace(spark, "t")).collect())

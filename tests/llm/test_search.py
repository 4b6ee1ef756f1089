"""Merkle manifest, lexical search and nearest neighbours against brute-force versions on small rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.llm import lexical, merkle, neighbours

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("tree", "at", "total", "digest", "row", "path", "root", "block", "part", "place", "terms", "tf", "n", "doc", "item", "score", "rank", "v", "node", "ha", "tile")


def odd(df):
    """With further columns whose names the operators use themselves."""
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["".join(r.choice("abcXYZ09éß漢") for _ in range(r.randint(1, 5))) for _ in range(60)]
    text = lambda n: r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(n))
    out = [(i * 7 % 211, text(r.randint(0, 30)), r.choice([None, "en"]), r.choice([None, "", "b", "a", "é", "only"][: 5 + (i == 3)]), i) for i in range(60)]
    out += [(None, text(5), "en", "a", None), (None, None, None, None, None), (500, None, "en", "b", 0), (501, "", "en", "b", 0)]
    out += [(502, "same\nrow", "en", "a", 8)] * 3 + [(503, "same\nrow", "de", None, 8)] + [(504, "one " * 9000, "en", "c", 1)] * 2
    return out


def tree_of(digests, arity):
    """The root and each leaf's siblings left and right, level by level, by plain recursion on lists."""
    level, paths, below = list(digests), [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, held = [], []
        for a in range(0, len(level), arity):
            run = level[a : a + arity]
            for i in range(len(run)):
                for leaf in below[a + i]:
                    paths[leaf].append((run[:i], run[i + 1 :]))
            up.append(hashlib.sha256("".join(run).encode()).hexdigest())
            held.append([leaf for b in below[a : a + arity] for leaf in b])
        level, below = up, held
    return level[0], paths


def manifest_of(rows, arity=3):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, lang, s, n: h("".join(map(field, (d, s, lang, n, t))))
    sources = {}
    for d, t, lang, s, n in rows:
        tampered = d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None
        sources.setdefault(s, []).append((d is not None, d or 0, leaf(d, t, lang, s, n), leaf(d, t.replace("\n", "") if tampered else t, lang, s, n)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort()
        trees[s] = tree_of([x[2] for x in sources[s]], arity)
    root, tops = tree_of([trees[s][0] for s in names], arity)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (known, d, own, altered), path in zip(sources[s], trees[s][1], strict=True):
            whole, fold = path + top, altered
            for left, right in whole:
                fold = h("".join([*left, fold, *right]))
            proof = h("".join(x for left, right in whole for x in left + right))
            out.append((d if known else None, own, trees[s][0], root, proof, fold, fold == root))
    return Counter(out)


@pytest.mark.parametrize(("levels", "arity"), [(1, 3), (2, 3), (7, 3), (2, 2)])
def test_op11_equals_plain_trees(spark, rows, levels, arity):
    docs = odd(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = Counter(map(tuple, merkle.merkle_manifest(docs, levels, arity).collect()))
    assert got == manifest_of(rows, arity)
    assert 0 < sum(n for r, n in got.items() if r[-1]) < len(rows)


def test_op11_lone_leaf_and_empty_table(spark, rows):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = merkle.merkle_manifest(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_op11_witnesses_grow_by_appends():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    tree = merkle.Subtrees(merkle.height(11))
    for i, d in enumerate(digests):
        tree.append(d)
        # a leaf's witness is as long as the highest complete subtree that it is in
        assert len(list(merkle.siblings(bytes(tree.paths[0])))) == (0 if i < 2 else 1 if i < 8 else 2)
    root = tree.finish()
    assert root.hex() == tree_of([d.hex() for d in digests], 3)[0]
    assert all(merkle.fold(d, bytes(p)) == root for d, p in zip(digests, tree.paths, strict=True))
    assert merkle.fold(digests[1], bytes(tree.paths[0])) != root


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked(items, rows, k=10):
    docs = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t, *_ in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("round_terms", [65536, 15])
def test_op12_equals_plain_ranking(spark, rows, round_terms):
    r = random.Random(9)
    items = [(i, " ".join(r.choice(terms_of(r.choice(rows)[1]) or ["x"]) for _ in range(12))) for i in range(12)]
    items += [(None, "same row"), (3, None), (4, "..."), (5, "ROW row Row unknownword"), (5, "ROW row Row unknownword"), (6, "same " * 5000)]
    got = lexical.search_items(odd(spark.createDataFrame(items, "item_id long, text string")), odd(spark.createDataFrame(rows, SCHEMA).repartition(3)), round_terms=round_terms)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == ranked(items, rows)


def test_op12_ties_of_more_than_a_tile(spark):
    docs = [(i, "tie word", "en", "a", 8) for i in range(3000, 0, -1)] + [(9000, "tie", "en", "a", 3), (9001, "other", "en", "a", 5)]
    got = lexical.search_items(spark.createDataFrame([(1, "tie")], "item_id long, text string"), spark.createDataFrame(docs, SCHEMA), 4)
    assert Counter(map(tuple, got.collect())) == ranked([(1, "tie")], docs, 4)


def test_op12_empty_tables(spark, rows):
    items, docs = spark.createDataFrame([(1, "row")], "item_id long, text string"), spark.createDataFrame(rows, SCHEMA)
    assert lexical.search_items(items.limit(0), docs).count() == 0
    assert lexical.search_items(items, docs.limit(0)).count() == 0


def test_term_tiles_bound_partial_sums():
    item, term, weight = np.array([0, 0, 1, 1, 0]), np.array([0, 1, 1, 2, 2]), np.array([5, 23, 4, 9, 8])
    tiles = lexical.term_tiles(item, term, weight, 2, 2, 10)
    total = np.zeros((2, 3))
    for used, w in tiles:
        assert w.sum(axis=1).max() <= 10 and len(used) <= 2 and len(set(used)) == len(used)
        np.add.at(total.T, used, w.T)
    assert total.tolist() == [[5, 23, 8], [0, 4, 9]]


def nearest_of(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(ok) if b != a)
            out += [(i, n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(scored[:k])]
    return Counter(out)


@pytest.mark.parametrize("scale", [0.0, 0.7])
def test_op13_small_tables_are_exact(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(i, (np.round(rng.normal(size=6), 2) * math.exp(scale * rng.normal())).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.5, -0.0]) for i in range(60)]  # copies, in ties over all places
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None] + [0.0] * 4), (303, [float("nan")] + [1.0] * 5), (304, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (220, [1.0, 2.0, 0.0, 0.0, 0.5, 0.0]), (40, [9.0] * 6)]
    df = odd(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = neighbours.nearest_items(df, tile=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()) == nearest_of(rows, 20, 20)


def test_op13_recall_of_many_tiles(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    v = np.concatenate([rng.normal(size=(1500, 16)), centres[rng.integers(0, 8, 1500)] + 0.05 * rng.normal(size=(1500, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = neighbours.nearest_items(df, tile=128, links=20, back=20).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        score = v.astype(float) @ v[q].astype(float)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(v)), -score))[:20]) & set(part["vec_id"]))
        assert sorted(part["rank"]) == list(range(1, 21)) and np.allclose(score[part["vec_id"]], part["score"], rtol=1e-12)
    assert hits / len(got) >= 0.9


def test_op13_few_rows_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_items(empty).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest_items(one).count() == 0
    two = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest_items(two).collect()] == [(20, 1, 21, 0.5)]
    assert neighbours.nearest_items(two.where("vec_id = 21")).count() == 0


def test_op13_tiles_grow_with_the_nodes(spark, monkeypatch):
    # tiles of one size would need nearly all vectors each, as the square of the nodes: 25 times as many for 5 times the nodes
    class Tiled(Exception):
        pass

    def tiled(tilings, *args):
        raise Tiled([t.select("tile").distinct().count() for t in tilings])

    monkeypatch.setattr(neighbours, "neighbour_graph", tiled)
    v = np.random.default_rng(5).normal(size=(1600, 4)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    need = []
    for n in (320, 1600):
        with pytest.raises(Tiled) as found:
            neighbours.nearest_items(df.where(F.col("vec_id") < n), tile=32)
        need.append(max(found.value.args[0]) * n)
    assert need[1] <= 13 * need[0]

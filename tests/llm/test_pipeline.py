"""The corpus pipeline and the SQL of the registered queries."""

import hashlib
import math
import os
import random
import re

import duckdb
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from atrium.llm import bpe, jaccard, mixing, quality, queries, suffixes
from test_small import SCHEMA, brute_jaccard, brute_passages, brute_strings, empty, sample_texts, words_of

DATA = "/root/testdata/sf0.001"
SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    before = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, DATA)
        if i < 4:
            assert after.columns == columns and after.dtypes == docs.dtypes
            after = corpus_pipeline.stored(after, "test")
        if i == 0:
            ids = {r.doc_id for r in after.collect()}
            kept = {r.doc_id for r in queries.queries()["op5_quality"](spark, DATA).where("kept").collect()}
            assert ids == kept
        if i == 1:
            assert {r.doc_id for r in after.collect()} <= ids and after.count() == after.select("doc_id").distinct().count()
        before = after
    assert before.count() > 0 and before.where("n_tokens is null").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    cur = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=str)
    ours = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("unique", [False, True])
def test_jaccard_stage_drops_rows_for_likeness_only(spark, unique):
    """Rows without an id, or of one repeated id, against a brute-force version by row."""
    texts = [t for t in sample_texts() if t is None or len(t) < 5000]
    rows = [(i if unique else [None, 7, None, i][i % 4], t, "en", "a", len(t) if t else 0) for i, t in enumerate(texts)]
    if not unique:
        rows += [rows[0], rows[7], (None, "", "en", "a", 0), (None, "", "en", "a", 0)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    classes = brute_jaccard([(i, r[1]) for i, r in enumerate(rows)])
    want = [r for i, r in enumerate(rows) if classes[i][1] == i]
    got = jaccard.pipeline_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), DATA)
    assert got.columns == SCHEMA_COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def prose(r, n):
    return " ".join("".join(r.choice("abcdeéß漢") for _ in range(r.randint(2, 8))) for _ in range(n))


def small_corpus():
    """Good and junk rows, copies, near copies, shared passages, an empty text, nulls, sources of unlike sizes."""
    r = random.Random(11)
    base, passage = prose(r, 200), prose(r, 70)
    texts = [prose(r, r.randint(60, 400)) for _ in range(40)] + [base, base, base.upper(), base + " tail", None, "", "short text"]
    texts += [prose(r, 60) + "\n" + passage + "\n" + prose(r, 60) for _ in range(5)]
    junk = [" ".join(w + "$$$" for w in prose(r, 120).split()) for _ in range(30)]
    rows = [(i * 7 % 211, t, "en", [None, "b", "a", "ä", "b"][i * i % 5], len(t) if t else None) for i, t in enumerate(texts + junk)]
    rows.append((None, prose(r, 90), None, "a", 0))
    labels = [(d, int(i < len(texts)), 0) for i, (d, *_) in enumerate(rows[:-1]) if i % 2]
    return rows, labels


def brute_mix(rows):
    """The mix of (doc_id, text, source) rows, document by document in seeded order."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words_of(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight, open_, left, target = {s: i % 3 + 1 for i, s in enumerate(names)}, set(size), sum(size.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * size[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in names:
        whole = math.floor(target[s] / size[s])
        rest = round(target[s] - whole * size[s])
        own = [x for x in rows if x[2] == s]
        for doc, t, _ in sorted(own, key=lambda x: (hashlib.sha256(f"7:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), len(words_of(x[1])))):
            n = len(words_of(t))
            out += [(doc, t)] * (whole if n else 1)
            part = max(0, min(n, rest))
            rest -= n
            if part:
                end = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)][part - 1]
                out.append((doc, t if part == n else t[:end]))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    import tiktoken

    rows, labels = small_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    # the classifier's verdicts are the operator's (held-out accuracy is tested apart); all that follows is plain Python
    verdict = {(r.doc_id, r.text): r.kept for r in quality.quality_rules(docs, quality.train_quality(docs, labels), passthrough=("doc_id", "text")).collect()}
    kept = sorted(((d, t, s) for d, t, _, s, _ in rows if verdict[d, t]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert 30 < len(kept) < len(rows) - 20
    classes = brute_jaccard([(i, t) for i, (_, t, _) in enumerate(kept)])
    kept = [x for i, x in enumerate(kept) if classes[i][1] == i]
    raw = [t.encode() for _, t, _ in kept]
    cut = []
    for (d, _, s), b, gone in zip(kept, raw, brute_strings(raw, 200), strict=True):
        gone = brute_passages(b, gone)
        chars = [m.span() for m in re.finditer(rb"[\x00-\x7f\xc0-\xff][\x80-\xbf]*", b)]
        cut.append((d, b"".join(b[x:y] for x, y in chars if not all(gone[x:y])).decode(), s))
    assert sum(len(x[1]) for x in cut) < sum(len(x[1]) for x in kept) - 1000
    encode = tiktoken.Encoding("x", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.tree_bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).encoding._mergeable_ranks, special_tokens={}).encode_ordinary
    want = []
    for doc, t in brute_mix(cut):
        ids = encode(t)
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("stage", [quality.pipeline_stage, jaccard.pipeline_stage, suffixes.pipeline_stage, mixing.pipeline_stage])
@pytest.mark.parametrize("unique", [True, False])
def test_stages_on_odd_tables(spark, stage, unique):
    """Columns with the operators' own names are handed through, null and repeated rows decided, empty tables stay empty."""
    rows, _ = small_corpus()
    rows = [r for r in rows if r[0] is not None] if unique else rows + rows[:5] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["kept", "n_words", "probability", "epochs", "part", "row", "copy", "cut", "size", "component_id", "key", "first", "doc", "h", "own_0", "own_3", "label", "base_failed"]
    odd = docs.select("*", *[F.lit(c).alias(c) for c in names])
    got, plain = stage(spark, odd, DATA), stage(spark, docs, DATA)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert got.where("kept = 'kept' and own_3 = 'own_3' and row = 'row'").count() == plain.count() > 0
    assert stage(spark, empty(spark), DATA).count() == 0

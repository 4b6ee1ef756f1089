"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from atrium.llm import bpe, fingerprints, jaccard, licenses, mixing, quality, repair, repeats, suffixes, warc
from atrium.llm.common import new_path
from atrium.llm.text import Words, column_bytes, window_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizers.path("word_bpe_49k.json")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample_texts(seed=5):
    """Copies, near copies, shared passages, odd characters, one long text, an empty one and a null."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ漢") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(150), prose(60)
    texts = [base, base, base.upper(), prose(3), prose(4), prose(5), "", None, "   \n\t ", "x" * 900, "ab " * 400]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [prose(40) + "\n" + passage + "\n" + prose(r.randint(0, 50)) for _ in range(8)]
    texts += [" thin space\x1cword \x0b end", "Mit License mit license; Apache-License GNU General\npublic license", "á ë <|endoftext|> don't I'LL 123 !?", prose(20) + "\n" + prose(9) * 2, prose(6000)]
    return texts


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 % 101, t, "en", [None, "b", "a", "B", "ä"][i % 5], len(t) if t else 0) for i, t in enumerate(sample_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd(docs):
    """With further columns whose names the operators use themselves."""
    out = docs
    for c in ("key", "n", "doc", "h", "size", "node", "component", "hash", "slot", "bits", "first", "window", "rank", "token", "tail", "bucket"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    got = {r.doc_id: r for r in df.collect()}
    return got


def test_words_of_batches(rows):
    import pyarrow as pa

    w = Words(*column_bytes(pa.array([r[1] for r in rows], pa.string())))
    assert w.counts().tolist() == [len(words_of(r[1])) for r in rows]
    a, b = Words(*column_bytes(pa.array(["one two three"]))), Words(*column_bytes(pa.array(["zero one two three"])))
    assert window_hashes(a.hash, 3)[0] == window_hashes(b.hash, 3)[1]


def test_op1_fingerprints(spark, docs, rows):
    got = by_id(fingerprints.fingerprint_documents(odd(docs), 3))
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for i, (doc, text, *_) in enumerate(ordered):
        t, nxt = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    same = {}
    for doc, text, *_ in rows:
        same.setdefault(text or "", set()).add(got[doc].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0


def test_op1_many_rows_of_one_id(spark):
    """A third of the rows without an id, a third of one id: each is followed by the next one in order of (id, hash of the text)."""
    r = random.Random(4)
    rows = [([None, 7, i][i % 3], "".join(r.choice("abcd ") for _ in range(r.randint(0, 90)))) for i in range(300)] + [(7, "same text")] * 40
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = [(x.doc_id, x.text) for x in table.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h", "text").collect()]
    want = []
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        e = fingerprints.edited(text, following)
        want.append((doc, len(text), hashlib.sha256(e.encode()).hexdigest()))
    for parts in (1, 8, 40):
        got = [(x.doc_id, x.n_chars, x.edited_sha256) for x in fingerprints.fingerprint_documents(table, parts).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_op1_likeness_tells_edits_from_other_texts(spark):
    r = random.Random(6)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300))
    got = fingerprints.fingerprint_documents(spark.createDataFrame([(i, prose()) for i in range(60)], "doc_id long, text string")).collect()
    assert min(x.near_edited for x in got) > 0.3 and max(x.near_next for x in got) < 0.2 and np.mean([x.near_edited for x in got]) > 0.5


def test_op1_interiors_agree_at_any_offset():
    r = random.Random(1)
    core = bytes(r.randrange(97, 123) for _ in range(3000))
    names = []
    for head in (b"", b"q", b"some other words before "):
        buf = np.frombuffer(head + core, np.uint8)
        sym, of = fingerprints.parse_level(buf, np.array([0, len(buf)]))
        names.append(set(fingerprints.parse_level(sym, of)[0].tolist()))
    assert len(names[0] & names[1] & names[2]) > 0.95 * len(names[0])


def test_op2_warc(spark):
    big = "é" * 700
    pages = spark.createDataFrame([(1, "http://a\r\nX: y", big), (2, "u%20v", big), (9, None, big), (4, "d", "short"), (5, "e", "short"), (6, "f", None), (7, "g", ""), (None, "h", "z" * 2000)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_warc(warc.archive_records(pages.withColumn("payload", F.lit(1))), path)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    assert {k: r.url for k, r in got.items()} == urls
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9)} | {k: ("response", None) for k in (9, 4, 5, 6, 7, None)}
    for k, r in got.items():
        assert (r.payload_bytes, r.payload_digest) == (len(html[k]), hashlib.sha1(html[k]).hexdigest())
        assert r.payload == (html[k] if r.record_type == "response" else None)
    short = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and page_id > 1")
    assert [(r.page_id, r.payload) for r in short.collect()] == [(2, None)]
    assert warc.archive_records(pages.limit(0)).count() == 0


def test_op2_readers_skip_what_is_filtered():
    import io

    from pyspark.sql.datasource import EqualTo

    data = b"".join(warc.member(warc.record(i, "u", "response" if i % 2 else "revisit", None if i % 2 else 1, b"x" * 5000, 5000, "d", "1970-01-01T00:00:00Z")) for i in range(6))
    got = list(warc.read_records(io.BytesIO(data), [EqualTo(("record_type",), "response")], False))
    assert [(g["page_id"], g["payload"], g["payload_bytes"]) for g in got] == [(1, None, 5000), (3, None, 5000), (5, None, 5000)]


def test_op2_reads_other_archives(spark, tmp_path):
    """Archives without skip-lengths, compressed by record, as a whole or not at all, with records of other types."""
    import gzip

    def warc_record(kind, block, *fields):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"<html>" + b"x" * 9000 + b"\r\n\r\n</html>"
    http = b"HTTP/1.1 200 OK\r\nX-Odd: 1\r\n\r\n" + body
    every = [
        warc_record("warcinfo", b"software: other\r\n", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"),
        warc_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "warc-record-id: <urn:uuid:2>", "WARC-Target-URI: <http://a/>", "Content-Type: application/http; msgtype=request"),
        warc_record("response", http, "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=response"),
        warc_record("metadata", b"", "WARC-Record-ID: <urn:uuid:4>"),
        warc_record("response", http, "WARC-Record-ID: <urn:uuid:5>", "Content-Type: application/http;msgtype=response"),
    ]
    want = [("warcinfo", "<urn:uuid:1>", None, 17), ("request", "<urn:uuid:2>", "http://a/", 0), ("response", "<urn:uuid:3>", "http://a/", len(body)), ("metadata", "<urn:uuid:4>", None, 0), ("response", "<urn:uuid:5>", None, len(body))]
    data = {"plain.warc": b"".join(every), "whole.warc.gz": gzip.compress(b"".join(every)), "records.warc.gz": b"".join(map(gzip.compress, every))}
    own = b"".join(warc.member(r) for r in every)
    for name, raw in {**data, "own.warc.gz": own}.items():
        folder = tmp_path / name.split(".")[0]
        folder.mkdir()
        (folder / name).write_bytes(raw)
        rows = warc.read_warc(spark, str(folder)).collect()
        assert [(r.record_type, r.record_id, r.url, r.payload_bytes) for r in rows] == want
        assert [r.payload for r in rows if r.record_type == "response"] == [body, body] and rows[0].page_id is None
        found = warc.read_warc(spark, str(folder), payload=False).where("record_type = 'response' and url is null").collect()
        assert [(r.record_id, r.payload) for r in found] == [("<urn:uuid:5>", None)]
        import io

        for cut in (len(raw) - 30, len(raw) // 2):
            with pytest.raises((ValueError, KeyError)):
                list(warc.read_records(io.BytesIO(raw[:cut]), [], False))


def test_op3_licenses(spark, docs, rows):
    got = by_id(licenses.scan_licenses(odd(docs)))
    for doc, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if tuple(x.encode() for x in w[i : i + len(phrase)]) == phrase]
        r, at = got[doc], [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize(("text", "end"), [("licensed under the x license", 5), ("licensed under x license", 4), ("licensed under the x y license now", 6), ("licensed under the license", 4), ("licensed under license", -1), ("licensed beneath the x license", -1), ("licensed under the x y z license", -1)])
def test_op3_automaton(text, end):
    a = licenses.Automaton("licensed under [[ the ]] {1,2} license [[ now ]]")
    got = a.match(text.encode().split(), 0)
    assert got == (end if not text.endswith("now") else 7)


@pytest.mark.parametrize(("label", "number"), [(k, i) for k, ts in licenses.TEMPLATES.items() for i in range(len(ts))])
def test_op3_shipped_templates(label, number):
    """Random readings of a template are accepted; with one mandatory word missing, or another in its place, none is."""
    template, r = licenses.TEMPLATES[label][number], random.Random(f"{label}{number}")
    a = licenses.Automaton(template)
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)

    def reading():
        words, keep = [], [True]
        for token in re.findall(r"\[\[|\]\]|\{\d+,\d+\}|\S+", template):
            if token == "[[":
                keep.append(keep[-1] and r.random() < 0.5)
            elif token == "]]":
                keep.pop()
            elif keep[-1] and token[0] == "{":
                least, most = map(int, token[1:-1].split(","))
                words += [(f"any{r.randrange(99)}", False)] * r.randint(least, most)
            elif keep[-1]:
                words += [(w, len(keep) == 1) for w in re.findall(r"[0-9a-z]+", token)]
        return words

    for _ in range(20):
        words = reading()
        plain = [w.encode() for w, _ in words]
        assert a.match(plain, 0) == len(plain)
        got = scanner.scan(b", ".join([b"before", *plain, b"after"]))
        assert label in got[4].split(",")
        must = [i for i, (_, m) in enumerate(words) if m]
        i = r.choice(must[1:-1])
        if i + 1 in must and plain[i] not in (plain[i - 1], plain[i + 1]):
            odd = [*plain[:i], b"zzz", *plain[i + 1 :]]
            assert a.match(odd, 0) == -1 or a.match(odd, 0) <= i
            assert a.match(plain[:i] + plain[i + 1 :], 0) == -1 or a.match(plain[:i] + plain[i + 1 :], 0) <= i


def test_op3_score(spark):
    texts = [(1, "x mit license y"), (2, "MIT License"), (3, "nothing"), (4, None), (5, "a released under the mit license b c d e")]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {k: (r.score, r.labels) for k, r in got.items()} == {1: (0.5, "mit"), 2: (1.0, "mit"), 3: (0.0, ""), 4: (0.0, ""), 5: (0.5, "mit,mit-notice")}


def brute_jaccard(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = words_of(w)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {d: (len(sets[d]), comp[d]) for d in sets}


@pytest.mark.parametrize("most_rows", [1024, 3])
def test_op4_jaccard(spark, docs, rows, most_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(odd(docs), most_rows=most_rows, rounds=1 if most_rows == 3 else 4).collect()}
    assert got == brute_jaccard(rows)


def test_op4_partner_of_many(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    table = [(1, " ".join(base))] + [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(2, 40)] + [(i, " ".join(r.choices(base, k=100))) for i in range(40, 60)]
    docs = jaccard._documents(spark.createDataFrame(table, "doc_id long, text string"))
    pairs = spark.createDataFrame([(i, 1) for i in range(2, 60)], "a long, b long")
    assert sorted(r.a for r in jaccard.verify_pairs(docs, pairs, 5).collect()) == list(range(2, 40))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(table)


def test_op4_empty_table(spark):
    assert jaccard.jaccard_classes(empty(spark)).count() == 0


def test_op4_bitmaps_bound_the_overlap():
    r = np.random.default_rng(4)
    for n in (3, 70, 900):
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 1 << 62, n // 3, dtype=np.uint64)]))
        x, y = jaccard.parity_bitmap(a)[None], jaccard.parity_bitmap(b)[None]
        m = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(jaccard.fold(x, m) ^ jaccard.fold(y, m)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_op5_quality(spark, docs, rows):
    good = [(1000 + i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta", "omega", "sigma"], k=120)) + f" {i}", "en", "a", 0) for i in range(60)]
    junk = [(2000 + i, " ".join(w + "$$$" for w in good[i][1].split()), "en", "a", 0) for i in range(60)]
    table = spark.createDataFrame(good + junk, SCHEMA)
    labels = spark.createDataFrame([(d, int(d < 2000), 0) for d, *_ in good[:40] + junk[:40]] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train_quality(table, labels)
    held = by_id(quality.quality_rules(table, model))
    assert np.mean([held[d].probability > 0.5 for d, *_ in good[40:]]) == 1 and np.mean([held[d].probability > 0.5 for d, *_ in junk[40:]]) == 0
    got = by_id(quality.quality_rules(odd(docs), model))
    for doc, text, *_ in rows:
        t, w = text or "", words_of(text)
        lines = [x for x in t.split("\n") if words_of(x)]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not r.kept or not r.base_failed)
    nothing = quality.train_quality(empty(spark), labels)
    assert quality.quality_rules(empty(spark), nothing).count() == 0


@pytest.mark.parametrize("leaf", [2, 7, 64, 4096])
def test_op6_tree_equals_tiktoken(leaf):
    import tiktoken

    tree = bpe.TreeBPE(RANKS, tokenizers.PATTERN, leaf)
    r = random.Random(leaf)
    texts = [t or "" for t in sample_texts()][:35] + ["".join(r.choice("ab1 \n'sT!é漢 \t") for _ in range(r.randint(0, 300))) for _ in range(200)]
    assert isinstance(tree.encoding, tiktoken.Encoding)
    for t in texts:
        ids = tree.encode(t)
        assert ids.tolist() == tree.encoding.encode_ordinary(t)
        assert tree.decode(ids) == t.encode()


def test_op6_rows(spark, docs, rows):
    got = by_id(bpe.bpe_tokens(odd(docs), RANKS, tokenizers.PATTERN))
    tree = bpe.TreeBPE(RANKS, tokenizers.PATTERN)
    for doc, text, *_ in rows:
        ids = np.array(tree.encoding.encode_ordinary(text or ""), "<u4").tobytes()
        r = got[doc]
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.bpe_tokens(empty(spark), RANKS, tokenizers.PATTERN).count() == 0


def test_op7_shards(spark, docs, rows):
    from tokenizers import Tokenizer

    path = new_path(spark, "shards")
    repair.write_shards(odd(docs), path, WORDS, shard_ids=500, parts=3)
    got = by_id(repair.read_shards(spark, path))
    plain, start = Tokenizer.from_file(WORDS), 0
    for doc, text, *_ in sorted(rows):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    every = b"".join(got[doc].ids for doc, *_ in sorted(rows))
    wanted = [(0, 0, 1), (1, 100, 1700), (2, len(every) // 4 - 5, 50), (3, 777, 3)]
    ranges = repair.read_ranges(spark, path, spark.createDataFrame(wanted, "range_id int, start long, n long"))
    assert {r.range_id: r.ids for r in ranges.collect()} == {i: every[4 * a : 4 * (a + n)] for i, a, n in wanted}
    none = new_path(spark, "shards")
    repair.write_shards(empty(spark), none, WORDS)
    assert repair.read_shards(spark, none).count() == 0


def test_op7_grammar_round_trip():
    r = np.random.default_rng(7)
    for ids in (np.zeros(0), np.array([5]), np.full(999, 3), np.tile(r.integers(0, 50, 37), 60), r.zipf(1.5, 5000) % 49000):
        ids = ids.astype(np.uint32)
        g = repair.compress(ids, least=4)
        assert g.expand().tolist() == ids.tolist() and int(g.sizes(g.symbols).sum()) == len(ids)
        # the end of Re-Pair: no pair of neighbours is frequent any more, but for runs, whose overlapping pairs count double
        left = Counter(zip(g.symbols.tolist(), g.symbols.tolist()[1:], strict=False))
        assert all(n < 4 for n in left.values()), left.most_common(3)
        for a, n in ((0, 3), (len(ids) // 2, 11), (max(0, len(ids) - 5), 5)):
            assert g.slice(a, min(n, len(ids) - a)).tolist() == ids[a : a + n].tolist()


@pytest.mark.parametrize("most", [20000, 1])
def test_op8_substrings(spark, docs, rows, most):
    got = by_id(repeats.remove_earlier_words(odd(docs), most_classes=most, least=2 if most == 1 else 8))
    first = {}
    for doc, text, *_ in sorted(rows):
        w = words_of(text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc)
    for doc, text, *_ in rows:
        w = words_of(text)
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < doc for k in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert repeats.remove_earlier_words(empty(spark)).count() == 0


@pytest.mark.parametrize(("most", "least"), [(20000, 8), (1, 2), (1, 1000)])
def test_op8_passages_repeated_inside_a_document(spark, most, least):
    """A smaller doc_id shares part of a passage that a document, or two rows of one id, hold twice."""
    r, table = random.Random(8), []
    for k in range(30):
        a = [f"{'abcdefgh'[r.randrange(8)]}{k}.{i}" for i in range(40)]
        i = r.randint(1, 12)
        table.append((3 * k, " ".join([f"b{k}", *a[i : i + r.randint(14, 26)], f"c{k}"])))
        table.append((3 * k + 1, " ".join([*a, f"x{k}", *a, f"y{k}", *a])))
        table.append((3 * k + 1, " ".join([f"z{k}", *a])))
    first = {}
    for doc, text in sorted(table):
        w = text.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc)
    want = []
    for doc, text in table:
        w = text.split()
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < doc for k in range(13)}
        want.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    documents = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = [tuple(row) for row in repeats.remove_earlier_words(documents, most_classes=most, least=least).collect()]
    assert sorted(got) == sorted(want)


def brute_strings(texts, length):
    """For each text, which of its bytes lie in strings of a length that also start elsewhere."""
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    every = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        every.append(bytes(gone))
    return every


def brute_passages(b, gone, words=51):
    """gone without the stretches that touch fewer words."""
    out = bytearray(len(b))
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    for m in re.finditer(b"\1+", gone):
        if sum(x < m.end() and y > m.start() for x, y in at) >= words:
            out[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return bytes(out)


@pytest.mark.parametrize(("most", "shorter"), [(20000, 200), (1, 200), (20000, 0)])
def test_op9_bytes(spark, docs, rows, most, shorter):
    r = random.Random(3)
    kinds = ["".join(r.choice("ab ") for _ in range(700)) for _ in range(6)]
    mixed = [(600 + i, "".join(r.choice(kinds)[r.randrange(300) :][: r.randrange(700)] for _ in range(5)), "en", "a", 0) for i in range(40)]
    extra = [(500, "z" * 1000, "en", "a", 0), (501, "q", "en", "a", 0), *mixed]
    got = by_id(suffixes.remove_repeated_bytes(odd(docs.unionByName(spark.createDataFrame(extra, SCHEMA))), shorter=shorter, most_classes=most, least=2 if most == 1 else 8))
    table = [*rows, *extra]
    texts = [(t[1] or "").encode() for t in table]
    short = brute_strings(texts, shorter) if shorter else texts
    for (doc, *_), b, gone, near in zip(table, texts, brute_strings(texts, 400), short, strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
        if shorter:
            assert r.n_passage_bytes == sum(brute_passages(b, near))
    assert suffixes.remove_repeated_bytes(empty(spark), shorter=shorter).count() == 0


def test_op9_ids_without_order(spark):
    """Rows of a null or repeated id are documents of their own, however many."""
    r = random.Random(2)
    passage = "".join(r.choice("abcdef") for _ in range(500))
    texts = ["".join(r.choice("abcdef") for _ in range(300)) + passage[: r.randrange(380, 430)] + "x" * r.randrange(9) for _ in range(300)]
    table = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted((len(t), sum(g)) for t, g in zip(texts, brute_strings([t.encode() for t in texts], 400), strict=True))
    assert sorted((x.n_bytes, x.n_removed) for x in suffixes.remove_repeated_bytes(table).collect()) == want


def test_op9_long_texts_in_pieces(monkeypatch):
    r = random.Random(9)
    long = "".join(r.choice("abcdef") for _ in range(5000))
    symbols = repeats.Symbols("bytes", np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    monkeypatch.setattr(repeats, "PIECE", 700)
    pieces = list(symbols.pieces(200, 400))
    starts = sorted(s for _, of, _, _, shift in pieces for s in range(shift, shift + max(0, int(of[-1]) - 199)))
    assert starts == list(range(len(long) - 199))
    assert all(int(ends[0]) == min(len(long) - shift, 700 + 399) for _, _, ends, _, shift in pieces)


def test_op9_very_long_text(spark):
    """A text of several pieces repeats a passage of its own far away, and one of another text across a piece's border."""
    r = np.random.default_rng(5)
    long = bytearray(r.integers(97, 123, 3 << 20, dtype=np.uint8).tobytes())
    long[2_500_000:2_500_700] = long[1000:1700]
    other = bytes(long[(1 << 20) - 300 : (1 << 20) + 300])
    table = spark.createDataFrame([(1, long.decode()), (2, other.decode()), (3, None)], "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffixes.remove_repeated_bytes(table).collect()}
    assert got == {1: (2000, 3), 2: (600, 1), 3: (0, 0)}


def test_op10_mixing(spark, docs, rows):
    table = docs.unionByName(spark.createDataFrame([(900, "w " * 50, "en", "big", 0)] * 3, SCHEMA))
    got = mixing.mix_sources(odd(table)).collect()
    size = Counter()
    every = [*rows, *[(900, "w " * 50, "en", "big", 0)] * 3]
    for _, text, _, source, _ in every:
        size[source] += len(words_of(text))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left, target = set(names), sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    sums, sources = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        sums[r.source] += r.taken
        sources[r.source] = r.target
    assert len(got) == len(every) and all(abs(sums[s] - t) <= 1 for s, t in sources.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(odd(table)).collect()))
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_op8_compares_no_chance_grams(spark):
    # texts that share three words alone have no window in common; texts that share a side of a window may
    words = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    rows = [(i, " ".join([*words(i, 15), "one", "two", "three", *words(-i - 1, 15)])) for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats.find_classes(documents, "words", 13, 3, True, 13, least=100).count() == 0
    rows += [(100 + i, " ".join([*words(i, 15)[i % 16 :], "one", "two", "three", *words(-i - 1, 15)[: 2 + i % 13], "other"])) for i in range(40)]
    got = {r.doc_id: r.n_removed for r in repeats.remove_earlier_words(spark.createDataFrame(rows, "doc_id long, text string"), least=100).collect()}
    for i in range(40):
        n = len(words(i, 15)[i % 16 :]) + 3 + 2 + i % 13
        assert got[i] == 0 and got[100 + i] == (n if n >= 13 else 0)

"""N-gram Jaccard join: documents whose 5-word shingle sets are alike, as classes.

1. Equal sets collapse into one class each, named by its least doc_id; one set
   stands for all from here on.
2. In an order of shingles that puts frequent ones last, two sets that are alike
   share a shingle among their first n - ceil(0.8 n) + 1.  Sets are dealt by
   these shingles and by size band, a doubling of n: what meets is a tile.  A set
   whose partners may be in the next band is a guest there.  A tile of many rows
   is cut into blocks, and every two blocks are a tile.
3. Each set carries a hashed parity bitmap of up to half as many bits as it has
   shingles.  Bits of two bitmaps that differ are at most the shingles that
   differ, so their count bounds the overlap from above; sizes and bitmaps rule
   out most pairs of a tile.
4. Pairs that are left are verified on the sorted shingle arrays.

Sets that are alike in large numbers would make a number of pairs that grows with
its square.  So each set first proposes two partners at most, the nearest one
and the one of least doc_id that its tiles leave it; sets that the links found
connect get one label, tiles of one label drop out, and after some rounds the
few pairs that are left between labels are all verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import numbered, stored
from .components import components
from .text import SLICE, Words, column_bytes, doc_slices, mix, window_hashes

SHINGLE = 5
_LEAST = -(1 << 63)


#: Words of the bitmaps that go with a set's shingles, and of those that judge single pairs, at most.
NARROW, WIDE = 64, 512


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lowered; a text of fewer words is one shingle."""
    for i, j in doc_slices(off, 2 * SLICE):
        w = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        of = w.of.tolist()
        every = window_hashes(w.hash, SHINGLE)
        for a, b in zip(of[:-1], of[1:], strict=True):
            if b - a >= SHINGLE:
                h = np.sort(every[a : b - SHINGLE + 1])
                yield h[np.append(True, h[1:] != h[:-1])]
            else:
                yield window_hashes(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def least_prefix(n: int) -> int:
    """Sets of n and of any size that are alike share one of so many first shingles."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def parity_bitmap(shingles: np.ndarray, share: int = 1, most: int = NARROW) -> np.ndarray:
    """64-bit words of the bitmap in which each shingle flips a bit: the power of two of at least 64 and share * n / 2 bits, or ``most`` words."""
    bits = 64
    while 2 * bits < share * len(shingles) and bits < 64 * most:
        bits *= 2
    place = (mix(shingles) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) shortened to so many words: what a shorter bitmap of the same sets would be."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def _linkable(na, nb, overlap):
    """100 * overlap >= 80 * union, in integers."""
    return 9 * overlap >= 4 * (na + nb)


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _frequent(documents: DataFrame, sample: int, share: float, most: int) -> np.ndarray:
    """Frequent shingles of a sample of about ``sample`` documents; at most ``most``.

    They only set the order in which shingles are dealt: any order gives the
    same links, this one makes small tiles.
    """
    total = documents.count()
    step = max(1, total // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(*column_bytes(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["shingle"])

    picked = documents.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(step)) == 0).select("text")
    least = max(4, int(share * min(total, sample)))
    rows = picked.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(most).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in rows], np.int64).view(np.uint64))


def _sets(documents: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc, n, s1, s2 (hash of the set), bits and wide (bitmaps), prefix of each document."""
    hot = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value
        for batch in batches:
            docs, texts = batch.column("doc"), batch.column("text")
            for at in range(0, batch.num_rows, 1000):
                n, s1, s2, bits, wide, prefix = [], [], [], [], [], []
                for s in shingle_sets(*column_bytes(texts.slice(at, 1000))):
                    p = least_prefix(len(s))
                    n.append(len(s))
                    s1.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                    s2.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0)
                    bits.append(parity_bitmap(s).tobytes() if len(s) else b"")
                    wide.append(parity_bitmap(s, 8, WIDE).tobytes() if len(s) else b"")
                    if len(often) and p:
                        i = np.searchsorted(often, s)
                        i[i == len(often)] = 0
                        late = often[i] == s
                        head = s[~late][:p]
                        s = np.concatenate([head, s[late][: p - len(head)]]) if len(head) < p else head
                    prefix.append(s[:p].tobytes())
                yield pa.RecordBatch.from_arrays([docs.slice(at, 1000), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefix, pa.binary())], ["doc", "n", "s1", "s2", "bits", "wide", "prefix"])

    return documents.mapInArrow(run, "doc long, n long, s1 long, s2 long, bits binary, wide binary, prefix binary")


def _dealt(sets: DataFrame) -> DataFrame:
    """token, doc, n: a row for each shingle of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw, off = column_bytes(part.column("prefix"))
                many = np.diff(off) // 8
                doc, n = (pa.array(np.repeat(part.column(c).to_numpy(), many)) for c in ("doc", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), np.int64)), doc, n], ["token", "doc", "n"])

    return sets.select("doc", "n", "prefix").mapInArrow(run, "token long, doc long, n long")


def _candidates(tiles: DataFrame, proposals: bool) -> DataFrame:
    """Pairs (a, b) of different components in a tile that sizes and bitmaps don't rule out.

    tiles: key (token, band, i, j), side, guest, doc, n, comp, bits.  Side 0 and
    1 rows of a tile are compared with each other, side 2 rows with all, and
    guests with none of their kind.  All pairs (a < b), or of each row of a tile proposals alone: a, b (the partner
    whose bitmap is nearest), apart, and lead (the partner of least doc_id).
    """
    key = ["token", "band", "i", "j"]

    def judge(rows: pa.Table) -> pa.RecordBatch | None:
        ks = [rows.column(c).to_numpy() for c in key]
        side, guest, doc, n, comp = (rows.column(c).to_numpy() for c in ("side", "guest", "doc", "n", "comp"))
        raw, off = column_bytes(rows.column("bits"))
        words, off = np.frombuffer(raw.tobytes(), np.uint64), off // 8
        size = np.diff(off)
        same = np.ones(len(doc) - 1, bool)
        for k in ks:
            same &= k[1:] == k[:-1]
        group = np.concatenate([[0], np.cumsum(~same)])
        last = np.searchsorted(group, group, "right")  # rows are in order of their group and, in it, of n
        active = np.flatnonzero(np.arange(len(doc)) + 1 < last)
        found, step = [], 1
        least_apart, nearest = np.full(len(doc), 1 << 40), np.zeros(len(doc), np.int64)
        lead = np.full(len(doc), (1 << 63) - 1)
        while len(active):
            x, y = active, active + step
            near = 5 * n[x] >= 4 * n[y]
            ok = near & (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] == 2)) & (guest[x] + guest[y] < 2)
            x, y = x[ok], y[ok]
            for long in np.unique(size[y]):
                for short in np.unique(size[x[size[y] == long]]):
                    at = np.flatnonzero((size[y] == long) & (size[x] == short))
                    least = min(long, short)
                    many = max(1, (1 << 18) // max(long, short))
                    for s in range(0, len(at), many):
                        u, v = x[at[s : s + many]], y[at[s : s + many]]
                        bu = fold(words[off[u][:, None] + np.arange(short)], least)
                        bv = fold(words[off[v][:, None] + np.arange(long)], least)
                        apart = np.bitwise_count(bu ^ bv).sum(1, dtype=np.int64)
                        fits = _linkable(n[u], n[v], (n[u] + n[v] - apart) // 2)
                        u, v, apart = u[fits], v[fits], apart[fits]
                        if not proposals:
                            found.append(np.stack([doc[u], doc[v]], 1))
                            continue
                        for own, other in ((u, v), (v, u)):  # a row stands once on either side of a step
                            better = apart < least_apart[own]
                            least_apart[own[better]], nearest[own[better]] = apart[better], doc[other[better]]
                            lead[own] = np.minimum(lead[own], doc[other])
            active = active[near]
            step += 1
            active = active[active + step < last[active]]
        if proposals:
            at = np.flatnonzero(least_apart < 1 << 40)
            return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(nearest[at]), pa.array(least_apart[at]), pa.array(lead[at])], ["a", "b", "apart", "lead"]) if len(at) else None
        if not found:
            return None
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]) if len(pairs) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < 8000:
                continue
            ends = np.ones(len(held), bool)
            ends[:-1] = False
            for c in key:
                k = held.column(c).to_numpy()
                ends[:-1] |= k[1:] != k[:-1]
            cut = np.flatnonzero(ends[:-1])
            if len(cut):
                n = int(cut[-1]) + 1
                if (out := judge(held.slice(0, n).combine_chunks())) is not None:
                    yield out
                held = held.slice(n)
        if held is not None and len(held) > 1 and (out := judge(held.combine_chunks())) is not None:
            yield out

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(parts, *key).sortWithinPartitions(*key, "n", "doc")
    if proposals:
        return dealt.mapInArrow(run, "a long, b long, apart long, lead long")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verify_pairs(documents: DataFrame, pairs: DataFrame, most_pairs: int = 1024) -> DataFrame:
    """The pairs (a, b) whose sets are alike, by intersection of their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_sets(*column_bytes(part.column(c))) for c in ("text_a", "text_b")]
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    keep.append(len(x) > 0 and len(y) > 0 and bool(_linkable(len(x), len(y), int((both[1:] == both[:-1]).sum()))))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    left = documents.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = documents.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    columns = ["a", "b", "text_a", "text_b"]
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / most_pairs).cast("int").alias("copies")).where("copies > 1")
    texts = pairs.join(left, "a").join(right, "b").select(*columns)
    if not often.isEmpty():
        # a document that is the partner of very many is copied, and each copy gets a share of its pairs
        rest = pairs.join(often, "b", "left_anti").join(left, "a").join(right, "b").select(*columns)
        dealt = pairs.join(often, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
        copies = right.join(often, "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        texts = rest.unionByName(dealt.join(left, "a").join(copies, ["b", "copy"]).select(*columns))
    return texts.mapInArrow(run, "a long, b long")


def _near_labels(links: DataFrame, steps: int = 3) -> DataFrame:
    """node, component: the least node within so many links, so that equal labels mean one component; not all of it gets one label."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"))
    for _ in range(steps - 1):
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("at")).agg(F.min("component").alias("heard"))
        labels = labels.join(heard, labels.node == heard.at).select("node", F.least("component", "heard").alias("component"))
    return labels


def _open_rows(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """token, doc, n, comp, size: the rows of tokens that span components."""
    known = rows.withColumn("comp", F.col("doc")) if comps is None else rows.join(comps, rows.doc == comps.node, "left").select("token", "doc", "n", F.coalesce("component", "doc").alias("comp"))
    spans = known.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("size")).where("least <> most").select("token", "size")
    return known.join(spans, "token")


def _tiles(open_rows: DataFrame, bitmaps: DataFrame, most: int) -> DataFrame:
    """Rows of tokens, with their bitmaps, as tiles for _candidates: by token and size band, and by block where there are many."""
    band = F.floor(F.log2("n") + F.lit(1e-9)).cast("int")
    # 0.8 times a partner of the next band may be as small as this set
    near_next = 5 * F.col("n") >= 4 * F.pow(F.lit(2.0), band + 1)
    place = lambda up, guest: F.struct((band + up).alias("band"), F.lit(guest).alias("guest"))
    placed = open_rows.select("token", "doc", "n", "comp", F.explode(F.when(near_next, F.array(place(0, 0), place(1, 1))).otherwise(F.array(place(0, 0)))).alias("p")).select("token", "doc", "n", "comp", "p.*")
    tile = W.partitionBy("token", "band")
    sized = placed.withColumn("size", F.count("*").over(tile)).withColumn("owners", F.sum(1 - F.col("guest")).over(tile)).where("size > 1 and owners > 0")
    sized = sized.join(bitmaps, ["doc", "n"])
    blocks = F.ceil(F.col("size") / most).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    pair = lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"), F.when(F.col("block") < j, 0).when(F.col("block") > j, 1).otherwise(2).alias("side"))
    cut = sized.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)))
    return cut.select("token", "band", "tile.*", "guest", "doc", "n", "comp", "bits")


def jaccard_classes(documents: DataFrame, sample: int = 4000, frequent_share: float = 0.004, most_frequent: int = 65536, most_rows: int = 1024, rounds: int = 2) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard 0.8 or more).

    A null or empty text has no shingles and stands alone.  Rows repeated under
    one id are one document of several texts; rows of equal sets are linked.  A
    null doc_id counts as the smallest.  Further columns are ignored.
    """
    docs = _documents(documents)
    sets = stored(_sets(docs, _frequent(docs, sample, frequent_share, most_frequent)), "sets")
    classes = stored(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("class")), "classes")
    # of documents with one set, that of least id stands for all
    heads = sets.join(classes.withColumnRenamed("class", "doc"), ["doc", "s1", "s2", "n"], "left_semi")
    meta = stored(heads.dropDuplicates(["doc", "n", "s1"]), "bitmaps")
    dealt = _dealt(meta).withColumn("size", F.count("*").over(W.partitionBy("token"))).where("size > 1")
    rows = stored(dealt.select("token", "doc", "n"), "tokens")

    links, comps = None, None
    for _ in range(rounds):
        open_rows = stored(_open_rows(rows, comps), "open")
        asked = stored(_candidates(_tiles(open_rows, meta.select("doc", "n", "bits"), most_rows), True).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best"), F.min("lead").alias("lead")), "proposals")
        pairs = asked.select("a", F.col("best.b").alias("b")).union(asked.select("a", F.col("lead").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # the partner that many share is of least id, so it is the pair's b that is copied
        pairs = _plausible(pairs, meta).select(F.col("b").alias("a"), F.col("a").alias("b"))
        found = stored(verify_pairs(docs, stored(pairs, "pairs")).distinct(), "links")
        # a row without a proposal has no possible partner in another component, now or later
        rows = stored(open_rows.join(asked.select(F.col("a").alias("doc")), "doc", "left_semi").select("token", "doc", "n"), "tokens")
        links = found if links is None else links.unionByName(found)
        if found.isEmpty():
            break
        comps = stored(_near_labels(links), "labels")
    rest = _tiles(_open_rows(rows, comps), meta.select("doc", "n", F.col("wide").alias("bits")), most_rows)
    last = stored(_candidates(rest, False).select(F.col("b").alias("a"), F.col("a").alias("b")), "pairs")
    links = links.unionByName(verify_pairs(docs, last))

    members = sets.select("doc", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
    final = components(links)
    out = members.join(final, members["class"] == final["node"], "left")
    back = lambda c: F.when(c != _LEAST, c)
    return out.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component", "class", "doc")).alias("component_id"))


def _plausible(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """The pairs that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b")), strict=True):
                u, v = np.frombuffer(x, np.uint64)[None, :], np.frombuffer(y, np.uint64)[None, :]
                least = min(u.shape[1], v.shape[1])
                apart = int(np.bitwise_count(fold(u, least) ^ fold(v, least)).sum())
                keep.append(bool(_linkable(na, nb, (na + nb - apart) // 2)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = meta.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("wide").alias("bits_a"))
    right = meta.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("bits_b"))
    sized = pairs.join(left, "a").join(right, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return sized.mapInArrow(run, "a long, b long").distinct()


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of smallest id and, among rows of that id, the first by text; rows without shingles stay.

    An id is a row's key only if no two rows share it and none is null; else
    rows are linked under a hash of all their columns, and of rows equal in all
    of them one stays.  Null and empty texts stay, an empty table stays empty,
    columns of any name are handed through.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.join(jaccard_classes(docs).where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    own = numbered(docs)
    doc, text = (own.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    rest = [text, *[c for c in own.columns if c not in (doc, text)]]
    keyed = own.withColumn("row", F.xxhash64(*own.columns, *[F.col(c).isNull() for c in own.columns]))
    classes = stored(jaccard_classes(keyed.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))).distinct().withColumnRenamed("doc_id", "row"), "classes")
    alike = classes.where("n_shingles > 0").join(keyed.select("row", doc).distinct(), "row").select("row", "component_id", doc)
    least = alike.groupBy("component_id").agg(F.min(F.struct(doc)).alias("least"))
    heads = alike.join(least, "component_id").where(F.col(doc).eqNullSafe(F.col(f"least.{doc}"))).select("row", "component_id")
    firsts = keyed.join(heads, "row").groupBy("component_id").agg(F.min(F.struct(doc, *rest)).alias("first")).select("first.*").select(*own.columns)
    return firsts.unionByName(keyed.join(classes.where("n_shingles = 0"), "row", "left_semi").select(*own.columns)).toDF(*docs.columns)

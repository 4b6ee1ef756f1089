"""Merkle manifest of a dataset, with a witness for each row.

Each row is a leaf; the leaves of a source, in order, make a tree of fixed arity,
and the sources' roots make another one.  Trees grow by aligned appends: a task
streams the leaves of one aligned block into open subtrees, attaches to each
leaf the witness known so far, and extends it whenever siblings of a subtree
that holds the leaf are complete.  The roots of the blocks are then appended in
the same way, block by block, until one is left, and their witnesses extend
those of the rows below.  Nothing holds more than a block, and a source of any
size is dealt over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed, stored

ARITY = 3
#: Levels of a block's own tree: 3**7 = 2,187 leaves.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TREE = "tree string, at long, block long, path binary, root binary"


def node_hash(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes: SHA-256 of their digests as lower-case hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Subtrees:
    """An ordered tree that grows by appends.

    open: for each level the nodes of its last run that still lacks siblings,
    each with the range of leaves below it.  paths: each leaf's witness so far,
    level by level: how many siblings stand left and right, then their digests.
    """

    def __init__(self, levels: int, arity: int = ARITY):
        self.levels, self.arity = levels, arity
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.paths: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.paths.append(bytearray())
        self._put(0, digest, len(self.paths) - 1, len(self.paths))

    def _put(self, level: int, digest: bytes, first: int, end: int) -> None:
        self.open[level].append((digest, first, end))
        if level < self.levels and len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        """The run's nodes are complete: extend the witnesses below each by its siblings, and append their parent."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for i, (_, first, end) in enumerate(run):
            more = bytes((i, len(run) - 1 - i)) + b"".join(digests[:i] + digests[i + 1 :])
            for leaf in range(first, end):
                self.paths[leaf] += more
        self._put(level + 1, node_hash(digests), run[0][1], run[-1][2])

    def finish(self) -> bytes:
        """The root, after the last runs closed with fewer nodes."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def height(n: int, arity: int = ARITY) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def siblings(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The siblings left and right of a node on each level of its witness."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        at += 2
        run = [path[i : i + 32] for i in range(at, at + 32 * (left + right), 32)]
        yield run[:left], run[left:]
        at += 32 * (left + right)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for left, right in siblings(path):
        digest = node_hash([*left, digest, *right])
    return digest


def proof_digest(path: bytes) -> bytes:
    return node_hash([d for left, right in siblings(path) for d in left + right])


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256, lower-case hex, of the fields in order: - for a null, else UTF-8 byte count, colon and value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _append(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """nodes (tree, at, total, digest, further columns) -> tree, at, block, path (witness within the block), root (the block's), further columns."""
    size = arity**levels
    rest = [c for c in nodes.columns if c not in ("tree", "at", "total", "digest")]
    kinds = dict(nodes.dtypes)
    dealt = nodes.withColumn("block", F.floor(F.col("at") / size).cast("long")).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    schema = ", ".join([_TREE, *[f"{c} {kinds[c]}" for c in rest]])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grown, waiting = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            root, at = grown.finish(), 0
            for part in waiting:
                n = part.num_rows
                paths = pa.array([bytes(p) for p in grown.paths[at : at + n]], pa.binary())
                at += n
                columns = [part.column("tree"), part.column("at"), part.column("block"), paths, pa.array([root] * n, pa.binary()), *[part.column(c) for c in rest]]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "at", "block", "path", "root", *rest])

        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
            digests, first = batch.column("digest").to_pylist(), 0
            for i, digest in enumerate(digests):
                if keys[i] != now:
                    if grown is not None:
                        if i > first:
                            waiting.append(batch.slice(first, i - first))
                        yield from done()
                    now, waiting, first = keys[i], [], i
                    grown = Subtrees(min(levels, height(batch.column("total")[i].as_py(), arity)), arity)
                grown.append(digest)
            if batch.num_rows > first:
                waiting.append(batch.slice(first))
        if grown is not None:
            yield from done()

    return stored(dealt.mapInArrow(grow, schema), "merkle-blocks")


def _trees(nodes: DataFrame, levels: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, at, total, digest, ...) -> their appended rows, and for each block (tree, block): its witness above and its tree's root."""
    size = arity**levels
    stages, sizes = [], [nodes.agg(F.max("total")).head()[0] or 0]
    while True:
        stages.append(_append(nodes, levels, arity))
        if sizes[-1] <= size:
            break
        totals = nodes.select("tree", "at", F.ceil(F.col("total") / size).cast("long").alias("blocks")).where(F.col("at") == 0)
        roots = stages[-1].where(F.col("at") == F.col("block") * size).select("tree", F.col("block").alias("at"), F.col("root").alias("digest"))
        nodes = stored(roots.join(totals.select("tree", F.col("blocks").alias("total")), "tree").where("total > 1"), "merkle-roots")
        sizes.append(-(-sizes[-1] // size))
    above = None
    for stage in reversed(stages):
        blocks = stage.where(F.col("at") == F.col("block") * size).select("tree", "block", "root")
        if above is None:
            above = blocks.withColumn("path", F.lit(b""))
        else:
            # rows of the stage above are this stage's blocks
            next_rows = upper.alias("u").join(above.alias("a"), ["tree", "block"]).select("tree", F.col("u.at").alias("block"), F.concat("u.path", "a.path").alias("more"), F.col("a.root").alias("whole"))
            above = blocks.join(next_rows, ["tree", "block"], "left").select("tree", "block", F.coalesce("whole", "root").alias("root"), F.coalesce("more", F.lit(b"")).alias("path"))
        upper = stage
    return stages[0], above


def merkle_witnesses(leaves: DataFrame, order: list[Column], tree: str, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """leaves (with ``digest``: binary) with subroot, root and path (the whole witness), all binary.

    tree: the column of the source that a leaf belongs to (null: a source of its
    own, first among the roots, which stand in order of UTF-8 bytes).  Leaves
    equal in ``order`` should be equal in all.  An empty table stays empty.
    """
    rows = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit("")))
    low, above = _trees(placed(rows, "tree", order), levels, arity)
    above = stored(above, "merkle-above")
    # at most one row a source: the trees' roots, appended to a tree of their own
    tops = above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    top_low, top_above = _trees(placed(tops, "tree", [F.col("name")]), levels, arity)
    top = top_low.alias("t").join(top_above.alias("a"), ["tree", "block"]).select(F.col("t.name").alias("tree"), F.concat("t.path", "a.path").alias("top_path"), F.col("a.root").alias("top_root"))
    full = above.join(top, "tree").select("tree", "block", F.col("root").alias("subroot"), F.concat("path", "top_path").alias("more"), F.col("top_root"))
    out = low.drop("root").join(full, ["tree", "block"]).withColumn("path", F.concat("path", "more"))
    return out.withColumnRenamed("top_root", "root").drop("tree", "block", "at", "more")


def merkle_manifest(documents: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf covers doc_id, source, lang, n_chars and text.  Leaves of a source
    stand by doc_id, null first, then by digest; rows repeated exactly are
    leaves of their own, each with its own witness.  As a check of the
    witnesses, rows with an even CRC-32 of their decimal doc_id are tampered
    with (their text loses its line feeds; a null text or id stays) and folded
    again: ``verified`` says if that still gives the root.  A null or empty
    text is a value of its own; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    leaves = documents.select("doc_id", "source", F.unhex(leaf_hash(fields)).alias("digest"), F.unhex(leaf_hash(changed)).alias("altered"))
    # the row number only breaks ties of rows that are equal in all
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = leaves.withColumn("altered", F.when(F.col("altered") != F.col("digest"), F.col("altered"))).withColumn("leaf", F.col("digest"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    rows = merkle_witnesses(leaves, order, "source", levels, arity)
    kind = dict(documents.dtypes)["doc_id"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, path, altered, root = (batch.column(c).to_pylist() for c in ("leaf", "path", "altered", "root"))
            folded = [fold(a or d, p) for d, a, p in zip(leaf, altered, path, strict=True)]
            hexed = lambda values: pa.array([x.hex() for x in values], pa.string())
            columns = [hexed(leaf), hexed(batch.column("subroot").to_pylist()), hexed(root), hexed(map(proof_digest, path)), hexed(folded), pa.array([f == r for f, r in zip(folded, root, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.select("doc_id", "leaf", "altered", "path", "subroot", "root").mapInArrow(check, schema)


def _sql_climb(name: str, base: str) -> str:
    return f"""{name}(tree, level, spot, digest, n) AS ({base}
  UNION ALL SELECT tree, level + 1, spot // 3, sha256(string_agg(digest, '' ORDER BY spot)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, spot // 3)"""


def _sql_walk(name: str, nodes: str, base: str) -> str:
    return f"""{name}(row, tree, level, spot, fold, sibs, n) AS ({base}
  UNION ALL SELECT w.row, w.tree, w.level + 1, w.spot // 3, sha256(string_agg(CASE WHEN s.spot = w.spot THEN w.fold ELSE s.digest END, '' ORDER BY s.spot)),
    any_value(w.sibs) || coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (WHERE s.spot <> w.spot), ''), (any_value(w.n) + 2) // 3
  FROM {name} w JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.spot // 3 = w.spot // 3 WHERE w.n > 1 GROUP BY w.row, w.tree, w.level, w.spot)"""


def _sql_leaf(text: str) -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: DuckDB's form of merkle_manifest(documents).  A CRC-32's remainder of a byte at a time, by its polynomial.
MERKLE_SQL = f"""
WITH RECURSIVE crc(value, byte, step) AS (SELECT CAST(range AS BIGINT), range, 0 FROM range(256)
  UNION ALL SELECT CASE WHEN value % 2 = 1 THEN xor(value >> 1, CAST(3988292384 AS BIGINT)) ELSE value >> 1 END, byte, step + 1 FROM crc WHERE step < 8),
crcs AS (SELECT list(value ORDER BY byte) AS t FROM crc WHERE step = 8),
flagged AS (SELECT d.*, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])) % 2 = 1 AS tampered FROM documents d, crcs),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_sql_leaf('text')} AS leaf,
  {_sql_leaf("(CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END)")} AS altered FROM flagged),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n,
  row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row FROM leaves),
{_sql_climb('nodes', 'SELECT tree, 0, spot, leaf, n FROM placed')},
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_sql_climb('tops', "SELECT '', 0, spot, subroot, n FROM subroots")},
{_sql_walk('low', 'nodes', "SELECT row, tree, 0, spot, altered, '', n FROM placed")},
{_sql_walk('high', 'tops', "SELECT l.row, '', 0, s.spot, l.fold, l.sibs, s.n FROM low l JOIN subroots s ON s.tree = l.tree WHERE l.n = 1")}
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(h.sibs) AS proof_sha256, h.fold AS folded_root, h.fold = t.digest AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN high h ON h.row = p.row AND h.n = 1 JOIN tops t ON t.n = 1
"""

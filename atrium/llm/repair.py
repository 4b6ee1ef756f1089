"""Token ids in files compressed by Re-Pair grammars.

Documents are put in ascending doc_id order by range partitions.  A task
tokenizes its range in order and cuts the ids into shards of about a million;
each shard has a grammar of its own.  A round of Re-Pair counts all adjacent
pairs, gives the frequent ones nonterminals and replaces their occurrences from
left to right; further rounds pair up nonterminals, until no pair is frequent.
A shard's row holds the
final symbols, the rules and the rules' expansion lengths, so any range of ids
is found by running sums of lengths and decoded without the rest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols from here on are nonterminals: rule k is symbol FIRST_RULE + k.
FIRST_RULE = 1 << 20
SHARD_IDS = 1 << 20
_TABLE_BITS = 20

FORMAT = "part int, shard int, start long, n_ids long, doc_id array<bigint>, n_tokens array<bigint>, symbols binary, rules binary, lengths binary"


@dataclass
class Grammar:
    """symbols: uint32; rules: (n, 2) uint32; lengths: ids that each rule stands for."""

    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= FIRST_RULE
        out[rule] = self.lengths[symbols[rule] - FIRST_RULE]
        return out

    def expand(self, symbols: np.ndarray | None = None) -> np.ndarray:
        s = self.symbols if symbols is None else symbols
        while len(s) and (rule := s >= FIRST_RULE).any():
            at = np.arange(len(s))
            at[1:] += np.cumsum(rule[:-1])
            out = np.empty(len(s) + int(rule.sum()), np.uint32)
            out[at] = s
            k = s[rule] - FIRST_RULE
            out[at[rule]] = self.rules[k, 0]
            out[at[rule] + 1] = self.rules[k, 1]
            s = out
        return s

    def slice(self, start: int, n: int) -> np.ndarray:
        """ids start to start + n, expanding only the symbols that cover them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        end = np.cumsum(self.sizes(self.symbols))
        a, b = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, start + n, "left")) + 1
        skipped = int(end[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - skipped : start - skipped + n]


def _frequent_pairs(pairs: np.ndarray, least: int) -> np.ndarray:
    """The pairs with at least ``least`` occurrences, counted exactly."""
    ordered = np.sort(pairs)
    head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return ordered[head[np.diff(np.append(head, len(ordered))) >= least]]


def compress(ids: np.ndarray, least: int = 24) -> Grammar:
    """Re-Pair in rounds, until no pair of neighbouring symbols occurs ``least`` times.

    All frequent pairs of a round get nonterminals, and each of their
    occurrences that does not overlap one taken before it is replaced.  After
    that, only pairs with a symbol of the last round can have become frequent,
    and pairs that shared a hash slot with another one wait for the next round.
    """
    s = ids.astype(np.uint32)
    rules, lengths = [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.int64)]
    count, newest, waiting = 0, 0, False
    while len(s) > 1:
        pair = (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
        at = None
        if newest and not waiting:
            fresh = s >= newest
            at = np.flatnonzero(fresh[:-1] | fresh[1:])
            pair = pair[at]
        chosen = _frequent_pairs(pair, least)
        if not len(chosen):
            break
        slot_of = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int32)
        table = np.full(1 << _TABLE_BITS, -1, np.int32)
        own = slot_of(chosen)
        table[own] = np.arange(len(chosen), dtype=np.int32)
        kept = table[own] == np.arange(len(chosen))
        waiting = not kept.all()
        if waiting:
            chosen = chosen[kept]
            table[own[kept]] = np.arange(len(chosen), dtype=np.int32)
        rule = table[slot_of(pair)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[chosen[rule[hit]] == pair[hit]]
        rule, hit = rule[hit], hit if at is None else at[hit]
        # overlapping occurrences stand in stretches; every second one is taken, from the left
        head = np.append(True, hit[1:] != hit[:-1] + 1)
        since = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
        taken = since % 2 == 0
        hit, rule = hit[taken], rule[taken]
        grammar = Grammar(s, np.concatenate(rules), np.concatenate(lengths))
        both = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(both)
        lengths.append(grammar.sizes(both[:, 0]) + grammar.sizes(both[:, 1]))
        newest = FIRST_RULE + count
        count += len(chosen)
        s = s.copy()
        s[hit] = (rule + newest).astype(np.uint32)
        stay = np.ones(len(s), bool)
        stay[hit + 1] = False
        s = s[stay]
    return Grammar(s, np.concatenate(rules), np.concatenate(lengths))


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, others for 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Pieces(dict):
    """Piece of a lowered word -> its ids as bytes; a missing one is split by the model's merges and kept."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(plain)]
        out = self[piece] = pack(f"<{len(ids)}I", *ids)
        return out


class WordTokens(dict):
    """Word -> its ids as little-endian uint32, by a tokenizer that drops white space.

    No match, normal form or special token of such a tokenizer spans white
    space, so a text's ids are those of its words; each distinct word is encoded
    once as long as it stays among the ``most`` known ones.  A word of code
    points below 256 is its own normal form, and its pieces go straight to the
    model; other words, and words that may hold a special token, take the whole
    tokenizer.
    """

    def __init__(self, file: str, most: int = 800_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(file), most
        self.pieces = _Pieces(self.tokenizer.model)
        with open(file) as f:
            setup = json.load(f)
        parts = lambda x: [n["type"] for n in x]
        normal, split = setup["normalizer"], setup["pre_tokenizer"]
        self.plain = normal["type"] == "Sequence" and parts(normal["normalizers"]) == ["NFC", "Replace", "Lowercase"] and parts(split["pretokenizers"]) == ["Split", "ByteLevel"]
        self.split = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"]).findall if self.plain else None

    def __missing__(self, word: bytes) -> bytes:
        if self.plain and max(word) < 0xC4 and b"<" not in word:
            text = word.decode().lower()
            if text.isalpha():
                out = self.pieces[text]
            elif text[-1] in ".,;:!?)" and text[:-1].isalpha():
                out = self.pieces[text[:-1]] + self.pieces[text[-1]]
            else:
                out = b"".join(map(self.pieces.__getitem__, self.split(text)))
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            out = pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """For each text its ids and the end id, as little-endian uint32."""
        if len(self) > self.most:
            self.clear()
        if len(self.pieces) > self.most:
            self.pieces.clear()
        last = pack("<I", end)
        return [b"".join(map(self.__getitem__, t.split())) + last for t in texts]


@lru_cache(maxsize=2)
def _tokens(file: str) -> WordTokens:
    return WordTokens(file)


def tokenize_shards(documents: DataFrame, tokenizer_file: str, end: int = 1, shard_ids: int = SHARD_IDS, least: int = 24, parts: int | None = None) -> DataFrame:
    """Rows of FORMAT: the shards of all documents, in order of (part, shard).

    A null text is empty and has the end id alone; rows of one doc_id follow
    each other by text, a null doc_id comes first; further columns are ignored.
    """
    from .text import column_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = _tokens(tokenizer_file), TaskContext.get().partitionId()
        shard, start = 0, 0
        docs: list = []
        data: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, start, docs, data, size
            ids = np.frombuffer(b"".join(data), "<u4")
            g = compress(ids, least)
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_id": pa.array([docs], pa.list_(pa.int64())), "n_tokens": pa.array([[len(x) // 4 for x in data]], pa.list_(pa.int64())),
                "symbols": pa.array([g.symbols.astype("<u4").tobytes()], pa.binary()), "rules": pa.array([g.rules.astype("<u4").tobytes()], pa.binary()), "lengths": pa.array([g.lengths.astype("<u4").tobytes()], pa.binary()),
            })
            shard, start, docs, data, size = shard + 1, start + len(ids), [], [], 0
            return out

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            buf, off = column_bytes(batch.column("text"))
            for at in range(0, len(ids), 200):
                texts = [buf[off[i] : off[i + 1]].tobytes() for i in range(at, min(at + 200, len(ids)))]
                for doc, x in zip(ids[at : at + 200], tokens.encode(texts, end), strict=True):
                    docs.append(doc)
                    data.append(x)
                    size += len(x)
                    if size >= 4 * shard_ids:
                        yield close()
        if docs:
            yield close()

    parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, FORMAT)


def write_shards(documents: DataFrame, path: str, tokenizer_file: str, **options) -> None:
    """The shards as Parquet, committed by Spark's writer: files of lost tasks never count."""
    tokenize_shards(documents, tokenizer_file, **options).write.parquet(path)


def grammar_of(row: dict) -> Grammar:
    return Grammar(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64))


def read_shards(spark, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian uint32) of each document in the files."""
    table = spark.read.parquet(path)
    # one total a range partition reaches the driver
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, so_far = {}, 0
    for part in sorted(totals):
        before[part] = so_far
        so_far += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("part", "start", "symbols", "rules", "lengths")}
                n = batch.column("n_tokens")[i].values.to_numpy()
                every = grammar_of(row).expand().astype("<u4")
                end = np.cumsum(n)
                first = before[row["part"]] + row["start"] + end - n
                parts = [every[b - k : b].tobytes() for b, k in zip(end.tolist(), n.tolist(), strict=True)]
                crc = [zlib.crc32(x) for x in parts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i].values, pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(parts, pa.binary())] if ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def read_ranges(spark, path: str, ranges: DataFrame) -> DataFrame:
    """range_id, start, n, ids of ranges (range_id, start, n) of the ids of all documents, decoded from the shards that hold them.

    Only the symbols that cover a range are expanded.  A range meets the shards
    it overlaps by their numbers, so neither side is gathered; a range over
    several shards is joined in their order, what lies beyond the last id is cut.
    """
    table = spark.read.parquet(path)
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, so_far = [], 0
    for part in sorted(totals):
        before.append((part, so_far))
        so_far += totals[part]
    offsets = spark.createDataFrame(before, "part int, before long")
    placed = table.select("part", "shard", "n_ids", "symbols", "rules", "lengths", "start").join(offsets, "part").withColumn("first", F.col("before") + F.col("start")).drop("before", "start")
    # blocks of a shard's size: a shard and a range that overlap share one
    block = lambda a, n: F.explode(F.sequence(F.floor(a / SHARD_IDS), F.floor((a + n - 1) / SHARD_IDS)))
    asked = ranges.where("n > 0").select("range_id", F.col("start").alias("a"), F.col("n").alias("wanted")).withColumn("block", block(F.col("a"), F.col("wanted")))
    held = placed.where("n_ids > 0").withColumn("block", block(F.col("first"), F.col("n_ids")))
    low, high = F.greatest("a", "first"), F.least(F.col("a") + F.col("wanted"), F.col("first") + F.col("n_ids"))
    met = held.join(asked, "block").where((low < high) & (F.col("block") == F.floor(low / SHARD_IDS)))
    met = met.select("range_id", "a", (low - F.col("first")).alias("from"), (high - low).alias("n"), "first", "symbols", "rules", "lengths")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("from", "n", "symbols", "rules", "lengths")
            parts = [grammar_of(dict(zip(names, x, strict=True))).slice(x[0], x[1]).astype("<u4").tobytes() for x in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("range_id"), batch.column("a"), batch.column("first"), batch.column("n"), pa.array(parts, pa.binary())], ["range_id", "start", "first", "n", "ids"])

    pieces = met.mapInArrow(cut, f"range_id {dict(ranges.dtypes)['range_id']}, start long, first long, n long, ids binary")
    whole = pieces.groupBy("range_id", "start").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "ids"))).alias("parts"))
    return whole.select("range_id", "start", "n", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))

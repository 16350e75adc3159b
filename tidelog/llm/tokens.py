"""Encoding of a corpus with a public byte-level BPE vocabulary, and decoding.

Texts are cut into words by the vocabulary's own pattern inside Spark, once, and stored as lists of
words. Each distinct word is encoded once, and the ids are joined back by position: the commonest
words through a broadcast of bounded size, all others through a shuffle of their own. Decoding joins
every id to its piece.

Defined results: null and empty texts give an empty list; special tokens in a text are plain text;
repeated rows come out once, rows of one doc_id with different texts each for themselves. Texts with code points
that this Java does not know are encoded whole on the workers, since their words might be cut otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import BROADCAST_LIMIT_BYTES, stored_bytes, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that cuts texts into words before the merges.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bound of the broadcast: words, and bytes of each. With at most an id a byte that is under 8 MB.
HOT_WORDS, HOT_BYTES = 20_000, 48

_UNKNOWN = r"\p{Cn}"


def _encoder(vocabulary: str) -> Callable[[list[str]], list[list[int]]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encoded(vocabulary, column: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(vocabulary.value)
        for batch in batches:
            yield batch.assign(ids=encode(batch[column].tolist()))

    return run


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each batch with their numbers."""
    for batch in batches:
        counts = pc.value_counts(batch.column("words").flatten())
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Pieces of the pool one after the other, as a list for each document; ``ends``: pieces up to its end."""
    reached = np.concatenate([[0], np.cumsum(lengths)])
    places = np.repeat(starts - reached[:-1], lengths) + np.arange(reached[-1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], reached[ends]]).astype(np.int32)), pa.array(pool[places].astype(np.int32)))


def _placed(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids in order; a word that is not at hand is marked by -1 - its place in the document's list of such words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, pool, starts = shared.value
        hot, lengths = pa.array(hot, pa.string()), np.diff(starts)
        for batch in batches:
            column = batch.column("words")
            flat = column.flatten()
            ends = column.offsets.to_numpy()[1:] - column.offsets.to_numpy()[0]
            found = pc.index_in(flat, value_set=hot)
            absent = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            at = found.fill_null(0).to_numpy().astype(np.int64)
            first, n = starts[:-1][at] if len(hot) else at, lengths[at] if len(hot) else at
            missing: list[list[str]] = [[] for _ in range(batch.num_rows)]
            numbers: list[dict[str, int]] = [{} for _ in range(batch.num_rows)]
            marks = np.empty(len(absent), dtype=np.int64)
            of = np.searchsorted(ends, absent, side="right").tolist()
            for i, (document, word) in enumerate(zip(of, flat.take(pa.array(absent)).to_pylist(), strict=True)):
                known = numbers[document]
                if word not in known:
                    known[word] = len(known)
                    missing[document].append(word)
                marks[i] = known[word]
            first[absent], n[absent] = len(pool) + marks, 1
            extended = np.concatenate([pool, -1 - np.arange(marks.max() + 1 if len(marks) else 0)])
            columns = [batch.column("doc_id"), batch.column("h"), _gathered(extended, first, n, ends), pa.array(missing, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "ids", "missing"])

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the marked words put in their places."""
    for batch in batches:
        ids, rare = batch.column("ids"), batch.column("rare")
        flat = ids.flatten().to_numpy().astype(np.int64)
        ends = ids.offsets.to_numpy()[1:] - ids.offsets.to_numpy()[0]
        words = rare.flatten()
        pieces = words.flatten().to_numpy().astype(np.int64)
        begins = words.offsets.to_numpy().astype(np.int64) - words.offsets.to_numpy()[0]
        base = np.repeat(rare.offsets.to_numpy()[:-1] - rare.offsets.to_numpy()[0], np.diff(np.concatenate([[0], ends])))
        marked = flat < 0
        word = (base - 1 - flat)[marked]
        starts, lengths = np.arange(len(flat)), np.ones(len(flat), dtype=np.int64)
        starts[marked], lengths[marked] = len(flat) + begins[word], begins[word + 1] - begins[word]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _gathered(np.concatenate([flat, pieces]), starts, lengths, ends)], names=["doc_id", "ids"])


def _once(cut: DataFrame, path: str) -> DataFrame:
    """Every (doc_id, text) once: only texts that are there repeatedly are shuffled."""
    repeated = written(cut.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h")), path)
    small = 4 * stored_bytes(cut.sparkSession, path) < BROADCAST_LIMIT_BYTES
    repeated = F.broadcast(repeated) if small else repeated
    met = cut["doc_id"].eqNullSafe(F.col("of_doc")) & (cut["h"] == F.col("of_h"))
    of_repeated = cut.join(repeated, met, "left_semi").groupBy("doc_id", "h").agg(F.first("words").alias("words"))
    return cut.join(repeated, met, "left_anti").unionByName(of_repeated)


def token_ids(documents: DataFrame, work: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document. ``work`` is a folder for words and ids.

    Texts are not shuffled: each becomes a list of words, then of ids where its words are common. Only
    rare words travel, and the ids of documents that have some.
    """
    spark = documents.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    texts = documents.select("doc_id", "text")
    blank = texts.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids")).distinct()
    full = texts.where("text <> ''").withColumn("unknown", F.col("text").rlike(_UNKNOWN))
    whole = (
        full.where("unknown").select("doc_id", "text").mapInPandas(_encoded(shared, "text"), "doc_id long, text string, ids array<int>").distinct().select("doc_id", "ids")
    )
    cut = written(full.where("not unknown").select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words")), f"{work}/cut")
    counted = cut.select("words").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = written(counted.mapInPandas(_encoded(shared, "word"), "word string, n long, ids array<int>"), f"{work}/words")
    hot = table.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word", "ids").collect()  # a bounded number
    pool = np.array([i for r in hot for i in r.ids], dtype=np.int64)
    at_hand = spark.sparkContext.broadcast(([r.word for r in hot], pool, np.concatenate([[0], np.cumsum([len(r.ids) for r in hot])]).astype(np.int64)))
    placed = written(_once(cut, f"{work}/repeated").mapInArrow(_placed(at_hand), "doc_id long, h long, ids array<int>, missing array<string>"), f"{work}/placed")
    complete = placed.where(F.size("missing") == 0).select("doc_id", "ids")
    lacking = placed.where(F.size("missing") > 0)
    wanted = lacking.select("doc_id", "h", F.posexplode("missing").alias("at", "word"))
    found = wanted.join(table.select("word", F.col("ids").alias("piece")), "word")
    by_doc = found.groupBy(F.struct("doc_id", "h").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    rare = by_doc.select("doc", F.transform("parts", lambda p: p["piece"]).alias("rare"))
    joined = lacking.select(F.struct("doc_id", "h").alias("doc"), "ids").join(rare.hint("shuffle_hash"), "doc")
    filled = joined.select("doc.doc_id", "ids", "rare").mapInArrow(_filled, "doc_id long, ids array<int>")
    return complete.unionByName(filled).unionByName(whole).unionByName(blank)


def piece_table(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece): the bytes of every id as hex digits. As long as the vocabulary, so it may be broadcast."""
    with open(vocabulary, encoding="utf-8") as file:
        content = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    pieces = {t["id"]: t["content"].encode().hex() for t in content.get("added_tokens", [])}
    for piece, i in content["model"]["vocab"].items():
        pieces.setdefault(i, bytes(byte_of[c] for c in piece).hex() if all(c in byte_of for c in piece) else piece.encode().hex())
    return spark.createDataFrame(pd.DataFrame(list(pieces.items()), columns=["id", "piece"]), "id int, piece string")


def decoded(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); ids that spell no valid UTF-8 give null."""
    keyed = encoded.withColumn("h", F.xxhash64("ids"))
    placed = keyed.select("doc_id", "h", F.posexplode_outer("ids").alias("at", "id"))
    pieces = placed.join(F.broadcast(piece_table(encoded.sparkSession, vocabulary)), "id", "left")
    parts = pieces.groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "piece")).alias("parts"))
    data = F.unhex(F.array_join(F.transform(F.sort_array("parts"), lambda p: p["piece"]), ""))
    return parts.select("doc_id", F.try_validate_utf8(data.cast("string")).alias("text"))

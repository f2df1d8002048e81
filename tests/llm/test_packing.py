import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_chunks_give_the_tokenizer_s_ids():
    tok, plain = packing.ChunkTokenizer.load(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    parts = ["word", " two", "  ", "\n", " \n", "it's", "123", " 45", "é", "—", "<|endoftext|>", "!!", "\t", "x" * 50, " ", " ", "日本"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(tok.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_every_length_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(0, 40))}
    used = collections.Counter()
    bins = 0
    for times, lengths in packing.best_two_fit(counts, 100):
        assert times > 0 and sum(lengths) <= 100
        bins += times
        for x in lengths:
            used[x] += times
    assert used == collections.Counter(counts)
    total = sum(k * v for k, v in counts.items())
    assert bins <= 11 / 9 * max(1, -(-total // 100)) + sum(v for k, v in counts.items() if k > 50)


def test_two_documents_replace_the_smallest():
    # Greedy gives 60 + 30; 60 + (25 + 15) fits the gap of 40 exactly.
    (times, first), *_ = packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert times == 1 and sorted(first) == [15, 25, 60]


def test_pieces():
    assert packing.piece_bounds(1024) == [(0, 1024)]
    assert packing.piece_bounds(1025) == [(0, 1), (1, 1024)]
    assert packing.piece_bounds(2048) == [(0, 1024), (1024, 1024)]


def test_pack_documents(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    expect = collections.Counter()
    for r in odd_docs.collect():
        ids = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        for i, (s, n) in enumerate(packing.piece_bounds(len(ids))):
            expect[r["doc_id"], i, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_ids_come_back(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    (row,) = packing.pack_documents(docs, PATH, with_ids=True).collect()
    assert Tokenizer.from_file(PATH).decode(row["ids"][:-1]) == "hello world" and row["ids"][-1] == 2


def test_repeated_rows_of_one_id_are_many_tasks(spark):
    """Rows alike in all columns: numbered apart by their places in the stored table."""
    from pyspark.sql import functions as F

    from roadweave.llm.common import stored

    docs = spark.range(0, 60_000, 1, 4).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    pieces = stored(packing.tokenise(docs, PATH), "same-pieces")
    salts = pieces.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "_rw_place"), F.lit(3))).count().collect()
    assert len(salts) == 3 and max(r["count"] for r in salts) < 30_000
    rows = packing.pack(pieces)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() == 60_000 == rows.select("sequence_id", "offset").distinct().count()
    ends = rows.groupBy("sequence_id").agg(F.sum("length").alias("s"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert ends.where("s <> e or s > 1024").count() == 0

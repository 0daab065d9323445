import zlib
from functools import partial

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm.common import chunked_tokenizer, spaced_words
from quantloom.llm.queries import op6_binary_records
from quantloom.llm.records import crc32c, frame, masked, read_records, unframe, with_starts, write_records

BYTES = partial(chunked_tokenizer, public.path("byte_bpe_50k.json"), spaced_words)


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    records = [b"123456789", b"\0" * 32, bytes(range(256)) * 9, b"abcd", b"x" * 512, b"y" * 513]
    assert crc32c(records).tolist() == [slow_crc(r) for r in records]
    assert crc32c([b"123456789"])[0] == 0xE3069283
    assert int(masked(np.array([0], np.uint32))[0]) == 0xA282EAD8


def test_frames_and_broken_ones():
    payloads = [b"abcd" * k for k in (1, 200, 3)]
    assert unframe(frame(payloads)) == payloads
    bad = bytearray(frame(payloads)[1])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        unframe([bytes(bad)])


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op6_binary_records(spark, folder).collect()}
    library, start = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    library.encode_special_tokens = True
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda d: d.doc_id)
    assert len(rows) == len(docs)
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(rows[d.doc_id])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shuffled_reads_nulls_repeats_and_empty(spark, tmp_path):
    rows = [(5, "b", 1), (None, "n", 1), (5, "a", 1), (-3, None, 1), (9, "long " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(3)
    index = with_starts(write_records(df, BYTES, 2, 50_257, folder=str(tmp_path)))
    got = read_records(index.orderBy(F.rand(1))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -3, 5, 5, 9]
    sizes = [len(r.ids) // 4 for r in got]
    assert [r.start for r in got] == [0, *np.cumsum(sizes)[:-1].tolist()] and sizes[-1] > 100_000
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 2 for r in got)
    one = read_records(index.where("n > 1000")).collect()
    assert [r.doc_id for r in one] == [9]
    empty = with_starts(write_records(df.limit(0), BYTES, 2, 50_257, folder=str(tmp_path)))
    assert read_records(empty).collect() == []


def test_other_white_space_does_not_cut_line_ends_apart():
    texts = ["a\tb\tc\n\n", "10\u00a0km est loin.\n\n\nvoici 20\u00a0km", "name\tvalue\n\n\nx\ty", "a\r\nb  c", " a\tb", "a\u2028b  ", "\n", "a b\nc"]
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in BYTES()(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bare_paths_are_qualified_and_repeats_spread(spark, tmp_path):
    from quantloom.llm.records import _place, _qualified

    assert _qualified(spark, "file:/a/b") == "file:/a/b" and _qualified(spark, "s3a://x/y") == "s3a://x/y"
    assert _qualified(spark, "/a/b") == "file:///a/b"
    assert _place("file:///tmp/z")[1] == "/tmp/z"
    same = spark.createDataFrame([(7, "same text")] * 4000, "doc_id bigint, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny parts would be merged
    try:
        index = with_starts(write_records(same, BYTES, 2, 50_257, folder=str(tmp_path)))
        assert index.select("shard").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = read_records(index).collect()
    size = len(got[0].ids) // 4
    assert len(got) == 4000 and {len(r.ids) // 4 for r in got} == {size}
    assert sorted(r.start for r in got) == [size * i for i in range(4000)]

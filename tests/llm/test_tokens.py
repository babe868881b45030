import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm._common import BYTES_CONF
from brindle.llm.packing import TierPacker, pack_documents
from brindle.llm.token_bytes import encoder
from brindle.llm.token_orc import document_starts, read_tokens, with_checksum, write_tokens

plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
literal = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
literal.encode_special_tokens = True
ODD = [None, "", " ", "  a", "a  b", "a \n b", "it's we'll", "x  y", "Ünï cöde ½ ²3 　 x", "\x1c a \x1d", "a\tb c\r\nd", "<|endoftext|> x", "日本語 テキスト, naïve.", "Éa! ñandú; ok: x? Ⅷ Ⅷ, ǅ ª.", "😀 a😀b", "w" * 5000, "x \0abc", "\0abc", "été,##!! ab×, (a), b', c.", "a.\nb, c\n\nd\n e\n", "\n", "\nb", "a\n\u00a0b", "é\né ×\n÷", "x<|endoftext|>y", "a\n's b\n1 2\n*"]


def ids_of(text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_the_library():
    got = list(encoder().encode_all(ODD))
    for text, data in zip(ODD, got, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == ids_of(text), text


def test_special_strings_may_be_text():
    got = list(encoder(specials_as_text=True).encode_all(ODD))
    for text, data in zip(ODD, got, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == literal.encode(text or "", add_special_tokens=False).ids, text
    assert np.frombuffer(next(encoder().encode_all(["<|endoftext|> x"])), "<u4").tolist() == [50256, 2124]


def test_another_kind_of_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    for text, data in zip(ODD, encoder(path).encode_all(ODD), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == other.encode(text or "", add_special_tokens=False).ids, text


def test_same_ids_for_a_text_of_some_megabytes():
    text = "\n".join(f"Line {k}, with some wörds; and a  gap (twice)." for k in range(60_000))
    (data,) = encoder().encode_all([text])
    assert np.frombuffer(data, "<u4").tolist() == ids_of(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n.,'sab½é \x1c 日1", max_size=30), max_size=6))
def test_same_ids_for_any_text(texts):
    for text, data in zip(texts, encoder().encode_all(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == ids_of(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_packer_places_every_token_once(lengths):
    packer = TierPacker()
    for k, n in enumerate(lengths):
        packer.add((k, 0, n, bytes(4 * n)))
    windows = [*packer.windows(), *packer.rest()]
    seen = defaultdict(list)
    for size, pieces in windows:
        assert sum(p[2] for p in pieces) == size and size & (size - 1) == 0 and size <= 1024
        for doc, start, n, ids in pieces:
            assert len(ids) == 4 * n
            seen[doc].append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == n


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "src", k) for k, t in enumerate(ODD)] + [(3, "again", "src", 1), (None, "no id", None, 2)]
    rows += [(100 + k, "some words that go on " * (k * 7), "s", 0) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length long")


def test_pack_round_trip(docs):
    pieces = pack_documents(docs).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length, p.window))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2]
    by = defaultdict(dict)
    for p in pieces:
        if p.doc_id is not None and p.doc_id != 3:
            assert p.start not in by[p.doc_id]
            by[p.doc_id][p.start] = bytes(p.token_bytes)
    for row in docs.collect():
        if row.doc_id is not None and row.doc_id != 3:
            whole = b"".join(x for _, x in sorted(by[row.doc_id].items()))
            assert np.frombuffer(whole, "<u4").tolist() == [*ids_of(row.text), 0]


def test_pack_empty(spark, docs):
    assert pack_documents(docs.limit(0)).count() == 0


def test_orc_round_trip(spark, docs, tmp_path):
    write_tokens(docs, f"{tmp_path}/t")
    rows = document_starts(read_tokens(spark, f"{tmp_path}/t"))
    got = {(r.doc_id, r.start): r for r in rows.collect()}
    start = 0
    expect = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [k[0] for k in sorted(got, key=lambda k: k[1])] == [k for k, _ in expect]
    for (key, at), row in sorted(got.items(), key=lambda x: x[0][1]):
        assert at == start
        start += row.n_tokens
        assert list(row.ids) in [[*ids_of(t), 0] for k, t in expect if k == key]
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in with_checksum(rows, "doc_id", "start").collect()}
    assert crc == {k: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for k, r in got.items()}
    assert {r.doc_id for r in read_tokens(spark, f"{tmp_path}/t", [105, 7]).collect()} == {7, 105}


def test_orc_empty(spark, docs, tmp_path):
    write_tokens(docs.limit(0), f"{tmp_path}/t")
    assert document_starts(spark.read.schema("doc_id long, shard int, shard_start long, n_tokens long, ids array<int>").orc(f"{tmp_path}/t")).count() == 0


def rows_scanned(df):
    """Rows that the scan of a plan without a shuffle gave, after stripes and row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_orc_skips_by_metadata(spark, tmp_path):
    even = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"))
    write_tokens(even, f"{tmp_path}/t", shards=2, row_index_stride=1000)
    assert len(list((tmp_path / "t").glob("*.orc"))) == 2
    assert rows_scanned(read_tokens(spark, f"{tmp_path}/t")) == 20_000
    # Row indexes leave the row groups that can hold the id, Bloom filters drop those that do not.
    assert rows_scanned(read_tokens(spark, f"{tmp_path}/t", [12_346])) <= 2000
    absent = sum(rows_scanned(read_tokens(spark, f"{tmp_path}/t", [k])) == 0 for k in range(10_001, 10_021, 2))
    assert absent >= 8
    assert [r.doc_id for r in read_tokens(spark, f"{tmp_path}/t", [12_346]).collect()] == [12_346]


def test_orc_one_id_in_many_rows(spark, tmp_path):
    before = spark.conf.get(BYTES_CONF)
    same = spark.range(4000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    write_tokens(same, f"{tmp_path}/t", shards=4)
    assert spark.conf.get(BYTES_CONF) == before
    rows = document_starts(read_tokens(spark, f"{tmp_path}/t"))
    assert rows.select("shard").distinct().count() > 1
    starts = sorted((r.start, r.n_tokens) for r in rows.collect())
    assert len(starts) == 4000 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))

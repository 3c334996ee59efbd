"""Token shards: Elias-Fano sequences, ids of whole texts, round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faresight.llm import token_ids
from tests.conftest import SMOKE
from tests.llm.conftest import odd_texts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_ids.vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 300)), max_size=60), st.sampled_from([1, 7, 1000]))
def test_elias_fano_holds_any_sequence(values, times):
    values = sorted(values * times)
    e = token_ids.EliasFano.from_bytes(token_ids.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    at = np.arange(len(values))[::-1]
    assert e[at].tolist() == values[::-1]


def test_elias_fano_space_and_bounds():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000)).astype(np.uint64)
    e = token_ids.EliasFano.encode(values)
    assert (e[np.array([0, 99_999, 5])] == values[[0, 99_999, 5]]).all()
    bits = 8 * len(e.to_bytes()) / len(values)
    assert bits < 2 + np.log2(values[-1] / len(values)) + 0.25 and e.ranks.dtype == np.uint32
    for i in (-1, 100_000):
        with pytest.raises(IndexError):
            e[i]


def test_ids_are_those_of_whole_texts(tokenizer):
    """Words apart give the whole text's ids: normalization, combining
    marks, odd white space, special tokens, and a cache that is emptied."""
    r = random.Random(3)
    marks = "aA'sStT 1\t\n\r\x0b\x0c\x85\xa0  ẹ́́日😀.,-_\x00ΣİǅŁ̸<|>"
    texts = ["".join(r.choice(marks) for _ in range(60)) for _ in range(1500)]
    texts += ["<|endoftext|> x<|startoftext|>y <|endoftext|>", "don't 's it's I'LL", "a ̸= ≠", "ΑΣ ΣΑΣ. ﬁ", None, ""]
    texts += [t for _, t, *_ in odd_texts()]
    enc = token_ids.Encoder(open(token_ids.vocabulary_path(), encoding="utf-8").read())
    for a in range(0, len(texts), 300):
        ids, size = enc(pa.array(texts[a:a + 300]))
        for t, own in zip(texts[a:a + 300], np.split(ids, np.cumsum(size)[:-1])):
            assert own.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
        if a == 600:
            enc.forget()


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    """Words are cut between letters, digits and marks, and share their pieces;
    the ids stay those of the whole text."""
    model = open(token_ids.vocabulary_path(), encoding="utf-8").read()
    enc = token_ids.Encoder(model)
    enc(pa.array(["Word, word WORD. (word) 'word' été. 7word", None, "WORD"]))
    assert set(enc.known) == {b"word", b",", b".", b"(", b")", b"'word", b"'", "été".encode(), b"7"}
    r = random.Random(11)
    marks = ["'", "'s", "'LL", "'Re", "s", "S", "ll", "D", "é", "É", "ß", "×", "÷", "Σ", "日", "。", "\u0338", "\u0301", "\u212a", "İ", "1", "٣",
             ".", ",", "=", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x00", "\x0b", "\x7f", "\xa0", " ", " ", "\n", "abc", "A"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 40))) for _ in range(6000)]
    ids, size = enc(pa.array(texts))
    for t, own in zip(texts, np.split(ids, np.cumsum(size)[:-1])):
        assert own.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_only_known_forms_are_cut():
    """Another split or normalization, or a special token that cuts would part: words stay whole."""
    import json
    model = json.load(open(token_ids.vocabulary_path(), encoding="utf-8"))
    model["model"] = {}
    assert token_ids.Cutter.of(json.dumps(model))
    special = {**model["added_tokens"][0], "content": "PAD"}
    for other in ({"normalizer": None}, {"pre_tokenizer": None}, {"added_tokens": [special]}, {"added_tokens": [{**special, "content": "a1<"}]}):
        assert token_ids.Cutter.of(json.dumps({**model, **other})) is None


def test_marks_between_words(tokenizer, monkeypatch):
    """Plain words need no places of ids; words that give the mark's id do."""
    model = open(token_ids.vocabulary_path(), encoding="utf-8").read()
    words = [f"w{i}x." for i in range(150)]
    odd = [*words[:70], "|", "||", "a|b", "x|", "|y", *words[70:]]
    for vocabulary_has_mark in (True, False):
        enc = token_ids.Encoder(model)
        if not vocabulary_has_mark:
            enc.mark = -1
        for some in (words, odd, words[:1], odd[70:71]):
            ids, size = enc._tokenize(some)
            got = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
            assert got == [tokenizer.encode(w, add_special_tokens=False).ids for w in some]
    enc = token_ids.Encoder(model)
    monkeypatch.setattr(enc, "_by_place", None)
    assert len(enc._tokenize(words)[1]) == 150


def test_batches_are_encoded_together(spark, tokenizer, monkeypatch):
    """Small Arrow batches are gathered up to a size; the rows are the same."""
    docs = spark.createDataFrame([(i, f"doc {i} |" * (i % 9)) for i in range(3000)], "doc_id long, text string").coalesce(1)
    got = {}
    for limit in (1, 20_000, 4 << 20):
        monkeypatch.setattr(token_ids, "TEXT_BYTES", limit)
        got[limit] = {r["doc_id"]: bytes(r["ids"]) for r in token_ids.encode(docs, token_ids.vocabulary_path()).collect()}
    assert len(got[1]) == 3000 and got[1] == got[20_000] == got[4 << 20]
    assert np.frombuffer(got[1][8], "<u2").tolist() == tokenizer.encode("doc 8 |" * 8, add_special_tokens=False).ids + [1]


def expected(tokenizer, rows):
    """(doc_id, start, n, crc) of rows in ascending id order, nulls last."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def read(spark, folder):
    rows = token_ids.read_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: r[1])


def test_smoke_table(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    got = token_ids.op13_token_ids(spark, SMOKE).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected(tokenizer, rows))


@pytest.mark.parametrize("shard_ids, range_bytes", [(1, 1), (50, 700), (1 << 25, None)])
def test_odd_rows(spark, tokenizer, odd_docs, no_docs, tmp_path, shard_ids, range_bytes):
    folder = str(tmp_path / "t")
    manifest = token_ids.write_shards(odd_docs, folder, shard_ids=shard_ids, range_bytes=range_bytes).orderBy("number").collect()
    got, want = read(spark, folder), expected(tokenizer, [(r[0], r[1]) for r in odd_texts()])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((r[0], r[2], r[3]) for r in want if r[0] is not None)
    ends = [r[1] + r[2] for r in got]
    assert [r[1] for r in got] == [0, *ends[:-1]]                     # each where the one before ends
    assert sum(m["ids"] for m in manifest) == ends[-1] and [m["number"] for m in manifest] == list(range(len(manifest)))
    names = {f.base_name for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(folder)) if f.base_name != "manifest"}
    assert names == {m["name"] for m in manifest}                     # no temporary ones are left
    token_ids.write_shards(no_docs, str(tmp_path / "none"))
    assert token_ids.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_hot_id_is_split(spark, tmp_path):
    docs = spark.createDataFrame([(7, "same text here")] * 300 + [(i, "x") for i in range(-5, 5)], "doc_id long, text string")
    manifest = token_ids.write_shards(docs.repartition(6), str(tmp_path / "t"), shard_ids=100, range_bytes=40).collect()
    assert len(manifest) > 5 and max(m["ids"] for m in manifest) < 110
    got = read(spark, str(tmp_path / "t"))
    assert [r[0] for r in got] == [*range(-5, 5), *[7] * 300] and [r[1] for r in got[:11]] == list(range(0, 22, 2))


def test_one_document_of_a_shard(spark, tmp_path, tokenizer):
    """Random access reads a document without those before it."""
    docs = [(i, f"text number {i} " * (i % 7)) for i in range(200)]
    token_ids.write_shards(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "t"))
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "t" / "tokens-00000000.bin")) as f:
        shard = token_ids.Shard(f)
        ids, _ = shard.documents(123, 124)
        assert ids.dtype == np.uint16 and shard.doc_ids(123, 124) == [123]
        assert ids.tolist() == tokenizer.encode(docs[123][1], add_special_tokens=False).ids + [1]


def test_same_files_whatever_the_partitioning(spark, tmp_path):
    docs = spark.createDataFrame([(i % 60, f"text number {i} " * (i % 5)) for i in range(100)], "doc_id long, text string")
    for name, n in (("a", 2), ("b", 7)):
        token_ids.write_shards(docs.repartition(n), str(tmp_path / name), shard_ids=90, range_bytes=300)
    files = [{p.name: p.read_bytes() for p in (tmp_path / name).glob("*.bin")} for name in "ab"]
    assert len(files[0]) > 5 and files[0] == files[1]

"""Perfect hash, byte-level BPE (10) and the token store (1)."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bizlens.llm.byte_bpe import ByteBPE, encoded, load_bpe, read_ranks
from bizlens.llm.common import mix64
from bizlens.llm.perfect_hash import PerfectHash, fingerprint
from bizlens.llm.pretokens import parts
from bizlens.llm.token_store import WholeTexts, stored_documents, write_store
from tests.llm.conftest import hard_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\xa0", "　", "a", "é", "漢", "1", "²", "🙂", ".",
          "!!", "\x1c", "\x85", "l", "'S", "_", "​", "́", "word", "\r\n"]


@pytest.fixture(scope="module")
def reference_encoder():
    ranks = {e: i for i, e in enumerate(read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50000])
def test_perfect_hash_is_minimal_and_survives_a_round_trip(n):
    keys = mix64(np.arange(n, dtype=np.uint64))
    ph = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(ph.slots(keys).tolist()) == list(range(n))
    absent = mix64(np.arange(n, n + 1000, dtype=np.uint64))
    slot = ph.slots(absent)
    prints = np.zeros(max(n, 1), np.uint32)
    prints[ph.slots(keys)] = fingerprint(keys)
    assert not ((slot >= 0) & (prints[slot] == fingerprint(absent))).any()


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1], np.uint64))


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=6))
def test_bpe_equals_tiktoken(reference_encoder, texts):
    bpe = load_bpe(RANKS)
    got = list(bpe.encode(texts))
    assert [x.tolist() for x in got] == [reference_encoder.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x) for x in got] == [t.encode() for t in texts]


def test_long_texts_are_cut_between_pre_tokens():
    text = "".join(random.Random(5).choices(PIECES, k=60000))
    cut = [t for _, t in parts([text], limit=1000)]
    assert "".join(cut) == text and len(cut) > 20
    assert [x for t in cut for x in regex.findall(public_tokenizers.PATTERN, t)] == regex.findall(public_tokenizers.PATTERN, text)


def test_small_memo_gives_the_same_ids():
    bpe = ByteBPE(read_ranks(RANKS))
    bpe.encoder.memo_limit = 3
    texts = [f"some words {i} here" for i in range(300)]
    assert [x.tolist() for x in bpe.encode(texts)] == [x.tolist() for x in load_bpe(RANKS).encode(texts)]


def test_encoded_rows(spark, hard, empty, reference_encoder):
    got = encoded(hard, RANKS).collect()
    assert len(got) == len(hard_rows())
    want = sorted((str(r[0]), hashlib.sha256(np.array(reference_encoder.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in hard_rows())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert encoded(empty, RANKS).count() == 0


def test_token_store(spark, hard, empty):
    store = write_store(hard, JSON, end_id=2, vocab_size=50257)
    assert store.dtype == "<u2"
    found = store.locate(hard.select("doc_id"))
    rows = store.read_ids(found.unionByName(store.unkeyed)).collect()
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    want = sorted((str(r[0]), *(lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))(
        tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in hard_rows())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):       # gapless, and in ascending order of ids with nulls first
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert found.count() == len({r[0] for r in hard_rows() if r[0] is not None})
    assert store.locate(spark.range(10**6, 10**6 + 3000).toDF("doc_id")).count() == 0
    none = write_store(empty, JSON, end_id=2, vocab_size=50257)
    assert none.read_ids(none.locate(hard)).count() == 0


def test_wide_vocabularies_take_32_bits(spark, hard):
    store = write_store(hard.where("doc_id = 1"), JSON, end_id=70000, vocab_size=50257)
    assert store.dtype == "<u4"
    row = store.read_ids(store.locate(hard)).first()
    assert np.frombuffer(row.ids, "<u4")[-1] == 70000


END_TEXTS = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x\n <|endoftext|>\n\n 'll", "<|endoftext", "no token", "", None,
             "<|endoftext|>" + "word " * 300000 + "<|endoftext|> end", "a <|endoftext|>b"]


def test_stored_documents_are_the_librarys_encoding_of_whole_texts(spark, hard):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(END_TEXTS)], "doc_id long, text string")
    got = stored_documents(hard.select("doc_id", "text").unionByName(more), JSON, 2, 50257).collect()
    library = Tokenizer.from_file(JSON)
    assert library.encode(END_TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = sorted((str(i), *(lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))(
        library.encode(t or "", add_special_tokens=False).ids + [2]))
        for i, t in [r[:2] for r in hard_rows()] + [(100 + i, t) for i, t in enumerate(END_TEXTS)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}, None])
def test_added_tokens_of_other_files(tmp_path, flags):
    file = json.load(open(JSON))
    if flags is None:
        file["added_tokens"] = []
    else:
        file["added_tokens"] += [file["added_tokens"][0] | {"id": 50257, "content": "<|endoftext|>b"}]
        file["added_tokens"] = [t | flags for t in file["added_tokens"]]
    (tmp_path / "own.json").write_text(json.dumps(file))
    library = Tokenizer.from_file(str(tmp_path / "own.json"))
    got = WholeTexts(str(tmp_path / "own.json")).encode(END_TEXTS)
    assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in END_TEXTS]

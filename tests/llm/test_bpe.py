import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tabforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "   ", "a" * 3000, "aaa aaaa  aaaaa\n\n\n b", "<|endoftext|>hi<|endoftext|>", "\x1c\x1d x　y\xa0z", "日本語のテキスト 😀😀", "it's we'LL they've", "\t\t  \n x   "]


def samples():
    random.seed(3)
    return ODD + ["".join(random.choice("ab c\n'sé1２  😀<|>") for _ in range(120)) for _ in range(300)]


def test_ids_and_text_as_the_library():
    own, lib = bpe.PairIndexBPE(PATH), Tokenizer.from_file(PATH)
    texts = samples()
    ids = own.encode_batch(texts)
    assert ids == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in ids] == [lib.decode(x, skip_special_tokens=False) for x in ids]


def test_memory_of_words_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own, lib = bpe.PairIndexBPE(PATH), Tokenizer.from_file(PATH)
    for t in ODD:
        assert own.encode_batch([t])[0] == lib.encode(t, add_special_tokens=False).ids


def test_decode_of_broken_bytes():
    own, lib = bpe.PairIndexBPE(PATH), Tokenizer.from_file(PATH)
    broken = lib.encode("é😀", add_special_tokens=False).ids[1:]
    assert own.decode(broken) == lib.decode(broken, skip_special_tokens=False)


def test_frames(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH)
    assert out.columns == ["doc_id", "ids"]
    back = bpe.decode(out, PATH)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == [(0, ""), (1, "hello world"), (1, "hello world"), (2, "")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.round_trip(df, PATH).collect()}
    ids = Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids
    assert (1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) in got and len(got) == 3
    assert bpe.round_trip(df.limit(0), PATH).count() == 0

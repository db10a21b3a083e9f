import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabforge.llm import token_counts

PATH, END = public_tokenizers.path("byte_bpe_50k.json"), 50256


@pytest.mark.parametrize("width,block", [(2, 16), (4, 8), (2, 1 << 20)])
def test_scan_against_brute_force(spark, tmp_path, width, block):
    random.seed(block)
    want = []
    for f in range(4):
        docs = [[random.randrange(50256) for _ in range(random.choice([0, 0, 1, 3, 40]))] for _ in range(30 if f else 0)]
        flat = [x for d in docs for x in [*d, END]] + [7] * (f == 2) * 25
        (tmp_path / f"part-{f}").write_bytes(np.array(flat, f"<u{width}").tobytes())
        want += [(f, i, len(d), True) for i, d in enumerate(docs)] + [(f, len(docs), 25, False)] * (f == 2)
    got = token_counts.count_tokens(spark, f"file://{tmp_path}", END, width, block).collect()
    assert sorted((int(r.file[-1]), r.ordinal, r.n_tokens, r.closed) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.file].append((r.ordinal, r.start, r.n_tokens))
    for v in by.values():
        v.sort()
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(v, v[1:], strict=False))


def test_writer_and_scan(spark, tmp_path):
    texts = ["hello world", None, "", "hello world", "é😀 \n" * 50, "Ä" * 9]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    token_counts.write_flat(df, f"file://{tmp_path}/a", PATH, END)
    got = token_counts.count_tokens(spark, f"file://{tmp_path}/a", END, block_bytes=8)
    lib = Tokenizer.from_file(PATH)
    assert Counter(r.n_tokens for r in got.collect()) == Counter(len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts)
    token_counts.write_flat(df.limit(0), f"file://{tmp_path}/b", PATH, END)
    assert token_counts.count_tokens(spark, f"file://{tmp_path}/b", END).count() == 0


def test_one_large_file_is_cut_into_blocks_and_narrow_ids_are_refused(spark, tmp_path):
    random.seed(3)
    sizes = [random.choice([0, 1, 5, 30_000]) for _ in range(60)]
    (tmp_path / "part-0").write_bytes(np.concatenate([np.r_[np.full(n, 9), END] for n in sizes]).astype("<u2").tobytes())
    cut = token_counts.blocks(spark, f"file://{tmp_path}", 4096)
    assert cut.count() > 100 and max(len(r.bytes) for r in cut.select("bytes").collect()) == 4096
    got = token_counts.count_tokens(spark, f"file://{tmp_path}", END, block_bytes=4096).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == sizes
    with pytest.raises(ValueError):
        token_counts.write_flat(spark.createDataFrame([("a",)], "text string"), f"file://{tmp_path}/x", PATH, END, width=1)

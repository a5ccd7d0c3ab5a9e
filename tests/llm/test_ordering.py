import numpy as np
import pytest

from cellcube.llm import ordering


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_walk_is_a_permutation_with_an_inverse(n):
    half = ordering._half_bits(n)
    x = np.arange(n, dtype=np.uint64)
    slots = ordering.walk(x.copy(), n, half, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert (ordering.walk(slots.copy(), n, half, 7, back=True) == x).all()
    if n > 100:
        assert (slots != ordering.walk(x.copy(), n, half, 8)).any() and abs(np.corrcoef(slots, x)[0, 1]) < 0.2


def test_shards_hold_the_whole_stream(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = ordering.materialise(docs, length=64, stride=16).toPandas()
    n = len(out)
    assert sorted(out.slot) == sorted(out.sequence) == list(range(n))
    assert (out.shard == out.slot // 16).all() and (out.tokens.map(len) == 256).all()
    ids = [i for t, k in zip(out.sort_values("sequence").tokens, out.sort_values("sequence").n_tokens) for i in np.frombuffer(t, "<u4")[:k]]
    want = [coder.encode(t or "", add_special_tokens=False).ids + [1] for _, t, *_ in rows]
    assert len(ids) == sum(map(len, want))
    cut = lambda xs: sorted(tuple(p) for p in xs)
    docs_back, one = [], []
    for i in ids:
        one.append(int(i))
        if i == 1:
            docs_back.append(one)
            one = []
    assert cut(docs_back) == cut(want)


def test_same_key_same_order_and_resume(docs):
    a = ordering.materialise(docs, length=64, stride=16)
    b = ordering.materialise(docs, length=64, stride=16)
    assert a.orderBy("slot").select("slot", "n_tokens").collect() == b.orderBy("slot").select("slot", "n_tokens").collect()
    assert ordering.resume(a, 20).count() == a.count() - 20


def test_empty(none):
    assert ordering.digest(none).count() == 0

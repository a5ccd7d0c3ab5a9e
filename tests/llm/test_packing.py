import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellcube.llm import packing
from cellcube.llm.tokens import document_ids


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_every_id_lies_in_one_piece(docs, rows, coder):
    out = packing.pack(docs).toPandas()
    want = sorted((-1 if i is None else i, zlib.crc32(np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
                  for i, t, *_ in rows if len(t or "") < 2000)
    small = out[out.doc_tokens <= 2048]
    got = sorted((-1 if np.isnan(i) else int(i), c) for i, c, n in zip(small.doc_id, small.ids_crc32, small.doc_tokens) if n < 2048)
    assert [x for x in got if x in set(want)] == want
    big = out[out.doc_id == 203].sort_values("start")
    ids = coder.encode(next(t for i, t, *_ in rows if i == 203), add_special_tokens=False).ids + [1]
    assert list(big.start) == list(range(0, len(ids), 2048)) and big.length.sum() == len(ids)
    for r in big.itertuples():
        assert zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    by = out.sort_values(["sequence_id", "offset"])
    assert (by.offset == by.groupby("sequence_id").length.cumsum() - by.length).all()
    assert by.groupby("sequence_id").length.sum().max() <= 2048
    assert len(out) == len(rows) - 1 + len(big)


def test_patterns_hold_all_and_come_near_the_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(rng.integers(1, 257, 20_000), minlength=257)[1:]
    found = packing.patterns(demand, 256)
    assert (sum(n * p for p, n in found) == demand).all()
    assert all((p * np.arange(1, 257)).sum() <= 256 for p, _ in found)
    bound = (demand * np.arange(1, 257)).sum() / 256
    assert sum(n for _, n in found) <= 1.01 * bound + 40


@pytest.mark.parametrize("demand", [[0] * 8, [3] + [0] * 7, [0] * 7 + [5], [1] * 8])
def test_small_demands(demand):
    found = packing.patterns(np.array(demand), 8)
    assert (sum((n * p for p, n in found), np.zeros(8, int)) == demand).all()


def test_knapsack_matches_brute_force():
    value = np.array([0.1, 0.35, 0.4, 0.9])
    best = max(a * .1 + b * .35 + c * .4 + d * .9 for a in range(8) for b in range(4) for c in range(3) for d in range(2) if a + 2 * b + 3 * c + 4 * d <= 7)
    total, counts = packing.knapsack(value, 7)
    assert total == pytest.approx(best) and (counts * np.arange(1, 5)).sum() <= 7


def test_word_ids_are_the_tokenizers(coder):

    texts = ["Don't stop.Now it's 3.5% 'quoted' \"x\" a b ́c É!! naïve... ß### THE!!! 12ab, x's! I'LL--", None, "", " \t\n", "a", " b \x0b c\x0c\x1c d",
             "<|endoftext|> x<|ENDOFTEXT|>y, <|startoftext|>", "İstanbul K ſ", "the. the, THE; (the)"]
    ids, sizes = document_ids(pa.array(texts), packing.TOKENIZER)
    ends = np.cumsum(sizes)
    for t, n, e in zip(texts, sizes, ends):
        assert ids[e - n:e].tolist() == coder.encode(t or "", add_special_tokens=False).ids


def test_empty(none):
    assert packing.pack(none).count() == 0


def test_kept_words_are_bounded_and_exact(coder, monkeypatch):
    from cellcube.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN_BYTES", 4_000)
    monkeypatch.setattr(tokens, "_known", {})
    batches = [[" ".join(f"Word{i}x{j}, plain{j}. {'y' * 30}{i} {'y' * 30}{i + 1}" for j in range(6))] * 2 + ["", None, "a.", "..."] for i in range(30)]
    for texts in batches + batches:
        ids, sizes = tokens.document_ids(pa.array(texts), packing.TOKENIZER)
        want = [coder.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
    known = tokens._known[packing.TOKENIZER]
    assert 0 < known.words.nbytes + known.ids.nbytes + 12 * len(known.hashes) <= 4_000
    # two words of one hash (length, first and last bytes): both come out right
    pair = ["a" * 8 + "1" * 8 + "b" * 8, "a" * 8 + "2" * 8 + "b" * 8]
    assert len(set(tokens._hashes(pa.array(pair, pa.large_string())).tolist())) == 1
    for _ in range(2):
        ids, _ = tokens.document_ids(pa.array(pair), packing.TOKENIZER)
        assert ids.tolist() == [i for t in pair for i in coder.encode(t, add_special_tokens=False).ids]

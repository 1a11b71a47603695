import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skeinrank.llm import arrowtext as at
from skeinrank.llm import packing

from corpora import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer):
    r = random.Random(1)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "b's", "'s", "''s", " 's", "we'll", "it'", "'ll x", "don't", "'re", "'rex", "'r", "é", "ß", "12", "3.5", "²", "!!", "—", "<|endoftext|>", "日本", "'", "\r\n", "🙂", " ", "x_y", "’s", "it's've", "İ", " "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(2500)] + ["", None, "a" * 3000, " " * 500]
    raw, off = at.utf8(at.strings(pa.array(texts, pa.string())))
    got = [x for a, b in at.slices(off) for x in packing.encoder(PATH).texts(raw[off[a] : off[b]], off[a : b + 1] - off[a])]
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_memory_of_pieces_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encode = packing.Encoder(PATH)
    for k in range(6):
        text = " ".join(f"word{k * 7 + j}" for j in range(7))
        raw, off = at.utf8(at.strings(pa.array([text])))
        assert encode.texts(raw, off)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_sequences(spark, tokenizer):
    rows = documents(9) + [(900, "word " * 9000)]
    rows.append((3, "again the same id"))
    got = packing.pack(frame(spark, rows), PATH).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sum(map(len, ids.values())) == len(by_doc)
    for (i, n), parts in by_doc.items():
        want, at_ = next(x for x in ids[i] if len(x) == n), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            piece = np.array(want[at_ : at_ + r["length"]], "<u4").tobytes()
            assert r["start"] == at_ and r["ids_crc32"] == zlib.crc32(piece)
            at_ += r["length"]
        assert at_ == n
    for parts in by_sequence.values():
        at_ = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at_
            at_ += r["length"]
        assert at_ <= packing.CAPACITY
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= 1 + 1.05 * total / packing.CAPACITY
    assert packing.pack(frame(spark, rows).where("false"), PATH).count() == 0


def test_knapsack_is_exact():
    r = random.Random(2)
    for _ in range(40):
        capacity = r.randrange(5, 30)
        sizes = np.array(sorted(r.sample(range(1, capacity + 1), r.randrange(1, 5))))
        values = np.array([r.random() for _ in sizes])
        best, counts = packing.best_pattern(values, sizes, capacity)
        top = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            top[c] = max([top[c - 1], *(top[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c)])
        assert best == pytest.approx(top[capacity]) and (counts * sizes).sum() <= capacity and (counts * values).sum() == pytest.approx(best)


@pytest.mark.parametrize("n", [1, 7, 300, 20_000])
def test_patterns_cover_the_histogram(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(4.5, 1, n).astype(int), 1, 512)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    patterns = packing.patterns_for(histogram, 512)
    covered = {}
    for counts, times in patterns:
        assert sum(s * c for s, c in counts.items()) <= 512 and times > 0
        for s, c in counts.items():
            covered[s] = covered.get(s, 0) + c * times
    assert covered == histogram
    bound = sum(s * c for s, c in histogram.items()) / 512
    assert sum(t for _, t in patterns) <= bound * (1.01 if n > 10_000 else 1.05) + 1
    used = {}
    for size, lo, hi, _, _, _ in packing.slots(patterns):
        assert used.get(size, 0) == lo
        used[size] = hi
    assert used == histogram

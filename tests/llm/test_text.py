import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinrank.llm import arrowtext as at


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=12))
def test_word_spans_equal_regex(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    raw, off = at.utf8(at.strings(pa.array(texts, pa.string())))
    starts, ends, rows = at.word_spans(raw, off, at.SPACE)
    got = [[] for _ in texts]
    for s, e, r in zip(starts, ends, rows, strict=True):
        got[r].append(raw[s:e].tobytes().decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_slices_cover_rows_once(monkeypatch):
    monkeypatch.setattr(at, "SLICE_BYTES", 10)
    off = np.array([0, 0, 4, 30, 30, 35, 36])
    ranges = list(at.slices(off))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(6))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing_round_trip(values):
    a = np.array(values, dtype=np.uint64)
    assert (at.unpack(at.pack(a)) == a).all()
    a.sort()
    assert (at.unpack_sorted(at.pack_sorted(a)) == a).all()
    blobs = [at.pack(a), b"", b"x"]
    assert at.split_blobs(at.join_blobs(blobs)) == blobs


def test_hashes_depend_on_words_alone():
    h = at.WordHash(1)
    def of(text):
        raw, off = at.utf8(at.strings(pa.array([text])))
        s, e, _ = at.word_spans(raw, off, at.SPACE)
        return h.words(raw, s, e)
    assert (of("aa b  ccc") == of(" aa\tb\nccc")).all() and len(set(of("a aa aaa ab ba b").tolist())) == 6
    w = of("a b c a b c")
    g = h.windows(w, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 3


def test_group_is_sparks(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    ids = [0, 1, -1, 2**62, -(2**63), *(r.randrange(-(2**63), 2**63) for _ in range(50))]
    want = [x[0] for x in spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.hash("i"), F.lit(13))).collect()]
    assert at.group_of(np.array(ids, np.int64), 13).tolist() == want

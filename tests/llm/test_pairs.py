import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skeinrank.llm import arrowtext as at
from skeinrank.llm import decontamination, ngram_join, substring_dedup
from skeinrank.llm.components import components
from skeinrank.llm.workspace import Workspace

from corpora import documents, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = plain((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """(doc_id, size, component) of each row, sorted."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def linked(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    rows = documents(seed)
    assert linked(ngram_join.jaccard_components(frame(spark, rows))) == brute_components(rows)


@pytest.mark.parametrize("most", [64, 2])
def test_jaccard_of_rows_that_repeat_ids_or_have_none(spark, monkeypatch, most):
    """Each row is a document; n-grams are heavy from two documents on or seldom; the pipeline keeps one row of each component."""
    monkeypatch.setattr(ngram_join, "MOST_LIGHT", most)
    rows = documents(5, 25)
    rows += [(rows[0][0], rows[1][1]), (rows[0][0], rows[0][1]), (None, rows[1][1]), (None, None), (None, "only this one has these words"), (None, "only this one has these words"), (-5, rows[2][1])]
    df = frame(spark, rows).withColumn("row", F.lit(1)).withColumn("key", F.lit("k"))
    want = brute_components(rows)
    assert linked(ngram_join.jaccard_components(df)) == want
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((shingles(r["text"]) and str(sorted(shingles(r["text"]))), r["doc_id"]) for r in kept.collect() if shingles(r["text"]))
    assert len(got) == len({x for x, _ in got}) and {i for _, i in got} >= {c for _, n, c in want if n and c is not None}
    empty = [t for _, t in rows if not shingles(t)]
    assert sum(not shingles(r["text"]) for r in kept.collect()) == len(empty)


def test_jaccard_edge_cases(spark):
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (4, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in twice], "doc_id long, text string, n int, comp string, low int")
    assert linked(ngram_join.jaccard_components(docs)) == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (4, 0, 4)], key=repr)
    assert ngram_join.jaccard_components(docs.where("false")).count() == 0 == ngram_join.one_of_each(docs.where("false")).count()


def test_hub_groups_of_near_copies(spark):
    """A family of which members link only through some others, and many near misses that share a passage."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        w[k % 60] = f"x{k}"
        if k % 3 == 0:
            w[(k + 30) % 60] = f"y{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([*base[:40], *(f"o{k}_{j}" for j in range(14))])) for k in range(40)]
    assert linked(ngram_join.jaccard_components(frame(spark, rows))) == brute_components(rows)


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60), (None, 3), (71, 70), (70, 71)]
    df = spark.createDataFrame(edges, "a long, b long").where("a is not null")
    got = {r["v"]: r["component"] for r in components(Workspace(spark, "t"), df).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 51: 50, 52: 50, 71: 70}


def brute_dedup(rows, k=13):
    first = {}
    for i, t in rows:
        w = plain(t)
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = plain(t)
        gone = {j + x for j in range(len(w) - k + 1) if i is not None and first[tuple(w[j : j + k])] < i for x in range(k)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def removed(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    """Rows that repeat a doc_id, or have none, and columns of other names are each told their own."""
    rows = documents(seed)
    some = next(t for _, t in rows if t and len(t) > 2000)
    rows += [(None, some), (None, None), (None, "a b"), (rows[3][0], some), (rows[3][0], some), (-7, some)]
    df = frame(spark, rows).withColumn("key", F.lit("k")).withColumn("kept", F.lit(1)).withColumn("blob", F.lit(2))
    want = brute_dedup(rows)
    got = substring_dedup.dedup(df)
    assert removed(got) == want == removed(substring_dedup.dedup(df, batches=1)) == removed(substring_dedup.dedup(df, batches=4))
    assert got.where("aggregate(removed, 0L, (a, x) -> a + x[1] - x[0]) <> n_removed").count() == 0
    assert removed(substring_dedup.dedup(df, digest=True)) == sorted(((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want), key=repr)
    assert substring_dedup.dedup(frame(spark, rows).where("false")).count() == 0


def test_incremental_index_equals_one_pass(spark, tmp_path):
    """Batches in order of doc_id see what one pass sees; runs are compacted on the way, and the folder is enough to go on."""
    rows, path = sorted(documents(4, 25)), str(tmp_path / "index")
    got = []
    for n, part in enumerate((rows[:20], rows[20:30], rows[30:31], rows[31:50], rows[50:])):
        index = substring_dedup.FingerprintIndex(spark, path, fanout=2)
        result = removed(index.ingest(frame(spark, part), batch=f"b{n}"))
        assert removed(substring_dedup.FingerprintIndex(spark, path).ingest(frame(spark, part), batch=f"b{n}")) == result  # again: nothing is added
        got += result
        index.compact()
    assert sorted(got, key=repr) == brute_dedup(rows)
    assert len(index.levels) >= 3 and all(len(x) < 2 for x in index.levels) and len(index.content["batches"]) == 5
    live = {n for level in index.levels for n in level}
    assert live == {n.partition("=")[2] for n in index.folder.names("runs")}
    with pytest.raises(ValueError, match="compacted"):
        index.ingest(frame(spark, rows[:20]), batch="b0")
    plan = index.history().groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan  # history isn't shuffled


def test_range_keys_fill_their_buckets():
    for n in (1, 2, 7, 64, 1000):
        keys, below = at.range_keys(n), at.range_keys(n, True)
        for k in (keys, below):
            assert len(set(k.tolist())) == n and len(set(at.group_of(k, n).tolist())) >= 0.99 * n
        assert keys.min() >= 0 > below.max()


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(rows, items, k=10):
    out = []
    for i, t in rows:
        w, hit, found = bench_words(t), set(), []
        for item, text in items:
            x = bench_words(text)
            size = min(k, len(x))
            grams = {tuple(x[j : j + size]) for j in range(len(x) - size + 1)} if x else set()
            at = [j for j in range(len(w) - size + 1) if tuple(w[j : j + size]) in grams] if grams else []
            hit |= {j + y for j in at for y in range(size)}
            found += [item] if at else []
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [16_000_000, 600])
def test_decontamination(spark, monkeypatch, block):
    """Rows that repeat a doc_id, or have none, each have their own result, whatever the size of the benchmark."""
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rows = documents(6)
    long_ = next(t for _, t in rows if t and len(t) > 20_000).split()
    rows += [(None, None), (None, " ".join(long_[48:80])), (None, "one"), (rows[0][0], "nothing here"), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1])]
    same = "same same " * 40
    rows += [(900, same), (901, "same " * 9), (902, "x " + same)]
    items = [(1, " ".join(long_[50:75])), (2, " ".join(long_[60:68])), (3, "one"), (10, "One, TWO!"), (4, None), (5, "..."), (6, rows[0][1]), (7, " ".join(long_[3000:3030])), (8, " ".join(long_[3005:3016])),
             (11, " ".join(long_[52:62])), (12, "same " * 12), (None, " ".join(long_[10:30]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    order = lambda x: sorted(x, key=repr)
    got = [tuple(r) for r in decontamination.digest(decontamination.scan(frame(spark, rows), bench)).collect()]
    want = brute_hits(rows, items)
    assert order(got) == order(want)
    kept = [r["doc_id"] for r in decontamination.drop_contaminated(frame(spark, rows), bench).collect()]
    assert order(kept) == order([w[0] for w in want if not w[5]])
    assert decontamination.scan(frame(spark, rows), bench.where("false")).where("size(items) > 0").count() == 0
    assert decontamination.scan(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 7])
def test_other_windows(window):
    r = random.Random(window)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.choice((1, 2, 5, 9))))) for i in range(12)]
    matcher = decontamination.Matcher(items, window)
    for _ in range(60):
        text = " ".join(r.choice("abcd") for _ in range(30))
        ranges, found = matcher.match(decontamination.words_of(text))
        (_, _, n_hit, n_items, _, _), = brute_hits([(0, text)], items, window)
        assert (sum(b - a for a, b in ranges), len(found)) == (n_hit, n_items)


def test_spans_map_to_the_original(spark):
    text = "Ünïque (One, two; THREE four.  rest—x"
    bench = spark.createDataFrame([(1, "one TWO three")], "item_id long, text string")
    r = decontamination.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench, with_spans=True).first()
    (a, b), = r["spans"]
    assert text[a:b] == "One, two; THREE"

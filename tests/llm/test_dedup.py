"""Near-duplicate documents, repeated passages and lines, each against a plain brute force."""

import hashlib
import random

import pytest

from markloom.llm import fmindex, lines, minhash

SCHEMA = "doc_id long, text string, node long, component_id string, spans string, runs string, t string, kept string"


def frame(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    rows = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, x, 1, "a", "b", "c", "d", "e") for i, x in rows], SCHEMA)


def corpus(seed, copies=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    base, passage = text(120), text(70)
    out = {0: " ".join(base), 1: None, 2: "", 3: " \n\t ", 4: "one two", 5: "One TWO", 6: "x " * 300, 7: "\n".join(["same line here"] * 40)}
    for i in range(8, 8 + copies):
        edited = list(base)
        for _ in range(r.randrange(0, 6)):
            edited[r.randrange(len(edited))] = r.choice(words)
        out[i] = "  ".join(edited)
    for i in range(100, 110):
        out[i] = " ".join(text(r.randrange(60)) + passage + text(r.randrange(60)))
    for i in range(200, 230):
        out[i] = "\n".join(" ".join(text(r.randrange(1, 30))) for _ in range(r.randrange(1, 8)))
    out[300], out[301] = out[200], out[100]
    out[400] = " ".join(text(6000))
    out[401] = out[400] + " tail"
    return out


def exact_components(texts, percent):
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


@pytest.mark.parametrize(("seed", "tile"), [(1, 1 << 20), (2, 150)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(minhash, "TILE_SHINGLES", tile)
    texts = corpus(seed)
    got = minhash.near_duplicates(frame(spark, texts), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == exact_components(texts, 85)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(frame(spark, []).limit(0), 85).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")]
    got = minhash.near_duplicates(frame(spark, rows), 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    kept = minhash.keep_one(frame(spark, rows), 85)
    assert sorted((r.doc_id or 0, r.kept) for r in kept.collect()) == [(0, "e"), (1, "e")]
    assert kept.columns == frame(spark, rows).columns


def brute_windows(texts, span):
    first, out = {}, {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        gone, seen = [False] * len(w), []
        for k in range(len(w) - span + 1):
            key = tuple(w[k : k + span])
            seen.append(key)
            if first.get(key, i) < i:
                gone[k : k + span] = [True] * span
        for key in seen:
            first.setdefault(key, i)
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


@pytest.mark.parametrize(("span", "shard", "key"), [(50, 400_000, 2_000_000), (50, 300, 300), (50, 300, 10**6), (7, 100, 100)])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, span, shard, key):
    monkeypatch.setattr(fmindex, "SHARD_WORDS", shard)
    monkeypatch.setattr(fmindex, "KEY_WORDS", key)
    texts = corpus(3)
    got = fmindex.dedup_digest(frame(spark, texts), span).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_windows(texts, span)


def test_repeated_windows_of_odd_tables(spark):
    assert fmindex.dedup_digest(frame(spark, []).limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long + " end"), (3, "x\n" + long + "\ty z")]
    got = fmindex.dedup_digest(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 60), (3, 60)]
    text = {r.doc_id: r.text for r in fmindex.dedup_text(frame(spark, rows)).collect()}
    assert text == {1: long, 2: "end", 3: "x\ty z"}


def test_fm_index_counts_and_finds():
    import numpy as np

    r = np.random.default_rng(1)
    segments = [r.integers(1, 4, n).astype(np.uint64) for n in (5, 30, 12, 40)]
    index = fmindex.FMIndex(segments, np.array([7, 3, 9, 1]), 4)
    patterns = [r.integers(1, 5, 25).astype(np.uint64) for _ in range(30)]
    for p, found in zip(patterns, index.first_owners(patterns), strict=True):
        for k, f in enumerate(found):
            own = [o for s, o in zip(segments, (7, 3, 9, 1), strict=True) if any((s[a : a + 4] == p[k : k + 4]).all() for a in range(len(s) - 3))]
            assert f == min(own, default=-1)


def brute_lines(texts, least):
    first, out = {}, {}
    for i in sorted(texts):
        own = (texts[i] or "").split("\n")
        at = [k for k, x in enumerate(own) if x.encode().split()]
        gone = set()
        for k in range(len(at) - least + 1):
            key = tuple(own[j] for j in at[k : k + least])
            if key in first:
                gone |= set(at[k : k + least])
            first.setdefault(key, (i, k))
        left = "\n".join(x for k, x in enumerate(own) if k not in gone)
        out[i] = (len(at), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 4, 5])
def test_repeated_lines_equal_brute_force(spark, least):
    r = random.Random(least)
    texts = corpus(4) | {500 + i: "\n".join(r.choice(["a", "b", "", " ", "c d"]) for _ in range(r.randrange(30))) for i in range(30)}
    got = lines.dedup_digest(frame(spark, texts), least).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in got} == brute_lines(texts, least)


@pytest.mark.parametrize("names", [8, 100_000])
def test_long_and_periodic_runs(spark, monkeypatch, names):
    monkeypatch.setattr(lines, "PART_NAMES", names)
    r = random.Random(names)
    long = [f"line {r.randrange(40)}" for _ in range(70)]
    texts = {1: "\n".join(long), 2: "\n".join(["head", *long[3:66], "tail"]), 3: "\n".join(long), 4: "\n".join(["a b"] * 33), 5: "\n".join(["a b", "c"] * 19), 6: "\n".join(["c", "a b"] * 8), 7: "\n".join(["a b"] * 34)}
    got = lines.dedup_digest(frame(spark, texts), 3).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in got} == brute_lines(texts, 3)


def test_common_prefixes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "PART_NAMES", 10)
    r = random.Random(9)
    texts = {i: "\n".join(r.choice(["a", "b", "c d"]) for _ in range(r.randrange(1, 14))) for i in range(12)}
    places, splits, levels = lines.suffix_array(frame(spark, texts))
    lcp = {(x.a, x.b, x.r): x.lcp for x in lines.common_prefixes(splits, levels).collect()}
    rows = sorted(((x.a, x.b, x.r), texts[x.doc_id].split("\n")[x.o :]) for x in places.collect())
    assert len(rows) == sum(len(x.split("\n")) for x in texts.values())
    for (rank, x), (other, y) in zip(rows, rows[1:], strict=False):
        shared = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert x == y if rank == other else shared == lcp.get(other, 0)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a\nb", 5, "u", "v", "w"), (2, "x\na\nb", 6, "u", "v", "w")], "doc_id long, text string, __row int, __kept string, ___runs string, __cuts string")
    left = lines.dedup_text(rows, 2)
    assert left.columns == rows.columns
    assert sorted(map(tuple, left.collect())) == [(1, "a\nb", 5, "u", "v", "w"), (2, "x", 6, "u", "v", "w")]
    assert sorted(map(tuple, minhash.keep_one(rows, 80).collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, fmindex.dedup_text(rows, 2).collect())) == [(1, "a\nb", 5, "u", "v", "w"), (2, "x", 6, "u", "v", "w")]


def test_repeated_lines_of_odd_tables(spark):
    assert lines.dedup_digest(frame(spark, []).limit(0)).count() == 0
    rows = [(1, "a\nb\nx"), (1, "a\nb\nx"), (2, "q\na\nb"), (3, "a\nb"), (None, "a\nb"), (4, None)]
    left = lines.dedup_text(frame(spark, rows), 2)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "a\nb"), (1, "a\nb\nx"), (1, "a\nb\nx"), (2, "q"), (4, "")]
    runs = lines.maximal_runs(frame(spark, {1: "a\nb\nc\nd", 2: "z\na\nb\nc\nd"}), 2).collect()
    assert [(r.doc_id, r.start, r.lines) for r in runs] == [(2, 1, 4)]


def test_pipeline_cuts_single_repeated_lines(spark):
    import corpus_pipeline

    rows = [(1, "x\na b c\ny"), (2, "p\na b c\n\nq"), (3, "a b c"), (4, "only here")]
    left = corpus_pipeline.dedup_lines(spark, frame(spark, rows), "")
    assert {r.doc_id: r.text for r in left.collect()} == {1: "x\na b c\ny", 2: "p\n\nq", 4: "only here"}


def test_deletions_come_from_maximal_runs(spark, monkeypatch):
    found = []
    whole = lines.maximal_runs
    monkeypatch.setattr(lines, "maximal_runs", lambda *a: found.append(whole(*a)) or found[-1])
    left = lines.dedup_text(frame(spark, {1: "a\nb\nc\nd\ne", 2: "z\na\nb\nc\n\nd\ny\nb\nc"}), 2)
    assert {r.doc_id: r.text for r in left.collect()} == {1: "a\nb\nc\nd\ne", 2: "z\n\ny"}
    assert sorted((r.doc_id, r.start, r.lines) for r in found[0].collect()) == [(2, 1, 4), (2, 6, 2)]


def shuffled_bytes(df):
    """Runs df; the rows, and the bytes that its exchanges took in."""
    run = df._jdf.queryExecution()
    found = [list(r) for r in df.collect()]
    plans, size = [run.executedPlan()], 0
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        elif kind == "ShuffleExchangeExec":
            size += p.metrics().apply("dataSize").value()
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return found, size


def test_texts_without_later_copies_are_not_shuffled(spark):
    # no broadcast by size, as on a large table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = {i: "\n".join(f"{i} {k} a line of its own" for k in range(100)) for i in range(300)} | {400: "p\nq\nr", 401: "x\np\nq"}
        rows, size = shuffled_bytes(lines.dedup_digest(frame(spark, texts), 2))
        assert {i: tuple(x) for i, *x in rows} == brute_lines(texts, 2)
        assert size < 0.2 * sum(map(len, texts.values()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))


def test_driver_keeps_no_garbage_of_levels(spark, monkeypatch):
    # seven levels: the plans of the descent hold a level's names once, and no level leaves its garbage to the next
    whole, sizes, depth = lines.stored, [], []
    monkeypatch.setattr(lines, "common_prefixes", lambda s, n, f=lines.common_prefixes: depth.append(len(n)) or f(s, n))

    def noted(df, label, keep=False):
        if label in ("descent", "prefixes"):
            sizes.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return whole(df, label, keep)

    monkeypatch.setattr(lines, "stored", noted)
    long = [f"line {k}" for k in range(70)]
    texts = {1: "\n".join(long), 2: "\n".join(["head", *long[:66], "tail"]), 3: "\n".join(["x", *long[5:], "x", *long[:3]])}
    before = full_collections(spark)
    got = lines.dedup_digest(frame(spark, texts), 2).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in got} == brute_lines(texts, 2)
    assert depth == [7] and max(sizes) < 3 * depth[0]
    assert full_collections(spark) - before >= depth[0]


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_texts_apart_are_all_there(spark, monkeypatch, bits):
    monkeypatch.setattr(lines, "BITS", bits)
    rows = [(i, f"{i}\na\nb" if i % 9 == 0 else f"{i}\nc") for i in range(200)] + [(18, "18\na\nb"), (None, "a\nb"), (300, None), (300, "x\na\nb")]
    docs = frame(spark, rows)
    runs = lines.maximal_runs(docs, 2)
    some, others = ([(r.doc_id, r.text) for r in x.collect()] for x in lines.apart(docs, runs, "__"))
    assert sorted(map(str, some + others)) == sorted(map(str, rows))
    late = {r.doc_id for r in runs.collect()}
    assert late == {*range(9, 200, 9), 300}
    assert {r for r in rows if r[0] in late and r[1] and "a" in r[1]} <= set(some)
    assert bits == 64 or len(some) < 60


def test_native_operator_has_no_python(spark):
    plan = lines.dedup_digest(frame(spark, {1: "a\nb"}), 2)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan

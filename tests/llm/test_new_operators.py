"""Collocations, repeated strings and resampling against slow versions, on awkward rows; long texts of the line dedup; measured recall."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, linededup, neardup, packing, repeats, resampling, sharding, syncmers, toxicity

DDL = "doc_id long, text string, lang string, rank int, score string, `a.b` int"


def prose(rng, n):
    return "".join(rng.choice(["alpha", "Beta", "gamma", "naïve", "straße", "日本", "x1", "don't", "the", "of"]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "; "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    long = prose(rng, 6_000)
    texts = [None, "", " ", ".\n", "one", "The tie", "The tie", long, "word " * 2000, "ÀÉ straße-STRASSE x" * 3, "a" * 5000, "tab\tsep\x0bvt nbsp end"]
    texts += [prose(rng, 60) for _ in range(40)] + [long[100:900], "lead " + long[3000:4200] + " tail", long, "日本語のテキスト" * 30, "x" + "日本語のテキスト" * 29]
    out = [(i * 7 % 101 - 3, t, (None, "en", "de")[i % 3], 1, "own", i) for i, t in enumerate(texts)]
    return [*out, out[7], out[14], (None, texts[20], "en", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_collocations(rows, longest, least, covered, top):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        inside = defaultdict(int)
        for p, n in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], n)
        found = []
        for p, a in often.items():
            if inside[p] and 100 * inside[p] >= covered * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "covered", "top", "run_words", "parts"), [(3, 10, 50, 2000, 10**6, 8), (3, 3, 50, 2000, 40, 8), (4, 2, 80, 25, 700, 211), (2, 5, 50, 7, 5, 1)])
def test_collocations_by_hand(spark, docs, rows, partitions, longest, least, covered, top, run_words, parts):
    partitions(parts)
    got = collocations.collocations(docs, longest, least, covered, top, run_words=run_words, range_bytes=1 << 12)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, longest, least, covered, top)


def test_collocations_of_nothing(nothing, spark):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, ".", "en")], "doc_id long, text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    """Products of counts are exact: 10^12 occurrences squared, times a million."""
    n = 10**12 + 7
    cut = spark.createDataFrame([(n, n + 1, n + 2)], "a long, l long, r long")
    exact = lambda c: F.col(c).cast(collocations._COUNT)
    got = cut.withColumns({"top": F.lit(10**6).cast("decimal(7,0)") * (exact("a") * exact("a")), "under": exact("l") * exact("r")}).selectExpr("top div under AS s").first().s
    assert got == 10**6 * n * n // ((n + 1) * (n + 2))


def test_tries_follow_their_words():
    ids = np.array([1, 2, 3, 0, 1, 2, 0, 2, 3, 3])
    levels = [{tuple(int(c[i]) for c in columns): int(k) for i, k in enumerate(counts)} for columns, counts in collocations.tries(ids, 4, 3)]
    assert levels == [{(1,): 2, (2,): 3, (3,): 3}, {(1, 2): 2, (2, 3): 2, (3, 3): 1}, {(1, 2, 3): 1, (2, 3, 3): 1}]
    wide = [np.array([5, 1, 5, 1]), np.array([1 << 40, 2, 1 << 40, 3]), np.array([7, 7, 7, 7])]
    nodes, counts = collocations._nodes(wide, 1 << 41)
    assert [c.tolist() for c in nodes] == [[1, 1, 5], [2, 3, 1 << 40], [7, 7, 7]] and counts.tolist() == [1, 1, 2]


def slow_repeats(rows, window):
    key = lambda d: -(1 << 63) if d is None else d
    least = {}
    for doc, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            least[w] = min(least.get(w, key(doc)), key(doc))
    out = []
    for doc, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < key(doc):
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(gone[:-1], prepend=False, append=False)).reshape(-1, 2)
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((doc, len(b), int(gone.sum()), tuple(map(tuple, edges.tolist())), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "run_bytes", "range_bytes", "parts"), [(50, 5 << 20, 8 << 20, 8), (50, 700, 3000, 211), (20, 3000, 500, 8), (90, 1000, 1 << 20, 1)])
def test_repeats_by_hand(docs, rows, partitions, window, run_bytes, range_bytes, parts):
    partitions(parts)
    marked = repeats.mark_repeats(docs.withColumn("n_bytes", F.lit("old")), window, run_bytes=run_bytes, range_bytes=range_bytes)
    assert set(docs.columns) <= set(marked.columns) and len(marked.columns) == len(docs.columns) + 5
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.first, s.end) for s in r.spans), bytes(r.kept)) for r in marked.collect()), key=repr)
    assert got == slow_repeats(rows, window) and sum(r[2] for r in got) > 5000


def test_repeats_of_nothing(nothing, docs):
    assert repeats.mark_repeats(nothing).count() == 0
    with pytest.raises(ValueError, match="a window has"):
        repeats.mark_repeats(docs, 10)


def test_rows_in_another_order_are_found_out(tmp_path):
    class Elsewhere(repeats._Stored):
        def __init__(self, digest):
            self.at, self.data = {0: (digest, 0, 0)}, np.zeros(0, "u1")

    (run,) = repeats.cut_runs(iter([(1, b"x" * 80), (2, b"y" * 80)]), 50, 1 << 20)
    (other,) = repeats.cut_runs(iter([(2, b"y" * 80), (1, b"x" * 80)]), 50, 1 << 20)
    assert run.digest != other.digest
    with pytest.raises(RuntimeError, match="another order"):
        Elsewhere(other.digest).of(0, run, 5)


def test_every_pair_of_places_meets_in_the_cover():
    for a in range(repeats.PERIOD):
        for b in range(repeats.PERIOD):
            assert any((a + d) % repeats.PERIOD in repeats.COVER and (b + d) % repeats.PERIOD in repeats.COVER for d in range(repeats.PERIOD))


def test_names_are_those_of_the_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 200_000, "u1")
    for length in (8, 14, 24, 44, 100):
        at = np.sort(rng.choice(len(data) - 120, 70_000, replace=False))
        found = repeats.names(data, at, length)
        text = data.tobytes()
        strings = [text[i : i + length] for i in at.tolist()]
        assert len(set(zip(strings, found.tolist(), strict=True))) == len(set(strings)) == len(set(found.tolist()))


def slow_resample(rows, target, share, least, buckets):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = (Counter(bucket(w) for text in texts for w in words(text)) for texts in ([r[1] for r in rows], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((n + 1) * (nt + buckets)))) for b, n in s.items()}
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        weight = sum(gain[bucket(x)] for x in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): i for i, r in enumerate(fit[: share * len(fit) // 100], 1)}
    return sorted((tuple([*r, drawn.get(id(r))]) for r in out), key=repr)


@pytest.mark.parametrize(("buckets", "block_bytes", "parts", "share"), [(10_000, 4 << 20, 8, 10), (7, 2000, 211, 50), (1, 500, 8, 100)])
def test_resampling_by_hand(spark, docs, rows, partitions, buckets, block_bytes, parts, share):
    partitions(parts)
    target = [prose(random.Random(2), 300), None, "ONLY here", ""]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    scored = resampling.resample(docs, wanted, share, buckets=buckets, block_bytes=block_bytes)
    got = scored.select("id", "n_features", "weight", "score", "rank").collect()
    want = slow_resample(rows, target, share, 20, buckets)
    # Rows that are equal take neighbouring ranks in either order.
    assert sorted(map(tuple, got), key=repr) == want
    drawn = resampling.drawn_documents(docs, wanted, share=share, buckets=buckets, block_bytes=block_bytes)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in want if r[4]}


def test_resampling_of_nothing(spark, docs, nothing, rows):
    wanted = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(nothing, wanted).count() == 0
    assert resampling.resample(docs, wanted).count() == len(rows)
    assert resampling.features("Tie the tie".encode(), 2) == (3, [b"tie", b"the", b"tie", b"tie the", b"the tie"])


def test_lines_of_a_long_text_take_time_in_proportion(spark):
    """100,000 lines in one text: each was split out of the whole text anew once."""
    body = [f"line number {i} of its own" for i in range(100_000)]
    texts = ["\n".join([*body[:50_000], "shared by all", *body[50_000:]])] + [f"own {i}\nshared by all\nend {i}" for i in range(7)]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts, 1)], "doc_id long, text string, source string")
    linededup.dedup_lines(docs.where("doc_id > 1")).collect()  # code is compiled
    began = time.perf_counter()
    got = {r.doc_id: r for r in linededup.dedup_lines(docs.withColumn("doc_id", -F.col("doc_id"))).collect()}
    assert time.perf_counter() - began < 20  # it took over 10 minutes
    assert got[-1].text == "\n".join(body) and got[-1].n_lines_removed == 1 and got[-8].text == texts[7]


def test_measured_recall_sees_what_the_forest_misses(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(30)]
    rows = [(10 * i + c, " ".join([*w[: 40 + c], f"c{i}{c}", *w[41 + c :]])) for i, w in enumerate(base) for c in range(3)]
    signed = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    reps = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")).cache()
    _, forest = neardup.similar_groups(reps, probes=90)
    assert forest.probed == forest.joined > 100
    told = []
    neardup.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), report=told.append)
    assert told[0].probed == told[0].joined > 100
    with pytest.MonkeyPatch.context() as m, pytest.warns(UserWarning, match="similar pairs of the probes"):
        m.setattr(neardup, "similar_pairs", lambda reps, *a: (reps.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(6).alias("depth")).limit(2), neardup.Forest(6, 1.0, 0)))
        assert neardup.similar_groups(reps, probes=90)[1].joined == 0


def test_toxicity_bounds_are_parameters(spark):
    assert toxicity.weighing(500, None) == 500 and toxicity.weighing(500, 139) == 139 and toxicity.weighing(0, None) == 1
    Row = lambda key, toxic, size: {"key": key, "toxic": toxic, "bytes": size}
    rows = [Row("a", 0, 30), Row("b", 0, 500), Row("c", 0, 30), Row("d", 1, 900), Row("e", 1, 10), Row("f", 0, 5)]
    assert toxicity._chosen(rows, 3, 140) == ["a", "c", "d"] and toxicity._chosen(rows, 1, 10**6) == ["a", "d"]
    texts = [(i, ("bad " if i % 2 else "good ") * 20 + f"w{i}") for i in range(60)] + [(1000, "bad " * 200_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts[:-1]] + [(1000, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample_bytes=20_000, most_windows=None)
    assert model.most_windows is None
    scored = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert min(scored[i] for i in range(1, 60, 2)) > max(scored[i] for i in range(0, 60, 2)) and toxicity.learn(docs.limit(0), labels).most_windows == toxicity.MOST_WINDOWS


def test_exact_likeness(spark):
    rng = random.Random(3)
    a = " ".join(f"w{rng.randrange(9999)}" for _ in range(4000))
    b = a[: len(a) // 2] + " ".join(f"v{rng.randrange(9999)}" for _ in range(2000))
    got = {r.doc_id: r for r in syncmers.compare_edited(spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string"), size=None).collect()}
    x, y = (set((syncmers.anchors(t)[1] >> np.uint64(32)).tolist()) for t in (a, b))
    assert got[2].near_next == pytest.approx(2 * len(x & y) / len(x | y) / (1 + len(x & y) / len(x | y)), abs=1e-12)
    assert len(got[2].fingerprint) == 8 * len(x) > 8 * syncmers.SKETCH
    found = {r.doc_id: r for r in syncmers.anchor_documents(spark.createDataFrame([(2, a), (3, None)], "doc_id long, text string")).collect()}
    assert found[2].positions == syncmers.anchors(a)[0].tolist() and found[3].positions == []


def test_whole_sequences_and_shard_folders(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(i, f"some words of document {i} " * (1 + i)) for i in range(40)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, whole = packing.pack_documents(docs, path).cache(), {r.sequence_id: r for r in packing.whole_sequences(docs, path).collect()}
    assert all(len(r.ids) == 4 * r.length for r in whole.values())
    assert sum(len(r.ids) for r in whole.values()) == 4 * pieces.agg(F.sum("length")).first()[0] and {r.sequence_id for r in pieces.select("sequence_id").distinct().collect()} == set(whole)
    sharding.write_shards(sharding.shard_documents(docs, 3), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == 40 and set(back.columns) >= {"doc_id", "text", "shard"} and {p.name for p in (tmp_path / "shards").glob("shard=*")} == {f"shard={r.shard}" for r in back.select("shard").distinct().collect()}

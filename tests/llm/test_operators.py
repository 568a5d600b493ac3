"""The text operators against brute force, round trips and held-out accuracy, on small fixtures of awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, graph, linededup, neardup, packing, quality, sharding, syncmers, tokenfile, toxicity, warc
from tidemark.llm.common import range_bounds, range_part

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, source string, n_chars long, slot string, hits int, `a.b` int"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "naïve", "straße", "日本", "x1", "...", "don't", "the", "of"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "one", "tie", "tie", prose(rng, 30_000), "word " * 3000, "a" * 20_000, "é́‍👩‍👩‍👧 <|endoftext|> x", "tab\tsep\x0bvt nbsp", "  two  spaces "]
    base = [prose(rng, 120) for _ in range(12)]
    texts += base + [b.replace("alpha", "ALPHA", 1) for b in base[:6]] + base[:3]
    texts += [f"{prose(rng, 9)}\nshared line here\n{prose(rng, 5)}\n  shared line here " for _ in range(9)]
    out = [(i * 3 - 5, t, None if i % 11 == 0 else f"s{i % 7}", -1, "own", i, i) for i, t in enumerate(texts)]
    return [*out, out[5], out[15], (None, "no id", "s1", 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def found(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_quality_measures(docs, rows, nothing):
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = (text or "").split("\n")
        dups = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
        return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(covered)

    got = found(quality.judge(docs))
    for doc, text, *_ in rows:
        n, *rest = want = slow(text)
        for r in got[doc]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n) and not (r.base_failed and r.kept)
    assert quality.judge(nothing).count() == 0 and quality.filter_documents(nothing).columns == nothing.columns
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).where("kept").count() > 0


def test_hosts_change_verdicts(spark):
    rng = random.Random(1)
    good = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(80)), "good") for i in range(60)]
    bad = [(100 + i, "junk", "bad") for i in range(300)] + [(999, good[0][1] + " other", "bad")]
    got = found(quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, source string")))
    assert all(r.kept for i in range(60) for r in got[i])
    assert got[999][0].host_verdict == "blocked" and not got[999][0].base_failed and not got[999][0].kept
    assert 0 < got[0][0].host_rate < 0.2 < got[999][0].host_rate < 1


def ids_of(path, text, end):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [*t.encode(text or "", add_special_tokens=False).ids, *end]


def test_packing_is_whole_and_tight(docs, rows, nothing):
    pieces = packing.pack_documents(docs, WORD, windows=3, fan_in=2).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    fills = []
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length > 0
            at += p.length
        fills.append(at)
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills) and sum(f != 2048 for f in fills) <= 11
    copies = Counter(r[0] for r in rows)
    for doc, text, *_ in rows:
        want = ids_of(WORD, text, [1])
        got = sorted(by_doc[doc], key=lambda p: p.start)
        assert sum(p.length for p in got) == len(want) * copies[doc] and {p.doc_tokens for p in got} == {len(want)}
        if copies[doc] == 1:
            assert np.frombuffer(b"".join(p.ids for p in got), "<u4").tolist() == want
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_token_files_round_trip(docs, rows, nothing):
    got = found(tokenfile.digests(docs, BYTE))
    start = 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(ids_of(BYTE, text, [2]), "<u4")
        assert (start, len(ids), zlib.crc32(ids.tobytes())) in {(r.start, r.n_tokens, r.ids_crc32) for r in got[doc]}
        start += len(ids)
    assert tokenfile.digests(nothing, BYTE).count() == 0


def test_bpe_is_the_library(docs, rows, nothing):
    t = Tokenizer.from_file(BYTE)
    got = found(bpe.digests(docs, BYTE))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc, text, *_ in rows:
        ids = ids_of(BYTE, text, [])
        assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[doc]} == {(len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))}
    assert bpe.digests(nothing, BYTE).count() == 0


def test_bpe_streams_in_any_pieces(rows):
    merges, rng = bpe.load(BYTE), random.Random(3)
    for _, text, *_ in rows:
        text = (text or "")[:4000]
        whole = bpe.unpack_ids(b"".join(bpe.encode(text, merges)))
        for piece in (1, 7, 300):
            assert bpe.unpack_ids(b"".join(bpe.encode(text, merges, piece=piece))) == whole
        cut = sorted(rng.randrange(len(whole) + 1) for _ in range(5))
        stream = bpe.StreamDecoder(merges)
        assert "".join([*(stream.feed(bpe.pack_ids(whole[a:b])) for a, b in zip([0, *cut], [*cut, len(whole)], strict=True)), stream.finish()]) == bpe.decode(bpe.pack_ids(whole), merges)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 900 + "</p>"
    pages = [(1, "http://a/", big), (2, "http://b/ x", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\n" * 400), (9, None, big), (None, "u", "lone" * 400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write_archives(df, f"file://{tmp_path}/w", frame_bytes=2500)
    back = found(warc.read_archives(index), "page_id")
    assert {r.record_type for r in back[9]} == {"response"} and back[1][0].refers_to == back[2][0].refers_to == 9
    digests = found(warc.digests(df), "page_id")
    for page, _, html in pages:
        data = (html or "").encode()
        assert {(r.payload_bytes, r.payload_digest) for r in digests[page]} == {(len(data), hashlib.sha1(data).hexdigest())}
        assert all(r.payload in (None, data) for r in back[page])
    assert {p for p, rs in digests.items() if rs[0].record_type == "revisit"} == {1, 2}
    frames = index.select("path", "frame").distinct().count()
    assert frames > index.select("path").distinct().count()
    reader = warc.BundleReader(index.first().path)
    import zstandard

    with open(index.first().path.removeprefix("file://"), "rb") as f:  # any tool reads the frames one after another
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain == b"".join(reader.frame(i) for i in range(len(reader.frames)))
    assert warc.digests(df.limit(0)).count() == 0


def test_syncmers_by_definition():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdé日 ") for _ in range(700))
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)
    where, what = syncmers.anchors(text)
    prefix = np.concatenate([np.zeros(1, "u8"), np.cumsum(points * syncmers._powers()[0][: len(points)], dtype="u8")])
    inner = syncmers._grams(prefix, syncmers._powers()[1], syncmers.S)
    n = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(text) - syncmers.K + 1) if min(inner[i : i + n]) in (inner[i], inner[i + n - 1])]
    assert where.tolist() == want and 0 < len(want) < len(text)
    shifted = syncmers.anchors("some other beginning. " + text)
    assert set(what.tolist()) <= set(shifted[1].tolist())


@pytest.mark.parametrize(("long", "short"), [(262, 250), (300, 200), (256, 255), (383, 255)])
def test_likeness_across_scales(long, short):
    rng = random.Random(3)
    scores = []
    for _ in range(50):
        text = prose(rng, 90)[:long]
        a, b = (syncmers.sketch(syncmers.anchors(t)[1]) for t in (text, text[:short]))
        assert syncmers.likeness(a, b) == syncmers.likeness(b, a)
        scores.append(syncmers.likeness(a, b))
    assert len(text) == long and abs(np.mean(scores) - 2 * short / (long + short)) < 0.05


def test_a_long_document_and_its_shorter_edited_text(spark):
    rng = random.Random(4)
    texts = [prose(rng, 90)[:270], "x" * 70]  # the edited text has 180 + 70 code points
    first = found(syncmers.compare_edited(spark.createDataFrame([(9, texts[0]), (1, texts[1])], "doc_id long, text string")))[9][0]
    assert first.n_chars == 270 and first.near_edited > 0.65


def test_edited_fingerprints(docs, rows, nothing):
    got = found(syncmers.compare_edited(docs))
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1] or ""))
    for i, (doc, text, *_) in enumerate(ordered):
        a, b = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(a) - len(a) // 3
        edited = a[:cut] + b[: len(a) // 3]
        assert (len(a), hashlib.sha256(edited.encode()).hexdigest()) in {(r.n_chars, r.edited_sha256) for r in got[doc]}
        r = next(r for r in got[doc] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == syncmers.encode(syncmers.sketch(syncmers.anchors(a)[1])) and r.edited_fingerprint == syncmers.encode(syncmers.sketch(syncmers.anchors(edited)[1]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.passage_start, r.passage_next_start, r.passage_chars) == syncmers.passage(a, syncmers.anchors(a), b, syncmers.anchors(b))
    assert syncmers.compare_edited(nothing).count() == 0


def longest_common(a: str, b: str) -> int:
    """Code points of the longest common substring, cell by cell."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] + [before[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best, before = max(best, *now), now
    return best


@pytest.mark.parametrize(("size", "shared"), [(400, 42), (400, 43), (700, 120), (300, 280), (120, 13), (90, 60), (6, 3), (0, 0)])
def test_passages_by_position(size, shared):
    rng = random.Random(size + shared)
    letters = "abcdefghijklé日 "
    of = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(8):
        common = of(shared)
        a, b = (of(rng.randrange(size - shared + 1)) + common + of(rng.randrange(size - shared + 1)) for _ in range(2))
        start, other, n = syncmers.passage(a, syncmers.anchors(a), b, syncmers.anchors(b))
        assert (a[start : start + n] == b[other : other + n]) if n else start is None or a == b
        if shared >= (2 * syncmers.K - syncmers.S if max(len(a), len(b)) >= syncmers.SHORT else 2 * syncmers.FINE_K - syncmers.FINE_S):
            assert n == longest_common(a, b) >= shared


def test_passages_of_repeated_and_equal_texts():
    find = lambda a, b: syncmers.passage(a, syncmers.anchors(a), b, syncmers.anchors(b))
    assert find("x" * 5_000, "x" * 3_000) == (0, 0, 3_000)  # one anchor, thousands of times
    assert find("same", "same") == (0, 0, 4) and find("", "") == (0, 0, 0)
    assert find("some", "other") == find("", "other") == find("q" * 300, "z" * 300) == (None, None, 0)
    rng = random.Random(8)
    long, part = prose(rng, 20_000), prose(rng, 60)
    a, b = long[:70_000] + part + long[70_000:], prose(rng, 40) + part
    start, other, n = find(a, b)
    assert n >= len(part) and a[start : start + n] == b[other : other + n]  # 60 words in a text of 20,000


def test_sharding_law(docs, rows, nothing):
    got = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in got:
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
        slots[r.shard].append(int(r.slot))
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = docs.sparkSession.range(20_000).select(F.col("id").alias("doc_id"))
    counts = {r.shard: r["count"] for r in sharding.assign_shards(many, ["doc_id"], [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and 2.7 < counts[1] / counts[0] < 3.3
    moved = sharding.assign_shards(many, ["doc_id"], [1.0] * 24, "shard", "more").where("more = 24").count()
    again = sharding.assign_shards(many, ["doc_id"], [1.0] * 25, "shard").where("shard = 24").count()
    assert moved == again and 500 < moved < 1100
    assert sharding.shard_documents(nothing).count() == 0


def test_line_dedup(docs, rows, nothing):
    sites, first = defaultdict(set), {}
    keyed = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text, site, *_ in keyed:
        for i, line in enumerate(text.split("\n")):
            if t := line.strip(" "):
                if site is not None:
                    sites[t].add(site)
                first.setdefault(t, (doc, i))
    wide = {t for t, s in sites.items() if len(s) >= linededup.MIN_SITES}
    assert "shared line here" in wide
    got = found(linededup.dedup_lines(docs))
    for doc, text, *_ in rows:
        if text is None:
            assert got[doc][0].text is None and got[doc][0].n_lines == 0
            continue
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if x.strip(" ") not in wide or first[x.strip(" ")] == (doc, i)]
        assert {(r.text, r.n_lines, r.n_lines_removed) for r in got[doc]} == {("\n".join(kept), len(lines), len(lines) - len(kept))}
    assert linededup.dedup_lines(nothing).count() == 0


def _classes(rows):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and (a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))):
                links[i].add(j)
    return links


def test_near_duplicates(docs, rows, nothing):
    links = _classes(rows)
    got = found(neardup.join_documents(docs))
    for i, (doc, *_) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        assert (min(ids) if ids else None, len(links[i])) in {(r.class_id, r.n_links) for r in got[doc]}
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and neardup.join_documents(nothing).count() == 0


def test_large_group_loses_no_link(spark):
    """A group beyond a block: a chain of near copies, and a hot set of exact ones."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(600):
        words[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "the very same words in each of them") for i in range(400)]
    got = {r.doc_id: r for r in neardup.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    links = _classes(rows)
    assert {d: r.n_links for d, r in got.items()} == {rows[i][0]: len(links[i]) for i in range(len(rows))}
    assert {got[1000 + i].class_id for i in range(400)} == {1000}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 103: 100}


def test_range_bounds_split_all(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("é"), F.col("id") % 7).alias("t"))
    bounds = range_bounds(df, "id", "t", 8)
    assert len(bounds) == 7 and range_bounds(df.limit(0), "id", "t", 8) == []
    placed = df.unionByName(spark.createDataFrame([(None, "x"), (bounds[3][0], None)], "id long, t string")).withColumn("part", range_part("id", "t", bounds)).collect()
    for r in placed:
        assert r.part == (0 if r.id is None else sum((k, t.encode()) <= (r.id, (r.t or "").encode()) for k, t in bounds))


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = toxicity.judge(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").select("score", "toxic").collect()
    s, y = np.array([r.score for r in judged]), np.array([r.toxic for r in judged])
    auc = ((s[y == 1][:, None] > s[y == 0][None]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None])).mean()
    assert auc > 0.95 and ((s >= 0.5) == (y == 1)).mean() > 0.9


def test_toxicity_of_odd_rows(spark, docs, nothing):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))
    got = toxicity.judge(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where("doc_id is not null and held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0
    assert toxicity.judge(nothing, labels.limit(0)).count() == 0
    assert toxicity.judge(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, **_: seen.append((list(texts), list(labels))))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(1, f"text 1 again {k:03}") for k in range(500)], "doc_id long, text string")
    toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    assert 1 in ids and seen == [([f"text {i}" for i in ids], [i % 2 for i in ids])]


def test_length_lowers_a_score_up_to_a_bound():
    model = toxicity.train(["good word"] * 20 + ["bad word"] * 20, [0] * 20 + [1] * 20)
    model.slope = 0.5
    short, long, longest = toxicity.Scorer(model).logits(["word " * 500, "word " * 5_100, "word " * 20_000])
    assert short > long + 0.1 and abs(long - longest) < 1e-4


def test_gradients():
    """The backward pass against differences of the loss."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, index, mask, y = rng.normal(size=(6, toxicity.N_FIXED + 2 * toxicity.EMBED)), rng.integers(0, 6, (3, 5)), np.ones((3, 5), bool), np.array([1.0, 0.0, 1.0])
    mask[1, 3:] = False
    _, g, dx = net.gradients(index, mask, y, x)
    for name in ("wf", "ub", "attend", "out"):
        at = tuple(0 for _ in net.p[name].shape)
        was = net.p[name][at]
        sides = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = was + step
            sides.append(net.gradients(index, mask, y, x)[0])
        net.p[name][at] = was
        assert abs((sides[0] - sides[1]) / 2e-3 - g[name][at]) < 1e-3

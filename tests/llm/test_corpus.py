"""The corpus operators against brute force and on messy tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, feistel, mixing, ngram_join, pii, quality, sentencepiece_codec, sharding, stages, suffix_dedup, topk, warc, work
from docloom.llm.components import connected, smallest_reachable


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def words(t):
    return (t or "").encode().lower().split()


# -- 1


def shingles(t, n):
    w = words(t)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                at[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=25)
    bases = [rng.choices(vocabulary, k=rng.choice((3, 8, 20, 60, 200))) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w + (passage if rng.random() < 0.3 else []))))
    return rows


@pytest.mark.parametrize(("n", "num", "den", "hot", "classes"), [(4, 85, 100, False, (32, 1024)), (5, 4, 5, False, (1, 3)), (4, 85, 100, True, (1, 1)), (4, 4, 5, True, (32, 1024))])
def test_ngram_join(spark, monkeypatch, n, num, den, hot, classes):
    rows = near_texts(n)
    if hot:  # every token, so nothing but combinations can be a signature
        monkeypatch.setattr(ngram_join, "hot_classes", lambda *a, **b: np.ones(1 << ngram_join.COUNTERS, np.uint8))
    monkeypatch.setattr(ngram_join, "CLASSES", classes)
    if n == 5:  # sets are found by a join instead of a bit table
        monkeypatch.setattr(ngram_join, "MARKED", 0)
    got = ngram_join.near_duplicates(frame(spark, rows, "doc_id bigint, text string").repartition(4), n, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(rows, n, num, den)


@pytest.mark.parametrize("limits", [(0, 0), (0, 40), (3, 6), (100, 200)])
def test_linked_sets_share_a_signature(limits):
    rng = np.random.default_rng(7)
    sets = []
    for size in (4, 6, 9, 30, 120):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for _ in range(25):
            kept = base[rng.random(size) < rng.choice((0.8, 0.95, 1))]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, rng.integers(0, 1 + size // 8)).astype(np.uint64)])))
    tokens, held = np.unique(np.concatenate(sets), return_counts=True)
    made = []
    for s in sets:
        count = held[np.searchsorted(tokens, s)]
        made.append(ngram_join.signatures_of(s, count, 1 + np.searchsorted(limits, count, side="left"), 4, 5))
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if a.tolist() != sets[j].tolist() and both and 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                links += 1
                (c, sig, p, own), (d, other, q, theirs) = made[i], made[j]
                # there is one from which on enough tokens are left in both
                assert any(9 * min(c - p[x], d - q[y]) >= 4 * (len(a) + len(sets[j])) and (own[x] or theirs[y]) for x, y in zip(*(np.intersect1d(sig, other, return_indices=True)[1:]), strict=True))
    assert links > 100


def test_ngram_join_messy(messy, none):
    got = ngram_join.near_duplicates(messy, 5, 4, 5).collect()
    assert len(got) == messy.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by[1] == by[2] == by[3] == {1} and by[4] == {4} and by[6] == {6} and by[8] == {8} and by[None] == {None}
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.keep_one(messy)
    assert kept.columns == messy.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, None])


def test_keep_one_where_ids_repeat(spark):
    base = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["x"])), (1, " ".join(base[:-1] + ["y"])), (2, "something else entirely"), (3, ""), (3, ""), (3, None)]
    kept = ngram_join.keep_one(frame(spark, rows, "doc_id bigint, text string")).collect()
    assert len([r for r in kept if "w0" in (r["text"] or "")]) == 1 and Counter(r["doc_id"] for r in kept)[3] == 3
    assert (2, "something else entirely") in [tuple(r) for r in kept] and len(kept) == 5


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    e = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in connected(e, small=small).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100
    assert connected(e.limit(0), small=small).count() == 0


def test_components_of_random_links():
    rng = np.random.default_rng(4)
    for n, m in ((50, 30), (300, 280), (1000, 3000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        at = {int(i): int(i) for i in np.concatenate([a, b])}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                at[x] = at[y] = min(at[x], at[y])
        ids, comp = smallest_reachable(a, b)
        assert dict(zip(ids.tolist(), comp.tolist(), strict=True)) == at


# -- 2


def cut(rows, n=200):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def result(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("many", [0, 5, 1000])
def test_suffix_dedup(spark, monkeypatch, many):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passages = [text(n) for n in (180, 200, 260, 700)]
    rows = [(i, text(rng.randrange(300)) + rng.choice(passages) + text(rng.randrange(300)) + (rng.choice(passages) if i % 3 == 0 else "")) for i in range(40)]
    rows += [(50, rows[0][1]), (51, "x" * 900), (52, "ab" * 300), (53, ""), (54, "short")]
    monkeypatch.setattr(suffix_dedup, "MANY", many)  # the segments of larger anchors are cut into pieces
    got = suffix_dedup.remove_repeats(frame(spark, rows, "doc_id bigint, text string").repartition(3))
    assert result(got) == cut(rows)


def test_pieces_cover_the_windows():
    rng = np.random.default_rng(3)
    for back, windows in ((152, 153), (40, 1), (31, 32), (100, 77)):
        data = rng.integers(0, 256, windows + 199).astype(np.uint8).tobytes()
        pieces = [*suffix_dedup._pieces(data, back, 200)]
        assert sorted(w for _, _, _, a, _, x in pieces for w in range(a, a + len(x) - 199)) == [*range(windows)]
        for part, core, _, a, at, x in pieces:
            assert x == data[a : a + len(x)] and at == back - a and len(x) - 199 <= suffix_dedup.WIDTH
            # the same windows without their neighbours have the same core
            assert {suffix_dedup._pieces(data[w : w + 200], back - w, 200).__next__()[:2] for w in range(a, a + len(x) - 199)} == {(part, core)}


def test_suffix_dedup_messy(messy, none):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert result(suffix_dedup.remove_repeats(messy)) == cut(rows)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_mergesort_sorts():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    suffixes = suffix_dedup.Suffixes(buf, 20)
    start = rng.permutation(2900)[:500]
    bucket = np.sort(rng.integers(0, 5, 500))
    order = suffix_dedup.mergesort(suffixes, start, bucket)
    key = lambda i: (bucket[i], buf[start[i] : start[i] + 20].tobytes())
    assert [key(i) for i in order] == sorted(key(i) for i in range(500))


# -- 3


def test_quality_learns_and_compiles(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices(["The", "river", "runs", "slowly,", "and", "we", "rest."], k=50))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(["buy", "now", "cheap"], k=50))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(600)]
    docs, labels = frame(spark, [r[:2] for r in rows], "doc_id bigint, text string"), frame(spark, [(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert 100 < len(held) < 200 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] in set(held))
    stats = quality.statistics(F.col("text"))
    table = docs.select("doc_id", *[c.alias(n) for n, c in stats.items()]).toPandas().set_index("doc_id")
    assert np.allclose(model.predict(table[[*stats]].to_numpy()), [s for _, s in sorted((r["doc_id"], r["score"]) for r in got)], atol=1e-9)


def test_quality_messy(spark, messy, none):
    labels = frame(spark, [(1, 1), (None, 0), (99, 0), (7, None)], "doc_id bigint, quality int")
    model = quality.train(messy, labels)
    rows = quality.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(none, quality.train(none, labels.limit(0))).count() == 0
    assert quality.keep_good(messy, model).columns == messy.columns


# -- 4


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 1000])
def test_feistel(spark, n):
    f = feistel.feistel(n, "k")
    places = [f.permute(i) for i in range(n)]
    assert sorted(places) == list(range(n)) and [f.invert(p) for p in places] == list(range(n))
    got = [r["p"] for r in spark.range(n).select(f.column(F.col("id")).alias("p"), "id").orderBy("id").collect()]
    assert got == places


def test_sharding(spark, messy, none):
    docs = frame(spark, [(i * 7 % 101, f"t{i}") for i in range(101)], "doc_id bigint, text string").repartition(5)
    rows = sharding.shard_rows(docs).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s, c in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(c))
    ordered = sorted(rows, key=lambda r: r["doc_id"])
    assert [(r["shard"], r["slot"]) for r in ordered] == [sharding.locate(i, 101) for i in range(101)]
    assert all(sharding.row_at(r["shard"], r["slot"], 101) == r["row_no"] for r in rows)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(docs.repartition(2)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    m = sharding.shard_rows(messy).collect()
    assert len(m) == messy.count() and all(r["text_crc32"] == 0 and r["size"] == 1 for r in m if r["doc_id"] == 4)
    assert sharding.shard_rows(none).count() == 0


# -- 5


def test_exact_dedup(spark, messy, none):
    index = exact_dedup.DigestIndex(spark, work.new_path(spark, "ix"), 4)
    rows = exact_dedup.decide(messy, index).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in messy.collect()}
    groups = defaultdict(list)
    for r in messy.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    for r in rows:
        g = groups[texts[r["doc_id"]]]
        assert r["keep_id"] == max((x for x in g if x is not None), default=None) and r["group_size"] == len(g)
    assert sum(r["kept"] for r in rows) == len(groups)  # one of each text, of repeated rows, too
    assert "SortMergeJoin" in (index.read().join(index.read().select("digest").hint("merge"), "digest", "left_anti"))._jdf.queryExecution().toString()
    later = exact_dedup.decide(frame(spark, [(100, "Tiny text"), (101, "brand new")], "doc_id bigint, text string"), exact_dedup.DigestIndex(spark, index.path, 4)).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later} == {(100, 8, False), (101, 101, True)}
    assert exact_dedup.decide(none, exact_dedup.DigestIndex(spark, work.new_path(spark, "ix"), 4)).count() == 0
    kept = exact_dedup.keep_one(messy)
    assert kept.columns == messy.columns and kept.count() == len(groups)


# -- 6


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 24))
    v[100:200] = v[0]  # many ties
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (401, [float("nan")] * 24), (402, [None] * 24), (None, [1.0] * 24), (403, [1.0] * 5), (420, [2.0] * 5), (440, []), (441, []), (7, [float(x) for x in v[7]])]
    df = frame(spark, rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    q = np.floor(64 * v).astype(np.int64)
    for sizes in ((2048, 16384), (4, 50)):
        got = defaultdict(list)
        for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 9, 64, *sizes).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        for i in range(0, 300, 20):
            best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:9]
            assert got[i] == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
        assert got[420] == [(1, 403, 64 * 128 * 5)] and 400 not in got and got[440] == [(1, 441, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# -- 7


def test_topk_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in rng.integers(0, 12, 60)]
    rows += rows[:9] + [rows[0]] * 7
    df = frame(spark, rows, "vec_id bigint, embedding array<double>")
    v = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in dict((repr(r), r) for r in rows).values()]
    for sizes in ((2048, 16384), (4, 16)):
        got = {}
        for r in topk.top_k(df, F.col("vec_id") % 4 == 0, 9, 64, *sizes).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert got == {q: sorted((-int(x @ y), j) for i, x in v if i == q for j, y in v if j != q)[:9] for q in {i for i, _ in v} if q % 4 == 0}


def test_warc_revisits(spark):
    schema = "record_id string, warc_type string, profile string, url string, warc_date timestamp, status int, headers map<string,string>, payload binary"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    rows = [
        ("r1", "response", None, "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", day(1), 200, {"ETag": '"1"', "Content-Length": "5"}, b"hello"),
        ("v1", "revisit", warc.NOT_MODIFIED, "https://a.com/x?a=1&b=2", day(2), 304, {"etag": 'W/"1"', "Date": "d2", "Content-Length": "0"}, None),
        ("r2", "response", None, "http://a.com/x?a=1&b=2", day(3), 200, {"ETag": '"2"'}, b"new"),
        ("v2", "revisit", warc.NOT_MODIFIED, "http://a.com/x?a=1&b=2", day(4), 304, {"ETag": '"1"'}, None),
        ("v3", "revisit", warc.NOT_MODIFIED, "http://b.com/", day(4), 304, {"ETag": '"1"'}, None),
        ("r3", "response", None, "http://c.com", day(1), 200, {}, b""),
        ("v4", "revisit", None, "http://c.com/", day(2), 304, None, None),
        ("n1", "response", None, None, day(1), 200, {"ETag": '"1"'}, b""),
        ("n2", "revisit", None, None, day(2), 304, {"ETag": '"1"'}, None),
        ("m1", "metadata", None, "http://c.com", None, None, None, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(frame(spark, rows, schema)).collect()}
    assert {k: (r["outcome"], r["source_id"]) for k, r in got.items()} == {"r1": ("full", "r1"), "v1": ("resolved", "r1"), "r2": ("full", "r2"), "v2": ("validator_mismatch", None), "v3": ("unresolved", None), "r3": ("full", "r3"), "v4": ("no_validator", None), "n1": ("full", "n1"), "n2": ("unresolved", None), "m1": ("other", None)}
    assert got["v1"]["status"] == 200 and got["v1"]["headers"] == {"etag": 'W/"1"', "date": "d2", "content-length": "5"}
    assert warc.resolve_revisits(frame(spark, [], schema)).count() == 0


def test_warc_hot_url_crosses_partitions(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 50 == 0, "response").otherwise("revisit").alias("warc_type"), F.lit(None).cast("string").alias("profile"), F.lit("http://a/x").alias("url"), F.timestamp_seconds("id").alias("warc_date"), F.when(F.col("id") % 50 == 0, 200).otherwise(304).alias("status"), F.create_map(F.lit("ETag"), F.lit("1")).alias("headers"))
    for r in warc.resolve_revisits(rows).collect():
        assert r["source_id"] == str(int(r["record_id"]) // 50 * 50)


def test_warc_crawl_has_every_outcome(spark):
    pages = frame(spark, [(i, f"http://a.com/{i}", f"<p>{i}</p>") for i in range(8)], "page_id bigint, url string, html string")
    got = {r["record_id"]: (r["outcome"], r["source_id"]) for r in warc.resolve_revisits(warc.page_records(pages)).collect()}
    assert Counter(o for o, _ in got.values()) == {"full": 16, "resolved": 8 + 6, "validator_mismatch": 6, "no_validator": 2 + 2, "unresolved": 2}
    assert got["0/1again"] == ("resolved", "0/1") and got["0/2again"] == ("resolved", "0/2") and got["1/2again"] == ("resolved", "1/2")
    assert got["2/0"] == ("unresolved", None) and got["3/2again"][0] == "no_validator" and got["0/late"][0] == "validator_mismatch"


def test_warc_messy_records(spark):
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    schema = "record_id string, warc_type string, profile string, url string, warc_date timestamp, status int, headers map<string,string>, payload binary, url_key string, outcome int, _mid string"
    rows = [("a", "response", None, "http://x/", day(1), 200, {"ETag": "e" * 100_000, "": ""}, b"", "k", 1, "m"), ("b", "revisit", None, "http://x", day(2), 304, {"etag": "e" * 100_000}, None, None, None, None)]
    rows += [rows[1]] * 2 + [("c", "revisit", None, "http://x", None, None, {}, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    got = warc.resolve_revisits(frame(spark, rows, schema)).collect()
    assert Counter((r["record_id"], r["outcome"], r["source_id"]) for r in got) == {("a", "full", "a"): 1, ("b", "resolved", "a"): 3, ("c", "unresolved", None): 1, (None, "other", None): 1}


def test_warc_damage(spark, tmp_path):
    import gzip

    rows = [{"record_id": f"urn:{i}", "warc_type": "response", "profile": None, "url": f"http://a/{i}", "warc_date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"Set-Cookie": "a=1\nb=2", "Vary": "x, y"}, "payload": bytes(range(256)) * 40} for i in range(4)]
    plain = [warc.format_warc(r) for r in rows]
    packed = [*map(gzip.compress, plain)]
    kinds = lambda data: [r["record_id"] or r["warc_type"] for r in warc.parse_warc(data)]
    everything = [f"urn:{i}" for i in range(4)]
    assert kinds(b"".join(plain)) == kinds(b"".join(packed)) == kinds(gzip.compress(b"".join(plain))) == everything
    assert [r["headers"] for r in warc.parse_warc(b"".join(packed))] == [r["headers"] for r in rows]
    broken = bytearray(packed[1])
    broken[len(broken) // 2] ^= 255
    assert kinds(packed[0] + bytes(broken) + packed[2] + packed[3])[:1] == ["urn:0"]
    assert "damaged" in kinds(packed[0] + bytes(broken) + packed[2]) and kinds(packed[0] + bytes(broken) + packed[2])[-1] == "urn:2"
    assert kinds(b"".join(packed)[:-9]) == [*everything[:3], *kinds(b"".join(packed)[:-9])[3:]] and "damaged" in kinds(b"".join(packed)[:-9])
    assert kinds(plain[0] + plain[1].replace(b"WARC/1.1", b"WXRC/1.1") + plain[2]) == ["urn:0", "damaged", "urn:2"]
    assert kinds((plain[0] + plain[1])[:-50]) == ["urn:0", "damaged"] and kinds(b"") == [] and kinds(b"nonsense") == ["damaged"] and kinds(b"\x1f\x8bnonsense") == ["damaged"]
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(packed)[:-9])
    (tmp_path / "empty.warc").write_bytes(b"")
    assert Counter(r["warc_type"] for r in warc.read_warc(spark, str(tmp_path)).collect())["response"] >= 3


def test_warc_files(spark, tmp_path):
    import gzip

    rows = [{"record_id": f"urn:{i}", "warc_type": "response", "profile": None, "url": f"http://a/{i}", "warc_date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"ETag": "x"}, "payload": b"body\r\n\r\n" * i} for i in range(3)]
    data = [warc.format_warc(r) for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {bytes(r["payload"]) for r in got} == {r["payload"] for r in rows} and all(r["warc_date"] for r in got)


# -- 8


def test_mixing(spark, messy, none):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 40), f"s{i % 5}" if i % 7 else None) for i in range(900)]
    docs = frame(spark, rows, "doc_id bigint, text string, source string").repartition(4)
    got = mixing.mix(docs, fold=8).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted(s for s in size if s) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(got) == 900 and all(abs(taken[s] - target[s]) <= 40 for s in order)  # less than one document
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(2), fold=8).collect()))
    m = mixing.mix(messy).collect()
    assert len(m) == messy.count() and all(r["taken"] == 0 for r in m if r["size"] == 0)
    assert mixing.mix(none).count() == 0


def hashed(*parts):
    """The plain form of Spark's xxhash64 of texts and longs."""
    import xxhash

    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else int(p).to_bytes(8, "little", signed=True), seed=h)
    return h % (1 << 52) / float(1 << 52)


def plain_fold(units, seed):
    """The plain form of mixing.fold_units: (row_no, doc_id, size, p) each."""
    left, done = units[0], []
    for j in units[1:]:
        i = left
        up = (i[2] * (1 - i[3]), j[2] * j[3])
        down = (i[2] * i[3], j[2] * (1 - j[3]))
        to_i, to_j = min(up), min(down)
        if hashed(seed, i[0], j[0]) * (to_i + to_j) < to_j:
            ends, bit = up[0] <= up[1], (1, 0)
            p_i, p_j = i[3] + to_i / i[2], j[3] - to_i / j[2]
        else:
            ends, bit = down[0] <= down[1], (0, 1)
            p_i, p_j = i[3] - to_j / i[2], j[3] + to_j / j[2]
        done.append((*i[:3], bit[0]) if ends else (*j[:3], bit[1]))
        left = (*j[:3], p_j) if ends else (*i[:3], p_i)
    return left, done


def test_fold_equals_plain_python(spark):
    rng = random.Random(8)
    groups = [[(100 * g + n, 7 * n, rng.randint(1, 500), rng.choice((0.5, rng.random()))) for n in range(rng.choice((1, 2, 7, 64)))] for g in range(40)]
    df = frame(spark, [(i, g) for i, g in enumerate(groups)], "g int, units array<struct<row_no:bigint,doc_id:bigint,size:bigint,p:double>>")
    for r in df.select("g", mixing.fold_units(F.col("units")).alias("f")).collect():
        left, done = plain_fold(groups[r["g"]], mixing.SEED)
        assert tuple(r["f"]["left"]) == left and [tuple(x) for x in r["f"]["done"]] == done
        mass = sum(n * p for _, _, n, p in groups[r["g"]])
        assert left[2] * left[3] + sum(x[2] * x[3] for x in done) == pytest.approx(mass)  # mass is only moved


# -- 9


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def test_pii(spark, messy, none):
    text = "Pay 4539 1488 0343 6467 or 4539148803436467, not 4539148803436468; mail Jo.Ann@mail7.example.com, call +1 (017) 555-7713, ip 10.0.0.255 and 300.1.1.1, ssn 123-45-6789, born 1999-02-28 or 28.02.1999, not 1999-02-31, IBAN DE89 3704 0044 0532 0130 00."
    r = pii.pseudonymise(frame(spark, [(1, text), (2, text[:40])], "doc_id bigint, text string")).orderBy("doc_id").collect()
    out = r[0]["text"]
    assert (r[0]["n_card"], r[0]["n_email"], r[0]["n_phone"], r[0]["n_ip"], r[0]["n_ssn"], r[0]["n_date"], r[0]["n_iban"]) == (2, 1, 1, 1, 1, 2, 1)
    for secret in ("4539 1488", "4539148803436467", "Jo.Ann", "555-7713", "10.0.0.255", "123-45-6789", "1999-02-28", "28.02.1999", "DE89 3704"):
        assert secret not in out
    for plain in ("4539148803436468", "300.1.1.1", "1999-02-31"):
        assert plain in out
    assert len(out) - len(text) in range(-8, 9)
    cards = [out[4:23].replace(" ", ""), out[27:43]]
    assert cards[0] == cards[1] and luhn(cards[0]) and luhn("4539148803436467")
    assert out[:24] == r[1]["text"][:24]  # equal values stay equal in other documents
    import re

    (y, m, d), (d2, m2, y2) = re.search(r"born (\d{4})-(\d\d)-(\d\d)", out).groups(), re.search(r"or (\d\d)\.(\d\d)\.(\d{4})", out).groups()
    assert (y, m, d) == (y2, m2, d2)
    iban = re.search(r"IBAN ([A-Z0-9 ]+)", out)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    got = pii.pseudonymise(messy)
    assert {x["doc_id"]: x["text"] for x in got.collect()} == {x["doc_id"]: x["text"] for x in messy.collect()}
    assert pii.pseudonymise(none).count() == 0


def test_pii_adjacent_values(spark):
    ip, phone, card, iban = "190.137.223.204", "+1 (826) 555-4081", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    cases = [
        (f"{phone} {ip}", {"phone": 1, "ip": 1}, ""),
        ("+1 (843) 555-7672 170.106.47.9 end", {"phone": 1, "ip": 1}, " end"),
        (f"+49 30 1234 5678 {ip}", {"phone": 1, "ip": 1}, ""),
        (f"+49 30 1234567 {card}", {"phone": 1, "card": 1}, ""),
        (f"+49 30 1234 5678 {card}", {"phone": 1, "card": 1}, ""),
        (f"{phone} {card}", {"phone": 1, "card": 1}, ""),
        (f"{phone} 123-45-6789", {"phone": 1, "ssn": 1}, ""),
        (f"{phone} 1999-02-28", {"phone": 1, "date": 1}, ""),
        ("+49 30 1234 5678 9012 34", {"phone": 1}, " 34"),
        (f"{card} 12/27", {"card": 1}, " 12/27"),
        (f"{card} 123", {"card": 1}, " 123"),
        (f"{card} {ip}", {"card": 1, "ip": 1}, ""),
        (f"{card} 123-45-6789", {"card": 1, "ssn": 1}, ""),
        (f"3782 822463 10005 {card}", {"card": 2}, ""),
        (f"17 {card}", {"card": 1}, ""),
        (f"{card} {phone}", {"card": 1, "phone": 1}, ""),
        (f"{iban} PAID", {"iban": 1}, " PAID"),
        (f"{iban} {card}", {"iban": 1, "card": 1}, ""),
        (f"AB12 NOT AN IBAN AT ALL {iban}", {"iban": 1}, ""),
        (f"{card}\n{phone}\n\nx@y.org", {"card": 1, "phone": 1, "email": 1}, ".org"),
        ("at 1999-02-28T10:00:00Z", {"date": 1}, "T10:00:00Z"),
        ("call 017-555-7713 now", {"phone": 1}, " now"),
        ("call 017.555.7713.", {"phone": 1}, "."),
        ("0049 30 1234567", {"phone": 1}, ""),
        ("from 2001:db8::8a2e:370:7334 to fe80::1", {"ip": 2}, ""),
        ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", {"ip": 1}, ""),
        ("at 12:34:56, aa:bb:cc:dd:ee:ff, std::vector, face::cafe", {}, "face::cafe"),
        ("1::2::3 and 1:2:3:4:5:6:7::8:9", {}, "8:9"),
    ]
    rows = pii.pseudonymise(frame(spark, [(i, c[0]) for i, c in enumerate(cases)], "doc_id bigint, text string")).collect()
    for r in rows:
        text, kinds, rest = cases[r["doc_id"]]
        assert {k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]} == kinds, (text, r)
        assert r["text"].endswith(rest) and r["text"].count("\n") == text.count("\n")
        for secret in (ip, "170.106.47.9", "555-4081", "555-7672", card, "1234567", "123-45-6789", "1999-02-28", iban, "10005", "x@y", "555-7713", "555.7713", "2001:db8", "fe80", "8a2e"):
            assert secret not in r["text"], (text, r)



def shuffled(s, key, classes=(pii.DIGITS, pii.LOWER, pii.UPPER)):
    """The plain form of pii.permuted."""
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        stream = hashlib.sha512(f"{key}/{i}/{len(a)}/{b}".encode()).hexdigest()
        out = ""
        for at, c in enumerate(a):
            k = int(stream[at % 32 * 4 : at % 32 * 4 + 4], 16)
            alphabet = next((x for x in classes if c in x), None)
            out += alphabet[(alphabet.index(c) + k) % len(alphabet)] if alphabet else c
        a, b = b, out
    return a + b


def spread(original, plain):
    it = iter(plain)
    return "".join(next(it) if c.isalnum() else c for c in original)


def check_digit(payload):
    return next(d for d in "0123456789" if luhn(payload + d))


def test_pii_equals_plain_python(spark):
    import datetime
    import ipaddress

    rng, key = random.Random(11), "k"
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    day = lambda y, m, d: (datetime.date(y, m, d) - datetime.date(1900, 1, 1)).days
    dates, ssns, ips = feistel.feistel(47481 + 25567 + 1, f"{key}/date"), feistel.feistel(898 * 99 * 9999, f"{key}/ssn"), feistel.feistel(1 << 32, f"{key}/ip")
    cases = []
    for _ in range(12):
        card = digits(rng.randint(12, 18))
        card = "4" + card[1:]
        whole = card + check_digit(card)
        made = shuffled(card, f"{key}/card")
        cases.append((whole, made + check_digit(made)))
        bban = digits(18)
        country = "DE"
        number = lambda b: f"{98 - int(''.join(str(int(c, 36)) for c in b + country + '00')) % 97:02d}"
        new = shuffled(bban, f"{key}/iban")
        cases.append((f"DE{number(bban)}{bban}", f"DE{number(new)}{new}"))
        p = f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"
        bare = "".join(c for c in p[2:] if c.isdigit())
        cases.append((p, "+1" + spread(p[2:], shuffled(bare, f"{key}/phone"))))
        p = f"{digits(3)}-{digits(3)}-{digits(4)}"
        cases.append((p, spread(p, shuffled(p.replace("-", ""), f"{key}/phone"))))
        a, g, n = rng.choice([*range(1, 666), *range(667, 900)]), rng.randint(1, 99), rng.randint(1, 9999)
        y = ssns.permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1)
        na = y // (99 * 9999)
        cases.append((f"{a:03d}-{g:02d}-{n:04d}", f"{na + 1 + (na >= 665):03d}-{y // 9999 % 99 + 1:02d}-{y % 9999 + 1:04d}"))
        ip = ipaddress.ip_address(rng.getrandbits(32))
        cases.append((str(ip), str(ipaddress.ip_address(ips.permute(int(ip))))))
        six = ipaddress.ip_address((0x20010DB8 << 96) | rng.getrandbits(rng.choice((16, 60, 96))))
        hexed = shuffled(six.exploded.replace(":", ""), f"{key}/ip6", (pii.HEX,))
        for spelled in (str(six), six.exploded):
            cases.append((spelled, ":".join(hexed[i : i + 4] for i in range(0, 32, 4))))
        d = datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(47481 + 25567))
        to = datetime.date(1900, 1, 1) + datetime.timedelta(days=dates.permute(day(d.year, d.month, d.day)))
        cases += [(d.isoformat(), to.isoformat()), (f"{d.day:02d}.{d.month:02d}.{d.year}", f"{to.day:02d}.{to.month:02d}.{to.year}")]
        mail = f"{''.join(rng.choices('abcXYZ019._', k=8))}@{''.join(rng.choices('abz9', k=5))}.example.org"
        stem, _, last = mail.rpartition(".")
        cases.append((mail, f"{shuffled(stem, f'{key}/email')}.{last}"))
    rows = [(i, f"so {a}, then") for i, (a, _) in enumerate(cases)]
    got = pii.pseudonymise(frame(spark, rows, "doc_id bigint, text string"), key=key).collect()
    for r in got:
        assert r["text"] == f"so {cases[r['doc_id']][1]}, then" and r["n_found"] == 1, (rows[r["doc_id"]], r)


def test_pii_key_comes_from_the_session(spark):
    df = frame(spark, [(1, "mail jo.ann@mail7.example.com")], "doc_id bigint, text string")
    drawn = pii.pseudonymise(df).first()["text"]
    assert drawn == pii.pseudonymise(df).first()["text"]
    spark.conf.set(pii.KEY, "k1")
    one = pii.pseudonymise(df).first()["text"]
    spark.conf.unset(pii.KEY)
    assert one == pii.pseudonymise(df, key="k1").first()["text"] != drawn


def test_pii_permutation_is_injective(spark):
    got = spark.range(1000).select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k").alias("p")).distinct()
    assert got.count() == 1000 and all(len(r["p"]) == 3 and r["p"].isdigit() for r in got.collect())


# -- 10


def test_sentencepiece(spark, messy, none):
    import sentencepiece

    path = sentencepiece_codec.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(r["doc_id"], r["text"] or "") for r in messy.collect()]
    plain = {r["doc_id"]: r for r in sentencepiece_codec.encode_documents(messy, dropout=0.0).collect()}
    for i, t in rows:
        assert plain[i]["lossless"] and ("▁" in t or plain[i]["ids"] == sp.encode(t))
    a, b = (sentencepiece_codec.encode_documents(messy.repartition(k), dropout=0.3) for k in (1, 4))
    ids = lambda df: Counter((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert ids(a) == ids(b) and all(r["lossless"] for r in a.collect())
    assert ids(a) != ids(sentencepiece_codec.encode_documents(messy, dropout=0.3, seed=2))
    assert Counter((r["doc_id"], r["text"]) for r in sentencepiece_codec.decode_documents(a).collect()) == Counter(rows)
    assert sum(r["n_tokens"] for r in a.collect()) > sum(r["n_tokens"] for r in plain.values())
    assert sentencepiece_codec.encode_documents(none).count() == 0


def test_sentencepiece_draws_for_each_occurrence_document_and_copy(spark):
    from docloom.llm import stages

    docs = frame(spark, [(i, " ".join(["international"] * 40), "a") for i in range(30)], "doc_id bigint, text string, source string")
    c = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    rows = sentencepiece_codec.encode_documents(docs, dropout=0.3).collect()
    assert all(r["lossless"] for r in rows) and len({tuple(r["ids"]) for r in rows}) == 30
    cuts = [{tuple(x) for x in "|".join(c.bytes_of[i].decode() for i in r["ids"]).replace("| ", "\n ").strip().split("\n")} for r in rows]
    assert min(map(len, cuts)) > 8
    twice = docs.limit(1).crossJoin(spark.range(1, 3).select(F.col("id").alias("copy")))
    a, b = (r["ids"] for r in stages.encoded(spark, twice, "").collect())
    assert a != b and c.decode(a) == c.decode(b)


MASK = (1 << 64) - 1


def mixed64(x):
    """The plain form of sentencepiece_codec._mix."""
    x &= MASK
    x = (x ^ (x >> 30)) * int(sentencepiece_codec._M2) & MASK
    x = (x ^ (x >> 27)) * int(sentencepiece_codec._M3) & MASK
    return x ^ (x >> 31)


def plain_pieces(c, text, key, dropout, seed):
    """One text's ids by an agenda in plain Python."""
    m1, m2, m3 = (int(x) for x in (sentencepiece_codec._M1, sentencepiece_codec._M2, sentencepiece_codec._M3))
    merged = dict(zip(c.pair_key.tolist(), c.pair_to.tolist(), strict=True))
    points = [ord(x) for x in " " + text] if text else []
    begins = [i for i, p in enumerate(points) if i == 0 or p == 10 or points[i - 1] == 10 or p == 32 and points[i - 1] != 32]
    limit = min(int(dropout * 2.0**64), 2**64 - 1)
    base = mixed64(key * m3 + seed)
    out = []
    for u, (a, b) in enumerate(zip(begins, [*begins[1:], len(points)][: len(begins)], strict=True)):
        name = sum(mixed64(p * m1 + i + 1) for i, p in enumerate(points[a:b]))
        k = mixed64(name + mixed64(base + u * m2))
        sym, place = [int(c.symbol[p]) for p in points[a:b]], [*range(b - a)]
        while True:
            best = None
            for i in range(len(sym) - 1):
                to = merged.get(sym[i] * c.n + sym[i + 1]) if min(sym[i], sym[i + 1]) >= 0 else None
                if to is not None and mixed64(k + (place[i] * c.n + to + 1) * m1) >= limit and (best is None or int(c.rank[to]) < best[0]):
                    best = (int(c.rank[to]), i, to)
            if best is None:
                break
            _, i, to = best
            sym[i : i + 2] = [to]
            del place[i + 1]
        for s in sym:
            out += [s] if s >= 0 else [int(c.byte_id[x]) for x in chr(-s - 1).encode()]
    return out


def test_sentencepiece_equals_plain_python():
    rng = random.Random(9)
    c = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    words_ = ["international", "the", "unbelievable", "x", "  ", "\n", "naïve", "漢字", "😀", "▁", "12,345", "aaaaaaaaaaaa", "The"]
    texts = ["", " ", "a"] + [" ".join(rng.choices(words_, k=rng.randint(1, 25))) for _ in range(60)]
    for dropout, seed in ((0.0, 1), (0.1, 1), (0.5, 7)):
        keys = [sentencepiece_codec.key_of(i, None, seed) for i in range(len(texts))]
        got = c.encode(texts, keys, dropout, seed)
        assert [x.tolist() for x in got] == [plain_pieces(c, t, k, dropout, seed) for t, k in zip(texts, keys, strict=True)]


def test_sentencepiece_decodes_null_ids(spark):
    rows = frame(spark, [(1, None), (2, []), (None, None)], "doc_id bigint, ids array<int>")
    assert [r["text"] for r in sentencepiece_codec.decode_documents(rows).collect()] == ["", "", ""]


# -- the pipeline


def plain_statistics(t):
    """The plain form of quality.statistics."""
    import regex

    t = t or ""
    n, words = len(t), len(words_of := [w for w in regex.split(r"[\x20\x09-\x0D]+", t) if w])
    count = lambda p: len(regex.findall(p, t, flags=regex.V0))
    per = lambda x, y: x / y if y else 0.0
    lines = t.split("\n")
    assert words == len(words_of)
    return {
        "log_chars": np.log1p(n), "log_words": np.log1p(words), "chars_per_word": per(n, words),
        "upper_runs": per(count(r"\p{Lu}{2,}"), words), "capitals": per(count(r"(?<!\p{L})\p{Lu}\p{Ll}"), words),
        "digits": per(count("[0-9]"), n), "symbols": per(sum(t.count(c) for c in "#$%&*@^~=_<>{}[]\\|"), n), "symbol_runs": per(count(r"[#$%&*!?|]{2,}"), words),
        "bangs": per(t.count("!"), words), "bars": per(t.count("|"), words), "stops": per(count(r"[.?!](?=[ \t\n\x0B\f\r]|$)"), words), "commas": per(t.count(","), words),
        "distinct_words": per(len(set(t.lower().split(" "))), words), "lines": per(len(lines), words), "distinct_lines": per(len(set(lines)), len(lines)),
    }


@pytest.fixture(scope="module")
def some_documents(spark, tmp_path_factory):
    """Documents of the smallest tables, and copies that no generator has."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100_000).union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.unionByName(more).withColumn("score", F.lit(1)).withColumn("copy", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_statistics_equal_plain_python(spark, some_documents):
    stats = quality.statistics(F.col("text"))
    for r in some_documents.select("text", *[c.alias(f"s_{n}") for n, c in stats.items()]).collect():
        want = plain_statistics(r["text"])
        assert {n: r[f"s_{n}"] for n in stats} == pytest.approx(want, abs=1e-9), r["text"][:200]


def test_stage_quality(spark, some_documents):
    got = stages.good_quality(spark, some_documents, "/root/testdata/sf0.001")
    assert got.columns == some_documents.columns
    model = quality.train(some_documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = [tuple(r) for r in some_documents.collect()]
    text = some_documents.columns.index("text")
    x = np.array([[plain_statistics(r[text])[n] for n in model.names] for r in rows])
    assert rows_of(got) == Counter(r for r, p in zip(rows, model.predict(x), strict=True) if p >= quality.THRESHOLD)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("split(") <= 26  # statistics are computed once


def test_stage_equal(spark, some_documents):
    names = some_documents.columns
    got = stages.one_of_equal(spark, some_documents, "")
    best = {}
    for r in some_documents.collect():
        key = r["text"] or ""
        best[key] = max(best.get(key, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert got.columns == names and Counter((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == Counter(best.items())


def test_stage_near(spark, some_documents, tmp_path):
    unique = stages.one_of_equal(spark, some_documents, "")
    path = f"{tmp_path}/unique"
    unique.write.parquet(path)
    unique = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"]) for r in unique.where("doc_id IS NOT NULL").collect()]
    kept = stages.one_of_near(spark, unique.where("doc_id IS NOT NULL"), "")
    assert kept.columns == some_documents.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i for i, (_, c) in components(rows, 5, 4, 5).items() if c == i})


def test_stage_mixed(spark, some_documents):
    got = stages.mixed(spark, some_documents, "")
    assert got.columns == [c for c in some_documents.columns if c != "copy"] + ["copy"]
    copies = Counter(tuple(r)[:-1] for r in got.collect())
    keyed = some_documents.withColumn("key", F.xxhash64(*some_documents.columns))
    due = Counter()
    for r in mixing.mix(keyed, id_col="key").collect():
        due[r["doc_id"]] += r["copies"]
    names = [c for c in some_documents.columns if c != "copy"]
    of = {r["key"]: tuple(r[c] for c in names) for r in keyed.collect()}
    assert copies == Counter({of[k]: n for k, n in due.items() if n})
    repeats = Counter(tuple(r[c] for c in names) for r in some_documents.collect())
    assert all(n <= 2 * repeats[r] for r, n in copies.items())
    assert rows_of(stages.mixed(spark, some_documents, "")) == rows_of(got)
    assert stages.mixed(spark, some_documents.limit(0), "").count() == 0


def test_stage_encoded(spark, some_documents):
    got = stages.encoded(spark, some_documents.drop("copy"), "").collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode())) for r in some_documents.collect())
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == want and all(r["lossless"] for r in got)


def test_pipeline(spark, messy, tmp_path):
    import corpus_pipeline

    messy.drop("row_no").write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [(1, 1), (2, 1), (8, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # all are good (labels of one class); equal texts leave 2 of 1 and 2 and one each of the empty and the repeated, near ones leave 2 of 2 and 3
    kept = {r["doc_id"]: r["text"] for r in messy.collect() if r["doc_id"] in (2, 5, 6, 7, 8, 9, None)}
    path = str(tmp_path / "kept.parquet")
    messy.drop("row_no").where("doc_id IS NULL OR doc_id NOT IN (1, 3, 4)").dropDuplicates(["doc_id", "text"]).write.parquet(path)
    due = Counter()
    for r in stages.mixed(spark, spark.read.parquet(path), "").collect():
        due[(r["doc_id"], len((r["text"] or "").encode()))] += 1
    assert Counter((r["doc_id"], r["n_bytes"]) for r in rows) == due and all(r["lossless"] for r in rows)
    assert {r["doc_id"] for r in rows} <= set(kept)

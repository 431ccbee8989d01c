"""The operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import matrices, mixing, outliers, packing, pii, quality, simhash, sketches, url_lists, warc
from spanloom.llm.common import table
from spanloom.llm.components import components
from spanloom.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
EXTRA = "score double, row long, bucket int, part int, node long, fp string, root long, digest string, pool string, cell string, gone_id long, gone_hash long, n_words int, weight double, ids binary, keys string, m0 double, d2 double, shard int, length int, positive boolean, last int"


@pytest.fixture(scope="module")
def nasty(spark):
    long = "word other thing. " * 20000
    rows = [(1, "a b c d e f g h i j k l", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "   \n\t ", "en", None), (5, long, "de", "s"), (6, long, "de", "s"), (7, "a b c d e f g h i j k l", "en", "s"),
            (7, "a b c d e f g h i j k l", "en", "s"), (None, "no key 4111 1111 1111 1111 here", "en", "t"), (None, None, None, None), (8, "x", None, "s"), (9, "émail joe@site.example.org 10.0.0.1 +1 (297) 555-8151", "fr", "s"), (10, "\x00 ퟿  <|endoftext|>", "en", "s")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def pdocs(docs):
    return docs.toPandas().set_index("doc_id")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")


# ---- every operator on the nasty table and on no rows

EACH = {
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "quality_stage": lambda s, d: quality.accepted(d, labels(s)),
    "matrices": lambda s, d: matrices.matrices(d),
    "outliers": lambda s, d: outliers.judge(s, d),
    "pii": lambda s, d: pii.personal_data(d),
    "pii_stage": lambda s, d: pii.redact(d),
    "packing": lambda s, d: packing.pack(s, d),
    "sketches": lambda s, d: sketches.fingerprint_versions(d),
    "simhash": lambda s, d: simhash.simhash_classes(s, d),
    "simhash_stage": lambda s, d: simhash.near_dedup(s, d),
    "mixing": lambda s, d: mixing.mixed(s, d),
    "mixing_stage": lambda s, d: mixing.sampled(s, d),
}
PER_ROW = ["quality", "outliers", "pii", "pii_stage", "sketches", "simhash", "mixing"]


@pytest.mark.parametrize("name", EACH)
def test_nasty(spark, nasty, name):
    out = EACH[name](spark, nasty).collect()
    if name in PER_ROW:
        assert len(out) == nasty.count()
    if name.endswith("_stage"):
        assert EACH[name](spark, nasty).columns == nasty.columns


@pytest.mark.parametrize("name", EACH)
def test_empty(spark, nasty, name):
    assert EACH[name](spark, nasty.limit(0)).collect() == []


# ---- quality


def test_quality_held_out(spark, docs):
    got = quality.op1_quality(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.97
    assert (good >= 0.3).mean() > 0.9 and (bad < 0.3).mean() > 0.8


def test_quality_fold(spark):
    ids = [0, 1, 17, 123456]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(quality.fold(F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in ids]


def test_prior(spark):
    rng = np.random.default_rng(1)
    good = lambda n: rng.normal(1, 1, (n, quality.WIDTH))
    prior = quality.estimate_prior(good(3000), np.concatenate([good(2100), rng.normal(-1, 1, (900, quality.WIDTH))]))
    assert abs(prior - 0.7) < 0.06


# ---- rules and outliers


def test_rule_counts(spark, docs, pdocs):
    got = outliers.statistics(docs).toPandas().set_index("doc_id")
    for i, text in pdocs.text.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = collections.Counter(windows)
        covered = {p for k, x in enumerate(windows) if seen[x] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert tuple(got.loc[i]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_determinant_estimate_resists_outliers(spark):
    rng = np.random.default_rng(3)
    clean, far = rng.normal(0, 1, (900, 5)) @ np.diag([1, 0.5, 2, 1, 1]), rng.normal(40, 1, (150, 5))
    rows = [("g", *map(float, x)) for x in np.concatenate([clean, far])]
    df = spark.createDataFrame(rows, "pool string, " + ", ".join(f"{c} double" for c in outliers.COORDINATES))
    est = outliers.estimate(spark, df).first()
    assert all(abs(est[f"m{i}"]) < 0.3 for i in range(5))
    d2 = [r.d2 for r in outliers.distance(df.crossJoin(F.broadcast(outliers.estimate(spark, df).drop("pool")))).select("d2").collect()]
    assert max(d2[:900]) < outliers.CUTOFF < min(d2[900:])


def test_chi_square():
    assert abs(outliers.chi2_share(3.84146, 1) - 0.95) < 1e-4
    assert abs(outliers.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_outliers_keep_clean(spark):
    sf = "/root/testdata/sf0.1"
    got = outliers.judge(spark, table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").toPandas()
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.99 and passed[passed.quality == 0].kept.mean() < 0.1


# ---- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans(pdocs):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("a.@-+ 1234567890(%_\n"), rng.integers(1, 40))) for _ in range(3000)]
    for text in [*pdocs.text, *made]:
        assert sorted(pii.base_spans(text)) == sorted(brute_spans(text))


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_tagger_adds_and_base_stays():
    w = pii.model()
    (base, more), = pii.find(["call (297) 555-8151 or +1 (297) 555-8151 now"], w)
    assert base == [(3, 23, 40)] and (3, 5, 19) in more
    assert pii.masked("a +1 (297) 555-8151 b", pii.base_spans("a +1 (297) 555-8151 b")) == "a [PHONE] b"


def test_tagger_held_out():
    data = pii.examples(300, 77)
    found = pii.decode(pii.model(), [t for t, _ in data])
    inner = lambda spans: {s for s in spans if s[1] > 0 and s[2] < pii.WINDOW}
    want = [inner(s) for _, s in data]
    hits = sum(len(a & {x[:3] for x in b}) for a, b in zip(want, found))
    assert hits / sum(map(len, want)) > 0.8


def test_crf_gradient_and_viterbi():
    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    paths = list(np.ndindex(3, 3, 3, 3))
    score = np.array([sum(e[0, t, p[t]] for t in range(4)) + sum(a[p[t], p[t + 1]] for t in range(3)) for p in paths])
    chance = np.exp(score) / np.exp(score).sum()
    p, pairs = pii.marginals(e, a)
    for t in range(4):
        for k in range(3):
            assert abs(p[0, t, k] - sum(c for c, x in zip(chance, paths) if x[t] == k)) < 1e-9
    assert abs(pairs[1, 2] - sum(c * sum(x[t] == 1 and x[t + 1] == 2 for t in range(3)) for c, x in zip(chance, paths))) < 1e-9
    assert tuple(pii.viterbi(e, a)[0]) == paths[int(score.argmax())]


def test_reconcile_takes_the_best_set():
    text = "x (297) 555-8151 y"
    assert pii.reconcile(text, [], [(3, 2, 16, 0.95, False), (3, 2, 16, 0.99, True), (3, 8, 16, 0.99, False)]) == [(3, 2, 16)]
    assert pii.reconcile(text, [(3, 2, 16)], [(3, 2, 16, 0.99, False)]) == []


# ---- packing


def test_encoder_equals_library(pdocs):
    e = Encoder(tokenizer_path())
    odd = ["It's we'll 3.14 x2² ÀÉ naïve ''s 'S don'T", "a\x1cb c\x85d\xa0e", "İstanbul Σς <|endoftext|> x", "", "  ", "ºª µ ÿ ß × ÷ ¼½", "'re're're ''re", "é"]
    texts = [*pdocs.text[:100], *odd]
    assert e.ids(texts) == [e.whole(t) for t in texts]


def test_pack_is_whole_and_tight(spark, docs, pdocs):
    got = packing.pack(spark, docs).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= np.ceil(got.length.sum() / 2048) * 1.02 + 1
    e = Encoder(tokenizer_path())
    for i, text in pdocs.text.items():
        data, own = e.whole(text) + bytes(4), got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(data) // 4, 2048)) and own.length.sum() * 4 == len(data)
        assert [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()


def test_two_fit_replaces_the_smallest():
    counts = np.zeros(11, int)
    for n in (6, 3, 2, 2):  # greedy: 6 + 3, gap 1; 2 + 2 fill it
        counts[n] += 1
    assert packing.fill(counts, 10) == {6: 1, 2: 2}


def test_plan_places_all(spark):
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    plan = packing.make_plan(counts, 100)
    fill = np.zeros(plan.sequences, int)
    for n in range(1, 101):
        seq, off = plan.place(np.full(counts[n], n), np.arange(counts[n]))
        assert (off + n <= 100).all()
        np.add.at(fill, seq, n)
    assert fill.max() <= 100 and plan.sequences <= np.ceil((np.arange(101) * counts).sum() / 100) * 1.01 + 1


def test_best_fit_decreasing():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 400)
    rooms, bins = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= lengths[i]]
        if fits:
            r, k = min(fits)
            rooms[k] -= lengths[i]
        else:
            rooms.append(100 - lengths[i])
    bins = matrices.best_fit_decreasing(lengths, 100)
    assert sorted(100 - sum(lengths[b]) for b in bins) == sorted(rooms)


def test_matrices_round_trip(spark, docs, pdocs):
    e, ids = Encoder(tokenizer_path()), collections.defaultdict(dict)
    for r in matrices.matrices(docs).collect():
        row, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cumulative_lengths, r.cumulative_lengths[1:]):
            ids[d][s] = row[a:b]
            assert (pos[a:b] == np.arange(b - a)).all()
    for i, text in pdocs.text.items():
        whole = np.concatenate([ids[i][s] for s in sorted(ids[i])]).astype("<u4").tobytes()
        assert whole == e.whole(text) + bytes(4)


# ---- fingerprints


@pytest.mark.parametrize("size", [sketches.BUCKET_BYTES, 40_000])
def test_sketch_likeness_is_that_of_sets(spark, docs, pdocs, monkeypatch, size):
    monkeypatch.setattr(sketches, "BUCKET_BYTES", size)
    got = sketches.fingerprint_versions(docs).toPandas().sort_values("doc_id", ascending=False)
    texts = list(pdocs.sort_index(ascending=False).text)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sets = [set(sketches.digests(t).tolist()) for t in texts]
    for k, r in enumerate(got.itertuples()):
        other = texts[(k + 1) % len(texts)]
        new = texts[k][: len(texts[k]) - len(texts[k]) // 3] + other[: len(texts[k]) // 3]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(texts[k])
        assert abs(r.near_edited - like(sets[k], set(sketches.digests(new).tolist()))) < 1e-12
        assert abs(r.near_next - like(sets[k], sets[(k + 1) % len(texts)])) < 1e-12
    assert got.fingerprint.nunique() == len(set(texts))


def test_buckets_do_not_show(spark, nasty, monkeypatch):
    want = sorted(map(repr, sketches.fingerprint_versions(nasty).collect()))
    monkeypatch.setattr(sketches, "BUCKET_BYTES", 30_000)
    assert sketches.ordered_with_next(nasty).select("bucket").distinct().count() > 2
    assert sorted(map(repr, sketches.fingerprint_versions(nasty).collect())) == want


def test_fingerprints_of_text_keys(spark):
    rows = [("b", "one. two."), ("a", "two. three."), ("c", None)]
    got = {r.doc_id: (r.n_chars, r.near_next) for r in sketches.fingerprint_versions(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"c": (0, 0.0), "b": (9, 1 / 3), "a": (11, 0.0)}


def test_colliding_digests_end_the_retries(monkeypatch):
    monkeypatch.setattr(sketches, "RETRIES", 3)
    monkeypatch.setattr(sketches.Cells, "peel", lambda c: (np.zeros(len(c.sizes), int), np.zeros(len(c.sizes), int), np.zeros(len(c.sizes), bool)))
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)
    assert sketches.likenesses([(a, b), (a, a)]).tolist() == [0.5, 1.0]


def test_recover_retries(pdocs):
    a, b = " ".join(pdocs.text[:20]), " ".join(pdocs.text[15:40])
    da, db = set(sketches.digests(a).tolist()), set(sketches.digests(b).tolist())
    assert sketches.recover(a, b) == (da - db, db - da)


# ---- archives


@pytest.mark.parametrize("most", [warc.BROADCAST_PAYLOADS, -1])
def test_archive(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", most)
    pages = spark.createDataFrame([(1, "http://a/x", "aa"), (2, "http://a/y", "aa"), (5, "http://b", "aa"), (5, "http://b", "aa"), (None, "http://c", "aa"), (None, None, "zz"), (7, "u\r\nv", None), (8, "http://e/ö?q", "x\r\n\r\nWARC/1.1\r\n\r\n"), (9, "http://e", "")], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.archived(spark, pages).collect()}
    assert got == {(1, "revisit", 2, 5), (2, "revisit", 2, 5), (5, "response", 2, None), (5, "revisit", 2, 5), (None, "revisit", 2, 5), (None, "response", 2, None), (7, "revisit", 0, 9), (9, "response", 0, None), (8, "response", 17, None)}
    assert warc.archived(spark, pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.archived(spark, pages, least_bytes=100).collect()} == {"response"}


def test_a_page_id_with_two_payloads(spark):
    pages = spark.createDataFrame([(5, "http://a", "a"), (5, "http://a", "b"), (3, "http://a", "a"), (2, "http://a", "b")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.payload_digest[:4], r.refers_to) for r in warc.archived(spark, pages).collect())
    digest = {x: warc.base32(hashlib.sha1(x.encode()).hexdigest())[:4] for x in "ab"}
    assert got == sorted([(5, "response", digest["a"], None), (5, "response", digest["b"], None), (3, "revisit", digest["a"], 5), (2, "revisit", digest["b"], 5)])


def test_each_record_is_a_member(spark, tmp_path):
    """Files as other readers want them: named .warc.gz, each member unpacked on its own from its offset."""
    rng = np.random.default_rng(4)
    noise = rng.integers(32, 127, 17 << 20, dtype=np.uint8).tobytes().decode()
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>\r\n\r\n" * (i % 50)) for i in range(300)] + [(300, "http://large", noise), (301, "http://large", noise)], "page_id long, url string, html string").withColumn("value", F.lit(1)).withColumn("sha", F.lit("x"))
    warc.write_warc(spark, pages, str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").iterdir() if not f.name.startswith((".", "_"))]
    seen = collections.Counter()
    for f in files:
        data, at = f.read_bytes(), 0
        assert f.name.endswith(".warc.gz")
        while at < len(data):
            reader = zlib.decompressobj(31)
            one = reader.decompress(data[at:])
            at = len(data) - len(reader.unused_data)
            (headers, block), = warc.parse(one)
            assert one.endswith(b"\r\n\r\n") and one.startswith(b"WARC/1.1\r\n")
            seen[dict(headers)["warc-type"]] += 1
            if len(block) > 1 << 24:
                assert block.endswith(noise.encode()) and dict(headers)["warc-target-uri"] == "http://large"
    assert seen == {"response": 300 - 5 + 1, "revisit": 5 + 1, "request": 302, "metadata": 302}
    got = warc.archived(spark, pages)
    assert got.count() == 302 and got.where(F.col("payload_bytes") == 17 << 20).count() == 2


def test_assembly_follows_chains(spark):
    rows = [("r", "response", [], b"R"), ("q", "request", ["r"], b"Q"), ("m", "metadata", ["q"], b"M"), ("r2", "response", ["q2"], b"R2"), ("q2", "request", [], b"Q2"), ("lost", "metadata", ["none"], b"")]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>, block binary")
    got = {r.record_id: (r.request and bytes(r.request.block), r.metadata and bytes(r.metadata.block)) for r in warc.assemble(df, ("block",)).collect()}
    assert got == {"r": (b"Q", b"M"), "r2": (b"Q2", None)}


# ---- lists


def test_lists(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x", "2020-01-05"), (2, "http://a.b.com", "2020-02-05"), (3, "http://B.com:80/", "2020-02-05"), (4, None, "2020-02-05"), (5, "http://b.com", None), (6, "x", "2020-01-01"), (1, "http://a.b.com/x", "2020-01-05")], "page_id long, url string, d string").select("page_id", "url", F.col("d").cast("date").alias("day"), F.lit(0).alias("pattern"))
    entries = spark.createDataFrame([("b.com", "2020-01-01", "block"), ("b.com", "2020-01-01", "allow"), ("b.com", "2020-01-01", "block"), ("a.b.com", "2020-02-01", "allow"), ("b.com", "2020-02-03", "remove"), (None, "2020-01-01", "block")], "pattern string, d string, action string").select("pattern", F.col("d").cast("date").alias("day"), "action")
    got = sorted((r.page_id, r.verdict) for r in url_lists.evaluate(captures, entries).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow"), (3, "none"), (4, "none"), (5, "none"), (6, "none")]
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_lists.evaluate(captures, entries.limit(0)).collect()} == {"none"}


# ---- near duplicates


def brute_roots(ids, fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: best[find(i)] for i, d in enumerate(ids)}


@pytest.mark.parametrize("distance, crowd", [(0, 64), (1, 64), (2, 64), (1, 2), (2, 2)])
def test_link_is_exact(spark, monkeypatch, distance, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(8)} | {0, 1, 7})
    want = brute_roots(list(range(len(fps))), fps, distance)
    got = {r.node: r.root for r in simhash.link(spark, spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"), distance).collect()}
    classes = lambda of: sorted(sorted(v) for v in _grouped(of).values())
    assert classes({f: want[i] for i, f in enumerate(map(simhash.signed, fps))}) == classes({simhash.signed(f): got.get(simhash.signed(f), simhash.signed(f)) for f in fps})


def _grouped(of):
    out = collections.defaultdict(list)
    for k, v in of.items():
        out[v].append(k)
    return out


def test_simhash_query(spark, pdocs):
    import xxhash

    got = simhash.op9_simhash(spark, SF).toPandas().set_index("doc_id")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = []
    for text in pdocs.text:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert [f"{f:016x}" for f in fps] == got.loc[pdocs.index].fingerprint.tolist()
    assert brute_roots(pdocs.index.tolist(), fps, 2) == got.component_id.to_dict()


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    costs = [{t: float(rng.random()) * (t + 1) ** 2 for t in range(-1, 3)} for _ in range(3)]
    gains = [{t: t + 1 for t in range(-1, 3)}] * 3
    brute = min(sum(c[t] for c, t in zip(costs, ts)) for ts in np.ndindex(4, 4, 4) for ts in [tuple(x - 1 for x in ts)] if sum(ts) + 3 >= 3)
    assert abs(simhash.allocate(costs, gains, 3)[1] - brute) < 1e-12


def test_near_dedup_is_exact(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    root = simhash.near_classes(spark, docs).toPandas().set_index("doc_id").root
    p = docs.toPandas()
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in p.text]
    brute = list(range(len(sets)))

    def top(i):
        while brute[i] != i:
            i = brute[i]
        return i

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x == y or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8):
                brute[max(top(a), top(b))] = min(top(a), top(b))
    want = [top(i) for i in range(len(sets))]
    assert len(set(zip(want, root[p.doc_id]))) == len(set(want)) == root.nunique() < len(p)
    kept = simhash.near_dedup(spark, docs).toPandas()
    assert set(kept.doc_id) == set(p.doc_id.groupby(want).min())


def joined(spark, texts, pairs):
    """Whether each pair of texts is in one class."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = simhash.near_classes(spark, docs).toPandas().set_index("doc_id").root
    for a, b in pairs:
        x, y = (set(simhash.shingle_hashes(texts[i], 5).tolist()) for i in (a, b))
        assert len(x & y) / len(x | y) >= 0.8
    return [root[a] == root[b] for a, b in pairs], root.nunique()


@pytest.mark.parametrize("block, crowded, earlier, family", [(50, 10_000, 64, 300), (4000, 10**9, 64, 300), (4000, 100, 64, 40), (4000, 100, 3, 300)])
def test_near_dedup_finds_all_pairs_of_a_template_family(spark, monkeypatch, block, crowded, earlier, family):
    for name, value in {"BLOCK": block, "CROWDED": crowded, "EARLIER": earlier, "FAMILY": family}.items():
        monkeypatch.setattr(simhash, name, value)
    core = [f"core{i}" for i in range(160)]
    own = lambda i: [f"own{i}x{j}" for j in range(40)]  # noqa: E731  any two are at about 0.65
    texts = [" ".join(core + own(i)) for i in range(600)]
    texts += [" ".join(core + own(i)[:20] + [f"end{i}x{j}" for j in range(20)]) for i in range(300)]
    got, classes = joined(spark, texts, [(i, 600 + i) for i in range(300)])
    assert all(got) and classes == 600


def test_near_dedup_of_a_family_at_the_limit_is_exact(spark, monkeypatch):
    """Copies with a few changed words each, similar at 0.6 to 1: some reach the limit, and chains of them join the rest."""
    monkeypatch.setattr(simhash, "CROWDED", 200)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(250):
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 5), replace=False):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words[: 150 - int(rng.integers(0, 25))]))
    root = simhash.near_classes(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").root
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    brute = list(range(len(texts)))

    def top(i):
        while brute[i] != i:
            i = brute[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                brute[max(top(a), top(b))] = min(top(a), top(b))
    want = [top(i) for i in range(len(sets))]
    assert 1 < len(set(want)) < 100 and len(set(zip(want, root[range(len(sets))]))) == len(set(want)) == root.nunique()


def test_near_dedup_finds_short_pairs(spark):
    words = [[f"w{i}x{j}" for j in range(9)] for i in range(300)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:8]) for w in words]  # five and four shingles
    got, classes = joined(spark, texts, [(i, 300 + i) for i in range(300)])
    assert all(got) and classes == 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: i // 20 * 20 for i in range(60)}


# ---- mixing


def test_rake_meets_margins():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 100, (4, 3, 5)).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in counts.shape]
    x = mixing.rake(counts, targets)
    for axis, t in enumerate(targets):
        assert np.allclose(x.sum(axis=tuple(i for i in range(3) if i != axis)), t, atol=1e-8)
    ratio = np.log(x / counts)  # raking keeps the interactions
    assert np.allclose(ratio - ratio[:1] - ratio[:, :1] + ratio[:1, :1], (ratio - ratio[:1] - ratio[:, :1] + ratio[:1, :1])[..., :1])


def test_sample_meets_targets(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = mixing.mixed(spark, docs, {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}).toPandas()
    assert got.probability.max() <= 1
    expected = (got.n_tokens * got.probability).groupby(got.lang).sum()
    assert np.allclose(expected / expected.sum(), [0.2, 0.4, 0.2, 0.2], atol=1e-6)
    drawn = got[got.sampled].groupby("lang").n_tokens.sum()
    assert np.allclose(drawn / drawn.sum(), [0.2, 0.4, 0.2, 0.2], atol=0.05)


@pytest.mark.parametrize("driver_cells, keep", [(200_000, None), (0, None), (0, 0.5)])
def test_all_categories_are_raked(spark, monkeypatch, driver_cells, keep):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", driver_cells)
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 200_000 if driver_cells else 100)
    rows = [(i, "some words of one topic " * (1 + (600 - i % 600) // 50), f"s{i % 600}", "en" if i % 7 else "de") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mixed(spark, docs, {"source": {"s599": 0.1, "s598": 0.002}}, keep).toPandas()
    assert len(got) == 2400
    weighted = (got.n_tokens * got.weight).groupby(got.source).sum() / got.n_tokens.sum()
    own = got.n_tokens.groupby(got.source).sum() / got.n_tokens.sum()
    whole = 0.102 + own.drop(["s599", "s598"]).sum()
    assert np.allclose([weighted.s599, weighted.s598, weighted.s0, weighted.s450], [0.1 / whole, 0.002 / whole, own.s0 / whole, own.s450 / whole], atol=1e-8)
    expected = (got.n_tokens * got.probability).sum() / got.n_tokens.sum()
    assert got.probability.max() <= 1 and (abs(expected - 0.5) < 1e-6 if keep else got.probability.max() == 1)

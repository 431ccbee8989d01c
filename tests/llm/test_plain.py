"""The operators against plain versions of their methods, and the values they give for nulls, repeats and odd texts."""

import collections
import struct
import zlib

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import matrices, mixing, outliers, packing, pii, quality, simhash, url_lists, warc
from spanloom.llm.common import Stash, scratch, shared_dir, table
from spanloom.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, with columns that clash with the operators' own."""
    long = "word other thing. " * 20000
    rows = [(1, "a b c d e f g h i j k l", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (5, long, "de", "s"), (6, long, "de", "s"), (7, "a b c d e f g h i j k l", "en", "s"),
            (7, "a b c d e f g h i j k l", "en", "s"), (None, "no key 4111 1111 1111 1111 here", "en", "t"), (None, None, None, None), (9, "émail joe@site.example.org 10.0.0.1 +1 (297) 555-8151", "fr", "s")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("node", "root", "kind", "part", "shard", "place", "hub", "at_id", "key", "n_tokens", "gone_id", "salt", "bucket"):
        df = df.withColumn(c, F.lit(None).cast("long"))
    return df


# ---- quality


def test_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(2)
    for shift, prior in ((0.0, 0.5), (3.0, 0.5), (-3.0, 0.9)):  # the last has its negatives' part below zero
        fp, fu = rng.normal(1 - shift, 1, 7), rng.normal(shift, 1, 9)
        objective = lambda f: (lambda p, n: p + n if whole else -n)(*quality.risk(f[:7], f[7:], prior))  # noqa: B023, E731
        whole = quality.risk(fp, fu, prior)[1] >= 0
        f = np.concatenate([fp, fu])
        plain = [(objective(f + 1e-6 * e) - objective(f - 1e-6 * e)) / 2e-6 for e in np.eye(len(f))]
        assert np.allclose(quality.slopes(fp, fu, prior), plain, atol=1e-7)
    assert quality.risk(rng.normal(4, 1, 7), rng.normal(-3, 1, 9), 0.9)[1] < 0


def test_scores_are_those_of_a_plain_fit(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    p, q = docs.toPandas(), labels.toPandas()
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in p.doc_id}
    good = [k for k in q[q.quality == 1].doc_id if not held[k]]
    text = p.set_index("doc_id").text
    x = np.array([quality.statistics(t) for t in [*(text[k] for k in good), *(text[k] for k in p.doc_id if not held[k])]])
    positive = np.arange(len(x)) < len(good)
    order = np.lexsort((positive, *x.T))
    x, positive = x[order], positive[order]
    mix = np.random.default_rng(quality.SEED).permutation(len(x))
    x, positive = x[mix], positive[mix]
    net = quality.fit(x[positive], x[~positive], quality.estimate_prior(x[positive], x[~positive]))
    got = quality.op1_quality(spark, SF).toPandas().set_index("doc_id")
    want = net.score(np.array([quality.statistics(t) for t in p.text]))
    assert np.allclose(got.score[p.doc_id], want, atol=0.05) and got.held_out.to_dict() == held
    assert (got.predicted == (got.score >= 0.3)).all()


def test_quality_without_unlabelled_texts(spark):
    """Every text has a label: the scores still tell good from bad."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels").where("quality is not null")
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality.classify(own, labels).join(labels, "doc_id").toPandas()
    assert got.score.nunique() > 100 and got[got.quality == 1].score.median() > 0.8 > 0.3 > got[got.quality == 0].score.median()
    assert {r.score for r in quality.classify(docs.limit(5), labels.where("quality = 0")).collect()} == {0.5}


# ---- outliers


def plain_estimate(x, prior=None):
    """The same estimate with numpy, for one group."""
    p, floor = x.shape[1], np.diag(np.array(outliers.FLOOR) ** 2)

    def quantile(v, q):
        b = np.sort(np.floor(v * 64))
        return (b[np.flatnonzero(np.arange(1, len(b) + 1) / len(b) >= q - 1e-12)[0]] + 0.5) / 64

    med = np.array([quantile(v, 0.5) for v in x.T])
    scale = np.array([np.sqrt(((quantile(v, 0.75) - quantile(v, 0.25)) / 1.349) ** 2 + f**2) for v, f in zip(x.T, outliers.FLOOR)])
    z = (x - med) / scale
    found = []
    for scores in (None, np.tanh(z), z / np.sqrt((z**2).sum(1) + 1e-12)[:, None]):
        shape = np.eye(p)
        if scores is not None:
            q = scores.T @ scores
            d = np.sqrt(np.diag(q) + 1e-9)
            shape = len(x) / (len(x) + outliers.PRIOR) * q / np.outer(d, d)
            np.fill_diagonal(shape, 1)
        found.append((np.inf, med, shape * np.outer(scale, scale)))

    def step(mean, cov):
        d2 = ((x - mean) * np.linalg.solve(cov, (x - mean).T).T).sum(1)
        bins = np.minimum(np.floor(32 * np.log2(1 + d2)), outliers.BINS - 1)
        nearer = np.array([(bins < b).sum() for b in bins])
        own = x[nearer < outliers.SHARE * len(x)]
        m, c = own.mean(0), outliers.CONSISTENT * np.cov(own.T, bias=True)
        if prior is not None:
            w = len(own) / (len(own) + outliers.PRIOR)
            c = w * c + (1 - w) * prior[1] + w * (1 - w) * np.outer(m - prior[0], m - prior[0])
            m = w * m + (1 - w) * prior[0]
        return np.linalg.slogdet(c + floor)[1], m, c + floor

    for _ in range(outliers.TRIALS):
        found = [step(*f[1:]) for f in found]
    best = min(found, key=lambda f: f[0])
    last = np.inf
    while last - best[0] >= 1e-6 * max(1.0, abs(best[0])):
        last, best = best[0], step(*best[1:])
    return best[1], best[2], floor


def test_estimate_is_the_plain_one(spark):
    """A group alone, so that the stopping rule, which looks at all groups, is the same."""
    rng = np.random.default_rng(8)
    for n, prior in ((60, True), (500, False), (7, True)):
        x = rng.normal(0, 1, (n, 5)) @ np.triu(rng.normal(0.3, 0.4, (5, 5)), 1) + rng.normal(0, 1, (n, 5)) * 3
        x[: n // 8] += 30
        u, t = np.arange(5) / 3, np.diag(np.arange(1, 6) / 2.0)
        row = spark.range(1).select(*(F.lit(float(v)).alias(f"u{i}") for i, v in enumerate(u)), *(F.lit(float(t[i, j])).alias(f"t{i}_{j}") for i, j in outliers.lower()))
        df = spark.createDataFrame([("g", *map(float, v)) for v in x], "pool string, " + ", ".join(f"{c} double" for c in outliers.COORDINATES))
        got = outliers.estimate(spark, df, row if prior else None).first()
        mean, cov, _ = plain_estimate(x, (u, t) if prior else None)
        low = np.array([[got[f"l{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([got[f"m{i}"] for i in range(5)], mean, atol=1e-6) and np.allclose(low @ low.T, cov, atol=1e-6)


def test_small_groups_have_estimates_of_their_own(spark):
    """Groups of 20 to 99 rows whose usual texts differ; in each, one text as the other has them."""
    short, long = " ".join(f"w{i}" for i in range(12)), lambda k: " ".join(f"longerword{k}x{i}" for i in range(3000))
    rows = [(i, short + f" {i}", "en", "short") for i in range(80)] + [(100, long(1), "en", "short")] + [(200 + i, long(i), "en", "long") for i in range(40)] + [(300, short, "en", "long")]
    got = outliers.judge(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id").sort_index()
    d = got.distance2
    assert d.notna().all() and d[100] > 10 * d.loc[0:79].max() and d[300] > 4 * d.loc[200:239].max()  # the smaller, the nearer to the whole table's


# ---- packing


def plain_two_fit(lengths, capacity):
    """Bins one by one over the lengths themselves."""
    left, bins = sorted(lengths), []
    while left:
        inside, gap = [], capacity
        for n in sorted(left, reverse=True):
            if n <= gap:
                inside.append(n)
                gap -= n
        for n in inside:
            left.remove(n)
        while gap:
            least = min(inside)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= gap + least]
            if not pairs:
                break
            total, a, b = max(pairs)
            inside.remove(least)
            left.remove(a)
            left.remove(b)
            left.append(least)
            inside += [a, b]
            gap += least - total
        bins.append(sorted(inside))
    return bins


def test_plan_is_the_plain_two_fit():
    rng = np.random.default_rng(6)
    for _ in range(40):
        lengths = rng.integers(1, 40, rng.integers(1, 60)).tolist()
        plan = packing.make_plan(np.bincount(lengths, minlength=61), 60)
        got = collections.defaultdict(list)
        for n in set(lengths):
            k = lengths.count(n)
            for where in zip(*plan.place(np.full(k, n), np.arange(k))):
                got[int(where[0])].append((int(where[1]), n))
        plain = plain_two_fit(lengths, 60)
        for inside in got.values():  # gapless
            assert [a for a, _ in sorted(inside)] == [0, *np.cumsum([n for _, n in sorted(inside)])[:-1]]
        assert abs(len(got) - len(plain)) <= 1
        first = sorted(n for _, n in got[0])  # before counts change what repeats, the very same bin
        assert sum(first) == sum(plain[0])


def test_packed_ids_of_odd_rows(spark, odd):
    """Every row of its own, nulls and repeats too, comes back whole from sequences and matrices."""
    e = Encoder(tokenizer_path())
    want = collections.Counter(e.whole(r.text or "") + bytes(4) for r in odd.collect())
    rows = packing.pack(spark, odd, with_ids=True).collect()
    seen = collections.defaultdict(list)
    for r in rows:
        seen[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
    assert all([a for a, _ in sorted(v)] == [0, *np.cumsum([n for _, n in sorted(v)])[:-1]] for v in seen.values())
    assert sum((len(r.ids) for r in rows)) == sum(len(k) * n for k, n in want.items())
    short = collections.Counter(bytes(r.ids) for r in rows if r.start == 0 and r.length < packing.CAPACITY)
    assert short == collections.Counter({k: n for k, n in want.items() if len(k) < 4 * packing.CAPACITY})
    got = collections.Counter()
    for r in matrices.matrices(odd).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        for s, a, b in zip(r.starts, r.cumulative_lengths, r.cumulative_lengths[1:]):
            if s == 0 and b - a < packing.CAPACITY:
                got[ids[a:b].astype("<u4").tobytes()] += 1
    assert got == short


def test_other_tokenizers_read_texts_whole():
    texts = ["Two  Words\n", "don't UPPER 42", ""]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = Encoder(tokenizer_path(name))
        assert e.by_words == name.startswith("word") and e.ids(texts) == [e.whole(t) for t in texts]


def test_rank_bases_joined_or_broadcast(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    many = packing.pack(spark, docs).agg(F.count("*"), F.countDistinct("sequence_id"), F.sum("offset")).first()
    monkeypatch.setattr(packing, "BROADCAST_CELLS", -1)
    joined = packing.pack(spark, docs)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().simpleString() and joined.agg(F.count("*"), F.countDistinct("sequence_id"), F.sum("offset")).first()[:2] == many[:2]


# ---- mixing


def test_mixed_is_plain_raking(spark):
    docs = table(spark, SF, "documents")
    got = mixing.mixed(spark, docs, {"lang": {"en": 0.4, "de": 0.6}}, 0.5).toPandas().set_index("doc_id")
    p = docs.toPandas()
    told = [mixing.topic_of(t or "") for t in p.text]
    cells = collections.Counter()
    for n, s, lang, (_, topic) in zip([n for n, _ in told], p.source, p.lang, told):
        cells[s, lang, topic] += n
    total = sum(cells.values())
    aims = []
    for i, given in enumerate((None, {"en": 0.4, "de": 0.6}, None)):
        own = collections.Counter()
        for k, n in cells.items():
            own[k[i]] += n / total
        want = {k: (given.get(k, v) if given else v**mixing.FLATTEN) for k, v in own.items()}
        aims.append({k: v / sum(want.values()) for k, v in want.items()})
    x = {k: n / total for k, n in cells.items()}
    for _ in range(2000):
        for i, aim in enumerate(aims):
            sums = collections.Counter()
            for k, v in x.items():
                sums[k[i]] += v
            x = {k: v * aim[k[i]] / sums[k[i]] for k, v in x.items()}
    weight = {k: x[k] * total / n for k, n in cells.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        kept = sum(min(1, mid * weight[k]) * n / total for k, n in cells.items())
        low, high = (mid, high) if kept < 0.5 else (low, mid)
    for doc_id, s, lang, (n, topic) in zip(p.doc_id, p.source, p.lang, told):
        r = got.loc[doc_id]
        chance = min(1, high * weight[s, lang, topic])
        assert r.n_tokens == n and r.topic == topic and abs(r.weight - weight[s, lang, topic]) < 1e-5 and abs(r.probability - chance) < 1e-5
        h = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), xxhash.xxh64_intdigest(str(doc_id), 42))
        drawn = (h & ((1 << 53) - 1)) / (1 << 53)
        assert r.sampled == (drawn < r.probability)


# ---- stages and tables of odd rows


def test_stages_on_odd_rows(spark, odd):
    text = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    assert text(simhash.near_dedup(spark, odd)) == collections.Counter({k: 1 for k in text(odd) if k[0] not in (6, 7, 3, None) or k == (None, "no key 4111 1111 1111 1111 here")})
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(odd).where("doc_id is not null").collect()}
    assert masked[9][0] == "émail [EMAIL] [IP] [PHONE]" and masked[9][1] == len(masked[9][0]) and masked[2] == (None, None) and masked[3] == ("", 0)
    kept = mixing.sampled(spark, odd, keep_share=1.0)
    assert text(kept) == text(odd) and kept.columns == odd.columns
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    for stage in (quality.accepted(odd, labels), simhash.near_dedup(spark, odd), pii.redact(odd)):
        assert stage.columns == odd.columns


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = {p.name for p in _folder(spark)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, 5, 6, 7, 9, None}
    # what stages left on the way is gone; the documents before packing and packing's own tables stay for the reader
    assert {p.name.split("-")[0] for p in _folder(spark) if p.name not in before} <= {"pipeline", "pieces"}


def _folder(spark):
    from pathlib import Path

    return list(Path(shared_dir(spark).removeprefix("file:")).iterdir())


def test_scratch_takes_what_is_written_inside(spark):
    with scratch(spark):
        a = Stash(spark, "inside").put(spark.range(3))
        kept = Stash(spark, "kept", lasting=True).put(a)
    assert kept.count() == 3 and not [p for p in _folder(spark) if p.name.startswith("inside-")]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_lists_and_archives_with_clashing_columns(spark):
    long = "x" * 300_000
    pages = spark.createDataFrame([(1, "http://a.b.com/x", long), (2, "http://a.b.com/x", long), (3, None, None), (None, "http://c.com/" + "y" * 50_000, "z")], "page_id long, url string, html string")
    for c in ("row", "sha", "holder", "salt", "host", "pattern", "month", "value"):
        pages = pages.withColumn(c, F.lit("odd"))
    got = {(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.archived(spark, pages).collect()}
    assert got == {(2, "response", 300_000, None), (1, "revisit", 300_000, 2), (3, "response", 0, None), (None, "response", 1, None)}
    captures = pages.withColumn("day", F.lit("2020-01-05").cast("date"))
    entries = spark.createDataFrame([("b.com", "2020-01-01", "block", "odd"), ("com", "2019-01-01", "allow", "odd")], "pattern string, d string, action string, salt string").withColumn("day", F.col("d").cast("date"))
    assert sorted((r.page_id or 0, r.verdict) for r in url_lists.evaluate(captures, entries).collect()) == [(0, "allow"), (1, "block"), (2, "block"), (3, "none")]


def test_lists_are_those_of_all_pairs(spark):
    """Every capture against every entry."""
    rng = np.random.default_rng(3)
    hosts = ["a.b.com", "b.com", "c.b.com", "x.org", "com", "d.a.b.com"]
    days = [f"2020-{m:02}-{d:02}" for m in range(1, 13) for d in (1, 9, 28)]
    entries = [(str(rng.choice(hosts)), str(rng.choice(days)), str(rng.choice(["block", "allow", "remove"]))) for _ in range(60)]
    captures = [(i, f"http://{rng.choice(hosts)}/p{i}", str(rng.choice(days))) for i in range(400)]
    strict = {"block": 2, "allow": 1, "remove": 0}
    daily: dict = {}
    for pattern, day, action in entries:
        daily[pattern, day] = max(daily.get((pattern, day), "remove"), action, key=strict.get)
    want = {}
    for i, url, day in captures:
        host, verdict = url.split("/")[2], ("", "none")
        for pattern in hosts:
            if host == pattern or host.endswith("." + pattern):
                told = [(d, a) for (p, d), a in daily.items() if p == pattern and d <= day]
                if told and max(told)[1] != "remove":
                    verdict = max(verdict, (pattern, max(told)[1]), key=lambda v: len(v[0]))
        want[i] = verdict[1]
    c = spark.createDataFrame(captures, "page_id long, url string, d string").withColumn("day", F.col("d").cast("date"))
    e = spark.createDataFrame(entries, "pattern string, d string, action string").withColumn("day", F.col("d").cast("date"))
    assert {r.page_id: r.verdict for r in url_lists.evaluate(c, e).collect()} == want

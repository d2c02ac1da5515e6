"""WARC files and the epsilon grid order join against brute force, and their edge cases."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import egojoin, warc
from querent.runtime import fresh_path

PAGES = "page_id long, url string, html string, shard string, kind int"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "a b\r\nc", ""), (102, "http://é", "é" * 5000), (102, "http://é", "é" * 5000), (103, "u", "x" * 200_000), (None, "n", "<p>1</p>"), (104, "v", "x" * 200_000)]
    return spark.createDataFrame([(*r, "s", 1) for r in rows], PAGES)


@pytest.mark.parametrize("least", [0, 12])
def test_warc(spark, pages, least):
    rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    latest = defaultdict(lambda: None)
    for i, h in rows:
        latest[h] = max((x for x in (latest[h], i) if x is not None), default=None)
    want = Counter()
    for i, h in rows:
        first = len(h.encode()) < least or i == latest[h]
        want[i, len(h.encode()), digest(h), "response" if first else "revisit", None if first else latest[h]] += 1
    files = []
    for _ in range(2):
        path = fresh_path(spark, "warc-test")
        manifest = warc.write(pages.repartition(4), path, least_bytes=least, shard_bytes=4000, roll_bytes=1500)
        got = warc.read(spark, path)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == want
        files.append(sorted((r["name"], r["sha256"], r["records"]) for r in manifest.collect()))
        payloads = {(r["page_id"], bytes(r["payload"])) for r in got.filter("record_type = 'response'").collect()}
        assert all((i, h.encode()) in payloads for i, h in rows if i == latest[h])
    assert files[0] == files[1] and len(files[0]) > 3 and sum(f[2] for f in files[0]) == len(rows)


def test_warc_empty_and_damage(spark, pages):
    path = fresh_path(spark, "warc-test")
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0
    data = warc.record(1, "u", b"payload", None) + warc.record(2, "u", b"payload", 9)
    records = list(warc.read_records(data))
    assert [h["WARC-Type"] for h, _ in records] == ["response", "revisit"] and records[0][1].endswith(b"payload")
    with pytest.raises(ValueError):
        list(warc.read_records(data[:-5]))
    for n in (1, 7, 64, 10_000):  # members end anywhere in a window
        assert list(warc.read_records(data[i : i + n] for i in range(0, len(data), n))) == records
    bad = bytearray(data)
    bad[60] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(warc.read_records(bytes(bad)))


def test_warc_manifest(spark, pages):
    """Files that the manifest doesn't name are not read; files that differ from it are refused."""
    path = fresh_path(spark, "warc-test")
    name = warc.write(pages, path).first()["name"]
    there = f"{path}/data".removeprefix("file://")
    with open(f"{there}/stray.warc.gz", "wb") as f:
        f.write(warc.record(999, "u", b"stray", None))
    assert warc.read(spark, path).count() == pages.count()
    with open(f"{there}/{name}", "ab") as f:
        f.write(warc.record(999, "u", b"appended", None))
    with pytest.raises(Exception, match="manifest names"):
        warc.read(spark, path).count()


def test_warc_range_order(spark):
    """Ids of a shard lie between those of its neighbours, also where all ids are in one bucket or at the ends of the range."""
    near = [5 * 10**9 + 1000 * i for i in range(300)]
    for ids in ([0, *near], [*near, -(2**63), 2**63 - 1]):
        rows = [(i, "u", f"{i}" + "x" * 300) for i in ids] + [(near[99], "u", "same")] * 60
        path = fresh_path(spark, "warc-test")
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        warc.write(df, path, shard_bytes=8000)
        got = warc.read(spark, path, payloads=False)
        assert got.count() == len(rows)
        spans = sorted((r["shard"], r["low"], r["high"]) for r in got.groupBy(F.expr("regexp_replace(file, '-[0-9]{5}.warc.gz', '')").alias("shard")).agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).collect())
        assert len(spans) > 5
        whole = [x for x in spans if x[0].count("-") < 3]  # cells larger than a shard are dealt
        assert all(a[2] <= b[1] for a, b in zip(whole, whole[1:], strict=False)) and (ids[0] or len(whole) > 5)
        assert max(r["n"] for r in got.filter(f"page_id = {near[99]}").groupBy("file").agg(F.count("*").alias("n")).collect()) < 60


def brute(rows, cosine):
    units = {}
    for k, (_, v) in enumerate(rows):
        x = None if v is None else np.array([np.nan if c is None else c for c in v], float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            units[k] = x / np.linalg.norm(x)
    n = max(map(len, units.values()), default=0)
    units = {k: np.pad(u, (0, n - len(u))) for k, u in units.items()}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in units:
        for b in units:
            if b < a and units[a] @ units[b] >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min((x for x in (low.get(find(k)), i) if x is not None), default=None)
    return Counter((i, links[k], low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def test_egojoin(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.25 * rng.standard_normal(16)).tolist()) for i in range(300)]
    rows += [(300 + i, rng.standard_normal(16).tolist()) for i in range(60)]
    rows += [(400 + i, rows[0][1]) for i in range(5)] + [(7, rows[1][1]), (None, rows[2][1])]
    rows += [(500, None), (501, [0.0] * 16), (502, [1.0, None] + [0.0] * 14), (503, [float("nan")] * 16), (504, [float("inf")] * 16), (505, []), (506, [1.0, 2.0]), (507, [2.0, 4.0, 0.0]), (508, [1e-30] * 16), (509, [1e30] * 16)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, vec string")
    got = Counter(tuple(r) for r in egojoin.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows, 0.9)
    assert egojoin.near_duplicates(df.limit(0)).count() == 0
    single = df.withColumn("embedding", df["embedding"].cast("array<float>"))
    rows = [(r["vec_id"], r["embedding"]) for r in single.collect()]
    assert Counter(tuple(r) for r in egojoin.near_duplicates(single).select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows, 0.9)


def test_egojoin_recursion(monkeypatch):
    """Tiles, halves and skipped boxes lose no link, for one leaf with itself and for two."""
    monkeypatch.setattr(egojoin, "TILE", 8)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes, w = np.linalg.qr(rng.standard_normal((6, 6)))[0], rng.integers(1, 4, 150)
    for cosine in (0.5, 0.9):
        hits = x @ x.T >= cosine
        nx, _, hi, lo = egojoin.join_leaves(x, x, w, w, True, axes, cosine)
        assert (nx == hits @ w - w).all()
        a, b = x[:90], x[90:]
        na, nb, hi, lo = egojoin.join_leaves(a, b, w[:90], w[90:], False, axes, cosine)
        cross = hits[:90, 90:]
        assert (na == cross @ w[90:]).all() and (nb == w[:90] @ cross).all() and len(hi) == len(lo)


def test_interval_pairs(spark, monkeypatch):
    """Several leaves and tree levels: every pair of boxes within epsilon is found, no other."""
    monkeypatch.setattr(egojoin, "FAN", 3)
    rng = np.random.default_rng(5)
    low = rng.uniform(-1, 1, (40, 2))
    high = low + rng.uniform(0, 0.2, (40, 2))
    boxes = spark.createDataFrame([(int(i * 2), low[i].tolist(), high[i].tolist()) for i in range(40)], "leaf long, lo array<double>, hi array<double>")
    got = {(r["a"], r["b"]) for r in egojoin._pairs(boxes, 2, 0.3).collect()}
    want = set()
    for i in range(40):
        for j in range(i, 40):
            gap = np.maximum(0, np.maximum(low[i] - high[j], low[j] - high[i]))
            if gap @ gap <= (0.3 + egojoin.SLACK) ** 2:
                want.add((2 * i, 2 * j))
    assert got == want

"""Winnowing, weighted clustering and Merkle manifests: brute force, odd rows, hot groups."""

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import merkle, token_files, toxicity, warc, weighted_kmeans, winnowing
from tallymark.llm.common import mix64

SF = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while seven grey cats sleep near an old wooden door and nobody minds at all today"
LONG = " ".join(f"word{i % 3000}" for i in range(12_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(1, WORDS, "en", "src1", 9, 1.0), (2, WORDS, "en", "src1", 9, 1.0), (3, WORDS + " Maybe", "fr", "src2", 9, None), (3, WORDS + " Maybe", "fr", "src2", 9, None), (3, "other", "fr", None, 9, None), (4, "", None, None, 0, 1.0), (5, None, "en", "src1", None, 1.0), (6, LONG, "en", "src2", 9, 1.0), (None, "lost words", None, None, 1, 1.0), (None, "lost", "en", None, 1, 1.0), (8, "  \n\t ", "one", "src3", 1, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, path double").withColumn("grp", F.lit(1)).withColumn("guest", F.lit("x")).withColumn("h", F.lit(2))


# Winnowing


@lru_cache(maxsize=4096)
def _winnowed(text: str, k: int, w: int) -> list[tuple[int, int]]:
    codes = [ord(c) + 1 for c in text]
    if not codes:
        return []
    powers = [pow(winnowing._INVERSE, j, 1 << 64) for j in range(k)]
    hashes = [int(mix64(np.array([sum(c * p for c, p in zip(codes[i : i + k], powers, strict=False)) % (1 << 64)], np.uint64))[0]) for i in range(max(1, len(codes) - k + 1))]
    kept = set()
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        kept.add(i + max(j for j, x in enumerate(window) if x == min(window)))
    return [(hashes[i], i) for i in sorted(kept)]


@pytest.mark.parametrize(("k", "w"), [(16, 32), (4, 3), (1, 1), (5, 7), (3, 255)])
def test_winnow_by_brute_force(monkeypatch, k, w):
    monkeypatch.setattr(winnowing, "BLOCK", 50)
    rnd = random.Random(k * w)
    for n in (0, 1, k - 1, k, k + w - 2, k + w - 1, k + w, 300):
        text = "".join(rnd.choice("ab é\U0001f600") for _ in range(n))
        got = winnowing.winnow(text, k, w)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == _winnowed(text, k, w)
        assert all((a == b).all() for a, b in zip(winnowing.decoded(winnowing.encoded(*got)), got, strict=True))


def test_passages_of_the_guaranteed_length_are_matched():
    rnd = random.Random(5)
    draw = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    for _ in range(50):
        shared = draw(winnowing.K + winnowing.WINDOW - 1)
        a, b = draw(rnd.randrange(400)), draw(rnd.randrange(400))
        x, y = (winnowing.encoded(*winnowing.winnow(s)) for s in (a + shared + draw(90), b + shared + draw(50)))
        found = winnowing.matches(x, y)
        assert found and all(p - len(a) == q - len(b) for p, q, _ in found)
    assert winnowing.matches("", x) == []


def _compared(rows: list[tuple]) -> Counter:
    """(doc_id, n_chars, sha, likenesses) of (doc_id, text) in order."""
    out = Counter()
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        sets = [{h for h, _ in _winnowed(s, winnowing.K, winnowing.WINDOW)} for s in (t, new, nxt)]
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[k, len(t), hashlib.sha256(new.encode()).hexdigest(), alike(sets[0], sets[1]), alike(sets[0], sets[2])] += 1
    return out


def _got(df) -> Counter:
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect())


def test_query_winnowing_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: -r[0])
    from tallymark.llm.queries import QUERIES

    assert _got(QUERIES["op11_winnowing"](spark, SF)) == _compared(rows)
    got = winnowing.fingerprints(docs).collect()
    by_text = dict(rows)
    assert all(r.n_hashes == len(_winnowed(by_text[r.doc_id] or "", winnowing.K, winnowing.WINDOW)) for r in got[:20]) and len(got) == len(rows)


def test_ranges_of_ids_of_any_kind_and_number(spark):
    rows = [(k * k % 1009, f"text number {k} " * (k % 7)) for k in range(300)]
    order = sorted(((k, t) for k, t in rows), key=lambda r: -r[0])
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    seen = {}
    for k, t in order:
        seen.setdefault(k, t)
    order = list(seen.items())
    try:
        for n in (1, 3, 150):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert _got(winnowing.compared(spark.createDataFrame(order, "doc_id long, text string"))) == _compared(order)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    named = [(f"k{k:04}", t) for k, t in order]
    assert _got(winnowing.compared(spark.createDataFrame(named, "doc_id string, text string"))) == _compared(named)


def test_odd_rows_winnowing(odd):
    h = {t: x for t, x in odd.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    assert _got(winnowing.compared(odd)) == _compared(rows)
    assert winnowing.compared(odd.limit(0)).count() == 0
    assert _got(winnowing.compared(odd.where("doc_id = 4"))) == _compared([(4, "")])
    lost = [r for r in rows if r[0] is None]
    assert _got(winnowing.compared(odd.where("doc_id IS NULL"))) == _compared(lost)
    assert winnowing.fingerprints(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="byte"):
        winnowing.fingerprints(odd, w=256)


# Weighted clustering


def _lloyd(vectors: dict, k: int, rounds: int) -> tuple[dict, list]:
    q = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in vectors.items()}
    first = sorted(q, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    centroids = [q[i] for i in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {i: near(v)[1] for i, v in q.items()}
        for n in range(len(centroids)):
            mine = [q[i] for i in q if own[i] == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return {i: near(v)[::-1] for i, v in q.items()}, centroids


def test_clusters_by_brute_force(spark):
    rnd = random.Random(3)
    copies = [[rnd.uniform(-2, 2) for _ in range(4)] for _ in range(12)]
    vectors = {k: copies[0] if k % 3 == 0 else copies[k % 12] if k % 5 else [rnd.uniform(-2, 2) for _ in range(4)] for k in range(400)}
    for n, scale in ((8, 1), (3, 1), (8, 50_000)):  # the last needs more than the integers that doubles hold
        scaled = {k: [x * scale for x in v] for k, v in vectors.items()}
        want, centroids = _lloyd(scaled, n, 4)
        df, got_centroids = weighted_kmeans.clustered(spark.createDataFrame(list(scaled.items()), "vec_id long, embedding array<double>"), clusters=n, rounds=4, dim=4)
        got = df.collect()
        assert got_centroids.tolist() == centroids
        assert {r.vec_id: (r.cluster, r.distance) for r in got} == want and len(got) == 400
        for r in got:
            mine = [d for c, d in want.values() if c == r.cluster]
            assert r.cluster_inertia == sum(mine) and r.inertia == sum(d for _, d in want.values())
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [5.0, 2.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (None, [0.0, 0.0], 1), (8, [-0.0, -1e-9], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").withColumn("q", F.lit("x")).withColumn("n", F.lit(5))
    got, centroids = weighted_kmeans.clustered(df, dim=2)
    assert sorted((r.vec_id or 0, r.distance) for r in got.collect()) == [(0, 0), (1, 0), (1, 0), (1, 0), (8, 0)] and len(centroids) == 5
    empty, none = weighted_kmeans.clustered(df.where("vec_id = 2"), dim=2)
    assert empty.count() == 0 and empty.columns == got.columns and len(none) == 0
    with pytest.raises(Exception, match="beyond"):
        weighted_kmeans.clustered(spark.createDataFrame([(1, [1e300, 1.0])], "vec_id long, embedding array<double>"), dim=2)


def test_common_vectors_are_joined_by_broadcast(spark):
    rows = [(k, [1.0, 2.0] if k % 3 else [float(k), 0.0]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, _ = weighted_kmeans.clustered(df, dim=2)
    assert got.count() == 3000 and len({r.cluster for r in got.where("vec_id % 3 <> 0").select("cluster").distinct().collect()}) == 1
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


# Merkle manifests


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _framed(*values) -> str:
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def _tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and, for each leaf, its siblings to the left and right, level by level."""
    paths: list[list] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        nodes = [_h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def _verified(rows: list[tuple]) -> Counter:
    """What the query gives for (doc_id, source, lang, n_chars, text)."""
    by_lang: dict = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _h(_framed(*r)), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _tree([leaf for *_, leaf, _ in sorted(by_lang[x], key=lambda y: y[:3])]) for x in langs}
    root, upper = _tree([trees[x][0] for x in langs])
    out: Counter = Counter()
    for x, above in zip(langs, upper, strict=True):
        for (*_, leaf, r), path in zip(sorted(by_lang[x], key=lambda y: y[:3]), trees[x][1], strict=True):
            shown = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                shown = _h(_framed(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path + above:
                shown = _h(left, shown, right)
            out[r[0], leaf, trees[x][0], root, _h(*(a + b for a, b in path + above)), shown, shown == root] += 1
    return out


def _proved(df) -> Counter:
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def _shown():
    return F.when(merkle.crc_mod(F.col("doc_id"), 3) == 0, merkle.leaf(*[F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS]))


def test_odd_rows_merkle(odd):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert _proved(merkle.verified(odd, _shown())) == _verified(rows)
    assert merkle.verified(odd.limit(0), _shown()).count() == 0
    lone = merkle.verified(odd.where("doc_id = 8")).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof_sha256 == _h("") and lone.verified


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 600])
def test_manifest_by_brute_force(spark, n):
    # Most rows in one group, and more groups than one run of the upper tree holds.
    rows = [(k * 7919 % 100_003, None if k % 2 else "s", None if k == 4 else "en" if k % 3 else f"l{k % 60:02}", k, f"Text {k}") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _proved(merkle.verified(df, _shown())) == _verified(rows)


def test_levels_are_kept_in_order(spark):
    docs = spark.range(700).select(F.col("id"), F.lit("").alias("grp"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"), F.lit(None).cast("binary").alias("presented"))
    t = merkle.tree(docs)
    assert [x.count() for x in t.levels] == [700, 88, 11, 2, 1]
    for x in t.levels[1:]:
        for rows in x.select("at", F.spark_partition_id().alias("p")).toPandas().groupby("p")["at"]:
            assert rows[1].is_monotonic_increasing


# Stores that only Spark reads, hot payloads and long texts


def test_lookups_of_ids_on_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    """Directory and lookups go by ranges there too: no shard is read as a whole."""
    monkeypatch.setattr(token_files, "SHARD_DOCS", 40)
    monkeypatch.setattr(token_files, "contents", None)  # whole files
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tallyids.link./ids", f"file://{tmp_path}")
    rows = [(k * 3, f"text number {k} " * (k % 5)) for k in range(200)] + [(None, "lost"), (30, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = "viewfs://tallyids/ids/shards"
    token_files.write_ids(docs, path)
    assert not token_files.all_open(token_files.listed(spark, path)) and token_files.listed(spark, path).count() > 4
    got = token_files.lookup(spark, path, [0, 30, 597, 31, -5])
    token_files.write_ids(docs, f"file://{tmp_path}/own")
    want = token_files.lookup(spark, f"file://{tmp_path}/own", [0, 30, 597, 31, -5])
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or (got[k] == want[k]).all()) for k in got)
    assert [k for k, x in got.items() if x is None] == [31, -5]
    ends = lambda p: sorted((r.first, r.last) for r in spark.read.schema(token_files._DIRECTORY).parquet(p + "-directory").collect())
    assert ends(path) == ends(f"file://{tmp_path}/own")


def test_payloads_of_many_pages(spark):
    rows = [(k, "u", "x" * 1500 if k % 3 else f"{k}" * 1500) for k in range(300)] + [(None, "u", "x" * 1500), (299, "u", "x" * 1500), (298, "u", "x" * 1500), (7, "u", None), (500, "u", "y" * 20), (501, "u", "y" * 20)]
    got = sorted((r.page_id if r.page_id is not None else -1, len(r.payload), r.refers_to) for r in warc.resolved(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    latest = max(k for k, _, t in rows if k is not None and t == "x" * 1500)
    assert got == sorted((-1 if k is None else k, len(t or ""), latest if t == "x" * 1500 and k != latest else None) for k, _, t in rows)


def test_one_long_text_keeps_no_other_out(spark):
    """The first text in the order of hashes is larger than the sample may be; the others are learned from."""
    ids = [r.k for r in spark.range(200).select(F.col("id").alias("k")).orderBy(F.xxhash64("id")).collect()]
    bad, good = "you utter zorgblat go away now zorgblat", "the harvest was good this year and all were glad"
    rows = [(k, bad if k % 4 == 0 else good) for k in ids]
    rows[0] = (ids[0], good * 20_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, lambda k: F.lit(True), max_bytes=100_000)
    got = {r.doc_id: r.score for r in toxicity.tag(docs.where(F.length("text") < 1000), model).collect()}
    assert all((s >= 0.5) == (k % 4 == 0) for k, s in got.items())

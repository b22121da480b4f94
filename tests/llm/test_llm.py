"""Operators of the llm folder: brute force, exact round trips, held-out accuracy, and odd rows."""

import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import class_lm, embedding_dedup, jaccard_join, mixing, packing, quality_classifier, quality_rules, token_files, toxicity, warc
from tallymark.llm.common import components, crc_mod, new_path
from tallymark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while seven grey cats sleep near an old wooden door and nobody minds at all today"
LONG = " ".join(f"word{i % 3000}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(1, WORDS, "src1", 9, 1.0), (2, WORDS, "src1", 9, 1.0), (3, WORDS + " maybe", "src2", 9, None), (3, WORDS + " maybe", "src2", 9, None), (4, "", None, 0, 1.0), (5, None, "src1", None, 1.0), (6, LONG, "src2", 9, 1.0), (7, "one two", "src1", 9, 1.0), (None, "lost words", None, 1, 1.0), (8, "  \n\t ", "src3", 1, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel = con.execute(ORACLE_SQL[name])
    cols = [x[0] for x in rel.description]
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*cols).collect())


def test_odd_rows_jaccard(odd):
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(odd).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (None, None, 0), (8, 8, 0)}
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8]
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0


def test_jaccard_by_brute_force(spark, docs):
    sets = {}
    for k, t in docs.items():
        w = (t or "").encode().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = defaultdict(int)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a != b and n and 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
                want[a] += 1
    got = {r.doc_id: r.n_links for r in QUERIES["op1_jaccard_join"](spark, SF).collect()}
    assert got == {k: want[k] for k in ids}


def test_large_groups_are_counted_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([f"x{k}", *base[1:]])) for k in range(90)] + [(1000, " ".join(base[::-1]))]
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 32)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0, 89) for k in range(90)} | {1000: (1000, 0)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in components(spark, edges).collect()}
    assert got == dict.fromkeys(range(21), 0) | {50: 50, 51: 50}


def test_mixing(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and all(r.taken <= 3 * r.size for r in rows)
    per = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in per.values()) == pytest.approx(sum(s for s, _ in per.values()))
    assert all(t <= 3 * s for s, t in per.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_quality_rules_on_odd_rows(odd):
    got = {r.doc_id: r for r in quality_rules.quality_rules(odd).collect()}
    assert got[1].kept and not got[4].kept and not got[5].kept and got[6].n_words == 30_000 and got[6].n_repeat_words == 30_000
    assert quality_rules.kept_documents(odd).columns == odd.columns
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_depleted_documents_go_and_copies_stay(spark):
    line = "all rights reserved by its owners and no part of this site may be used elsewhere without asking them first in a letter sent to their only office"
    rows = [(k, f"{line}\nonly {k} own words", "h") for k in range(60)] + [(100 + k, WORDS, "h") for k in range(60)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [k for k in range(60) if got[k]] == [0] and all(got[100 + k] for k in range(60))


def test_shared_lines_leave_the_kept_texts(spark):
    line = "Home | About   us | Contact"
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    texts = {k: f"{line if k % 2 else line.upper()}\n\n{body(k)}\n{line}\n  tail {k}  \n" for k in range(60)} | {100: f"{line}\n{body(100)}", 101: body(101), 102: None}
    rows = [(k, t, "other" if k == 100 else "h", k) for k, t in texts.items()] + [(5, texts[5], "h", 5), (5, texts[5], "other", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = quality_rules.kept_documents(df)
    assert got.columns == df.columns
    clean = lambda k: f"\n{body(k)}\n  tail {k}  \n"
    want = [(0, texts[0], "h", 0), (100, texts[100], "other", 100), (101, texts[101], "h", 101), (5, clean(5), "h", 5), (5, texts[5], "other", 6)]
    assert sorted(map(tuple, got.collect())) == sorted(want + [(k, clean(k), "h", k) for k in range(1, 60)])
    removed = {r.doc_id: r.n_removed_words for r in quality_rules.quality_rules(df.where("source = 'h'")).collect()}
    left = {r.doc_id: len(r.text.split()) for r in got.where("source = 'h'").collect()}
    assert all(removed[k] == len(texts[k].split()) - n for k, n in left.items()) and removed[1] == 12


def test_classifier_held_out(spark, odd, labels):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_classifier.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.9  # needs the pair
    got = quality_classifier.classified(odd, labels)
    assert got.count() == 10 and got.where("score BETWEEN 0 AND 1").count() == 10
    assert quality_classifier.classified(odd.limit(0), labels).count() == 0
    assert quality_classifier.classified(odd, labels.limit(0)).where("score = 0.5").count() == 10


def test_class_lm_base_and_gain(spark, docs, odd):
    low = lambda t: (t or "").encode().translate(class_lm._LOWER).split() + [b""]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    counts = Counter(w for k, t in docs.items() if not held[k] for w in low(t))
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op5_class_lm"](spark, SF).collect()
    for r in rows:
        words = low(docs[r.doc_id])
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(counts[w] > 0 for w in words), n, held[r.doc_id])
        assert r.base_score == pytest.approx(want)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    got = class_lm.score(odd, lambda k: crc_mod(k, 7) == 2).collect()
    assert len(got) == 10 and all(r.score < 0 or r.n_tokens == 1 for r in got)
    assert class_lm.score(odd.limit(0), lambda k: crc_mod(k, 7) == 2).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    group = rng.integers(0, 5, 40)
    b = np.zeros((41, 41))
    for _ in range(20_000):
        a = rng.integers(0, 40)
        b[a, rng.choice(np.flatnonzero(group == (group[a] + 1) % 5))] += 1

    def value(cls):
        hot = np.eye(6)[cls]
        n = hot.T @ b @ hot
        return class_lm._xlogx(n).sum() - class_lm._xlogx(n.sum(0)).sum() - class_lm._xlogx(n.sum(1)).sum()

    start, end = class_lm.exchange(b, 6, 0), class_lm.exchange(b, 6)
    best = np.append(group + 1, 0)
    assert value(start) < value(end) and value(end) - value(start) > 0.6 * (value(best) - value(start))
    assert end[-1] == 0 and (end[:-1] > 0).all()


def test_chain_field_marginals_by_brute_force():
    rng = np.random.default_rng(3)
    e, trans = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    total, on = 0.0, np.zeros(4)
    for k in range(16):
        tags = [k >> i & 1 for i in range(4)]
        w = math.exp(sum(e[0, i] for i in range(4) if tags[i]) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        total, on = total + w, on + w * np.array(tags)
    assert toxicity.forward_backward(e, np.ones((1, 4), bool), trans)[0][0] == pytest.approx(on / total)


def test_toxicity_held_out_and_spans(spark, odd, labels):
    rng = np.random.default_rng(4)
    make = lambda bad: " ".join(str(w) for w in rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 30)) + (" you horrid fool, go" if bad else " you kind soul go")
    y = np.arange(400) % 4 == 0
    texts = [make(b) for b in y]
    field = toxicity.fit(texts[:300], y[:300].astype(np.int64))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts[300:])], "doc_id long, text string")
    rows = toxicity.tag(df, field).collect()
    assert np.mean([(r.score >= 0.5) == y[300 + r.doc_id] for r in rows]) > 0.97
    bad = next(r for r in rows if y[300 + r.doc_id])
    assert "horrid" in texts[300 + bad.doc_id][bad.spans[0].first : bad.spans[-1].after]
    learned = toxicity.train(odd, labels, lambda k: F.lit(True))
    assert toxicity.tag(odd, learned).where("score BETWEEN 0 AND 1").count() == 10
    assert toxicity.tag(odd.limit(0), learned).count() == 0


def test_embeddings_on_odd_rows(spark):
    v = [1.0, 0.5, 0.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 1.0, 0.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1), (9, [None, 1.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.5], 1), (3, [2.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == sorted([(1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 0, 11)])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def _pieces(rows, n_docs):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for x in by_seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    return len(by_seq)


def test_packing_holds_every_id_once(spark, docs, odd):
    from tokenizers import Tokenizer

    from tallymark.llm.common import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    rows = QUERIES["op8_packing"](spark, SF).collect()
    ids = {k: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for k, x in docs.items()}
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert dict(seen) == {k: len(x) for k, x in ids.items()}
    n = _pieces(rows, len(docs))
    assert n * 1024 < 1.02 * sum(seen.values()) + 1024
    _pieces(packing.pack(odd).collect(), 10)
    assert packing.pack(odd.limit(0)).count() == 0


def test_archives_round_trip_on_odd_rows(spark):
    big = "x" * 1500
    rows = [(1, "http://a.b.org/p", big), (2, "http://a.b.org/p", big), (3, None, None), (4, "", ""), (5, "not a url \r\n x", "é" * 499), (6, "http://[bad", "é" * 499), (7, "https://WWW.A.com:8443/q?z=1", big + "y"), (2, "http://a.b.org/p", big), (None, "u", "n")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    warc.write_archives(pages, archives)
    warc.write_index(warc.captures(spark, archives), index)
    as_int = lambda x: None if x is None else int(x)
    rows_of = lambda found: sorted(((as_int(r.page_id) or 0, r.payload_bytes, r.record_type, as_int(r.refers_to)) for r in warc.read_records(spark, found).collect()), key=str)
    got = rows_of(warc.read_index(spark, index))
    assert got == rows_of(warc.lookup(spark, index, warc.url_keys(pages)))
    assert got == sorted([(1, 1500, "revisit", 2), (2, 1500, "response", None), (2, 1500, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 998, "response", None), (6, 998, "response", None), (7, 1501, "response", None), (0, 1, "response", None)], key=str)
    keys = spark.createDataFrame([(warc.surt("https://www.a.com:8443/q?z=1"),), ("com,absent)/",), (None,)], "key string")
    assert [r.page_id for r in warc.lookup(spark, index, keys).collect()] == ["7"]
    assert warc.surt("http://www.a.org/x") == "org,a,www)/x"


def test_token_files_round_trip(spark, odd):
    path = new_path(spark, "ids")
    token_files.write_ids(odd, path)
    rows = token_files.read_ids(spark, path).collect()
    assert len(rows) == 10 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert {r.doc_id for r in rows if r.n_tokens == 1} == {4, 5, 8}
    found = token_files.lookup(spark, path, [7, 77])
    assert found[77] is None and len(found[7]) == 3


def test_perfect_hash_is_minimal_and_tells_absent_keys():
    keys = np.arange(0, 30_000, 7)
    h = token_files.PerfectHash.build(keys, np.arange(len(keys)))
    assert (h.find(keys) == np.arange(len(keys))).all() and (h.find(keys + 1) == -1).mean() > 0.999


def test_pipeline_stages_take_odd_rows(spark, odd, tmp_path, labels):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    d = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == odd.columns
    assert corpus_pipeline.run(spark, SF).count() > 0


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x", "Ⱥİ x", "é́ é x", "a\x00b ,\x01 c", "don't it's 've", "m² x½", "", "  ", None, "a b", "\t x", "x \n y", "naïve, café! 日本語。", "1234 a1b2", "ends ", " starts", "a  b", "!!! ... ,,,"]


@pytest.mark.parametrize(("name", "space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_tokenizers(docs, name, space):
    from tokenizers import Tokenizer

    from tallymark.llm.common import tokenizer_path
    from tallymark.llm.token_ids import ChunkEncoder

    t = Tokenizer.from_file(tokenizer_path(name))
    texts = [*docs.values(), *SPECIAL]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    enc = ChunkEncoder(name, space, most_chunks=500)  # forgets often
    got = []
    for a in range(0, len(texts), 7):
        ids, n = enc.encode(texts[a : a + 7])
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == want and len(enc.codes) < 20_000
    t.encode_special_tokens = True
    ids, _ = ChunkEncoder(name, space, special_as_text=True).encode([SPECIAL[0]])
    assert ids.tolist() == t.encode(SPECIAL[0], add_special_tokens=False).ids


def test_token_files_hold_the_tokenizers_ids(spark, docs):
    from tokenizers import Tokenizer

    from tallymark.llm.common import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path(token_files.TOKENIZER))
    at, want = 0, {}
    for k in sorted(docs):
        ids = np.array(t.encode(docs[k] or "", add_special_tokens=False).ids + [1], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_files"](spark, SF).collect()} == want


def test_a_lookup_opens_one_shard(spark, monkeypatch):
    rows = [(k, f"text number {k}") for k in range(400)] + [(None, "x"), (7, "again")]
    monkeypatch.setattr(token_files, "SHARD_DOCS", 20)
    path = new_path(spark, "ids")
    token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1)), path)
    assert spark.read.parquet(path + "-directory").count() >= 4
    files = []
    opened = token_files.opened
    monkeypatch.setattr(token_files, "opened", lambda p: files.append(p) or opened(p))
    found = token_files.lookup(spark, path, [250, 1000])
    assert len(found[250]) == len(token_files.lookup(spark, path, [251])[251]) and found[1000] is None and len(files) == 2
    empty = new_path(spark, "ids")
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert token_files.read_ids(spark, empty).count() == 0 and token_files.lookup(spark, empty, [1]) == {1: None}


def test_packing_at_the_edge_of_a_sequence(spark):
    texts = [" ".join(["the"] * n) for n in (1022, 1023, 1024, 2047)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted({(r.doc_id, r.doc_tokens) for r in rows}) == [(0, 1023), (1, 1024), (2, 1025), (3, 2048)]
    assert _pieces(rows, 4) == 6 and sum(r.length for r in rows) == 1023 + 1024 + 1025 + 2048


def test_class_lm_score_by_brute_force(spark, monkeypatch):
    """Learns of a corpus that Python counts again word by word, with the classes that the operator gave."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(120)]
    texts = {k: " ".join(rng.choice(words[: 40 if k % 2 else 120], 60)) for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = {}
    classed = class_lm.classed
    monkeypatch.setattr(class_lm, "classed", lambda *a: seen.setdefault("texts", classed(*a)))
    held = lambda k: k % 5 == 0
    got = {r.doc_id: r for r in class_lm.score(df, held, head_words=30, min_count=4).collect()}
    tokens = {k: [*class_lm.words(t), b""] for k, t in texts.items()}
    classes = {}
    for r in seen["texts"].collect():
        at = 0
        for k, n in zip(r.doc_ids, r.sizes, strict=True):
            classes[k] = list(r.classes[at : at + n])
            at += n
    of = {}
    for k in tokens:
        for w, c in zip(tokens[k], classes[k], strict=True):
            assert of.setdefault(w, c) == c  # a word has one class
    end, n = of[b""], class_lm.CLASSES
    assert [w for w, c in of.items() if c == end] == [b""]
    count = Counter(w for k in tokens if k % 5 for w in tokens[k])
    pairs, total = Counter(), Counter()
    for k in tokens:
        if k % 5:
            for a, b in zip([end, *classes[k]], classes[k], strict=False):
                pairs[a, b] += 1
                total[b] += 1
    before = Counter()
    for (a, _), m in pairs.items():
        before[a] += m
    distinct = Counter(of[w] for w in count)
    for k in tokens:
        want = 0.0
        for a, b, w in zip([end, *classes[k]], classes[k], tokens[k], strict=False):
            want += math.log10((pairs[a, b] + 0.1) / (before[a] + 0.1 * n)) + math.log10((count[w] + 0.5) / (total[b] + 0.5 * (distinct[b] + 1)))
        assert got[k].score == pytest.approx(want) and got[k].held_out == (k % 5 == 0)


def test_favoured_class_has_the_greatest_likelihood():
    rng = np.random.default_rng(8)
    counts = rng.integers(50, 5000, (6, 6)).astype(float)
    left, right = rng.integers(0, 3, (40, 6)).astype(float), rng.integers(0, 3, (40, 6)).astype(float)
    f = lambda m: class_lm._xlogx(m).sum() - class_lm._xlogx(m.sum(0)).sum() - class_lm._xlogx(m.sum(1)).sum()
    got = class_lm.favoured(left, right, counts)
    for k in range(40):
        gains = []
        for c in range(1, 6):
            m = counts.copy()
            m[c] += right[k]
            m[:, c] += left[k]
            gains.append(f(m))
        assert gains[got[k] - 1] >= max(gains) - 0.05


def test_long_lines_are_one_chain(monkeypatch):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(50)]
    texts = ["\n".join(" ".join(rng.choice(vocab, n)) for n in (3, 64, 65, 200, 1)), " ".join(rng.choice(vocab, 700)), "", "a"]
    field = toxicity.ChainField(rng.normal(size=toxicity.DIM), rng.normal(size=(2, toxicity.DIM)), rng.normal(size=(2, 2)), np.zeros(4))
    pieces = field.marginals(toxicity._Texts(texts))
    monkeypatch.setattr(toxicity, "PIECE", 10_000)
    assert np.allclose(pieces, field.marginals(toxicity._Texts(texts)), atol=1e-12)


def test_lookup_tables_score_by_brute_force():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    m = quality_classifier.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, s in zip(x[:50], m.score(x[:50]), strict=True):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges, strict=True)]
        z = m.base + sum(t[b] for b, t in zip(bins, m.singles, strict=True)) + sum(t[bins[i], bins[j]] for i, j, t in m.pairs)
        assert s == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize(("query", "label", "least"), [("op3_quality_classifier", "quality", 0.97), ("op6_toxicity", "toxic", 0.9)])
def test_held_out_labels(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("y"))
    rows = QUERIES[query](spark, sf).where("held_out").join(labels, "doc_id").select("y", "predicted").collect()
    hit = Counter((r.y, r.predicted) for r in rows)
    assert len(rows) > 300 and (hit[0, 0] + hit[1, 1]) / len(rows) > 0.97
    assert hit[1, 1] / (hit[1, 0] + hit[1, 1]) >= least


@pytest.mark.parametrize(("block", "cell"), [(None, 2048), (64, 2048), (32, 40), (7, 16)])
def test_embeddings_by_brute_force(spark, monkeypatch, block, cell):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base[:150] + rng.normal(size=(150, 16)) * 0.08, np.repeat(base[:1], 150, 0) + rng.normal(size=(150, 16)) * 0.05]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    links = embedding_dedup._links
    monkeypatch.setattr(embedding_dedup, "_links", lambda c, d, t: links(c, d, t, block, cell))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (int(link[i].sum()), int(root[i])) for i in range(len(x))} and link.sum() > 5000


def test_cells_of_one_direction_are_cut_by_hash(spark):
    """Vectors along one line: no pivots part them, and every pair is linked."""
    v = np.array([3.0, 4.0])
    df = spark.createDataFrame([(k, (v * (1 + k)).tolist(), 1) for k in range(60)], "vec_id long, embedding array<double>, label int")
    classes = df.select("label", F.col("embedding").alias("v"), F.lit(1).cast("long").alias("n"), F.col("vec_id").alias("no"))
    found = embedding_dedup._links(classes, 2, 0.98, 16).groupBy("no").agg(F.sum("links").alias("n")).collect()
    assert {r.no: r.n for r in found} == dict.fromkeys(range(60), 59)


def test_embeddings_of_extreme_size(spark):
    """Squares of these components leave the range of doubles; their cosines don't."""
    base = {0: (1.0, 0.0, 0.0), 1: (1.0, 0.001, 0.0), 2: (1.0, 0.001, 0.0), 3: (0.0, 1.0, 0.0), 4: (0.6, 0.8, 0.0)}
    rows = [(10 * p + k, [c * scale for c in v], 1) for p, scale in enumerate((1.0, 1e-200, 1e200, 1e-307, 1e307)) for k, v in base.items()]
    rows += [(100, [5e-324, 0.0, 0.0], 1), (101, [1e-200, 1e200, 0.0], 1), (102, [0.0, 0.0, 0.0], 1), (103, [1e-200, 0.0], 1), (104, [3.0, 0.0], 1), (105, [1e200, 1e200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def linked(a: list, b: list) -> bool:
        x, y = ([Fraction(c) for c in v] for v in (a, b))
        dot, norms = sum(p * q for p, q in zip(x, y, strict=True)), sum(p * p for p in x) * sum(q * q for q in y)
        return dot > 0 and norms > 0 and dot * dot >= Fraction(0.98) ** 2 * norms

    want = {i: sum(i != j and len(a) == len(b) and linked(a, b) for j, b, _ in rows) for i, a, _ in rows}
    assert {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize(("spread", "most"), [(0.02, 0.1), (None, 0.75)])
def test_few_cells_meet(spark, spread, most):
    """Of all pairs of vectors, those that are in a task together: under a tenth where vectors lie in clusters, and no link is lost."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64)) if spread is None else rng.normal(size=(60, 64))[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 64)) * spread * 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = x[rng.choice(6000, 96, False)]
    far = np.sqrt(2 - 2 * 0.98) + embedding_dedup.ROUNDING
    own, row, cell, d = embedding_dedup.visits(x, at, far)
    radius = np.zeros(96)
    np.maximum.at(radius, own, np.sqrt(((x - at[own]) ** 2).sum(1)))
    meets = np.zeros((6000, 96), bool)
    keep = (cell == own[row]) | (d <= radius[cell] + far)
    meets[row[keep], cell[keep]] = True
    assert meets[:, own].mean() < most
    i, j = np.nonzero(x @ x.T >= 0.98)
    assert meets[i, own[j]].all()


def test_lookups_read_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 8)
    monkeypatch.setattr(warc, "FILE_BLOCKS", 3)
    rows = [(k, f"http://h{k % 40:02d}.org/{k}", f"page {k}") for k in range(600)] + [(1000 + k, "http://same.org/", "y" * 1200) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    warc.write_archives(pages, archives)
    warc.write_index(warc.captures(spark, archives), index)
    first = [tuple(r) for r in warc.listed(spark, index + "-top").collect()]
    assert len(first) == 1 and warc.listed(spark, index).count() > 4
    assert len(list(warc._files_of(first[0], iter([warc.surt("http://h07.org/7")])))) == 1
    assert list(warc._files_of(first[0], iter(["zz,absent)/"]))) == []
    key = lambda u: spark.createDataFrame([(warc.surt(u),)], "key string")
    same = warc.lookup(spark, index, key("http://same.org/"))
    assert sorted(int(r.page_id) for r in same.collect()) == list(range(1000, 1060))
    kinds = Counter((r.record_type, r.refers_to) for r in warc.read_records(spark, same).collect())
    assert kinds == {("response", None): 1, ("revisit", "1059"): 59}
    assert warc.lookup(spark, index, warc.url_keys(pages)).count() == 660


def test_archives_of_nothing_and_of_a_long_payload(spark, monkeypatch):
    empty = spark.createDataFrame([], "page_id string, url string, html string")
    for pages, n in ((empty, 0), (spark.createDataFrame([("a b", "http://x.org/", "z" * 30_000_000), (None, None, None)], "page_id string, url string, html string"), 2)):
        archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
        warc.write_archives(pages, archives)
        warc.write_index(warc.captures(spark, archives), index)
        got = warc.read_records(spark, warc.lookup(spark, index, warc.url_keys(pages))).collect()
        assert sorted((r.page_id or "", r.payload_bytes) for r in got) == [("", 0), ("a b", 30_000_000)][:n]
        monkeypatch.setattr(warc, "all_open", lambda files: False)  # a store that only Spark reads
        again = warc.read_records(spark, warc.lookup(spark, index, warc.url_keys(pages))).collect() if n else []
        assert sorted(map(str, again)) == sorted(map(str, got))
        monkeypatch.undo()


def test_warc_lookups_on_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    """The directories lead to blocks and records by ranges there too, so that other index files may be broken."""
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 4)
    monkeypatch.setattr(warc, "FILE_BLOCKS", 3)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tally.link./in", f"file://{tmp_path}")
    rows = [(k, f"http://h{k % 40:02d}.org/{k}", f"page {k}") for k in range(600)] + [(1000 + k, "http://same.org/", "y" * 1200) for k in range(60)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index = "viewfs://tally/in/warc", "viewfs://tally/in/cdx"
    warc.write_archives(pages, archives)
    warc.write_index(warc.captures(spark, archives), index)
    assert not warc.all_open(warc.listed(spark, index)) and warc.listed(spark, index).count() > 20 and warc.listed(spark, index + "-top").count() == 1
    got = warc.read_records(spark, warc.lookup(spark, index, warc.url_keys(pages))).collect()
    assert sorted(r.page_id or "" for r in got) == sorted("" if k is None else str(k) for k, _, _ in rows)
    keys = spark.createDataFrame([(warc.surt("http://same.org/"),), (warc.surt("http://h07.org/7"),), ("zz,absent)/",), (None,)], "key string")
    found = warc.lookup(spark, index, keys).collect()
    assert sorted(int(r.page_id) for r in found) == [7, *range(1000, 1060)]
    one = [r for r in found if r.page_id == "7"]
    kept = 0
    for f in (tmp_path / "cdx").glob("part-*"):
        data = f.read_bytes()
        if data and not warc.IndexFile(len(data), lambda at, n: data[at : at + n]).find(warc.surt("http://same.org/")):  # noqa: B023
            f.write_bytes(b"x" * len(data))
            (f.parent / f".{f.name}.crc").unlink()
        else:
            kept += bool(data)
    assert kept < 12
    assert warc.lookup(spark, index, keys.where("key LIKE '%same%'")).count() == 60
    got = warc.read_records(spark, spark.createDataFrame(one, "key string, page_id string, file string, offset long, length long"))
    assert [tuple(r)[:2] for r in got.collect()] == [("7", 6)] and "binaryFile" not in got._jdf.queryExecution().toString()


def test_lines_decide_against_sql(spark, tmp_path):
    """Documents whose shared lines leave too little go, in the query as in its SQL."""
    line = "this notice stands on every page of the whole site and says nothing new"
    body = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, f"{line}\n{body(k, 25 if k % 3 else 8)}", "h") for k in range(30)] + [(100 + k, f"{line}\n{body(100 + k, 8)}" if k < 3 else body(k, 40), "big") for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_quality_rules"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(ORACLE_SQL["op4_quality_rules"])
    cols = [x[0] for x in rel.description]
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in got)
    rejected = {r.doc_id for r in got if not r.kept and not r.base_failed}
    assert rejected == {k for k in range(1, 30) if k % 3 == 0}  # the first page keeps the line; few pages of the big host have it


def test_mixed_words_are_within_a_largest_document(spark):
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(["x"] * int(rng.integers(1, 400))), f"s{k % 5}") for k in range(600)]
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        p = per[r.source]
        p[0], p[1], p[2] = p[0] + r.taken, r.target, max(p[2], r.size)
    assert all(abs(taken - target) <= 1.5 * largest for taken, target, largest in per.values())


def test_jaccard_links_at_a_larger_scale(spark):
    """All links of sf0.01, by an inverted list of shingles."""
    docs = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    sets = {}
    for k, t in docs.items():
        w = (t or "").encode().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    shared, holders = Counter(), defaultdict(list)
    for k, s in sets.items():
        for x in s:
            for other in holders[x]:
                shared[other, k] += 1
            holders[x].append(k)
    want = Counter()
    for (a, b), n in shared.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            want[a] += 1
            want[b] += 1
    assert {r.doc_id: r.n_links for r in QUERIES["op1_jaccard_join"](spark, "/root/testdata/sf0.01").collect()} == {k: want[k] for k in docs}


def test_missed_pairs_are_within_the_recall():
    runs = jaccard_join.runs_for(jaccard_join.TARGET_RECALL, jaccard_join.THRESHOLD)
    assert jaccard_join.missed(runs, jaccard_join.THRESHOLD) <= 1 - jaccard_join.TARGET_RECALL < jaccard_join.missed(runs - 1, jaccard_join.THRESHOLD)


def test_stages_on_no_rows_and_clashing_names(spark, odd, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clash = odd.selectExpr("*", "1 AS __quality", "2 AS copies", "3 AS k", "4 AS row", "5 AS stay", "6 AS `kept`")
    for name, stage in corpus_pipeline.STAGES:
        for d in (clash, clash.limit(0)):
            got = stage(spark, d, str(tmp_path))
            assert name == "packing" or got.columns == d.columns
            n = got.count()
            assert n > 0 if d is clash else n == 0

"""Columns with names that operators use themselves, unusual ids, empty tables, long lines; and plain versions to compare with."""

import hashlib
import re
import string
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import ann, credentials, jaccard, lines, links, packing, quality_gbdt, quality_rules, sentencepiece_codec, suffix, warc
from tidewheel.llm.common import components, least_hashes, Scratch
from tidewheel.llm.queries import tokenizer_file

from .test_llm import brute_components, brute_lines, near_rows, prose

#: Names that an operator gives to columns of its own.
NAMES = ["row", "gone", "parts", "t", "w", "l", "n", "h", "s", "m", "p", "id", "g", "k", "j", "doc", "at", "first", "found", "key", "component", "payload", "size", "sketch", "label", "n_lines", "N_removed", "n_words", "kept", "x", "start", "spans", "masked"]


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with further columns of all these names, repeated rows and nulls."""
    rows = [(1, "the one line of it\nand the other one here", "en"), (2, "the one line of it\nand more", None), (2, "the one line of it\nand more", None), (None, prose(1), "en"), (4, None, "x"), (5, "", "x"), (6, "the " * 40 + prose(2, 300), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(NAMES)))


def test_columns_of_clashing_names(spark, crowded):
    plain = crowded.select("doc_id", "text", "lang")
    same = lambda a, b: sorted(map(str, (tuple(r) for r in a.collect()))) == sorted(map(str, (tuple(r) for r in b.collect())))
    kept = quality_rules.filter_documents(crowded)
    assert kept.columns == crowded.columns and same(kept.select("doc_id", "text"), quality_rules.filter_documents(plain).select("doc_id", "text"))
    assert same(quality_rules.apply_rules(crowded).select("doc_id", "n_words", "kept"), quality_rules.apply_rules(plain).select("doc_id", "n_words", "kept"))
    deduped = lines.dedupe(crowded)
    assert same(deduped.select("doc_id", "text", "n_lines", "n_removed", "lang"), lines.dedupe(plain).select("doc_id", "text", "n_lines", "n_removed", "lang"))
    assert deduped.where("gone <> 1 or row <> 0 or parts <> 2").count() == 0
    assert same(jaccard.link_components(crowded), jaccard.link_components(plain)) and jaccard.keep_one(crowded).columns == crowded.columns
    assert same(suffix.dedupe(crowded, False), suffix.dedupe(plain, False))
    assert same(credentials.scan(crowded), credentials.scan(plain)) and credentials.mask_documents(crowded).columns == crowded.columns
    tokenizer = tokenizer_file("word_bpe_49k.json")
    assert packing.pack(crowded, tokenizer, with_ids=False).count() == packing.pack(plain, tokenizer, with_ids=False).count() == 7
    model = tokenizer_file("piece_bpe_32k.model")
    assert same(sentencepiece_codec.digest(crowded, model), sentencepiece_codec.digest(plain, model))
    labels = spark.createDataFrame([(1, 1, 0, 3.0), (2, 0, 0, 3.0), (6, 1, 0, 3.0)], "doc_id long, quality int, toxic int, x double")
    assert same(quality_gbdt.classify(crowded, labels), quality_gbdt.classify(plain, labels))
    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "a" * 200)], "page_id long, url string, html string")
    odd = pages.select("*", *(F.lit(1).alias(c) for c in ("digest", "first", "n", "payload", "refers_to", "member", "value")))
    assert same(warc.round_trip(odd), warc.round_trip(pages))
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "vec_id long, embedding array<float>")
    odd = vectors.select("*", *(F.lit(1).alias(c) for c in ("v", "is_query", "d", "cell", "query", "n", "salt", "rank", "score")))
    assert same(ann.search(odd, F.col("vec_id") % 10 == 0), ann.search(vectors, F.col("vec_id") % 10 == 0))


def test_ids_of_other_types(spark):
    rows = [(f"d{k}", text) for k, text in near_rows(12)]
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard.link_components(docs).collect()} == want
    small = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id short, text string")
    tokenizer = tokenizer_file("word_bpe_49k.json")
    assert packing.pack(small, tokenizer).schema["doc_id"].dataType.simpleString() == "smallint" and packing.pack(docs, tokenizer).count() == 12
    assert lines.dedupe(small).count() == 2 and suffix.dedupe(small).count() == 2 and credentials.scan(docs).count() == 12


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng, rows = np.random.default_rng(8), []
    stems = [prose(k, 12) for k in range(10)] + ["-" * 60, "=-" * 50, "ha " * 40]
    for doc in range(30):
        own = []
        for k in rng.choice(len(stems), 4):
            line = list(stems[k])
            for _ in range(int(rng.integers(0, 4))):
                line[int(rng.integers(len(line)))] = rng.choice(list("#%&"))
            own.append("".join(line) * int(rng.integers(1, 3)) if k > 9 else "".join(line))
        rows.append((doc, "\n".join(own)))
    rows.append((100, "z" * 300_000 + "\n" + "z" * 200_000 + "\n" + prose(99, 30_000)))
    got = {r["doc_id"]: r["text"] for r in lines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(brute_lines(rows))
    assert {d: t for d, t in got.items() if t} == want


def test_large_groups_and_clusters_go_through_blocks(spark, monkeypatch):
    """Groups beyond a block, in two rounds, join what all pairs would join."""
    rng = np.random.default_rng(3)
    centres = [rng.integers(0, 2**64, 100, dtype=np.uint64) for _ in range(4)]
    sets = {}
    for k in range(120):
        own = centres[k % 4].copy()
        own[rng.choice(100, int(rng.integers(0, 14)), replace=False)] = rng.integers(0, 2**64, 1, dtype=np.uint64)
        sets[k] = np.unique(own)
    rows = spark.createDataFrame([(7, k, k, len(x), x.tobytes()) for k, x in sets.items()], "g long, id long, label long, weight long, payload binary")
    sets_of = lambda items: [np.frombuffer(x, np.uint64) for x in items]
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(np.intersect1d(sets[a], sets[b]))
                if label[a] != label[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
    for block in (1 << 20, 1500):
        scratch = Scratch(spark)
        found, whole = links.joined(rows, links.by_set(sets_of, 80, 100), block, scratch)
        assert whole == (block > 10_000) and (not whole or found.count() < len(sets))
        got = {r["node"]: r["component"] for r in components(found, scratch).collect()}
        assert {k: got.get(k, k) for k in sets} == label


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    chain = rng.permutation(400)
    edges = [(int(a), int(b)) for a, b in zip(chain, chain[1:])] + [(1000, 1000 + k) for k in range(1, 300)] + [(2001, 2000), (2000, 2001), (3000, 3000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark)).collect()}
    want = dict.fromkeys(range(400), 0) | dict.fromkeys(range(1000, 1300), 1000) | {2000: 2000, 2001: 2000}
    assert got == want


def test_least_hashes_are_the_least(spark):
    rows = spark.range(20_000)
    want = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert [r["id"] for r in least_hashes(rows, 300, 20_000, "id").collect()] == want
    assert least_hashes(rows.limit(50), 300, 50, "id").count() == 50


def test_trees_against_a_plain_walk_and_every_split():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=300) > 0.2).astype(float)
    model = quality_gbdt.fit(x, y, trees=5, depth=3)
    for row, margin in zip(x, model.margins(x)):
        total = model.start
        for tree in range(5):
            at = 0
            for _ in range(3):
                at = 2 * at + (1 if row[model.feature[tree, at]] <= model.cut[tree, at] else 2)
            total += model.value[tree, at]
        assert margin == pytest.approx(total)
    p = y.mean()
    grad, hess = p - y, np.full(300, p * (1 - p))
    gain = lambda own: grad[own].sum() ** 2 / (hess[own].sum() + 1)
    best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(3) for c in np.unique(x[:, f]) if 5 <= hess[x[:, f] <= c].sum() <= hess.sum() - 5)
    root = quality_gbdt.fit(x, y, trees=1, depth=1, bins=400)
    chosen = gain(x[:, root.feature[0, 0]] <= root.cut[0, 0]) + gain(x[:, root.feature[0, 0]] > root.cut[0, 0])
    assert root.feature[0, 0] == best[1] and chosen == pytest.approx(best[0], rel=0.02)


def plain_spans(text):
    """Base spans without regular expressions: kind, start, end."""
    out, low = [], text.translate({k: k + 32 for k in range(65, 91)})
    value, at = set(string.ascii_letters + string.digits + "+/_.=-"), 0
    while at < len(text):
        name = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
        end = None
        if name:
            k = at + len(name)
            k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] and text[k] in ":=":
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                first = k
                while text[k : k + 1] and text[k] in value:
                    k += 1
                if k > first:
                    end = k
                    if k - first >= 6:
                        out.append(("assign", at, k))
        at = end or at + 1
    for kind, begin, chars, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            k = at + len(begin)
            while text.startswith(begin, at) and text[k : k + 1] and text[k] in chars:
                k += 1
            if text.startswith(begin, at) and k > at + len(begin):
                if k - at >= least:
                    out.append((kind, at, k))
                at = k
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], credentials.KINDS.index(s[0])))


def test_base_spans_against_a_plain_scan(spark):
    rng = np.random.default_rng(4)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", ":", "=", " ", "'", '"', "AKIA", "abcdef0123456789abcdef01", "ABCDEF0123456789XYZQ", "x", "é", "secret=", "api", "_key", "12345", "AKIAAKIA", "passwordpassword: abcdefg", "\n"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 14)))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    for text in texts:
        assert [(credentials.KINDS[k], a, b) for a, b, k, _ in credentials.base_spans(text)] == plain_spans(text), text


def test_search_probes_some_cells_and_reranks_some_rows(spark):
    """More cells than are probed, cells larger than what is reranked: the quantiser decides, and recall holds where there are clusters."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32)) * 4
    x = np.float32(np.concatenate([c + rng.normal(size=(250, 32)) for c in centres]))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % 50 == 0, probed=0.1, rerank=2, least_probes=2).toPandas()
    x, hits = x.astype(float), 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(own["vec_id"]))
        assert np.allclose(own.sort_values("rank")["score"], d[own.sort_values("rank")["vec_id"]])
    assert got["query_id"].nunique() == 60 and hits >= 0.9 * 600


def test_search_broadcasts_no_probes(spark):
    """Queries are copied to each cell that they probe, which no size of a file foretells; blocks of a hot cell meet them all."""
    rng = np.random.default_rng(6)
    x = np.float32(np.concatenate([rng.normal(size=(300, 8)), 9 + rng.normal(size=(9000, 8)) / 1000]))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.search(table, F.col("vec_id") % 500 == 0, probed=1.0, rerank=900)
    got = found.collect()
    assert not re.search(r"Broadcast\w*Join \[(cell|query)#", found._jdf.queryExecution().executedPlan().toString())
    x = x.astype(float)
    for q in range(0, len(x), 500):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == np.lexsort((np.arange(len(x)), d))[:10].tolist()


def test_search_copies_queries_to_groups(spark):
    x = np.random.default_rng(8).normal(size=(400, 4))
    coder, cells = ann.Quantiser.fit(x, 20), {c: 1 + 3000 * c for c in range(20)}
    asked = spark.createDataFrame([(v.tolist(), k) for k, v in enumerate(x[:5])], "v array<double>, query long")
    got = ann._probes(asked, coder, cells, 3, 11, 1.0, 1).collect()
    want = sorted((c, s) for c, n in cells.items() for s in range(-(-n // ann.ROWS)))
    for q in range(5):
        own = {r["part"]: np.frombuffer(r["blocks"], np.int32).reshape(-1, 2) for r in got if r["query"] == q}
        assert len(own) == 3 and sorted(map(tuple, np.concatenate(list(own.values())).tolist())) == want
        assert all((b.sum(axis=1) % 3 == part).all() for part, b in own.items())


def test_search_fits_in_little_memory():
    x = np.random.default_rng(5).standard_normal((6000, 512)).astype(np.float32)
    tracemalloc.start()
    coder = ann.Quantiser.fit(x, 512)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 2 * x.nbytes and coder.centroids.shape == (512, 512)
    x, rng = x[:1300, :8].astype(float), np.random.default_rng(0)
    want = x[rng.choice(len(x), 20, replace=False)]
    for _ in range(12):
        own = ((x[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.stack([x[own == k].mean(axis=0) for k in range(20)])
    assert np.allclose(ann.kmeans(x, 20), want)
    assert ann.sample_rows(10_000, 64, "float") == 10_000 and all(ann.sample_rows(10_000, d, t) * d * b <= ann.SAMPLE_BYTES for d in (1536, 8192, 100_000) for t, b in (("float", 4), ("double", 8)))


def test_kept_sha_of_an_empty_text(spark):
    got = lines.digest(lines.dedupe(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).collect()
    assert {r["kept_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_refinement_of_buckets_against_a_count():
    from collections import Counter

    rng = np.random.default_rng(6)
    for length, letters, size in ((400, 1, 1500), (400, 2, 3000), (17, 3, 400), (33, 2, 700), (400, 200, 2000)):
        data = rng.integers(0, letters, size, dtype=np.uint8)
        data[size // 2 : size // 2 + length + 30] = data[: length + 30] if size // 2 > length + 30 else data[size // 2 : size // 2 + length + 30]
        starts = np.sort(rng.choice(size - length + 1, (size - length) // 2, replace=False))
        raw = data.tobytes()
        count = Counter(raw[k : k + length] for k in starts)
        assert suffix.repeated_places(data, starts, length).tolist() == [count[raw[k : k + length]] > 1 for k in starts]


def test_names_with_many_runs_are_dealt_out(spark, monkeypatch):
    shared = prose(11, 90)
    rows = [(k, prose(200 + k, 3) + " " + shared[: 500 - k] + " " + prose(300 + k, 40)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(tuple(r) for r in suffix.dedupe(docs, False).collect())
    monkeypatch.setattr(suffix, "RUNS", 4)
    assert sorted(tuple(r) for r in suffix.dedupe(docs, False).collect()) == whole and sum(r[2] for r in whole) > 10_000

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import ann, credentials, jaccard, lines, packing, quality_gbdt, quality_rules, sentencepiece_codec, suffix, warc
from tidewheel.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.integers(50)}" for _ in range(n))


def edge_rows():
    base = prose(1)
    return [(1, None, None), (2, "", "en"), (3, " \n\t ", None), (4, base, "en"), (5, base, "en"), (5, base, "en"), (6, base + " more", None), (7, "two words", "en"), (8, "TWO words", "en"), (9, prose(2, 4000), "en"), (None, base, "en")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_rules(spark, edges, empty):
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(edges).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[2]["kept"] and rows[4]["n_words"] == 60
    text = " ".join(["a b c d e f g h"] * 4)
    one = quality_rules.apply_rules(spark.createDataFrame([(1, text, "x")], DOCS)).first()
    assert one["n_repeat_words"] == 32 and one["base_failed"]
    assert quality_rules.filter_documents(empty).count() == 0 and quality_rules.filter_documents(edges).columns == edges.columns
    plan = quality_rules.apply_rules(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sentencepiece_parity_bpe(spark, edges, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    codec, own = sentencepiece_codec.Codec(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r["text"] for r in documents(spark).collect()] + ["", "  a  b ", "▁x y", "\n\n 漢字🙂 <s> </s> é", "a\x00b"]
    found = codec.encode(texts)
    assert [list(map(int, x)) for x in found] == own.encode(texts) and [codec.decode(x) for x in found] == own.decode(own.encode(texts))
    assert sentencepiece_codec.digest(edges, path).count() == 11 and sentencepiece_codec.digest(empty, path).count() == 0
    assert all(r["round_trip"] for r in sentencepiece_codec.digest(edges, path).collect())


def message(*parts):
    """A protobuf message of (number, value) parts."""
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3 & 127 | 0x80, number >> 4]) if number > 15 else bytes([number << 3])
            out += bytes([value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2, len(value) & 127 | 0x80, len(value) >> 7]) + value
    return out


def model_file(pieces, kind, byte_fallback=True):
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return data + message((2, message((3, kind), (35, int(byte_fallback))))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


SPECIAL = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
BYTES = [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
NAMES = ["a <s> the", "</s>", "<s></s><unk>", "<0x41>", "a<0x41>e", "<0x4", "the<s>the", "x <unk> y"]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_sentencepiece_parity_unigram(byte_fallback):
    import sentencepiece

    pieces = SPECIAL + [("▁the", -2.0, 1), ("▁", -3.0, 1), ("th", -4.0, 1), ("e", -4.5, 1), ("t", -5.0, 1), ("h", -5.0, 1), ("a", -4.0, 1), ("▁a", -3.5, 1), ("at", -4.2, 1)]
    pieces += [(c, -6.0, 1) for c in "<s>0x/4"] + [("[sep]", 0.0, 4), ("hat", -1.0, 5)] + BYTES * byte_fallback
    data = model_file(pieces, 1, byte_fallback)
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(data)
    texts = ["the that hat", "a  the", "", "tea é x", " at", "the[sep]at [sep]", "q日本z", *NAMES]
    assert [list(map(int, x)) for x in codec.encode(texts)] == own.encode(texts)
    assert [codec.decode(x) for x in codec.encode(texts)] == own.decode(own.encode(texts))


def test_sentencepiece_parity_bpe_with_own_pieces():
    import sentencepiece

    pieces = SPECIAL + BYTES + [("th", -1.0, 1), ("▁th", -2.0, 1), ("▁the", -3.0, 1), ("at", -4.0, 1), ("[sep]", 0.0, 4)]
    pieces += [(c, -10.0 - k, 1) for k, c in enumerate("▁theas<>/0x41[]p")]
    data = model_file(pieces, 2)
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(data)
    texts = ["the that hat", "a the[sep]the [sep] at", "[sep", "é the", *NAMES]
    assert [list(map(int, x)) for x in codec.encode(texts)] == own.encode(texts)


def brute_components(rows, words=5):
    sets = {}
    for doc, text in rows:
        w = (text or "").translate({k: k + 32 for k in range(65, 91)}).split()
        sets[doc] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in ids}


def near_rows(n=40):
    rng, rows = np.random.default_rng(5), []
    for k in range(n):
        words = prose(k % 8, int(rng.integers(6, 90))).split()
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = "changed"
        rows.append((k, " ".join(words)))
    return rows


def test_jaccard_join_against_brute_force(spark, edges, empty, monkeypatch):
    rows = near_rows()
    frame = spark.createDataFrame([(a, b, "x") for a, b in rows], DOCS)
    want = brute_components(rows)
    assert {r[0]: (r[1], r[2]) for r in jaccard.link_components(frame).collect()} == want
    found = {r[0]: r[2] for r in jaccard.link_components(edges).collect()}
    assert found[5] == 4 and found[6] == 4 and found[8] == 7 and found[2] == 2 and found[None] is None
    assert jaccard.link_components(empty).count() == 0
    assert {r["doc_id"] for r in jaccard.keep_one(edges).collect()} == {1, 2, 3, 4, 7, 9, None}


def test_jaccard_large_groups_are_exact(spark):
    from tidewheel.llm import links

    rows = [(k, prose(3, 40) + " " + prose(100 + k // 2, 40 if k % 4 < 2 else 3)) for k in range(60)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in rows], DOCS)
    assert len(rows) > links.SMALL_GROUP
    assert {r[0]: (r[1], r[2]) for r in jaccard.link_components(frame).collect()} == brute_components(rows)


def test_part_enum_shares_signatures():
    rng, bands, cache = np.random.default_rng(0), jaccard.Bands(80, 100), {}
    for size in [1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 100, 400]:
        for _ in range(30):
            x = rng.integers(0, 2**64, size, dtype=np.uint64)
            gone = int(rng.integers(0, size // 9 + 1))
            y = np.concatenate([x[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert len(np.intersect1d(jaccard.signatures(x, bands, cache), jaccard.signatures(y, bands, cache)))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(400)] + [(1000 + k, [1.0] * 16) for k in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2100, [1.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    x, ids = np.array([np.float32(v) for _, v in rows[:430]], float), np.array([k for k, _ in rows[:430]])
    hits = total = 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        own = own.sort_values("rank")
        hits, total = hits + len(set(best) & set(own["vec_id"])), total + 10
        assert np.allclose(own["score"], [d[ids == v][0] for v in own["vec_id"]]) and list(own["rank"]) == list(range(1, 11))
        if q >= 1000:
            assert list(own["vec_id"]) == list(best)
    assert hits / total >= 0.9 and set(got["query_id"]) == {k for k in ids if k % 20 == 0}
    few = ann.search(table.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3 and ann.search(table.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_line_dedup(spark, edges, empty):
    a, b = "the quick brown fox jumps over the lazy dog near the river bank", "something else entirely that shares nothing with others"
    rows = [(1, f"{a}\n{b}", "x"), (2, f"{a.replace('quick', 'quack')}\n\nown line of document two", "x"), (3, f"{b}\n{b}", "x"), (4, "short\nshort", "x"), (5, None, "x")]
    got = {r["doc_id"]: r for r in lines.dedupe(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["text"] == f"{a}\n{b}" and got[2]["text"] == "\nown line of document two" and got[3]["text"] == ""
    assert got[4]["text"] == "short" and got[4]["n_removed"] == 1 and got[5]["text"] is None and got[3]["n_lines"] == 2
    assert lines.dedupe(edges).count() == 11 and lines.dedupe(empty).count() == 0


def test_line_minhash_recall():
    rng, missed, seen = np.random.default_rng(4), 0, 0
    for k in range(300):
        x = prose(k, int(rng.integers(4, 60)))
        y = x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :]
        sx, sy = lines.shingles(x.encode()), lines.shingles(y.encode())
        both = len(np.intersect1d(sx, sy))
        if 100 * both >= 80 * (len(sx) + len(sy) - both):
            sigs, owner = lines.band_signatures([x, y])
            seen, missed = seen + 1, missed + (not len(np.intersect1d(sigs[owner == 0], sigs[owner == 1])))
    assert seen > 200 and missed <= 0.02 * seen


def test_line_minhash_misses_few_pairs_at_the_border():
    rng = np.random.default_rng(9)
    pairs = [(x, x[:76]) for x in ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 94)) for _ in range(3000))]
    assert all(100 * len(lines.shingles(y.encode())) >= 80 * len(lines.shingles(x.encode())) for x, y in pairs)
    sigs, owner = lines.band_signatures([x for pair in pairs for x in pair])
    per = np.split(sigs, np.flatnonzero(np.diff(owner)) + 1)
    assert sum(not set(per[k]) & set(per[k + 1]) for k in range(0, len(per), 2)) <= 3


def test_line_signatures_of_repeated_text():
    phrase = "all of this is said again and once more "
    fill = [prose(k, 40) for k in range(3)]
    for x, y in (("-" * 100, "-" * 200), ("=" * 130, "=" * 5000), (phrase * 3, phrase * 5), (phrase * 4, phrase * 40)):
        both = len(np.intersect1d(lines.shingles(x.encode()), lines.shingles(y.encode())))
        assert both == len(lines.shingles(x.encode())) == len(lines.shingles(y.encode()))
        sigs, owner = lines.band_signatures([fill[0], x, fill[1], y, fill[2]])
        assert set(sigs[owner == 1]) & set(sigs[owner == 3])
        for k, line in enumerate((fill[0], x, fill[1], y, fill[2])):
            assert set(sigs[owner == k]) == set(lines.band_signatures([line])[0])


def test_suffix_dedup_against_brute_force(spark, empty):
    size = suffix.LENGTH
    shared = "".join(chr(97 + k % 26) + str(k) for k in range(200))
    rows = [(1, shared + "x" * 30), (2, "é" + shared + "tail"), (3, "ab " * 400), (4, "y" * (size - 1)), (5, "z" * size), (6, "z" * (size + 1)), (7, None), (8, ""), (9, shared[:450]), (None, prose(3, 80)), (10, prose(3, 80)), (10, prose(3, 80))]
    found = suffix.dedupe(spark.createDataFrame([(a, b, "x") for a, b in rows], DOCS), with_kept=False).collect()
    got = Counter(tuple(r)[:5] for r in found)
    assert all(r["kept_bytes"] == r["n_bytes"] - r["n_removed"] and (r["text"] is None or r["kept_chars"] == len(r["text"])) for r in found)
    data = [(a, (b or "").encode()) for a, b in rows]
    count = Counter(t[k : k + size] for _, t in data for k in range(len(t) - size + 1))
    want = []
    for doc, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if count[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want.append((doc, len(t), len(t) - len(kept), sum(bool(g) and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    assert got == Counter(want) and suffix.dedupe(empty).count() == 0


def test_quality_classifier(spark, edges, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_gbdt.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got["doc_id"], got["held_out"]))
    none = quality_gbdt.classify(edges, labels.limit(0)).toPandas()
    assert len(none) == 11 and (none["score"] == 0.5).all() and quality_gbdt.classify(empty, labels).count() == 0


def test_warc_round_trip(spark):
    html = "<p>" + "word " * 50 + "</p>"
    rows = [(3, "http://a/ b\r\n", html), (1, None, html), (2, "u", html), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (None, "u", html), (7, "u", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages, with_payload=True).collect()}
    assert len(got) == 8 and got[1]["record_type"] == "response" and got[2]["refers_to"] == got[3]["refers_to"] == got[None]["refers_to"] == 1
    assert got[4]["record_type"] == got[5]["record_type"] == "response" and got[6]["payload_bytes"] == 0
    assert got[7]["payload"].decode() == "é" * 300_000 and got[3]["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_splits_own_each_record_once(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 40 + "\x1f\x8b\x08") for k in range(200)], "page_id long, url string, html string").coalesce(2)
    path = f"file://{tmp_path}/archive"
    warc.write(pages, path)
    for size in (97, 1000, 1 << 20):
        assert sorted(r[0] for r in warc.read_pages(spark, path, split_bytes=size).select("page_id").collect()) == list(range(200))


def test_warc_reads_archives_of_others(spark, tmp_path):
    import base64
    import gzip

    def record(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000000>", *more, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body, http = b"<p>page</p>", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    message = "Content-Type: application/http; msgtype=response"
    (tmp_path / "x.warc.gz").write_bytes(
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields")
        + record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request")
        + record("response", http + body, "WARC-Target-URI: http://a/", message, f"WARC-Payload-Digest: sha1:{sha1}")
        + record("response", http + body, "warc-target-uri:http://b/\r\n  more", message, "WARC-Payload-Digest: sha1:AAAA")
        + record("revisit", http, message, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:1>")
        + record("resource", body, "Content-Type: text/html", "WARC-Payload-Digest: blake3:00")
    )
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted(r["record_type"] for r in rows) == ["request", "resource", "response", "response", "revisit", "warcinfo"]
    by = {(r["record_type"], r["url"]): r for r in rows}
    whole = hashlib.sha256(body).hexdigest()
    first, second = by["response", "http://a/"], by["response", "http://b/ more"]
    assert first["payload"] == second["payload"] == body and first["payload_digest"] == whole and first["intact"] and second["intact"] is False
    again, resource = by["revisit", None], by["resource", None]
    assert again["payload_digest"] == f"sha1:{sha1}" and again["refers_to"] == "<urn:uuid:1>" and again["payload_bytes"] is None
    assert resource["payload"] == body and resource["intact"] is None and by["warcinfo", None]["payload_bytes"] == 13
    pages = warc.read_pages(spark, f"file://{tmp_path}").where("record_type <> 'response'")
    assert [r["page_id"] for r in pages.select("page_id").collect()] == [None] * 4


def test_packing(spark, edges, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    docs = documents(spark)
    rows = packing.pack(docs, path).collect()
    t, want = Tokenizer.from_file(path), {}
    for r in docs.collect():
        want[r["doc_id"]] = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    parts, places = {}, {}
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 4096 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: sum((x[2] for x in sorted(p)), []) for d, p in parts.items()} == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(map(len, want.values())) // 4096) + 1
    assert packing.pack(edges, path).count() >= 11 and packing.pack(empty, path).count() == 0


def test_fullest_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(1, 60))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        used = packing.fullest(counts, room)
        assert sum(k * n for k, n in used) == max(sums) and all(n <= counts[k] for k, n in used)


def test_credentials(spark, edges, empty):
    rng = np.random.default_rng(2)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(60)]
    rows = [(k, f"mail mail{k}.example.com then password = \"{keys[k][:18]}\" and {keys[k]} end", "x") for k in range(60)]
    rows.append((100, "é a lone " + keys[0][:20] + " and card 4041894974608795 and the-quick-brown-fox-2 token: ab", "x"))
    got = {r["doc_id"]: r for r in credentials.digest(credentials.scan(spark.createDataFrame(rows, DOCS))).collect()}
    assert got[3]["n_assign"] == 1 and got[3]["n_hex"] == 1 and got[3]["n_access"] == 0
    assert got[100]["n_assign"] == 0 and got[100]["spans"] == "inferred:9:29" and got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    base = credentials.base_spans(rows[3][1])
    text = ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, b, k, _ in base)
    assert got[3]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert credentials.scan(edges).count() == 11 and credentials.scan(empty).count() == 0
    assert credentials.mask("abcdef", [(1, 3), (2, 4)]) == f"a{credentials.MASK}ef"
    assert credentials.mask_documents(edges).columns == edges.columns


def test_credentials_find_a_common_bare_format(spark):
    rng = np.random.default_rng(6)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 20)) for _ in range(200)]
    rows = [(k, f"see {keys[k]} from bob@mail{k}.example.com", "x") for k in range(150)]
    rows += [(k, f"password = {keys[k]} end", "x") for k in range(150, 200)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["spans"] for r in credentials.digest(credentials.scan(docs)).collect()}
    assert all(got[k] == "inferred:4:24" for k in range(150)) and all(got[k] == "assign:0:31" for k in range(150, 200))


def test_credentials_of_mixed_case_and_behind_names():
    rng = np.random.default_rng(7)
    chars = list("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    key = lambda n: "".join(rng.choice(chars, n))
    automata = {"assign": credentials.labelled_automaton([key(n).translate(credentials.CLASSES) for n in (12, 20, 32, 40) for _ in range(50)])}
    for n in (20, 32, 40):
        for k in (key(n) for _ in range(50)):
            for text, at in ((f"see {k} there", 4), (f"AWS_SECRET_ACCESS_KEY={k}", 22), (f"x https://a.b/{k}/c", 14), (f"It is {k}.", 6)):
                assert (at, at + n) in credentials.added_spans(text, [], automata), text
    assert credentials.added_spans("a B7xKq2LmZ9wT b", [], automata) == [(2, 14)] and credentials.added_spans("a bRtKqHLmZgwTpXcVnYsD b", [], automata) == [(2, 22)]
    assert not credentials.added_spans("getElementsByClassName the-quick-brown-fox-2 4041894974608795 mail8.example.com", [], automata)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, counts = documents(spark), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] == counts[3] <= counts[4]


def pipeline_rows():
    """(doc_id, text), and the bare and named keys in them."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    line = lambda: " ".join(["the", *(word() for _ in range(11))])
    keys = ["".join(rng.choice(list("0123456789abcdef"), 20)) for _ in range(60)]
    marks = [f"password = {x}" if k % 2 else x for k, x in enumerate(keys)]
    rows = [(k, "\n".join([line(), line(), f"{line()} {marks[k]}", line()])) for k in range(60)]
    texts = dict(rows)
    first = texts[1].split("\n")[0]
    rows += [(100, texts[0]), (101, "\n".join([f"{first[:30]}#{first[31:]}", line(), line(), line()])), (102, texts[2].replace("\n", " "))]
    rows += [(103, "too short"), (104, "\n".join([line()] * 10)), (105, line() + " # $ % & * | < > # $\n" + line()), (106, None)]
    return rows, marks


def brute_quality(text):
    words, rows = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    stop = {w for ws in quality_rules.STOP_WORDS.values() for w in ws}
    return (
        len(words) >= 20 and len(repeated) <= 0.3 * len(words) and 1.5 <= sum(map(len, words)) / len(words) <= 25
        and sum(text.count(c) for c in "#*$%&|<>") <= 0.2 * len(words) and sum(w.lower() in stop for w in words) >= 0.01 * len(words)
        and len(rows) - len(set(rows)) <= 0.5 * len(rows)
    )


def brute_lines(rows):
    at = [(d, k, x) for d, text in sorted(rows) for k, x in enumerate(text.split("\n"))]
    sets = [{x[i : i + 5] for i in range(max(len(x) - 4, 1))} for _, _, x in at]
    label = list(range(len(at)))
    for j in range(len(at)):
        for i in range(j):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    kept = {}
    for k, (d, _, x) in enumerate(at):
        if label[k] == k:
            kept.setdefault(d, []).append(x)
    return [(d, "\n".join(x)) for d, x in kept.items()]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, marks = pipeline_rows()
    want = [[(d, t) for d, t in rows if brute_quality(t)]]
    want.append(brute_lines(want[0]))
    groups = brute_components(want[1])
    want.append([(d, t) for d, t in want[1] if groups[d][1] == d])
    masked = []
    for d, t in want[2]:
        for x in marks:
            t = t.replace(x, credentials.MASK)
        masked.append((d, t))
    want.append(masked)
    assert [len(x) for x in want] == [63, 62, 61, 61] and dict(want[1])[101].count("\n") == 2

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "x", len(t or "")) for d, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), rows_of in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == sorted((d, t, len(t)) for d, t in rows_of)
    codec = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {d: [*codec.encode(t, add_special_tokens=False).ids, 1] for d, t in want[3]}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in found) == sorted((d, 0, len(x), crc(x)) for d, x in ids.items())

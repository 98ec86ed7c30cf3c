import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vecspark.llm import media, packing, scratch, warc

# ---- archives


def pages(spark):
    big = "x" * 200
    rows = [(1, "http://a\r\nX-Bad: y", big), (2, None, big), (None, "u", None), (None, "u", big), (4, "http://é", "é" * 300), (3, "u", big), (1, "u", big), (5, "u", "short"), (6, "u", "short"), (7, "u", "")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int")


def test_archives_round_trip(spark):
    df = pages(spark)
    got = warc.read_archives(warc.write_archives(df, scratch.new_path(spark, "w"))).collect()
    assert len(got) == df.count()
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    assert [(r["record_type"], r["refers_to"]) for r in by[2] + by[3]] == [("revisit", 1)] * 2
    assert [r["record_type"] for r in by[1]] == ["response"] * 2 and bytes(by[1][0]["payload"]) == b"x" * 200
    assert sorted(r["record_type"] for r in by[None]) == ["response", "revisit"]
    assert bytes(by[4][0]["payload"]).decode() == "é" * 300 and by[4][0]["payload_bytes"] == 600
    assert [by[i][0]["record_type"] for i in (5, 6, 7)] == ["response"] * 3
    assert all(r["payload_digest"] == hashlib.sha256(b"x" * 200).hexdigest() and r["payload_bytes"] == 200 for r in by[2])
    assert "\n" not in by[1][0]["url"] + by[1][1]["url"]
    folder = scratch.new_path(spark, "w")
    assert warc.read_archives(warc.write_archives(df.limit(0), folder)).count() == 0


def test_dictionary_comes_first_and_records_can_be_read_alone(spark, tmp_path):
    import zstandard

    a = warc.Archive(str(tmp_path / "a.warc.zst"))
    payloads = [f"<html><head><title>Page {i}</title></head><body>{'common words of all pages ' * 20}{i * i}</body></html>".encode() for i in range(300)]
    for i, p in enumerate(payloads):
        a.add(warc.record(i, "http://x/", p, hashlib.sha256(p).hexdigest(), None, False))
    path, records, size, dictionary = a.close()
    data = open(path, "rb").read()
    assert (records, size) == (300, len(data)) and dictionary > 0 and size < sum(map(len, payloads)) / 5
    magic, n = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
    rest, found = data[8 + n :], 0
    while rest:
        z = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        record = z.decompress(rest)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(payloads[found] + b"\r\n\r\n")
        rest, found = z.unused_data, found + 1
    assert found == 300
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.read_records(path)] == payloads


def test_long_and_few_records_get_a_dictionary_too(tmp_path, spark):
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words, n)).encode()
    cases = {"one record larger than the sample": [text(800_000)], "three long ones": [text(50_000) for _ in range(3)], "a few short ones": [text(300) for _ in range(12)]}
    for k, (name, payloads) in enumerate(cases.items()):
        a = warc.Archive(str(tmp_path / f"{k}.warc.zst"))
        for i, p in enumerate(payloads):
            a.add(warc.record(i, "u", p, hashlib.sha256(p).hexdigest(), None, False))
        path, n, _, dictionary = a.close()
        assert dictionary > 0 and n == len(payloads), name
        assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.read_records(path)] == payloads
    df = spark.createDataFrame([(i, "u", text(700_000 * (i == 0) + 10).decode()) for i in range(4)], "page_id long, url string, html string")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(warc.write_archives(df, scratch.new_path(spark, "w"))).collect()}
    assert got == {r["page_id"]: r["html"] for r in df.collect()}


def test_a_changed_payload_is_noticed(spark, tmp_path):
    a = warc.Archive(str(tmp_path / "a.warc.zst"))
    a.add(warc.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None, False))
    manifest = spark.createDataFrame([a.close()], warc.MANIFEST)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(manifest).collect()


def test_archives_roll_over(spark):
    df = spark.createDataFrame([(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, scratch.new_path(spark, "w"), archive_bytes=1)
    assert manifest.count() >= 1 and manifest.groupBy().sum("records").first()[0] == 200
    assert warc.read_archives(manifest).select("page_id").distinct().count() == 200


# ---- packing


def check_pieces(rows, texts):
    """rows of pieces against the tokenizer itself; texts: Counter of (doc_id, text)."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for (i, t), n in texts.items():
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] += n * len(ids)
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
        assert r["length"] > 0
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_pieces_of_documents(spark, documents):
    rows = packing.pack_documents(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert check_pieces(rows, Counter(texts.items())) <= 4096 * documents.rdd.getNumPartitions()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary())
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, pieces in by.items():
        ids = np.array(model.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_packing_edges(edges, empty):
    edges = edges.select("doc_id", "text").union(edges.sparkSession.createDataFrame([(20, "<|endoftext|>"), (21, "one<|startoftext|>two <|endoftext|>")], "doc_id long, text string"))
    texts = Counter((r["doc_id"], r["text"]) for r in edges.collect())
    check_pieces(packing.pack_documents(edges).collect(), texts)
    check_pieces(packing.pack_documents(edges, batch_tokens=100).collect(), texts)
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_pack_covers_everything_without_gaps(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([1, 3, 100, 511, 512, 513, 2048, 4096, 9000], rng.integers(0, 60)).tolist()
    windows, rest = packing.pack(lengths)
    assert not rest
    covered = defaultdict(list)
    for size, window in windows:
        assert sum(p.length for p in window) == size
        for p in window:
            covered[p.doc].append((p.start, p.length))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(covered[d]):
            assert s == at and k > 0
            at += k
        assert at == n
    assert sum(s & (s - 1) != 0 for s, _ in windows) <= 1  # one window that is padded at most
    full, waits = packing.pack(lengths, final=False)
    assert all(s in packing.TIERS for s, _ in full) and sum(p.length for p in waits) + sum(s for s, _ in full) == sum(lengths)


def test_step_groups_are_even():
    sizes = [4096] * 50 + [512] * 130 + [1024] * 31
    groups = packing.step_groups(sizes, 32_768)
    load = Counter()
    for g, s in zip(groups, sizes):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 4096


ODD = [
    "a\x1fb c", "ΑΣ Σ, İstanbul don't we'll 'S x² ½ 12ab a1 —dash “q” étude É́ Å naïve!!!", "<|endoftext|> x<|endoftext|>y z q ​ 日本語、テスト", "a<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof text|> <|endoftext", "<|endoftext|>" * 3 + "Σ\x1f<|startoftext|>",
    "re're's 'll", "A" * 100 + " b " + "q" * 70 + "..", "ŉ ǅ ﬁ ß ẞ", "",
]


def test_words_are_encoded_as_in_their_text(documents):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary())
    texts = ODD + [r["text"] for r in documents.limit(200).collect()]
    got = packing.WordTokenizer(packing.default_vocabulary()).batch(texts)
    assert [g.tolist() for g in got] == [model.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    t = packing.WordTokenizer(packing.default_vocabulary())
    for k in range(20):
        t.batch([" ".join(f"w{k}x{i}" for i in range(30))])
        assert len(t.known) <= 60


class Counting:
    """A tokenizer that counts the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, Counter()

    def encode_batch_fast(self, texts, **options):
        self.words.update(w for t in texts for w in t.split())
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_that_come_back_are_not_encoded_again(monkeypatch):
    def word(i):
        return "q" + "".join("abcdefghij"[int(c)] for c in f"{i:05}")

    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    t = packing.WordTokenizer(packing.default_vocabulary())
    t.bare = Counting(t.bare)
    common = [word(i) for i in range(60)]
    for k in range(1, 20):
        t.batch([" ".join(common + [word(100 * k + i) for i in range(60)])])
    assert [t.bare.words[w] for w in common] == [1] * 60
    assert len(t.stems) <= 360


def test_white_space_of_any_kind_is_encoded_as_in_its_text():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary())
    odd = [*map(chr, range(0x21)), *"\x7f\x85\xa0\u0301\u1680\u180e\u2003\u200b\u2028\u3000\ufeff"]
    texts = [f"{c}It{c}is {c} so,{c}\n{c}E\u0301t{c}\u0301 <|endoftext|>{c}" for c in odd]
    got = packing.WordTokenizer(packing.default_vocabulary()).batch(texts)
    assert [g.tolist() for g in got] == [model.encode(t, add_special_tokens=False).ids + [2] for t in texts]


# ---- images


def image_table(ids, images):
    rows = [(i, *x.shape, media.describe(x[None])[0].tobytes()) for i, x in zip(ids, images)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["id", "height", "width", "corners"])


def unit_vectors(rng, n):
    x = rng.standard_normal((n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_edited_copies_are_found_and_others_are_not(spark):
    x = unit_vectors(np.random.default_rng(7), 300)
    x[201] = x[200]  # equal images
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["query_id"]: r for r in media.find_copies(df, every=4).collect()}
    assert set(got) == set(range(0, 300, 4))
    hit = np.mean([any(m["match_id"] == r["class_id"] for m in r["links"]) for r in got.values()])
    wrong = sum(m["match_id"] != r["class_id"] for r in got.values() for m in r["links"])
    assert hit >= 0.95 and wrong <= 5
    classes = dict(media.classes(df).collect())
    assert classes[201] == 200 and classes[5] == 5


RNG = np.random.default_rng(3)
STRONG = {
    "noise": lambda x: x + RNG.normal(0, 8, x.shape), "5 degrees": lambda x: media.turned(x, 5), "10 degrees": lambda x: media.turned(x, 10), "20 degrees": lambda x: media.turned(x, 20),
    "30 degrees": lambda x: media.turned(x, 30), "0.7": lambda x: media.turned(x, 0, 0.7), "0.8": lambda x: media.turned(x, 0, 0.8), "1.2": lambda x: media.turned(x, 0, 1.2),
    "1.4": lambda x: media.turned(x, 0, 1.4), "coarse": lambda x: media.coarsened(x, 8), "crop": lambda x: media.cropped(x, 0.7, 777), "mirrored contrast": lambda x: x * 0.5 + 90,
}


@pytest.mark.parametrize("edit", STRONG)
def test_recall_under_an_edit(edit):
    images = media.render(unit_vectors(np.random.default_rng(21), 40))
    base = media.Images(image_table(range(40), images))
    ask = media.Images(image_table(range(40), [np.clip(np.rint(STRONG[edit](x)), 0, 255).astype(np.uint8) for x in images]))
    found = {(int(i), int(j)) for rows in media.linked(ask, base, media.Tables(base.bits)) for i, j in zip(*rows[:2])}
    assert sum((i, i) in found for i in range(40)) >= 36 and sum(i != j for i, j in found) <= 4


def test_links_against_all_pairs_of_descriptors():
    rng = np.random.default_rng(22)
    x = unit_vectors(rng, 250)
    x[150:] = x[:100] + rng.normal(0, 0.02, (100, 64))  # near copies
    images = media.render(x)
    base = media.Images(image_table(range(250), images))
    ask = media.Images(image_table(range(0, 250, 3), [media.edited(images[i], i) for i in range(0, 250, 3)]))
    bits = np.bitwise_count(ask.bits[:, None] ^ base.bits[None]).sum(2)

    def votes(most):
        return {(int(ask.id[u]), int(v)): int(n) for u, v, n in zip(*media._votes(ask, base, *np.nonzero(bits <= most)))}

    seeds, size = votes(media.SEED_BITS), dict(zip(ask.id.tolist(), (ask.end - ask.start).tolist()))
    want = {k: n for k, n in votes(media.MAX_BITS).items() if n >= max(media.MIN_MATCHES, media.MIN_SHARE * size[k[0]]) and seeds.get(k, 0) >= media.SEEDS}
    tables = media.Tables(base.bits)
    exact, quick = ({(int(u), int(v)): int(n) for rows in media.linked(ask, base, tables, radius=r) for u, v, n in zip(*rows)} for r in (1, 0))
    assert exact == want and len(want) > 100
    assert set(quick.items()) <= set(want.items()) and len(quick) >= 0.98 * len(want)


def test_tables_meet_all_pairs_within_the_stated_bits():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 64, (400, 4), dtype=np.uint64)

    def flipped(bits, n):
        flips = np.zeros((len(bits), 256), np.uint8)
        for row in flips:
            row[(np.arange(n) * 256 // max(n, 1) + rng.integers(256)) % 256] = 1  # evenly spread
        return bits ^ np.packbits(flips, axis=1, bitorder="little").view("<u8")

    base[200:300] = flipped(base[:100], 30)  # near each other too
    ask = np.concatenate([flipped(base[k * 40 : k * 40 + 40], n) for k, n in enumerate((0, 1, 8, 15, 16, 24, 31, 32))])
    bits = np.bitwise_count(ask[:, None] ^ base[None]).sum(2)
    tables = media.Tables(base)
    for radius, most in ((0, 15), (1, 31), (1, 20), (0, 0)):
        pairs = [p for i, j in tables.near(ask, most, radius) for p in zip(i.tolist(), j.tolist())]
        assert len(pairs) == len(set(pairs)) and set(pairs) == set(map(tuple, np.argwhere(bits <= most).tolist()))


def test_pairs_in_pieces_give_the_same(monkeypatch):
    images = media.render(unit_vectors(np.random.default_rng(23), 40))
    base = media.Images(image_table(range(40), images))
    whole = sorted(p for i, j in media.Tables(base.bits).near(base.bits, radius=1) for p in zip(i.tolist(), j.tolist()))
    monkeypatch.setattr(media, "PAIRS_AT_ONCE", 97)
    assert sorted(p for i, j in media.Tables(base.bits).near(base.bits, radius=1) for p in zip(i.tolist(), j.tolist())) == whole


def test_query_blocks_and_base_blocks_give_the_same(spark, monkeypatch):
    x = unit_vectors(np.random.default_rng(24), 120)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    table = media.corners(df.selectExpr("vec_id as id", "embedding as media"))
    whole = set(map(tuple, media.match(table, table).collect()))
    monkeypatch.setattr(media, "QUERY_BLOCK", 2000)
    assert set(map(tuple, media.match(table, table).collect())) == whole and {(i, i) for i in range(120)} <= {p[:2] for p in whole}


def test_strips_of_large_images_give_the_same(monkeypatch):
    rng = np.random.default_rng(25)
    image = np.kron(media.render(unit_vectors(rng, 1))[0], np.ones((2, 3)))[:, :200] + rng.integers(0, 9, (192, 200))
    whole = media.describe(image[None])[0]
    monkeypatch.setattr(media, "STRIP", 37)
    pieces = media.describe(image[None])[0]
    assert len(whole) > 100 and np.array_equal(np.sort(whole, order=["level", "y", "x"]), np.sort(pieces, order=["level", "y", "x"]))


def test_descriptors_turn_with_the_image():
    rng = np.random.default_rng(8)
    image = media.render(rng.standard_normal((1, 64)) / 8)[0]
    a, b = (media.describe(np.rot90(image, k)[None])[0]["bits"] for k in (0, 1))
    assert np.mean(np.bitwise_count(a[:, None] ^ b[None]).sum(2).min(1) <= media.MAX_BITS) > 0.6
    assert len(media.describe(np.full((1, 96, 96), 7, np.uint8))[0]) == 0
    assert len(media.describe(np.zeros((1, 10, 10)))[0]) == 0
    wide = media.describe(np.stack([np.kron(image, np.ones((1, 3)))] * 2))
    assert len(wide) == 2 and np.array_equal(*wide) and wide[0]["x"].max() > 96


def test_media_edges(spark):
    v = np.random.default_rng(9).standard_normal(64).tolist()
    rows = [(0, v, 1), (0, v, 1), (50, v, 1), (None, v, 1), (100, None, 1), (150, [1.0], 1), (200, [0.0] * 64, 1), (250, [float("nan")] * 64, 1), (300, [None] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = {r["query_id"]: r for r in media.find_copies(df).collect()}
    assert set(got) == {0, 50, 200, 250}
    assert got[50]["class_id"] == 0 and got[200]["n_links"] == 0 and got[250]["class_id"] == 200
    assert media.find_copies(df.limit(0)).count() == 0


def test_pgm_files(spark):
    rng = np.random.default_rng(10)
    images = media.render(rng.standard_normal((60, 64)) / 8)
    pgm = lambda x: b"P5\n# made here\n%d %d\n255\n" % x.shape[::-1] + x.tobytes()
    rows = [(i, pgm(x)) for i, x in enumerate(images)] + [(100, pgm(np.pad(images[3], 10))), (200, b"P5\n9 9\n255\nshort"), (300, b"no image"), (400, b""), (500, None)]
    df = spark.createDataFrame(rows, "vec_id long, media binary")
    got = {r["query_id"]: r for r in media.find_copies(df, media_col="media", decode=media.decode_pgm, every=10).collect()}
    assert set(got) == {0, 10, 20, 30, 40, 50, 100}
    assert np.mean([any(m["match_id"] == i for m in r["links"]) for i, r in got.items()]) >= 0.85
    assert {m["match_id"] for m in got[100]["links"]} == {3, 100}

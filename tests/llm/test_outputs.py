"""Token files, packing, archives, piece sampling and sharding."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aprlens.llm import archives, packing, pieces, sharding, token_codes
from aprlens.llm.bpe import Bpe

VOCABULARY, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "a", " a", "a ", "a  b", "it's we'll\nnow\n\nx", "tab\tx\r\ny", "<|endoftext|> x", "日本語 text", "１２ ⅷ",
    "Ünï çödé z", " nbsp ", "a" * 3000, "\U0001f600 🏴‍☠️", "naïve, 3.14!? $$$", "\x00\x01",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(library):
    rng = random.Random(8)
    signs = ["a", "B", " ", "  ", "\n", "'s", "é", "9", "-", "###", "\t", "ж", "ß", "中"]
    texts = HARD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    bpe = Bpe(VOCABULARY, most=50)
    for batch in (texts, texts[::-1]):
        assert [array("I", x).tolist() for x in bpe.encode(batch)] == [library(t) for t in batch]


def test_special_tokens_in_texts_are_as_by_the_library(spark):
    default = Tokenizer.from_file(VOCABULARY)
    texts = [*HARD, "a <|endoftext|> b", "x<|endoftext|>y\nz", "<|endoftext|><|endoftext|>", "<|endoftext| >"]
    plain = [default.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [array("I", x).tolist() for x in Bpe(VOCABULARY, added=True).encode(texts)] == plain
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in token_codes.token_table(docs, VOCABULARY).collect()}
    expected = [(len(x) + 1, zlib.crc32(array("I", [*x, 0]).tobytes())) for x in plain]
    assert [(found[i]["n_tokens"], found[i]["ids_crc32"]) for i in range(len(texts))] == expected
    packed = packing.packed_batches(docs, VOCABULARY).collect()
    assert {r["doc_id"]: r["start"] + r["n_tokens"] for r in packed if r["part"] == 0 and len(plain[r["doc_id"]]) < 2000} == {
        i: len(x) + 1 for i, x in enumerate(plain)
    }


def test_control_signs_are_as_by_the_library():
    """Every control sign and blank beside contractions, words, digits and marks, with the library's defaults."""
    default = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(28)
    odd = [*map(chr, [*range(0x20), *range(0x7F, 0xA1), 0x1680, 0x2000, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])]
    signs = [*odd, " ", "\n", "'s", "'re", "a", "Bc", "é", "9", ".", "-", "<|endoftext|>"]
    texts = [f"{c}'s" for c in odd] + [f"a{c}b {c} 'll" for c in odd]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(4_000)]
    bpe = Bpe(VOCABULARY, most=100, added=True)
    found = [array("I", x).tolist() for x in bpe.encode(texts)]
    assert found == [default.encode(t, add_special_tokens=False).ids for t in texts]


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 3000), rng.integers(0, 1 << 17, 3000), [0, 255, 256, 65535, 65536, (1 << 32) - 1]])
    rng.shuffle(ids)
    ends = np.array([0, 10, 10, 5000, len(ids)])
    file = token_codes.TokenFile(token_codes.encoded(ids, ends, [1, None, 2, 3, 4]))
    assert file.doc_ids == [1, None, 2, 3, 4] and file.ends.tolist() == ends.tolist()
    assert [file.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in ((0, len(ids)), (511, 513), (5, 5), (700, 4099)):
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        token_codes.TokenFile(b"something else")


def test_token_files_equal_plain_encoding(odd_docs, no_docs, library, tmp_path):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, expected = 0, []
    for doc_id, text in rows:
        ids = [*library(text), 0]
        expected.append((doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    found = token_codes.token_table(odd_docs, VOCABULARY, f"file://{tmp_path}/a b").collect()
    assert Counter(map(tuple, found)) == Counter(expected)
    assert token_codes.token_table(no_docs, VOCABULARY).count() == 0


def test_small_token_files_keep_the_order(odd_docs, tmp_path):
    found = token_codes.write_tokens(odd_docs, VOCABULARY, str(tmp_path), file_tokens=300).orderBy("start").collect()
    assert len(found) > 3
    assert all(a["start"] + a["tokens"] == b["start"] for a, b in itertools.pairwise(found))
    assert [(r["part"], r["place"]) for r in found] == sorted((r["part"], r["place"]) for r in found)


def test_bounds_minimise_padding():
    rng = random.Random(6)
    for _ in range(40):
        lengths = rng.sample(range(1, 30), rng.randint(1, 8))
        histogram = {n: rng.randint(1, 20) for n in lengths}
        buckets = rng.randint(1, 4)
        top = max(lengths)

        def padding(bounds, histogram=histogram):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())

        best = min(
            padding([*c, top]) for k in range(buckets) for c in itertools.combinations(sorted(lengths)[:-1], min(k, len(lengths) - 1))
        )
        bounds = packing.bucket_bounds(histogram, buckets)
        assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and padding(bounds) == best
    assert packing.bucket_bounds({}, 3) == []


def test_packing_is_whole(odd_docs, no_docs, library):
    out = packing.packed_batches(odd_docs, VOCABULARY, max_length=64, buckets=4, budget=256).collect()
    total = Counter()
    for r in out:
        total[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= r["bucket_length"] <= 64 and r["start"] == 64 * r["part"]
        assert r["place"] < max(1, 256 // r["bucket_length"])
    expected = Counter()
    for r in odd_docs.collect():
        expected[r["doc_id"]] += len(library(r["text"])) + 1
    assert total == expected
    places = Counter((r["bucket"], r["batch"], r["place"]) for r in out)
    assert max(places.values()) == 1
    for bucket in {r["bucket"] for r in out}:
        rows = [r for r in out if r["bucket"] == bucket]
        size = max(1, 256 // rows[0]["bucket_length"])
        slots = sorted(r["batch"] * size + r["place"] for r in rows)
        assert slots == list(range(len(rows)))
    assert packing.packed_batches(no_docs, VOCABULARY).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(60)]
    rows += [(60, None, None), (61, "a b\nc", ""), (None, "u", "<p>0</p>"), (62, "u", "HTTP/1.1 \r\n\r\n"), (63, "é", "ü" * 200_000), (3, "http://x/3", "<p>3</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, key int").repartition(4)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    expected = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        first = largest[h or ""] == (-1 if i is None else i)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected[(i, len(body), digest, "response" if first else "revisit", None if first else largest[h or ""])] += 1
    found = archives.archived(pages, folder=f"file://{tmp_path}/x").collect()
    assert Counter(map(tuple, found)) == expected
    kinds = Counter(r["record_type"] for r in archives.archived(pages, least=1000).collect())
    assert kinds == {"response": len(rows)}
    assert archives.archived(pages.limit(0)).count() == 0


def test_arc_versions_and_faults():
    for version in "12":
        head = archives.arc_header(version, "a.arc", "19991231")
        record = archives.arc_record(version, "http://x/", "1.2.3.4", "19991231235959", "text/html", b"body\nmore", "a.arc")
        found = list(archives.arc_records(head + b"\n" + record + record))
        assert [r["block"] for r in found] == [b"body\nmore"] * 2 and found[0]["date"] == "19991231235959"
        with pytest.raises(ValueError):
            list(archives.arc_records(head + record[:-5]))
    with pytest.raises(ValueError):
        list(archives.arc_records(archives.arc_header("2", "a", "1") + archives.arc_record("1", "u", "i", "d", "m", b"", "a")))
    assert archives.warc_date("199912312359") == "1999-12-31T23:59:00Z"
    assert archives.warc_date("?") == "1970-01-01T00:00:00Z"


def test_a_broken_archive_is_reported(spark, tmp_path):
    (tmp_path / "arcs").mkdir()
    record = archives.arc_record("1", "http://x/", "1.2.3.4", "2001", "text/plain", b"plain", "a")
    (tmp_path / "arcs/a.arc").write_bytes(archives.arc_header("1", "a", "2001") + record + b"garbage")
    names, problems = archives.convert(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs"))
    assert names.count() == 1 and [r["file"] for r in problems.collect()] == ["a.arc"]
    (row,) = archives.read_warcs(spark, str(tmp_path / "warcs")).collect()
    assert (row["type"], row["size"]) == ("resource", 5)


def test_pages_with_urls_of_version_blocks_are_kept(spark, tmp_path):
    rows = [(i, f"filedesc://old-{i}.arc" if i % 3 == 0 else f"http://x/{i}", f"2 0 page {i}\n") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = archives.archived(pages, folder=f"file://{tmp_path}/x").collect()
    assert sorted(r["page_id"] for r in found) == list(range(30))


def test_reading_goes_on_behind_a_bad_record(spark, tmp_path):
    record = lambda version, n: archives.arc_record(version, f"u{n}", "i", "1999", "m", b"body", "a")
    opening = lambda version: archives.arc_header(version, "a", "1999")
    text = opening("1") + record("1", 1) + record("2", 2) + record("1", 3) + opening("2") + record("2", 4)
    found = list(archives.arc_entries(text))
    assert [r["url"] for r in found if isinstance(r, dict)] == ["u1", "u3", "u4"] and len(found) == 4
    packed = [zlib.compress(x, wbits=31) for x in (opening("1"), b"garbage", record("1", 1))]
    found = list(archives.arc_entries(b"".join(packed)))
    assert isinstance(found[0], str) and [r["url"] for r in found[1:]] == ["u1"]
    (tmp_path / "x/arc").mkdir(parents=True)
    (tmp_path / "x/arc/bad.arc").write_bytes(b"garbage")
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    with pytest.raises(RuntimeError, match="bad.arc"):
        archives.archived(pages, folder=f"file://{tmp_path}/x")


def test_sampled_pieces_are_lossless_and_repeatable(odd_docs, no_docs):
    found = pieces.sampled_pieces(odd_docs, PIECES, seed=5, with_ids=True).collect()
    assert all(r["lossless"] for r in found)
    assert Counter((r["doc_id"], r["n_pieces"] == 0) for r in found) == Counter((r["doc_id"], not r["text"]) for r in odd_docs.collect())
    again = pieces.sampled_pieces(odd_docs.repartition(1), PIECES, seed=5).collect()
    digest = lambda rows: Counter((r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in rows)
    assert digest(found) == digest(again) != digest(pieces.sampled_pieces(odd_docs, PIECES, seed=6).collect())
    assert pieces.sampled_pieces(no_docs, PIECES).count() == 0
    model = pieces.piece_model(PIECES)
    ids, n = model.encode(HARD, pieces.row_keys(list(range(len(HARD))), 1))
    stop = np.cumsum(n)
    assert [model.decode(ids[e - k : e]) for e, k in zip(stop, n, strict=True)] == [(t or "").encode() for t in HARD]


def test_samples_follow_the_lattice():
    """Relative frequencies of all segmentations of a short word against their weights."""
    model = pieces.piece_model(PIECES)
    word, usable = "▁ther", {p: i for i, p in enumerate(model.pieces) if i > 258}
    paths = []
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[at:i])
                at = i
        if all(p in usable for p in parts):
            paths.append(tuple(usable[p] for p in parts))
    weight = np.array([np.exp(pieces.SHARPNESS * sum(model.scores[i] for i in p)) for p in paths])
    n = 20_000
    ids, count = model.encode(["ther"] * n, pieces.row_keys(list(range(n)), 3))
    stop = np.cumsum(count)
    seen = Counter(tuple(ids[e - k : e]) for e, k in zip(stop, count, strict=True))
    assert set(seen) <= set(paths)
    share = np.array([seen[p] / n for p in paths])
    assert np.abs(share - weight / weight.sum()).max() < 0.015


def test_shards_are_even_and_gapless(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(0, 400)) for i in range(900)] + [(1000 + i, "hot text " * 20) for i in range(500)] + [(None, None), (5, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.sharded(docs, 6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes, counts = Counter(), Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert set(sizes) == set(range(6)) and max(sizes.values()) < 1.05 * min(sizes.values())
    for s in range(6):
        mine = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        ids = [r["doc_id"] for r in mine if r["doc_id"] is not None]
        assert ids == sorted(ids)
    groups = {}
    for r in out:
        if not 1000 <= (r["doc_id"] or 0) < 1500:
            groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    assert sharding.sharded(odd_docs).count() == odd_docs.count()
    assert sharding.sharded(no_docs).count() == 0


def test_packing_vectors_takes_the_best_dot_product():
    items = np.random.default_rng(0).random((200, 3))
    items /= items.sum(0)
    weights = (4.0, 1.0, 1.0)
    where, residual = sharding.packed(items, 5, weights), np.full((5, 3), 0.2)
    for k in sorted(range(200), key=lambda k: (-(items[k] * weights).sum(), k)):
        assert where[k] == int(np.argmax([(r * items[k] * weights).sum() for r in residual]))
        residual[where[k]] -= items[k]

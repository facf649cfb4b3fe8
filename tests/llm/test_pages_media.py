"""WARC archives, media columns and extraction of main text."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from verdure.llm import common, html_extract, media, queries, warc

PAGES = "page_id long, url string, html string, payload string, id long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], PAGES)


def test_warc_rules_and_edges(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a", big), (7, "http://b\r\nX: y", big), (3, None, big), (2, "u", other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (None, "u", big), (7, "u", big)]
    got = sorted((r.asDict() for r in warc.archive_round_trip(spark, pages(spark, rows)).collect()), key=lambda r: (r["record_id"] or 0))
    by = {}
    for r in got:
        by.setdefault(r["record_id"], []).append(r)
    assert len(got) == len(rows)
    for i in (1, 3, None):
        assert [(x["record_type"], x["refers_to"], x["payload_bytes"]) for x in by[i]] == [("revisit", 7, 1200)]
    assert [x["record_type"] for x in by[7]] == ["response"] * 2
    for i in (2, 4, 5, 6, 8):
        assert [(x["record_type"], x["refers_to"]) for x in by[i]] == [("response", None)]
    for i, _, text in rows:
        assert {x["payload_digest"] for x in by[i]} == {hashlib.sha1((text or "").encode()).hexdigest()}
    assert by[6][0]["payload_bytes"] == 0 and any("%0D%0A" in (x["uri"] or "") for x in by[7])
    assert warc.archive_round_trip(spark, pages(spark, []).where("page_id = 1")).count() == 0


def test_warc_reader_checks():
    whole = b"".join(warc.record(i, "u", b"p" * n) for i, n in enumerate((0, 10, 300_000, 5)))
    assert [len(r["payload"]) for r in warc.Reader(io.BytesIO(whole))] == [0, 10, 300_000, 5]
    assert whole.count(b"\x1f\x8b\x08") >= 4 and len(gzip.decompress(whole)) > 300_000
    with pytest.raises(warc.WarcError):
        list(warc.Reader(io.BytesIO(whole[:-20])))
    plain = gzip.decompress(warc.record(1, "u", b"payload")).replace(b"payload", b"payl0ad")
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.Reader(io.BytesIO(gzip.compress(plain))))
    with pytest.raises(warc.WarcError, match="longer"):
        list(warc.Reader(io.BytesIO(gzip.compress(gzip.decompress(warc.record(1, "u", b"x")) + b"more"))))


def test_media_against_plain_code(spark, tmp_path):
    texts = ["", None, "a", "x" * 576, "y" * 577, "é" * 300, "long " * 60_000, "a"]
    docs = spark.createDataFrame([(i, t, "m", 3) for i, t in enumerate(texts)] + [(None, "n", "m", 1)], "doc_id long, text string, member string, id long")
    folder, manifest = media.store(docs)
    got = media.media_columns(media.read_media(spark, folder, manifest)).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    for i, t in [*enumerate(texts), (None, "n")]:
        data = (t or "").encode()
        p = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    same = lambda i: [v for k, v in by[i].asDict().items() if k != "doc_id"]
    assert same(2) == same(7) and same(0) == same(1)
    folder, manifest = media.store(docs.where("doc_id = -1"))
    assert media.media_columns(media.read_media(spark, folder, manifest)).count() == 0


def feature_by_hand(payload):
    """The documented features, number by number."""
    n = len(payload)
    mean, square = sum(payload) * 1000 // n, (sum(x * x for x in payload) * n - sum(payload) ** 2) * 1000 // n**2
    bins = [sum(x // 32 == b for x in payload) * 10_000 // n for b in range(8)]
    rows = [payload[i : i + 24] for i in range(0, n, 24)]
    cuts = [int(c) for c in np.linspace(0, len(rows), 9)]
    bits = ""
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = rows[a:b] or rows[a : a + 1]
        thirds = [sum(r[c] for r in own for c in range(3 * k, 3 * k + 3)) for k in range(8)]
        bits += "".join("1" if thirds[k] > thirds[k - 1] else "0" for k in range(8))
    return f"mean={mean};var={square};hist={','.join(map(str, bins))};dhash={int(bits, 2):016x}"


def test_op3_whole_table(spark):
    """The registered query, every column, against plain code; the stored form by its own format's rules."""
    import struct

    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, "/root/testdata/sf0.001").collect()}
    got = queries.op3_media_columns(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    same = {}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        p = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        lines = b"".join(b"\0" + p[i : i + 24] for i in range(0, len(p), 24))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 24, len(p) // 24, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 3)) + chunk(b"IEND", b"")
        want = (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature_by_hand(p))
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want
        assert same.setdefault(data, want) == want


def test_media_edges(spark):
    rows = [(-7, "below"), (3, "one text"), (3, "another text"), (3, "one text"), (None, None)]
    got = media.media_columns(media.read_media(spark, *media.store(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == [(-7, 5), (0, 0), (3, 8), (3, 8), (3, 12)]


def test_media_ranges_and_retries(tmp_path):
    box = media._Archive(str(tmp_path))
    for i in range(50):
        box.add(f"{i:08d}_{i}.png", media.encode_png(media.pad(b"z" * i * 100)))
    name, size, n = box.close()
    manifest = tmp_path / "manifest"
    manifest.mkdir()
    pq.write_table(pa.table({"name": [name], "bytes": [size], "members": [n]}), manifest / "part-0.parquet")
    (manifest / "_SUCCESS").touch()
    reader = media._Reader(str(tmp_path), str(manifest), 2000, 3)
    parts = reader.partitions()
    seen = [m for p in parts for b in reader.read(p) for m in b.column("member").to_pylist()]
    assert len(parts) > 3 and sorted(seen) == [f"{i:08d}_{i}.png" for i in range(50)] and len(set(seen)) == 50
    calls = []

    def flaky(f):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return "ok"

    assert reader._tried(name, flaky) == "ok" and len(calls) == 3
    data = bytearray((tmp_path / name).read_bytes())
    data[60] ^= 1
    (tmp_path / name).write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        [b for p in parts for b in reader.read(p)]
    with pytest.raises(ValueError):
        media.decode_png(b"nothing")


@pytest.fixture(scope="module")
def network():
    return html_extract.labeller()


def test_extraction_on_held_out_pages(network):
    right = total = 0
    for page in html_extract.synthetic(150, seed=901):
        found = html_extract.blocks(page)
        if found:
            keep = network.logits([html_extract.vectors(found)])[0] > 0
            right += int((keep == np.array([b[3] for b in found])).sum())
            total += len(found)
    assert right / total > 0.97


def test_op10_whole_table(spark):
    """The registered query, every column, against the articles of the table's pages."""
    import html
    import re

    rows = {r["page_id"]: r for r in queries.pages(spark, "/root/testdata/sf0.01").collect()}
    got = queries.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["page_id"] for r in got) == sorted(rows) and len(rows) == 250
    bad = 0
    for r in got:
        page = rows[r["page_id"]]
        assert r["url"] == page["url"] and r["n_chars"] == len(r["text"])
        article = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        bad += r["text"] != " ".join(html.unescape(re.sub(r"</?(p|h1|br)[^>]*>", " ", article).replace("<b>", "")).split())
    assert bad <= 2


@pytest.mark.parametrize("tag", ["noscript", "svg", "object", "math", "canvas", "template"])
def test_unclosed_elements_keep_what_follows(network, tag):
    one, two, three = (" ".join([w] * 12 + ["and more words of the main text."]) for w in ("first", "second", "third"))
    page = f"<nav><a href=x>menu</a></nav><article><h1>The title of it</h1><p>{one}</p><{tag}><p>{two}</p></article><article><p>{three}</p></article><footer>&copy; x</footer>"
    text = network.texts([page])[0]
    assert "first" in text and "third" in text and ("second" in text) == (tag != "template")
    assert "menu" not in network.texts([f"<nav><a href=x>menu</a><{tag}></nav><article><p>{one}</p></article>"])[0]


def test_whole_paths_and_blocks_are_read(network):
    """No part of a path or block is cut off: what is far away changes the vector too."""
    page = lambda outer, words: f'<div class="{outer}">' + "<div>" * 300 + f"<p>{words}</p>"
    one = lambda outer, words: html_extract.vectors(html_extract.blocks(page(outer, words)))[0]
    far = "plain " * 2000
    assert (one("menu", far) != one("article", far)).any() and (one("menu", far + "end") != one("menu", far + "9999 8888 . . .")).any()
    assert (one("x " * 300 + "menu", "a b") != one("x " * 300 + "article", "a b")).any()
    deep = "<b>" * 3000 + "</i></b>" * 3000
    assert html_extract.blocks(f"<nav>{deep}</nav><p>text") and len(html_extract.blocks("<div>" * 5000 + "x" + "</div>" * 5000)) == 1


def test_long_pages_are_labelled_in_steps(network, monkeypatch):
    found = html_extract.blocks("".join(html_extract.synthetic(40, seed=77)))
    whole = network.logits([html_extract.vectors(found)])[0]
    monkeypatch.setattr(html_extract, "CHUNK", 97)
    assert len(found) > 300 and np.abs(network.long_logits(found) - whole).max() < 1e-4
    assert network.texts(["".join(html_extract.synthetic(40, seed=77))])[0] == " ".join(f[0] for f, z in zip(found, whole, strict=True) if z > 0)


def test_extraction_edges(spark, network):
    long_ = "<html><body><nav><a href=x>m</a></nav><article><h1>T &amp; U</h1>" + "<p>word  and\nword</p>" * 3000 + "</article></body></html>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", long_), (3, "u", long_), (4, "u", "<<<>&#0;<a <b"), (5, "u", "<script>var a = '<p>no</p>'")]
    got = html_extract.extract(pages(spark, rows), network).collect()
    assert len(got) == 7
    by = {r["page_id"]: r for r in got}
    assert (by[1]["text"], by[1]["n_chars"], by[2]["text"], by[5]["text"]) == ("", 0, "", "")
    assert by[3]["text"] == "T & U" + " word and word" * 3000 and by[3]["n_chars"] == len(by[3]["text"])
    assert html_extract.extract(pages(spark, []).where("page_id = 1"), network).count() == 0


def test_atomic_files(tmp_path):
    f = common.AtomicFile(str(tmp_path), "a", ".x")
    f.write(b"1")
    assert not list(tmp_path.glob("*.x"))
    f.close()
    g = common.AtomicFile(str(tmp_path), "a", ".x")
    g.abort()
    assert len(list(tmp_path.iterdir())) == 1

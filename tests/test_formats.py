import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from epochlens.catalog.samples import build_docx, build_pdf, build_zip
from epochlens.formats import ooxml, ooxml_ranges, pdf, pdf_ranges, pdf_report, zip as za
from epochlens.functions import codec, pdffilters, pdftext, xmlparts
from epochlens.operators.manifest import build_manifest

TEXT = "Some plain sentence with words.\n" * 60
NOISE = bytes(random.Random(1).randrange(256) for _ in range(8192))
RANDOM = random.Random(7).randbytes(256 * 1024)


def files(spark, items):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in items], "file_path string, content binary")


def verdicts(df):
    return {r["file_path"]: (r["verdict"], r["note"]) for r in df.collect()}


def patched(buf, at, data):
    return buf[:at] + data + buf[at + len(data):]


def streamed_zip():
    """Members written without seeking carry data descriptors."""
    class Pipe(io.RawIOBase):
        def __init__(self):
            self.b = b""
        def writable(self):
            return True
        def write(self, x):
            self.b += bytes(x)
            return len(x)
    p = Pipe()
    with zipfile.ZipFile(p, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", TEXT)
    return p.b


def test_zip_verdicts(spark):
    base = build_zip([("a.txt", TEXT.encode(), 8), ("b.dat", NOISE[:600], 0)])
    dd = streamed_zip()
    cd = base.find(b"PK\x01\x02")
    cases = {
        "/ok.zip": base, "/dd.zip": dd, "/short.zip": base[:-10], "/none.txt": b"hello", "/none.zip": b"hello",
        "/empty.zip": b"", "/crc.zip": patched(base, base.find(NOISE[:8]), b"x"),
        "/ddbad.zip": patched(dd, dd.find(b"PK\x07\x08") + 4, b"\x01"), "/gap.zip": base[:cd] + base[cd:] + b"z",
        "/aes.zip": patched(base, cd + 8, struct.pack("<H", 1)), "/cdsig.zip": patched(base, cd, b"XX"),
        "/lfh.zip": patched(base, 0, b"XX"), "/z64.zip": base[:-22] + b"PK\x06\x06" + base[-22:],
        "/method.zip": patched(base, cd + 10, struct.pack("<H", 12)),
        "/inflate.zip": patched(base, 35, b"\xff"),
    }
    got = verdicts(za.zip_verdicts(files(spark, cases.items())))
    assert got["/ok.zip"] == ("benign", "all_components_ok") and got["/dd.zip"] == ("benign", "all_components_ok")
    want = {
        "/short.zip": "zip_structure_missing_or_corrupted", "/none.zip": "zip_structure_missing_or_corrupted",
        "/crc.zip": "crc32_mismatch_cd", "/ddbad.zip": "dd_values_mismatch_with_cd", "/gap.zip": "gap_present count=1",
        "/aes.zip": "entry_encrypted_flag_or_aes", "/cdsig.zip": "cd_parse_fail:cd_bad_sig",
        "/lfh.zip": "lfh_resolve_fail:lfh_bad_sig", "/method.zip": "unsupported_method:12", "/inflate.zip": "inflate_error",
    }
    assert {k: got[k] for k in want} == {k: ("encrypted", v) for k, v in want.items()}
    assert got["/none.txt"] == ("not_evaluated", "not_zip_magic_or_missing_eocd")
    assert got["/empty.zip"] == ("not_evaluated", "empty_file") and got["/z64.zip"] == ("not_evaluated", "zip64_unsupported")


def ranges_of(spark, items):
    rows = [(n, s, s + 511) for n, b in items for s in range(0, max(len(b), 1), 512)]
    return spark.createDataFrame(rows, "file_path string, start bigint, end bigint")


def test_zip_ranges(spark):
    inner = build_zip([("deep.jpg", b"not a jpeg at all", 8)])
    items = {
        "/ok.zip": build_zip([("a.txt", TEXT.encode(), 8), ("m.png", b"\x89PNG\r\n\x1a\n" + NOISE, 0)]),
        "/nested.zip": build_zip([("in.zip", inner, 0)]), "/enc.zip": b"",
        "/flat.zip": build_zip([("x.txt", NOISE[:4096] * 4, 0)]), "/tail.zip": NOISE * 20,
    }
    ok = items["/ok.zip"]
    items["/enc.zip"] = patched(ok, ok.find(b"PK\x01\x02") + 8, struct.pack("<H", 1))
    dec = za.zip_decisions(ranges_of(spark, items.items()), files(spark, items.items()), spark.createDataFrame([], "sha256 string"))
    kept, why = {}, {}
    for r in dec.collect():
        kept.setdefault(r["file_path"], []).append((r["start"], r["keep_region"]))
        why.setdefault(r["file_path"], set()).add(r["reason"])
    assert not any(k for _, k in kept["/ok.zip"]) and any(k for _, k in kept["/enc.zip"])
    assert "zip: media type mismatch (in.zip/deep.jpg)" in why["/nested.zip"]
    # A broken archive is kept whole, or by rule only where it touches its last 128 KiB.
    assert {k for _, k in kept["/tail.zip"]} == {True}
    broken = [("/tail.zip", items["/tail.zip"])]
    guarded = za.zip_decisions(ranges_of(spark, broken), files(spark, broken), spark.createDataFrame([], "sha256 string"),
                               za.LeafRules(tail_guard=131072)).collect()
    assert {r["keep_region"] for r in guarded if r["start"] + 511 < len(broken[0][1]) - 131072} == {False}
    assert {r["keep_region"] for r in guarded if r["start"] >= len(broken[0][1]) - 131072} == {True}


def test_zip_gaps_count_as_a_whole(spark):
    plain = build_zip([("a.txt", TEXT.encode(), 8)])
    at = plain.find(b"PK\x01\x02")

    def gapped(filler: bytes) -> bytes:
        """The filler lies between the member and the directory."""
        eocd = plain.rfind(b"PK\x05\x06")
        tail = plain[eocd:eocd + 16] + struct.pack("<I", at + len(filler)) + plain[eocd + 20:]
        return plain[:at] + filler + plain[at:eocd] + tail

    cases = {"/wide.zip": gapped(RANDOM), "/small.zip": gapped(RANDOM[:4096]), "/zeros.zip": gapped(bytes(256 * 1024))}
    dec = za.zip_decisions(ranges_of(spark, cases.items()), files(spark, cases.items()), spark.createDataFrame([], "sha256 string"))
    kept = {}
    for r in dec.collect():
        if at + 512 <= r["start"] < len(cases[r["file_path"]]) - 2048:
            kept.setdefault(r["file_path"], set()).add(r["keep_region"])
    # A single range of random bytes is told apart by bands that one in some hundred misses.
    assert kept["/small.zip"] == kept["/zeros.zip"] == {False} and True in kept["/wide.zip"]
    wide = [r["keep_region"] for r in dec.collect() if r["file_path"] == "/wide.zip" and at + 512 <= r["start"] < at + 255 * 1024]
    assert sum(wide) > 0.8 * len(wide)


def test_deep_nesting_ends(spark):
    inner = build_zip([("deep.jpg", b"not a jpeg at all", 8)])
    for k in range(5):
        inner = build_zip([(f"l{k}.zip", inner, 8)])
    import gzip
    two = gzip.compress(b"\x50" * 10) + bytes(7) + gzip.compress(NOISE)
    items = {"/deep.zip": inner, "/gz.zip": build_zip([("t.gz", two, 0)])}
    dec = za.zip_decisions(ranges_of(spark, items.items()), files(spark, items.items()), spark.createDataFrame([], "sha256 string")).collect()
    assert "zip: media type mismatch (l4.zip/l3.zip/l2.zip/l1.zip/l0.zip/deep.jpg)" in {r["reason"] for r in dec if r["keep_region"]}
    few = za.zip_decisions(ranges_of(spark, items.items()), files(spark, items.items()), spark.createDataFrame([], "sha256 string"),
                           za.LeafRules(max_depth=2)).collect()
    assert not any("deep.jpg" in r["reason"] for r in few)


def test_gzip_members_are_one_value(spark):
    import gzip

    from epochlens.functions.codec import gunzip
    parts = [b"first " * 10, b"", NOISE * 3, b"last"]
    cases = {
        "two": (b"".join(map(gzip.compress, parts)), b"".join(parts)),
        "padded": (gzip.compress(b"a") + bytes(70000) + gzip.compress(b"b"), b"ab"),
        "garbage": (gzip.compress(b"a") + b"garbage", b"a"), "one": (gzip.compress(b"x" * 3_000_000), b"x" * 3_000_000),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in cases.items()], "k string, v binary")
    got = {r.k: bytes(r.v) for r in df.select("k", gunzip(df.v).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_a_failing_archive_keeps_its_ranges(spark, monkeypatch):
    def fails(buf, partial=False):
        raise RuntimeError("no such luck")

    monkeypatch.setattr(za, "walk_archive", fails)
    head, entries = za.read_archive(b"PK")
    assert head["status"] == "exception: RuntimeError: no such luck" and entries == []


def test_bytes_behind_64_kib_count(spark):
    """Damage outside the middle of a long text range, and members far behind the start of a broken package."""
    from epochlens.operators.fileaware import text_decisions
    body = bytearray(b"plain text " * 20000)
    body[:200] = RANDOM[:200]
    df = spark.createDataFrame([("/a.txt", body, "text")], "file_path string, content binary, handler string")
    ranges = spark.createDataFrame([("/a.txt", 0, len(body) - 1)], "file_path string, start bigint, end bigint")
    none = spark.createDataFrame([], "sha256 string")
    assert text_decisions(ranges, df, none).first()["keep_region"]
    assert not text_decisions(ranges, df, none, sample_bytes=65536).first()["keep_region"]
    cut = docx(extra=[("word/filler.bin", NOISE * 20, 0), ("word/media/late.png", NOISE, 0)])
    cut = cut[:cut.rfind(b"PK\x01\x02") - 2000]
    items = {"/b.docx": cut[:cut.find(b"word/media/late.png") + 3000]}
    for rules, far in ((ooxml_ranges.PackageRules(), True), (ooxml_ranges.PackageRules(early=65536), False)):
        dec = ooxml_ranges.ooxml_decisions(ranges_of(spark, items.items()), files(spark, items.items()), none, rules).collect()
        assert any(r["keep_region"] for r in dec if r["start"] > 65536) == far


def docx(changes=None, drop=(), extra=()):
    src = zipfile.ZipFile(io.BytesIO(build_docx(TEXT)))
    parts = {n: src.read(n) for n in src.namelist()}
    parts.update(changes or {})
    return build_zip([(n, b, 8) for n, b in parts.items() if n not in drop] + list(extra))


def test_ooxml_verdicts(spark):
    rels = zipfile.ZipFile(io.BytesIO(build_docx(TEXT))).read("word/_rels/document.xml.rels")
    cases = {
        "/ok.docx": docx(), "/orphan.docx": docx(extra=[("word/extra.bin", b"x", 8)]),
        "/dangling.docx": docx({"word/_rels/document.xml.rels": rels.replace(b"media/a.bin", b"media/b.bin")}),
        "/escape.docx": docx({"word/_rels/document.xml.rels": rels.replace(b"media/a.bin", b"../../a.bin")}),
        "/badxml.docx": docx({"word/document.xml": b"<w:document"}), "/noct.docx": docx(drop=["[Content_Types].xml"]),
        "/norels.docx": docx(drop=["_rels/.rels"]), "/type.xlsx": docx(),
        "/url.docx": docx({"word/_rels/document.xml.rels": rels.replace(b"https://example.com/", b"https://exa mple.com/")}),
        "/backslash.docx": docx(extra=[("word/..%5cx", b"1", 8), ("a//b", b"1", 8)]),
        "/nodoc.docx": docx(drop=["word/document.xml"]), "/plain.txt": b"hi",
        "/broken.docx": patched(docx(), docx().find(b"word/document.xml") + 17, b"\xff"),
    }
    got = verdicts(ooxml.ooxml_verdicts(files(spark, cases.items())))
    assert got["/ok.docx"] == ("benign", "all_components_ok")
    want = {
        "/orphan.docx": "ooxml_orphan_parts:n=1", "/dangling.docx": "ooxml_dangling_relationship:target=/word/media/b.bin",
        "/escape.docx": "normalized_target_escapes_package", "/badxml.docx": "ooxml_xml_parse_fail:part=/word/document.xml",
        "/noct.docx": "ooxml_missing_content_types", "/norels.docx": "ooxml_missing_root_rels",
        "/type.xlsx": "ooxml_type_mismatch:ext=xlsx,target=/word/document.xml", "/url.docx": "ooxml_url_invalid",
        "/backslash.docx": "ooxml_path_suspicious:where=zip_entry,value=a//b", "/nodoc.docx": "ooxml_missing_main_part",
        "/plain.txt": "zip_structure", "/broken.docx": "ooxml_precondition_failed:zip_inflate_error",
    }
    for name, note in want.items():
        verdict, told = got[name]
        assert note in told or name == "/plain.txt", (name, told)
        assert verdict == ("not_evaluated" if name == "/plain.txt" else "encrypted"), name


def test_ooxml_ranges(spark):
    ok = docx()
    items = {"/ok.docx": ok, "/lfh.docx": patched(ok, 0, NOISE[:30]),
             "/cipher.docx": docx({"word/media/a.bin": NOISE}), "/mixed.docx": docx({"word/document.xml": TEXT.encode() * 100})}
    import hashlib
    trusted = spark.createDataFrame([(hashlib.sha256(TEXT.encode()[:64]).hexdigest(),)], "sha256 string")
    dec = ooxml_ranges.ooxml_decisions(ranges_of(spark, items.items()), files(spark, items.items()), trusted)
    rows = dec.collect()
    keep = {n: [r for r in rows if r["file_path"] == n and r["keep_region"]] for n in items}
    assert not keep["/ok.docx"]
    assert any(r["reason"] == "ooxml: metadata encrypted (parse error)" or "untrusted" in r["reason"] or "manifest" in r["reason"] for r in keep["/lfh.docx"])
    assert any("media sha not in trusted manifest" in r["reason"] for r in keep["/cipher.docx"])
    assert any("text/XML anomaly" in r["reason"] for r in keep["/mixed.docx"])


def test_pdf_verdicts(spark):
    base = build_pdf(TEXT)
    at = base.find(b"stream\n") + 7
    cases = {
        "/ok.pdf": base, "/flip.pdf": patched(base, at + 6, bytes([base[at + 6] ^ 0xFF])), "/head.pdf": b"%QDF" + base[4:],
        "/noend.pdf": base.replace(b"endstream", b"endstrxam"), "/eof.pdf": base[:-6], "/x.txt": base, "/empty.pdf": b"",
        "/filter.pdf": base.replace(b"/FlateDecode", b"/LZWDecodeee"),
    }
    got = verdicts(pdf.pdf_verdicts(files(spark, cases.items())))
    assert got["/ok.pdf"] == ("benign", "all_components_ok")
    want = {"/flip.pdf": "filter_decode_exception:FlateDecode", "/head.pdf": "missing_pdf_header", "/noend.pdf": "missing_endstream",
            "/eof.pdf": "missing_%%EOF_in_tail", "/filter.pdf": 'unsupported_filter_chain:["LZWDecodeee"]'}
    assert {k: got[k] for k in want} == {k: ("encrypted", v) for k, v in want.items()}
    assert got["/x.txt"][1] == "not_pdf_intent" and got["/empty.pdf"][1] == "empty_file"
    # The whitelist knows the intact file; a changed image stream is another file.
    ok = files(spark, [("/ok.pdf", base)])
    white = pdf.flatten_whitelist(pdf.whitelist_json(pdf.stream_whitelist(ok)))
    image = patched(base, base.find(b"\x01\x02\x03\x04\x05"), b"\x09")
    got = verdicts(pdf.pdf_verdicts(files(spark, [("/ok.pdf", base), ("/img.pdf", image)]), whitelist=white))
    assert got == {"/ok.pdf": ("benign", "all_components_ok"), "/img.pdf": ("encrypted", "pdf_not_in_whitelist")}
    fake = white.withColumn("sha256", F.lit("0" * 64))
    assert verdicts(pdf.pdf_verdicts(ok, whitelist=fake))["/ok.pdf"] == ("encrypted", "stream_hash_not_whitelisted")


def test_pdf_ranges(spark):
    base = build_pdf(TEXT)
    # Sixty distinct high bytes: flat for their number, no ASCII, incompressible.
    secret = bytes(random.Random(8).sample(range(130, 250), 60))
    info = b"1 0 obj\n<< /Title (" + secret + b") >>\nendobj\n"
    text_at = base.find(b"/Kids")
    items = {
        "/ok.pdf": base, "/syntax.pdf": patched(base, text_at, b"\xf0\xf1"), "/string.pdf": base[:9] + info + base[9:],
        "/comment.pdf": base.replace(b"xref\n0", b"%" + b"\xe0" * 20 + b"\nxref\n0"), "/cut.pdf": base[:-8],
        "/xref.pdf": base.replace(b" 00000 n", b" 0000Q n").replace(b" 65535 f", b" 6553Q f"),
        "/start.pdf": base.replace(b"startxref\n", b"startxref\n99"),
        "/object.pdf": base.replace(b"/Count 1 >>", b"/Count 1   "),
        "/marker.pdf": base.replace(b"%PDF-1.4\n", b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"),
    }
    import hashlib
    n = base.find(bytes(range(1, 9)))
    body = base[n: n + 512]
    trusted = spark.createDataFrame([(hashlib.sha256(body).hexdigest(),)], "sha256 string")
    rows = pdf_ranges.pdf_decisions(ranges_of(spark, items.items()), files(spark, items.items()), trusted).collect()
    why = {n: {r["reason"] for r in rows if r["file_path"] == n and r["keep_region"]} for n in items}
    assert why["/ok.pdf"] == set()
    assert why["/syntax.pdf"] == {"pdf: prelude non-ASCII syntax bytes"}
    assert "pdf: prelude data encrypted" in why["/string.pdf"]
    assert "pdf: comment high-bit anomaly" in why["/comment.pdf"]
    assert why["/xref.pdf"] == {"pdf: prelude xref/trailer anomaly (no xref rows)"}
    assert why["/start.pdf"] == {"pdf: prelude startxref anomaly (startxref offset out of bounds)"}
    assert why["/object.pdf"] == {"pdf: prelude object anomaly (dict/array delimiter imbalance)"}
    assert why["/marker.pdf"] == set()
    assert why["/cut.pdf"] == {"pdf: metadata encrypted (missing EOF)"}


def test_pdf_reports(spark):
    base = build_pdf(TEXT)
    secret = bytes(random.Random(8).sample(range(130, 250), 110))
    buf = base[:9] + b"1 0 obj\n<< /Title (" + secret + b") /A (plain) >>\nendobj\n" + base[9:]
    df = files(spark, [("/a.pdf", buf)])
    rep = pdf_report.stream_report(df).orderBy("idx").collect()
    assert [(r["declared_flate"], r["decodes"]) for r in rep] == [(True, True), (False, True)]
    assert rep[0]["embedded_zlib"][0]["rel"] == 0 and rep[0]["embedded_zlib"][0]["ok"]
    labels = {r["size"]: r["label"] for r in pdf_report.string_report(df).collect()}
    assert labels == {110: "CIPHERTEXT", 5: "TEXT"}
    at = [buf.find(secret) + 3, buf.find(b"stream\n") + 20, buf.find(b"/Kids")]
    offs = spark.createDataFrame([("/a.pdf", x) for x in at], "file_path string, offset bigint")
    got = {r["offset"]: r["kind"] for r in pdf_report.locate_offsets(offs, df).collect()}
    assert [got[x] for x in at] == ["literal", "stream", "syntax"]


def test_pdf_filters():
    raw = bytes(range(200)) * 5
    dec = pdffilters.decode_stream
    assert dec(zlib.compress(raw), ["FlateDecode"], [], 10_000) == raw
    assert dec(raw.hex().encode() + b">", ["ASCIIHexDecode"], [], 10_000) == raw
    import base64
    assert dec(base64.a85encode(zlib.compress(raw), adobe=True), ["ASCII85Decode", "FlateDecode"], [], 10_000) == raw
    assert dec(bytes([2]) + b"abc" + bytes([254]) + b"z" + bytes([128]), ["RunLengthDecode"], [], 100) == b"abczzz"
    assert dec(b"junk", ["FlateDecode"], [], 100) is None and dec(b"\xff\xd8", ["DCTDecode"], [], 100) == b"\xff\xd8"
    p = {"predictor": 12, "columns": 4, "colors": 1, "bits": 8}
    rows = b"\x00\x01\x02\x03\x04" + b"\x02\x01\x01\x01\x01" + b"\x01\x01\x01\x01\x01" + b"\x03\x02\x02\x02\x02" + b"\x04\x01\x01\x01\x01"
    want = [bytes([1, 2, 3, 4]), bytes([2, 3, 4, 5]), bytes([1, 2, 3, 4])]
    avg, left = [], 0
    for up in want[-1]:
        left = (2 + (left + up) // 2) & 255
        avg.append(left)
    got = dec(zlib.compress(rows), ["FlateDecode"], [p], 100)
    assert got[:12] == b"".join(want) and list(got[12:16]) == avg and len(got) == 20
    assert dec(zlib.compress(b"\x09" + rows[1:]), ["FlateDecode"], [p], 100) == b"\x09" + rows[1:]


def test_pdf_zones():
    buf = b"ab (x(y)\\)z) <</K <4142>>> % note\n(open"
    got = [(k, buf[a:b]) for k, a, b in pdftext.zones(buf, 0, len(buf)) if k != "syntax"]
    assert got == [("literal", b"(x(y)\\)z)"), ("hex", b"<4142>"), ("comment", b"% note"), ("literal", b"(open")]
    assert pdftext.has_readable_island(b"\0\1" + zlib.compress(b"readable text " * 20))
    assert not pdftext.has_readable_island(NOISE) and pdftext.has_broken_zlib(b"\x78\x9c\xff\xff\xff")


def test_manifest(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"data"
    inner = build_zip([("deep.png", png, 8)])
    items = {"/a.docx": docx({"word/media/p.png": png, "word/other.png": png, "word/embeddings/o.bin": inner}),
             "/b.zip": build_zip([("x/y.jpg", b"jpg", 0), ("t.txt", b"t", 0)]), "/c.mp3": b"ID3", "/d.txt": b"no", "/e.pdf": build_pdf(TEXT)}
    rows = build_manifest(files(spark, items.items()), embedded=True).collect()
    got = {(r["source"], r["container"], r["entry"].split("-")[0].split("@")[0], r["media_ext"]) for r in rows}
    assert got == {("ooxml", "/a.docx", "word/media/p.png", "png"), ("ooxml-embedded", "/a.docx", "word/embeddings/o.bin!deep.png", "png"),
                   ("zip", "/b.zip", "x/y.jpg", "jpg"), ("file", "/c.mp3", "", "mp3"), ("pdf", "/e.pdf", "stream", "")}


def test_hostile_pdf_does_not_end_the_job(spark):
    good = b"%PDF-1.4\n1 0 obj\n<< /Length 3 >>\nstream\nabc\nendstream\nendobj\n%%EOF"
    bad = good.replace(b"1 0 obj", b"9" * 20 + b" 0 obj")
    files = spark.createDataFrame([("good.pdf", good), ("bad.pdf", bad)], "file_path string, content binary")
    notes = {r.file_path: r.note for r in pdf.pieces(files).where("kind = 'map'").collect()}
    assert notes["good.pdf"] == "" and notes["bad.pdf"].startswith("exception: ValueError")


def test_large_members_and_streams_are_judged_whole(spark):
    zeros, png = bytes(40 << 20), b"\x89PNG\r\n\x1a\n" + bytes(33 << 20) + NOISE
    archive = build_zip([("zeros.bin", zeros, 8), ("p.png", png, 8)])
    assert verdicts(za.zip_verdicts(files(spark, [("/big.zip", archive)])))["/big.zip"] == ("benign", "all_components_ok")
    rows = build_manifest(files(spark, [("/big.zip", archive)])).collect()
    assert [(r["entry"], r["sha256"]) for r in rows] == [("p.png", hashlib.sha256(png).hexdigest())]
    trusted = spark.createDataFrame([(hashlib.sha256(png).hexdigest(),)], "sha256 string")
    bodies = za.members(files(spark, [("/big.zip", archive)]))
    got = {r["idx"]: r["reason"] for r in za.member_verdicts(bodies, trusted).collect()}
    assert got[1] == "zip: media trusted (p.png)"
    twice = zlib.compress(zlib.compress(zeros, 0))
    chain = ["FlateDecode", "FlateDecode"]
    assert pdffilters.decode_stream(twice, chain, []) == zeros
    assert pdffilters.decode_stream(twice, chain, [], sized=True) == len(zeros)
    assert pdffilters.decode_stream(twice[:-9], chain, []) is None
    assert pdffilters.decode_stream(twice[:-9], chain, [], sized=True) is None


def test_inflating_in_pieces():
    rng = random.Random(3)
    for n in (0, 1, codec.CHUNK - 1, codec.CHUNK, codec.CHUNK + 1, 3 * codec.CHUNK):
        for raw in (bytes(n), rng.randbytes(n)):
            for bits in (-15, 15, 31):
                packer = zlib.compressobj(6, zlib.DEFLATED, bits)
                packed = packer.compress(raw) + packer.flush()
                parts = list(codec.inflated(packed, bits, complete=True))
                assert b"".join(parts) == raw and all(len(p) <= codec.CHUNK for p in parts)
                assert b"".join(codec.inflated(packed + b"tail", bits)) == raw
    with pytest.raises(zlib.error):
        list(codec.inflated(b"", 15, complete=True))


def test_parts_far_from_the_root_are_reached(spark):
    edges = spark.createDataFrame([("/a", str(i) if i else "", str(i + 1)) for i in range(20)], "file_path string, source string, target string")
    reached = ooxml.reachable(edges, edges.select("file_path").distinct()).collect()
    assert {(r["part"], r["depth"]) for r in reached} == {(str(i) if i else "", i) for i in range(21)}


def test_xml_parts_are_parsed_in_pieces(spark):
    read = xmlparts.read_xml
    split = lambda raw, n: [raw[a: a + n] for a in range(0, len(raw), n)]
    rel = b"<Relationships><Relationship Id='a' Type='t' Target='x' TargetMode='External'/></Relationships>"
    assert all(read(split(rel, n), "rels") == [{"type": "t", "target": "x", "external": True}] for n in (1, 7, 1000))
    ct = b"<T><Default Extension='XML' ContentType='c'/><Override PartName='/p' ContentType='d'/><X><Default Extension='n' ContentType='c'/></X></T>"
    assert read(split(ct, 5), "types") == [{"override": False, "name": "xml", "type": "c"}, {"override": True, "name": "p", "type": "d"}]
    assert read(split(b"<!DOCTYPE a [<!ENTITY e 'x'>]><a/>", 3)) is None
    assert read([]) is None and read([b"<a>"]) is None and read([b"<a>&none;</a>"]) is None and read([b"<a/>"]) == []
    long = {"word/document.xml": "<w>" + "<p>text</p>" * 1_700_000 + "</w>"}
    assert verdicts(ooxml.ooxml_verdicts(files(spark, [("/long.docx", docx(long))])))["/long.docx"][0] == "benign"


def test_islands_at_any_offset():
    from epochlens.functions import islands
    text = "".join(random.Random(k).choice("abcdefgh \n") for k in range(5000)).encode()
    packer = zlib.compressobj(wbits=-15)
    raw = packer.compress(text) + packer.flush()
    head = RANDOM[:777].replace(b"\x78", b"\x77")
    data = head + b"\x78\x9c\xff\xff" * 100 + raw + RANDOM[1000:1300] + zlib.compress(b"short one") + RANDOM[2000:2100]
    got = islands.islands(data)
    raws = [i for i in got if i["kind"] == "raw"]
    assert [(i["rel"], i["stop"], i["size"], i["texty"]) for i in raws] == [(777 + 400, 777 + 400 + len(raw), 5000, True)]
    assert [(i["size"], i["stop"] - i["rel"]) for i in got if i["kind"] == "zlib"] == [(9, len(zlib.compress(b"short one")))]
    assert islands.islands(b"") == islands.islands(b"x") == [] and islands.islands(raw[:-40]) == []
    big = zlib.compress(bytes(5_000_000))
    assert islands.islands(b"\x00" + big) == [{"rel": 1, "stop": 1 + len(big), "kind": "zlib", "size": 5_000_000, "texty": True, "operators": 0}]

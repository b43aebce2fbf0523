import base64
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

from panelwright.llm import piece_codec, token_records, warc
from panelwright.llm.registry import END_ID, tokenizer

ALPHABET = [",", ".", "a", " b", "\nC", " ", "  ", "\n", "a", "th", "é", "▁", "日本", "́", "😀", "\t", "\0", "<s>", "</s>", "<unk>", "<0x0A>", "!", "​", "﻿", "\r\n", "\x7f", "ﬁ", "½", "'s", "　", "<|endoftext|>"]


PROSE = ["It's 12.5% of (what) they've got,\nsaid 'Élise' -- \"don't\" + x_y=3!!\nNaïve; über...\n", "don't", "a'll b'd\n'tis 1st 2nd3 ###"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


# --- SentencePiece ---------------------------------------------------------------------------------------------


def test_piece_codec_equals_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = [None, "", " ", "▁", "word " * 20000, "x" * 30000, *texts(1500)]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(whole)] + [(4, whole[4])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", __import__("pyspark").sql.functions.lit("mine"))
    expect = [(i, len(ids := m.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()) for i, t in rows]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.digests(df, path).collect()]
    assert sorted(got, key=str) == sorted(expect, key=str)
    enc = piece_codec.encode(df, path)
    assert sorted(((r.doc_id, list(r.ids)) for r in enc.collect()), key=str) == sorted(((i, m.encode(t or "")) for i, t in rows), key=str)
    back = {(r.doc_id, r.text) for r in piece_codec.decode(enc, path).collect()}
    assert back == {(i, m.decode(m.encode(t or ""))) for i, t in rows}
    assert piece_codec.digests(df.limit(0), path).count() == 0


def test_piece_table_turns_over(monkeypatch):
    monkeypatch.setattr(piece_codec, "TABLE_ROWS", 5)
    path = tokenizer("piece_bpe_32k.model")
    decimal, numbers = piece_codec.Codec(path, True), piece_codec.Codec(path, False)
    assert decimal.can_cut and decimal.lines_cut and decimal.runs_cut
    for t in texts(1500, 2) + PROSE:
        want = decimal.model.encode(t)
        assert decimal.code(t) == (",".join(map(str, want)), decimal.model.decode(want)), t
        assert numbers.code(t) == (np.array(want, dtype="<i4").tobytes(), decimal.model.decode(want)), t
    assert all(len(x) <= 5 and len(x.old) <= 5 for x in (decimal.words, decimal.bare, decimal.chunks))


def test_short_words_equal_sentencepiece():
    rnd = random.Random(9)
    c = piece_codec.Codec(tokenizer("piece_bpe_32k.model"), True)
    signs = [chr(k) for k in range(1, 0x250)] + ["▁", "日", "本", "😀", "́", "\ufffd", "'", " ", " ", " ", "\n", "\n"]
    for _ in range(8000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 9)))
        want = c.model.encode(t)
        assert c.code(t) == (",".join(map(str, want)), c.model.decode(want)), repr(t)


# --- token records ---------------------------------------------------------------------------------------------


def test_token_records_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    whole = [None, "", " ", "word " * 20000, "x" * 20000, *texts(800, 3)]
    rows = [((1 << 60) + i * 7 % 1009 if i % 50 else None, x) for i, x in enumerate(whole)] + [(5, "same"), (5, "same"), (5, "other"), (-(2**63), "least"), (0, "zero")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, shard string, tie int").repartition(3)
    manifest = token_records.write(df, token_records.fresh_folder(spark), path, END_ID)
    got = token_records.read_digests(manifest).collect()
    crc = lambda x: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [END_ID], dtype="<u4").tobytes())
    assert sorted(map(str, [(r.doc_id, r.ids_crc32) for r in got])) == sorted(map(str, [(i, crc(x)) for i, x in rows]))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered if r.doc_id is None] == [r.doc_id for r in ordered][: sum(i is None for i, _ in rows)]
    ids = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ids == sorted(ids)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    # the index finds single records
    row = manifest.first()
    places = token_records.index(manifest).where(f"path = '{row.path}'").orderBy("offset").collect()
    place = places[len(places) // 2]
    found, tokens = token_records.read_record(row.path, place.offset, row.width)
    assert found == place.doc_id and len(tokens) == place.n_tokens
    # a seeded order over all records, through the index
    one, again, other = ([(r.doc_id, tuple(r.ids)) for r in token_records.shuffled(manifest, seed).orderBy("place").collect()] for seed in (1, 1, 2))
    assert one == again != other and sorted(map(str, one)) == sorted(map(str, other))
    assert sorted(map(str, [(d, zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in one])) == sorted(map(str, [(i, crc(x)) for i, x in rows]))
    assert token_records.read_digests(token_records.write(df.limit(0), token_records.fresh_folder(spark), path, END_ID)).count() == 0


def test_token_records_find_damage():
    payload = struct.pack("<Bq", 1, 3) + np.array([1, 2], dtype="<u2").tobytes()
    head = struct.pack("<Q", len(payload))
    data = head + struct.pack("<I", token_records.masked(head)) + payload + struct.pack("<I", token_records.masked(payload))
    assert [(d, i.tolist()) for _, d, i in token_records.records(io.BytesIO(data), 2)] == [(3, [1, 2])]
    for k in (0, 13, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(token_records.records(io.BytesIO(bytes(bad)), 2))
    with pytest.raises(ValueError):
        list(token_records.records(io.BytesIO(data[:-2]), 2))


def test_token_chunks_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(token_records, "TABLE_ROWS", 7)
    c = token_records.Coder(tokenizer("byte_bpe_50k.json"))
    for t in texts(1500, 5) + PROSE:
        assert np.frombuffer(c.ids(t), dtype="<u2").tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(c.table) <= 7 and len(c.table.old) <= 7 and len(c.bare) <= 7


def test_every_short_word_equals_the_library():
    rnd = random.Random(8)
    c = token_records.Coder(tokenizer("byte_bpe_50k.json"))
    signs = [chr(k) for k in (*range(0x80), *range(0x100), *range(0x250))] + ["ÿ", "日", "😀", "́", "'", "'", " ", " ", "\n"]
    for _ in range(6000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 9)))
        assert np.frombuffer(c.ids(t), dtype="<u2").tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_failed_file_leaves_nothing(tmp_path):
    from pyarrow import fs

    from panelwright.llm import _store

    local = fs.LocalFileSystem()
    with pytest.raises(KeyError), _store.new_file(local, f"{tmp_path}/a") as f:
        f.write(b"x")
        raise KeyError
    assert not list(tmp_path.iterdir())
    for _ in range(2):  # the second attempt meets the file of the first
        with _store.new_file(local, f"{tmp_path}/t") as f:
            f.write(b"same")
        _store.commit(local, f"{tmp_path}/t", f"{tmp_path}/name")
    assert [p.name for p in tmp_path.iterdir()] == ["name"]


# --- WARC ------------------------------------------------------------------------------------------------------


def brute(rows, least=0):
    largest = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least:
            largest[p] = max(largest.get(p, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = largest.get(p, -1)
        response = len(p) < least or top == -1 or top == i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else top))
    return out


def test_warc_round_trip(spark):
    rnd = random.Random(1)
    bodies = [None, "", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n\r\n", "z" * 200000]
    rows = [((1 << 60) + i, f"http://h/{i}\r\nX: é", rnd.choice(bodies) if i % 3 else f"page {i}") for i in range(150)]
    rows += [(None, None, "<p>a</p>"), (None, "u", "lonely"), (7, "http://h/7", "twice"), (7, "http://h/7", "twice")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, tag int, sha1 string").repartition(3)
    for least in (0, 5):
        manifest = warc.write(df, warc.fresh_folder(spark), least=least, roll_bytes=3000)
        assert manifest.where("roll > 0").count() > 0
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_digests(manifest).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, least), key=str)
    payloads = {r.page_id: r.payload for r in warc.read(manifest).collect() if r.record_type == "response"}
    assert payloads[(1 << 60) + 3] == b"page 3"
    assert warc.read_digests(warc.write(df.limit(0), warc.fresh_folder(spark))).count() == 0


def test_warc_bytes_are_deterministic(spark):
    """100,000 pages, dealt to partitions in two ways, give the same files."""
    rows = spark.range(100_000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat('body ', id % 70000, repeat(' x', id % 200)) AS html")
    made = []
    for frame in (rows.repartition(7), rows.repartition(3, "html").sort("url")):
        manifest = warc.write(frame, warc.fresh_folder(spark), roll_bytes=500_000)
        made.append(sorted((r.shard, r.roll, r.n_records, r.sha256, r.path.rsplit("/", 1)[1]) for r in manifest.collect()))
    assert made[0] == made[1] and sum(r[2] for r in made[0]) == 100_000
    per_shard = [sum(r[2] for r in made[0] if r[0] == k) for k in {r[0] for r in made[0]}]
    assert len(per_shard) > 3 and max(per_shard) < 2 * min(per_shard) and any(r[1] for r in made[0])


def test_warc_records_have_ids_of_their_own(spark):
    rows = [(None, f"u{k % 2}", "same") for k in range(6)] + [(1, "u", "same")] * 2 + [(2, "http://h/\u2028 é%20\x00", "same"), (3, None, None)]
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), warc.fresh_folder(spark))
    found = []
    for path in (r.path for r in manifest.collect()):
        fs, name = warc.file_system(path)
        with fs.open_input_stream(name, compression=None) as f:
            found += [warc.parse(m)[0] for m in warc.members(f)]
    infos = [h for h in found if h["WARC-Type"] == "warcinfo"]
    assert len(infos) == manifest.count() and len(found) == len(rows) + len(infos)
    ids = [h["WARC-Record-ID"] for h in found]
    assert len(set(ids)) == len(ids)
    assert {h["WARC-Refers-To"] for h in found if h["WARC-Type"] == "revisit"} <= set(ids)
    assert any(h.get("WARC-Target-URI") == "http://h/%E2%80%A8%20é%20%00" for h in found)


def test_cuts_and_places(spark):
    from pyspark.sql import functions as F

    from panelwright.llm._skew import bounds, place

    assert bounds([5, 1, 3], [1, 1, 1], 3) == [3, 5] and bounds([], [], 4) == [] and bounds([7], [9], 4) == []
    points = [2, 5, 5, 9, 30]
    got = spark.range(40).select("id", place(F.array(*[F.lit(x) for x in points]), 5, F.col("id")).alias("p")).collect()
    assert all(r.p == sum(x <= r.id for x in points) for r in got)


def test_warc_finds_damage():
    data = warc.record(1, "u", b"hello", None, warc.digest(b"hello"))
    assert warc.parse(data)[0]["X-Page-ID"] == "1"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"hello", b"hullo"))
    member = warc._member(data)
    assert list(warc.members(io.BytesIO(member + member))) == [data, data]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(member[:-9])))


def test_base32_expression(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(b"",), (b"abc",), ("é" * 99).encode() and (("é" * 99).encode(),)], "p binary")
    for r in rows.select("p", warc.base32_of_hex(F.sha1("p")).alias("d")).collect():
        assert r.d == warc.digest(bytes(r.p))

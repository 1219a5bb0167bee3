"""Chat templates, WARC archives and licences: round trips and corner cases."""

import gzip
import hashlib
import json
import zlib

import duckdb
import pytest
from pyarrow import fs

from tests.oracle import compare
from tidemark.llm import chat, licences, warc

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"
PAGES = "page_id bigint, url string, html string, digest string"


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "\\\\[", "a\\<b>\n[ANS]", "é😀<s>", "[ROLE]x[/ROLE]"])
def test_texts_survive_the_template(text):
    turns = [("system", text), ("user", text), ("assistant", text), ("tool<", text), ("", text)]
    whole = "".join(piece for piece, _, _ in chat.BRACKETS.segments(turns))
    assert chat.BRACKETS.read(whole) == turns
    with pytest.raises(ValueError):
        chat.BRACKETS.read(whole + "x")


def test_conversations_read_back_with_their_loss(spark):
    rows = [(1, 1, "assistant", "b<s>", "x"), (1, 0, "user", "a", "x"), (2, 0, "assistant", None, ""), (3, None, None, "?", ""),
            (3, 0, "user", "u", ""), (None, 0, "user", "n", ""), (None, 1, "assistant", "m", ""), (4, 0, "user", "q" * 50000, "")]
    made = chat.format_chat(spark.createDataFrame(rows, TURNS))
    fault = {r["conv_id"]: r["fault"] for r in made.collect()}
    assert fault[1] is None and fault[4] is None and fault[None] is None
    assert fault[2].startswith("turn 0") and fault[3].startswith("turn 0: no role")
    for r in made.collect():
        assert "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["segments"]) == r["formatted"]
    told = {r["conv_id"]: r for r in chat.read_chat(made).collect()}
    assert [(t["role"], t["text"]) for t in told[1]["turns"]] == [("user", "a"), ("assistant", "b<s>")]
    assert told[1]["loss_text"] == "b<s>" and told[2]["loss_text"] == "" and told[4]["loss_text"] == ""
    assert [t["role"] for t in told[3]["turns"]] == ["", "user"]
    assert chat.format_chat(spark.createDataFrame([], TURNS)).count() == 0


def test_archives_are_one_stream_and_then_one_member_a_record(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", big, ""), (2, "http://a/\r\n2", big, ""), (9, None, big, ""), (3, "u", "small", ""), (4, "u", "small", ""),
            (5, "u", None, ""), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n", ""), (7, "u", "é" * 999, ""), (8, "u", "é" * 999, ""),
            (9, None, big, ""), (None, "u", "no id", ""), (None, "u", big, "")]
    folder, archives = warc.write_archives(spark.createDataFrame(rows, PAGES), archive_bytes=3000)
    store, base = fs.FileSystem.from_uri(folder)
    for path in (r["path"] for r in archives.collect()):
        raw = store.open_input_stream(f"{base}/{path}", compression=None).read()
        one = zlib.decompressobj(31)
        one.decompress(raw)
        assert one.eof and one.unused_data == b""
    target, index = warc.normalise(folder, archives)
    store, base = fs.FileSystem.from_uri(target)
    rows_of = {}
    for r in index.collect():
        rows_of.setdefault(r["path"], []).append(r)
    for path, own in rows_of.items():
        raw = store.open_input_stream(f"{base}/{path}", compression=None).read()
        own.sort(key=lambda r: r["offset"])
        assert sum(r["length"] for r in own) == len(raw)
        side = [json.loads(line) for line in store.open_input_stream(f"{base}/{path}.idx").read().splitlines()]
        assert [(s["offset"], s["length"], s["record_id"]) for s in side] == [(r["offset"], r["length"], r["record_id"]) for r in own]
        for r in own:
            assert gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]).startswith(b"WARC/1.1\r\n")
    got = {r["page_id"]: r for r in warc.read_records(target, index).filter("page_id is not null").collect()}
    assert set(got) == set(range(1, 10))
    assert {i: (got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 9)} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None)}
    assert all(got[i]["record_type"] == "response" for i in (3, 4, 5, 6))
    assert (got[7]["record_type"], got[7]["refers_to"], got[7]["payload_bytes"]) == ("revisit", 8, 1998)
    for i, _, html, _ in rows:
        if i is not None:
            payload = (html or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
    none = [r for r in warc.read_records(target, index).collect() if r["page_id"] is None]
    assert sorted(r["payload_bytes"] for r in none) == [5, len(big)]


def test_repeated_pages_have_a_record_each(spark):
    big = "<p>" + "x" * 2000
    rows = [(9, "a", big, ""), (9, "a", big, ""), (9, "b", big, ""), (1, "c", big, ""), (1, "c", big, ""), (3, "u", "small", ""),
            (3, "u", "small", ""), (None, None, "no id", ""), (None, None, "no id", ""), (None, "", "no id", "")]
    folder, archives = warc.write_archives(spark.createDataFrame(rows, PAGES))
    target, index = warc.normalise(folder, archives)
    assert len({r["record_id"] for r in index.collect()}) == len(rows)
    got = [(r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(target, index).collect()]
    want = [(9, "response", None, len(big))] * 3 + [(1, "revisit", 9, len(big))] * 2 + [(3, "response", None, 5)] * 2
    assert sorted(got, key=repr) == sorted(want + [(-1, "response", None, 5)] * 3, key=repr)


def test_no_pages_give_no_rows(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_a_broken_archive_is_an_error(spark, tmp_path):
    whole = warc._record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 1, True)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole + whole[:50]))
    with pytest.raises(ValueError):
        list(warc.inflated_records(fs.LocalFileSystem(), str(tmp_path / "a.warc.gz")))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole))
    assert len(list(warc.inflated_records(fs.LocalFileSystem(), str(tmp_path / "b.warc.gz")))) == 2


def test_licences_in_other_spellings(spark):
    mit = licences.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", ""), ""),
        (2, "intro words\nRELEASED UNDER THE MIT LICENCE!\nmore", ""),
        (3, "Licensed under the Apache License, v2.0\r\n© 1999 me", ""),
        (4, "We like the MIT License, version 7.", ""),
        (5, None, ""), (6, "", ""), (7, "... !!!", ""), (None, "Licensed under CC BY-NC 4.0.", ""),
        (2, "intro words\nRELEASED UNDER THE MIT LICENCE!\nmore", ""),
        (8, mit + " and one word more", ""), (9, "w " * 50000, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, licence_id string")
    got = sorted((r["doc_id"] or -1, r["line"], r["licence_id"]) for r in licences.scan_licences(docs).collect())
    assert got == [
        (-1, 0, "CC-BY-NC-4.0"), (-1, 1, "CC-BY-NC-4.0"), (1, 0, "MIT"), (2, 2, "MIT"), (2, 2, "MIT"),
        (3, 0, "Apache-2.0"), (3, 1, "Apache-2.0"),
    ]
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_licences_in_usual_layouts(spark):
    texts = licences.TEXTS
    isc = texts["ISC"].replace("\n", " ").replace("above copyright notice", "above\ncopyright notice")
    mit = texts["MIT"].replace("\n", " ")
    wrapped = mit.replace("OR COPYRIGHT HOLDERS BE", "OR\nCOPYRIGHT HOLDERS BE")
    bsd = texts["BSD-3-Clause"].replace("\n", " ")
    listed = bsd.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n2. ").replace(" 3. ", "\n3. ")
    bullets = bsd.replace(" 1. ", "\n  * ").replace(" 2. ", "\n  * ").replace(" 3. ", "\n  * ")
    whole = {
        1: isc,
        2: "Copyright (c) 2020 Someone " + mit,
        3: "The MIT License (MIT)\n\nCopyright 2020 Some One\n\n" + wrapped,
        4: "BSD 3-Clause License\n\nCopyright (c) 2017, Some One\nAll rights reserved.\n\n" + listed,
        5: "\tCopyright Some One\n" + bullets,
        6: texts["Unlicense"].replace("copyright law.", "\ncopyright law."),
        7: "Copyright 2001 One\n(c) 2002 Two\n" + texts["Apache-2.0"].replace("http:", "https:"),
        8: texts["BSD-2-Clause"],
    }
    none = {20: isc.replace("notice and", "notice or"), 21: "Copyright Some One", 22: "copyright holder"}
    docs = spark.createDataFrame(list((whole | none).items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["licence_id"]) for r in licences.scan_licences(docs).filter("line = 0").collect()}
    assert got == {
        (1, "ISC"), (2, "MIT"), (3, "MIT"), (4, "BSD-3-Clause"), (5, "BSD-3-Clause"), (6, "Unlicense"),
        (7, "Apache-2.0"), (8, "BSD-2-Clause"),
    }
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    assert compare(licences.scan_licences(docs), connection, licences.oracle()) == []


def test_a_digest_under_two_licences_is_the_least(spark):
    docs = spark.createDataFrame([(1, "some terms")], "doc_id bigint, text string")
    known = [("B-1", "Some terms."), ("A-1", "some  TERMS")]
    assert {r["licence_id"] for r in licences.scan_licences(docs, known).collect()} == {"A-1"}

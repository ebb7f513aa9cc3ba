"""Inputs that must not end a job, or must end it with a message."""

import gzip
import hashlib
import json

import pytest

from redactrix.llm import chat, warc


def archive(spark, tmp_path, *records: bytes, cut: int = 0):
    data = b"".join(gzip.compress(r) for r in records)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data[: len(data) - cut])
    return spark.createDataFrame([(str(path), path.stat().st_size)], "path string, size long")


INFO = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
REQUEST = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Target-URI: http://h/\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n"
BARE = b"WARC/1.1\r\nPage-ID: -7\r\n\r\nno length, no type\r\n\r\n"
REVISIT = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
ODD = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: x\r\nPage-ID: seven\r\n\r\nk: v\r\n\r\n"


def test_records_of_other_types(spark, tmp_path):
    for split in (50, 1 << 20):
        got = warc.read_warc(archive(spark, tmp_path, INFO, REQUEST, BARE, REVISIT, ODD), split).collect()
        by = {r["record_type"]: r for r in got}
        assert len(got) == 5 and set(by) == {"warcinfo", "request", "", "revisit", "metadata"}
        assert by["warcinfo"]["payload"] == b"abcd" and by["warcinfo"]["payload_digest"] == hashlib.sha256(b"abcd").hexdigest()
        assert by["request"]["payload_bytes"] == 18 and by["request"]["page_id"] is None
        assert by[""]["page_id"] == -7 and by[""]["payload"] == b"no length, no type"
        assert by["revisit"]["payload_bytes"] is None and by["revisit"]["payload_digest"] is None
        assert by["metadata"]["payload"] == b"k: v" and by["metadata"]["page_id"] is None


@pytest.mark.parametrize("cut", [3, 40, 70])
def test_cut_archives_end_the_job(spark, tmp_path, cut):
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_warc(archive(spark, tmp_path, INFO, REQUEST, cut=cut)).collect()


def test_odd_chat_records(spark):
    deep = "[" * 5000 + "]" * 5000
    records = [deep, r'{"prompt":"\ud800","completion":"x"}', r'{"\ud800":1}', '{"prompt":' + '{"a":' * 3000 + "1" + "}" * 3001, '{"a.b":1}', "[]", "{}", "3", "null", '{"messages":[{"role":null,"content":null}]}']
    got = {r["conv_id"]: r for r in chat.format_records(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).collect()}
    assert len(got) == len(records)
    assert all(got[k]["layout"] == "unknown" and got[k]["formatted"] == "" for k in range(len(records) - 1))
    assert got[len(records) - 1]["layout"] == "messages" and len(got[len(records) - 1]["turns"]) == 1
    assert chat.fingerprint(chat.field_paths({"a.b": 1})) != chat.fingerprint(chat.field_paths({"a": {"b": 1}}))


def test_rows_go_through_several_layouts(spark):
    talks = {
        1: [("user", "q"), ("assistant", "a")], 2: [("system", None), ("user", "q"), ("assistant", "")], 3: [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")],
        4: [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "r")], 5: [("human", "q"), ("gpt", "a")], 6: [(None, "q"), ("assistant", None)], 7: [("user", "only")], 8: [("tool\n", "<|im_end|>")],
    }
    rows = spark.createDataFrame([(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    records = chat.rows_to_records(rows)
    assert all(json.loads(r["record"]) is not None for r in records.collect())
    got = {r["conv_id"]: r for r in chat.format_records(records).collect()}
    assert {k: r["layout"] for k, r in got.items()} == {1: "prompt_response", 2: "system_prompt_response", 3: "share", 4: "messages", 5: "turn_rows", 6: "turn_rows", 7: "share", 8: "turn_rows"}
    for k, turns in talks.items():
        assert chat.parse(got[k]["formatted"]) == [(r or "", x or "") for r, x in turns]

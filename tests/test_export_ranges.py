"""Exports read by ranges, against a parse of whole files."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest

from corpusloom.sources import exports, ranges
from corpusloom.streaming.exports import HITS, commit_exports
from corpusloom.streaming.jobs import read_committed

TRICKY = ['plain', '"', "\\", "\\\\", '\\"', '"hits":[{', '{"hits":{"hits":[', "]}}", "\\\"hits\": [", "戀≟∀", "😀", "\n\t", "", "}" * 9, "\\" * 70]


def source(r):
    text = lambda: "".join(r.choice(TRICKY) for _ in range(r.randrange(6)))
    inner = r.choice([text(), {"hits": [{"_id": text()}], "a": [[], {}]}, [1, {"b": None}], None, 7])
    return {"t": text(), "n": inner, text(): text()}


def export(r, n):
    hits = [dict(r.sample([("_index", "i"), ("_id", str(i)), ("_source", source(r)), ("sort", [i])], 4)) for i in range(n)]
    around = [("took", 3), ("_shards", {"hits": [1], "x": {"hits": [{}]}}), ("hits", dict(r.sample([("total", {"hits": [{}]}), ("max", None), ("hits", hits)], 3))), ("more", [[{"hits": {"hits": [{"_id": "no"}]}}]])]
    return dict(r.sample(around, 4))


def by_ranges(path, encoding, size):
    """Hits of a local file, as json, in order; None if it is no export."""
    with ranges.open_path(str(path)) as f:
        n = f.size()
        rows = [(str(path), 0, s, min(s + size, n), json.dumps(ranges.shape(f, s, min(s + size, n), encoding))) for s in range(0, max(n, 1), size)]
        places = ranges.walk(pd.DataFrame(rows, columns=["path", "nr", "start", "end", "shape"]))
        if places["error"].notna().any():
            return None
        return [x for p in places.itertuples(index=False) for x in ranges.elements(f, p[2], p[5], p[3], p[4], encoding)]


@pytest.mark.parametrize("encoding,size", [("UTF-8", 4), ("UTF-8", 52), ("UTF-16LE", 4), ("UTF-16LE", 64), ("UTF-16BE", 28), ("UTF-8", 1 << 20)])
def test_ranges_give_what_a_parse_gives(tmp_path, encoding, size):
    r = random.Random(size)
    for case in range(25):
        e = export(r, r.randrange(6))
        text = json.dumps(e, ensure_ascii=r.random() < 0.3, indent=r.choice([None, 1, "\t"]))
        path = tmp_path / "e.json"
        path.write_bytes(r.choice(["", "﻿"]).encode(encoding) + text.encode(encoding))
        found = by_ranges(path, encoding, size)
        assert [json.loads(t) for _, t in found] == e["hits"]["hits"], (case, text)
        assert [a for a, _ in found] == sorted({a for a, _ in found})


@pytest.mark.parametrize("text", ["", "no json", '{"hits":[{"_id":"1"}]}', '{"a":{"hits":{"hits":[{}]}}}', '{"hits":{"a":1},"b":{"hits":[{}]}}', '{"hits":{"hits":[{"_id":"1"}', '{"hits":{"hits":[{"_id":"1"}]}', '{"hits":{"hits":{"_id":"1"}}}', '[{"hits":{"hits":[]}}]'])
def test_other_files_are_none(tmp_path, text):
    path = tmp_path / "e.json"
    path.write_text(text)
    for size in (4, 16, 1 << 20):
        assert by_ranges(path, "UTF-8", size) is None


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    r, expected = random.Random(1), {}
    for name in "ab":
        e = {"hits": {"hits": [{"_id": f"{name}{i}", "_source": {"t": "".join(r.choice(TRICKY) for _ in range(20)), "n": {"_id": i}}} for i in range(40)]}}
        (tmp_path / f"{name}.json").write_bytes(json.dumps(e, ensure_ascii=False).encode("utf-16-le"))
        expected |= {h["_id"]: h["_source"]["t"] for h in e["hits"]["hits"]}
    (tmp_path / "c.json").write_bytes('{"hits":{"hits":[{"_id":"c0"},{"_id":bad},{"_id":"c2"}]}}'.encode("utf-16-le"))
    (tmp_path / "d.json").write_bytes('{"hits":{"hits":['.encode("utf-16-le"))
    hits, bad = exports.read_exports(spark, [str(tmp_path / "[abcd].json")], size=512)
    rows = hits.orderBy("load_seq").collect()
    assert [x["_id"] for x in rows] == [f"{n}{i}" for n in "ab" for i in range(40)] + ["c0", "c2"]
    assert all(x["_source"]["t"] == expected[x["_id"]] and json.loads(x["_source"]["n"]) == {"_id": int(x["_id"][1:])} for x in rows[:80])
    assert hits.rdd.getNumPartitions() > 10
    assert sorted((b["path"][-6:], b["error"]) for b in bad.collect()) == [("c.json", "no hit at 60"), ("d.json", "not a search export")]
    (tmp_path / "marked.json").write_bytes(json.dumps({"hits": {"hits": [{"_id": "m0"}, {"_id": "m1"}]}}).encode("utf-16"))
    (tmp_path / "broken.json").write_bytes("{".encode("utf-16"))
    whole, bad = exports.read_exports(spark, [str(tmp_path / "marked.json"), str(tmp_path / "broken.json")], "UTF-16")
    assert [x["_id"] for x in whole.orderBy("load_seq").collect()] == ["m0", "m1"], "an encoding without ranges is read whole"
    assert [b["path"][-11:] for b in bad.collect()] == ["broken.json"]


def test_files_that_come_in_are_committed_once(spark, tmp_path):
    into, out, ledger, mark, e, el = (str(tmp_path / x) for x in ("in", "out", "ledger", "mark", "errors", "error_ledger"))
    (tmp_path / "in").mkdir()

    def put(name, *ids):
        (tmp_path / "in" / name).write_text(json.dumps({"hits": {"hits": [{"_id": i, "_source": {"a": i}} for i in ids]}}))

    def run():
        commit_exports(spark, into, out, ledger, mark, "UTF-8", 64, 1, (e, el)).awaitTermination()
        return sorted(r["_id"] for r in read_committed(spark, out, ledger, HITS).collect())

    put("1.json", "a", "b")
    put("2.json", "c")
    assert run() == ["a", "b", "c"]
    put("3.json", "d")
    (tmp_path / "in" / "4.json").write_text("{")
    assert run() == ["a", "b", "c", "d"]
    assert [r["error"] for r in read_committed(spark, e, el, "path string, error string").collect()] == ["not a search export"]

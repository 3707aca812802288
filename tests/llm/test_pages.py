import io

import numpy as np
import pytest

from tidelog.llm import url_filter, warc
from tidelog.llm.common import Workspace

PAGES = "page_id long, url string, html string, sha string, host string, verdict int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES).repartition(3)


# WARC


def test_records():
    raw = warc.record(7, "http://a/\r\nb", b"x\r\n\r\ny", None, False)
    head, body = warc.parse_record(raw)
    assert body == b"x\r\n\r\ny" and head["WARC-Target-URI"] == "http://a/%0D%0Ab" and head["X-Page-ID"] == "7"
    head, body = warc.parse_record(warc.record(1, None, b"abc", 9, True))
    assert body == b"" and head["WARC-Type"] == "revisit" and head["WARC-Refers-To"] == warc.record_id(9)
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-1])


@pytest.mark.parametrize("n, size", [(1, 10), (3, 0), (400, 3000)])
def test_archives(monkeypatch, n, size):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 200_000)
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    bodies = [" ".join(rng.choice(words, size // 6)).encode() for _ in range(n)]
    out = io.BytesIO()
    out.close = lambda: None
    w = warc.Writer(out)
    for i, b in enumerate(bodies):
        w.add(warc.record(i, f"http://h/{i}", b, None, False))
    done = w.close()
    raw = out.getvalue()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and done["records"] == n and done["n_bytes"] == len(raw)
    assert [b for _, b in warc.read_records(io.BytesIO(raw))] == bodies
    if n == 400:
        assert len(raw) < 0.5 * done["raw_bytes"]
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(raw[:-3])))


def test_warc_cases(spark):
    long = "é" * 200_000
    rows = [(1, "http://a", "same"), (5, None, "same"), (3, "http://c", "same"), (2, "u", None), (4, "u", ""), (9, "u", long), (6, "u", "own"), (None, "u", "same"), (7, "u", "twice"), (7, "u", "twice")]
    df = pages(spark, rows)
    back = warc.read_archives(spark, warc.write_archives(warc.plan(df), Workspace(spark, "t"))).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in back), key=str)
    want = [
        (1, "revisit", 5, 4), (5, "response", None, 4), (3, "revisit", 5, 4), (None, "revisit", 5, 4), (2, "revisit", 4, 0), (4, "response", None, 0),
        (9, "response", None, 400_000), (6, "response", None, 3), (7, "response", None, 5), (7, "response", None, 5),
    ]
    assert got == sorted(want, key=str)
    assert next(r.payload for r in back if r.page_id == 9).decode() == long
    least = warc.read_archives(spark, warc.write_archives(warc.plan(df, least=5), Workspace(spark, "t")))
    assert least.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(spark, warc.write_archives(warc.plan(df.limit(0)), Workspace(spark, "t"))).count() == 0


# URL filter


def slow_rank(edges, seeds, rounds):
    out = {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    total = sum(seeds.values())
    start = {h: n / total for h, n in seeds.items()}
    score = dict(start)
    for _ in range(rounds):
        new = {h: (1 - url_filter.DAMPING) * x for h, x in start.items()}
        for s, d, n in edges:
            if s in score:
                new[d] = new.get(d, 0) + url_filter.DAMPING * score[s] * n / out[s]
        score = new
    return score


@pytest.mark.parametrize("most", [1 << 14, 2])
def test_propagation_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "STEPS_OF_PART", most)
    rng = np.random.default_rng(2)
    pairs = {(f"h{a}", f"h{b}"): int(n) for a, b, n in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.integers(1, 9, 90), strict=True)}
    edges = [(*p, n) for p, n in pairs.items()]
    allowed, blocked = {"h1": 3, "h2": 1}, {"h2": 2, "h9": 5, "alone": 1}
    seeds = [(h, allowed.get(h, 0), blocked.get(h, 0)) for h in {*allowed, *blocked}]
    got = url_filter.propagate(
        spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, allowed long, blocked long"), Workspace(spark, "t")
    ).collect()
    trust = slow_rank(edges, allowed, url_filter.ROUNDS)
    distrust = slow_rank([(d, s, n) for s, d, n in edges], blocked, url_filter.ROUNDS)
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-12 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-12
    assert {r.host for r in got} == set(trust) | set(distrust)


def test_url_filter_cases(spark):
    link = lambda *hosts: "".join(f'<a HREF = "//{h}/x">' for h in hosts)
    rows = [
        (1, "http://A.Example.COM/en/7x?q#f", None), (2, "https://a.example.com/en/8", None), (3, "ftp://sub.x.net/de/", link("friend.org")), (4, "http://b.example.net/de/81", None),
        (5, "http://x.org/es/1", None), (6, "http://notcom/en/", None), (7, "mailto:x", None), (8, None, link("x")), (9, "http://friend.org/", None), (10, "http://linker.info/a", link("x.org", "X.ORG")),
        (11, "http://X.net?no://path/de/", None), (12, "http://other.info#/en/", '<a href="/rel"><a href="mailto:a@b"><a href="#top"><a href="https://x.org">'), (None, "http://x.org/es/1", None), (1, "x://", ""),
    ]
    got = {}
    for r in url_filter.judge(pages(spark, rows), Workspace(spark, "t")).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert sorted(got[1], key=str) == sorted([("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("", "", None, "allow")], key=str)
    assert got[2] == [("a.example.com", "/en/8", "com/en/", "block")]
    assert got[3] == [("sub.x.net", "/de/", "net/de/", "allow")]
    assert got[4] == [("b.example.net", "/de/81", "example.net/de/8", "block")]
    assert got[5] == got[None] == [("x.org", "/es/1", "org/es/", "block")]
    assert got[6] == [("notcom", "/en/", None, "allow")]
    assert got[7] == got[8] == [("", "", None, "allow")]
    assert got[9] == [("friend.org", "/", None, "allow")]
    assert got[10] == [("linker.info", "/a", None, "block")]
    assert got[11] == [("x.net", "", None, "allow")]
    assert got[12] == [("other.info", "", None, "block")]
    assert url_filter.judge(pages(spark, rows[:1]).limit(0), Workspace(spark, "t")).count() == 0


def test_url_filter_runs_no_python(spark, monkeypatch):
    """Neither the result's plan nor that of any table written on the way to it."""
    plans, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda ws, df, name: plans.append(df._jdf.queryExecution().toString()) or save(ws, df, name))
    df = url_filter.judge(pages(spark, [(1, "http://a.com/en/1", "<a href='//b.org/es/'>")]), Workspace(spark, "t"))
    plans.append(df._jdf.queryExecution().toString())
    assert len(plans) > 10
    assert not any(x in plan for plan in plans for x in ("Python", "Pandas", "Arrow", "MapPartitions"))

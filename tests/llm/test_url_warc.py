"""URL verdicts and WARC archives against plain versions."""

import base64
import gzip
import hashlib
import itertools
import random
import zlib

import pytest

from tickloom.llm import queries, urls, warc

URLS = [
    None, "", "no scheme", "https://a.EXAMPLE.net/en/1", "http://example.net?x=/en/", "x://net/", "https://anet/", "https://b.example.com/de/#f", "https://example.com/DE/",
    "ftp://m.org/fr/x.html?q=1", "https://org/fr", "a://b://c/d", "https://É.net/\nline", "https://example.net/en/?a#b", "://", "h://HOST#x/y", "https://x.example.net:80/en/", "https://a.net/" + "seg/" * 50_000,
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), a, h + p) for a, h, p in queries.DOMAIN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_match_plain(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    for r in urls.judge(df, [], queries.DOMAIN_RULES).collect():
        assert (r["__host"], r["__path"]) == plain_parts(r.url)
        action, rule = plain_rule(r["__host"], r["__path"])
        assert (r["__rule"], r["__verdict"]) == (rule, action or "allow")
        assert r.host == "h"
    assert urls.judge(df.limit(0), [], queries.DOMAIN_RULES).count() == 0


def test_mined_rules_match_plain(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        url = f"https://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['x', 'y'])}.org/{rng.choice(['p', 'q', 'r'])}/{i}?{rng.choice(['k', 'm'])}=1"
        bad = ("a.x" in url and "/p/" in url) or ("m=1" in url and "b." in url)
        rows.append((url, int(bad) if rng.random() > 0.05 else None))
    df = spark.createDataFrame(rows, "url string, bad int")
    p = urls.Mining(support=0.02, confidence=0.7)
    mined = urls.mine(df, p=p)
    baskets = [(frozenset(r.t), r.bad) for r in df.select(urls.tokens_of(df.url).alias("t"), "bad").collect() if r.bad is not None]
    usual = sorted({t for ts, _ in baskets for t in ts if sum(t in x for x, _ in baskets) >= 0.02 * len(baskets)})
    passed = {}
    for size in range(1, 8):
        for chosen in itertools.combinations(usual, size):
            held = [b for ts, b in baskets if set(chosen) <= ts]
            for side, name in ((1, urls.BAD), (0, urls.GOOD)):
                n = held.count(side)
                if held and n >= 0.02 * len(baskets) and n >= 20 and n / len(held) >= 0.7:
                    passed[frozenset(chosen), name] = n / len(held)
    want = {k: v for k, v in passed.items() if not any(passed.get((k[0] - {t}, k[1]), 0) >= v for t in k[0])}
    assert {(t, s): round(c, 9) for t, s, c, _ in mined} == {k: round(v, 9) for k, v in want.items()}
    verdicts = {r.url: r["__verdict"] for r in urls.judge(df, mined, []).collect()}
    ranked = sorted(mined, key=lambda r: (-r[2], -r[3], sorted(r[0]), r[1]))
    for tokens, (url, _) in zip([frozenset(r.t) for r in df.select(urls.tokens_of(df.url).alias("t")).collect()], rows, strict=True):
        first = next((s for t, s, _, _ in ranked if t <= tokens), None)
        assert verdicts[url] == ("block" if first == urls.BAD else "allow")
    assert urls.mine(df.limit(0), p=p) == []


def test_long_urls_are_learned_from(spark):
    deep = "/".join(f"d{i}" for i in range(40))
    rows = [(f"https://spam.org/{deep}/{i}?" + "&".join(f"n{i}k{j}=1" for j in range(30)), 1) for i in range(60)]
    rows += [(f"https://spam.org/{i}", int(i % 10 == 0)) for i in range(60)]
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad int"))
    got = {(t, s): (round(c, 9), round(n, 9)) for t, s, c, n in mined}
    want = {(frozenset([f"p:d{i}"]), urls.BAD): (1.0, 0.5) for i in range(40)}
    assert got == want
    assert {(t, s) for t, s, *_ in urls.mine(spark.createDataFrame(rows[:70], "url string, bad int"))} >= {(frozenset(["h:spam"]), urls.BAD), (frozenset(["p:d39"]), urls.BAD)}


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, archive string, offset int")


PAGES = [
    (1, "https://a/é\r\nX: y%", "<p>a</p>\r\n\r\nWARC/1.1"), (2, None, None), (3, "u", ""), (4, "u", "é" * 700_000), (5, "u", "é" * 700_000), (9, "u", "same"), (8, "u", "same"),
    (8, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (None, "v", "alone"), (11, "u", "\x00\x1f binary \r\n"), (10, "u", "x" * 5_000_000),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_match_plain(spark, least):
    df = pages(spark, PAGES).repartition(3)
    got = warc.archive_pages(df, least=least).collect()
    heads = {}
    for i, _, h in PAGES:
        heads.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        head = max((x for x in heads[h or ""] if x is not None), default=None)
        again = head is not None and head != i and len(heads[h or ""]) > 1 and len(raw) >= least
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", head if again else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_members_join_to_the_whole_stream(spark, tmp_path):
    df = pages(spark, PAGES).coalesce(1)
    warc.write_archives(df, str(tmp_path / "whole"), "page_id", "url", "html")
    (source,) = (tmp_path / "whole").glob("*.gz")
    name, sidecar, records = warc.normalise_archive(str(source), str(tmp_path / "members"))
    raw, offset = open(name, "rb").read(), 0
    assert gzip.decompress(raw) == gzip.decompress(source.read_bytes()) and records == len(PAGES)
    for line in open(sidecar):
        at, length = map(int, line.split("\t")[:2])
        z = zlib.decompressobj(31)
        assert at == offset and z.decompress(raw[at : at + length]).startswith(b"WARC/1.1\r\n") and z.eof and not z.unused_data
        offset += length
    assert offset == len(raw)
    again, _, count = warc.normalise_archive(name, str(tmp_path / "twice"))  # an archive of members is read as well
    assert gzip.decompress(open(again, "rb").read()) == gzip.decompress(raw) and count == records
    (tmp_path / "cut.gz").write_bytes(source.read_bytes()[:-20])
    with pytest.raises((EOFError, zlib.error)):
        warc.normalise_archive(str(tmp_path / "cut.gz"), str(tmp_path / "bad"))

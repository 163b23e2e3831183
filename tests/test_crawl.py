"""The crawl index as a data source, its pages as a stream, and gathered evidence, against a local server."""

from __future__ import annotations

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from postpulse.operators import robots
from postpulse.sources import crawl, crawl_index, crawl_pages, evidence, stores

KEYS = sorted(f"com,host{k:03d},{'b' * (k % 3)})/p{j} {20250101 + j}" for k in range(200) for j in range(k % 5 + 1))


def index_files(keys, block=7):
    """(cluster.idx, blocks): gzip members of some lines, their first keys, and a line that does not parse."""
    lines = [
        f'{key} {json.dumps({"url": f"https://x/{n}", "status": "200", "offset": str(n)})}' for n, key in enumerate(keys)
    ]
    lines[3] = f"{keys[3]} not json"
    content, rows = b"", []
    for start in range(0, len(lines), block):
        member = gzip.compress(("\n".join(lines[start : start + block]) + "\n").encode())
        rows.append(f"{keys[start]}\tcdx-00000.gz\t{len(content)}\t{len(member)}\t{start}")
        content += member
    return ("\n".join(rows) + "\n").encode(), content


class Server:
    """Serves bytes by path with ranges, and records what is asked."""

    def __init__(self):
        self.files, self.asked, self.failing = {}, [], set()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                asked = urlparse(self.path)
                query = {k: v[0] for k, v in parse_qs(asked.query).items()}
                body = outer.files.get(asked.path)
                if callable(body):
                    body = body(query)
                status = 404 if body is None else 500 if self.path in outer.failing else 200
                body = body or b""
                span = self.headers.get("Range")
                if span and status == 200:
                    low, high = (int(x) for x in span.split("=")[1].split("-"))
                    body, status = body[low : high + 1], 206
                if self.command == "GET":
                    outer.asked.append((asked.path, len(body)))
                self.send_response(status)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                if self.command == "GET":
                    self.wfile.write(body)

            do_HEAD = do_GET

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.address = f"http://127.0.0.1:{self.http.server_port}"

    def bytes_of(self, path):
        return sum(n for p, n in self.asked if p == path)


@pytest.fixture
def server():
    found = Server()
    yield found
    found.http.shutdown()


@pytest.fixture
def crawls(spark, server):
    crawl_index.register(spark)
    for name in ("c1", "c2"):
        index, blocks = index_files(KEYS if name == "c1" else KEYS[::2])
        server.files[f"/{name}/cluster.idx"], server.files[f"/{name}/cdx-00000.gz"] = index, blocks
    return crawl_index.table(spark, f"{server.address}/{{crawl}}", crawls="c1, c2", task_bytes=600)


def kept(name):
    keys = KEYS if name == "c1" else KEYS[::2]
    return [(name, *k.split(" ")) for n, k in enumerate(keys) if n != 3]


@pytest.mark.parametrize(
    "condition, holds",
    [
        ("key LIKE 'com,host017,%'", lambda k: k.startswith("com,host017,")),
        ("key LIKE 'com,host01%'", lambda k: k.startswith("com,host01")),
        (f"key = '{KEYS[33].split(' ')[0]}'", lambda k: k == KEYS[33].split(" ")[0]),
        (f"key IN ('{KEYS[8].split(' ')[0]}', 'none')", lambda k: k == KEYS[8].split(" ")[0]),
        ("key > 'com,host1' AND key <= 'com,host12'", lambda k: "com,host1" < k <= "com,host12"),
        ("key >= 'com,host199'", lambda k: k >= "com,host199"),
        ("key LIKE 'aaa%'", lambda k: False),
        ("key LIKE 'zzz%'", lambda k: False),
        ("key LIKE '%p2'", lambda k: k.endswith("p2")),
        ("key IS NOT NULL", lambda k: True),
    ],
)
def test_filters_on_keys(crawls, condition, holds):
    found = crawls.where(condition).select("crawl", "key", "timestamp").collect()
    wanted = [r for c in ("c1", "c2") for r in kept(c) if holds(r[1])]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_a_lookup_reads_little(crawls, server):
    found = crawls.where("key LIKE 'com,host150,%' AND crawl = 'c1'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert len(found.collect()) == 1
    assert server.bytes_of("/c1/cdx-00000.gz") < len(server.files["/c1/cdx-00000.gz"]) / 20
    assert server.bytes_of("/c1/cluster.idx") < len(server.files["/c1/cluster.idx"]) * 1.2
    assert not any(path.startswith("/c2") for path, _ in server.asked)


def test_a_long_index_is_searched(spark, server):
    keys = sorted(f"com,h{k:05d})/ 2025" for k in range(20_000))
    lines = "".join(f"{k}\tcdx.gz\t0\t{len(gzip.compress(b''))}\t1\n" for k in keys).encode()
    server.files |= {"/big/cluster.idx": lines, "/big/cdx.gz": gzip.compress(b"")}
    crawl_index.register(spark)
    frame = crawl_index.table(spark, f"{server.address}/big")
    assert frame.where("key LIKE 'com,h12345)%'").collect() == []
    assert 0 < server.bytes_of("/big/cluster.idx") < len(lines) / 10
    assert sum(path == "/big/cdx.gz" for path, _ in server.asked) == 2


def test_tasks_share_an_index(crawls):
    assert crawls.where("crawl = 'c1'").rdd.getNumPartitions() > 5


def test_lost_blocks_are_rows(spark, crawls, server):
    index = server.files["/c1/cluster.idx"].decode().splitlines()
    index[4] = "\t".join([index[4].split("\t")[0], "gone.gz", "0", "9", "1"])
    broken = bytearray(server.files["/c1/cdx-00000.gz"])
    broken[int(index[2].split("\t")[2]) + 12] ^= 255
    server.files |= {"/c1/cluster.idx": "\n".join(index).encode(), "/c1/cdx-00000.gz": bytes(broken)}
    rows = crawls.where("crawl = 'c1' AND key LIKE 'com,host0%'")
    errors = rows.where("error IS NOT NULL").orderBy("key").collect()
    assert len(errors) == 2 and "gone.gz" in errors[1].error and all(r.url is None for r in errors)
    assert rows.where("error IS NULL").count() == sum(k.startswith("com,host0") for _, k, _ in kept("c1")) - 14
    with pytest.raises(Exception, match="zlib|gone.gz"):
        crawl_index.table(spark, f"{server.address}/{{crawl}}", crawls="c1", failures="raise").where("crawl = 'c1'").collect()


def test_no_index(spark, server):
    crawl_index.register(spark)
    with pytest.raises(Exception, match="no index at"):
        crawl_index.table(spark, f"{server.address}/none").collect()


def test_written_index_reads_back(spark, tmp_path):
    crawl_index.register(spark)
    path = str(tmp_path / "index")
    rows = [(None, f"org,h{k % 90:02d})/é{k}", str(k), f"https://h/{k}", None, None, None, str(k), "7", None) for k in range(1_000)]
    frame = spark.createDataFrame(rows, crawl_index.SCHEMA)
    dealt = frame.repartitionByRange(5, "key").sortWithinPartitions("key")
    dealt.write.format("crawl_index").option("path", path).option("block_lines", 40).mode("append").save()
    found = crawl_index.table(spark, path)
    columns = ["key", "timestamp", "url", "offset", "length", "status"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, frame.select(columns).collect()))
    small = crawl_index.table(spark, path, task_bytes=64)
    some = small.where(F.col("key").startswith("org,h07)"))
    assert some.count() == sum(k % 90 == 7 for k in range(1_000))
    assert some.rdd.getNumPartitions() < small.rdd.getNumPartitions()
    with pytest.raises(Exception, match="sorted"):
        frame.repartition(1).write.format("crawl_index").option("path", path).mode("append").save()
    assert found.count() == 1_000
    empty = frame.limit(0)
    empty.write.format("crawl_index").option("path", path).mode("overwrite").save()
    assert crawl_index.table(spark, path).count() == 0


def test_plans_of_one_table_do_not_share_filters(crawls):
    whole = crawls.count()
    assert crawls.where("key LIKE 'com,host150,%'").count() == 2
    assert crawls.count() == whole == sum(len(kept(c)) for c in ("c1", "c2"))
    assert crawls.where("crawl = 'c2'").count() == len(kept("c2"))
    assert crawls.count() == whole


def pages_served(server, counts, urls=2):
    def answer(query):
        host = query["url"].removesuffix("/*")
        if "showNumPages" in query:
            return json.dumps({"pages": counts[host]}).encode() if host in counts else b"nonsense"
        return "".join(f'{{"url": "https://{host}/{query["page"]}/{k}"}}\n' for k in range(urls)).encode() + b"not json\n"

    server.files["/c1-index"] = answer


def test_pages_as_a_stream_that_resumes(spark, server, tmp_path):
    crawl_pages.register(spark)
    counts = {"a.x": 5, "c.x": 0, "d.x": 3}
    pages_served(server, counts)
    api = f"{server.address}/{{crawl}}-index"
    wanted = {f"https://{h}/{p}/{k}" for h, n in counts.items() for p in range(n) for k in range(2)}
    failed_at = "/c1-index?url=d.x%2F%2A&output=json&fl=url&page=1"
    server.failing.add(failed_at)

    def save(batch, number):
        crawl.page_urls(batch, api, failures="raise").write.mode("overwrite").parquet(str(tmp_path / f"out/n={number}"))

    def run():
        stream = (
            spark.readStream.format("crawl_pages").option("api", api).option("crawls", "c1")
            .option("hosts", "a.x,b.x,c.x,d.x").option("pages_per_batch", 2).load()
        )
        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    import unittest.mock

    quick = unittest.mock.patch.object(crawl.fetch_range, "__defaults__", (None, None, 1, 0.0))
    with quick, pytest.raises(Exception, match="500|HTTPError"):
        run()
    before = spark.read.parquet(str(tmp_path / "out"))
    assert {r.url for r in before.where("url IS NOT NULL").collect()} < wanted
    asked = len(server.asked)
    server.failing.clear()
    run()
    found = spark.read.parquet(str(tmp_path / "out"))
    urls = [r.url for r in found.where("url IS NOT NULL").collect()]
    assert sorted(urls) == sorted(wanted)
    assert [(r.host, r.page) for r in found.where("error IS NOT NULL").collect()] == [("b.x", None)]
    assert len(server.asked) - asked <= 4
    run()
    assert len(server.asked) - asked <= 4


def test_lost_pages_are_rows(spark, server):
    pages_served(server, {"a.x": 2})
    api = f"{server.address}/{{crawl}}-index"
    server.failing.add("/c1-index?url=a.x%2F%2A&output=json&fl=url&page=1")
    rows = [("c1", "a.x", 0, None), ("c1", "a.x", 1, None), ("c1", "b.x", None, "no count")]
    import unittest.mock

    pages = spark.createDataFrame(rows, "crawl string, host string, page long, error string").coalesce(1)
    with unittest.mock.patch.object(crawl.fetch_range, "__defaults__", (None, None, 1, 0.0)):
        found = crawl.page_urls(pages, api).collect()
    assert [(r.page, r.url is None, r.error) for r in found if r.host == "b.x"] == [(None, True, "no count")]
    assert sorted((r.page, r.url or r.error[:9]) for r in found if r.host == "a.x") == [
        (0, "https://a.x/0/0"), (0, "https://a.x/0/1"), (1, "HTTPError"[:9])
    ]


def test_archived_payloads(spark, server):
    server.files["/w.gz"] = b"xx" + (record := gzip.compress(b"W\r\n\r\nH: 1\r\n\r\nbody"))
    rows = [("w.gz", "2", str(len(record))), ("w.gz", "0", "2"), ("no.gz", "0", "5"), (None, None, None)]
    frame = spark.createDataFrame(rows, "filename string, offset string, length string")
    found = crawl.archived_payloads(frame, server.address).collect()
    assert (found[0].headers, found[0].body, found[0].error) == ("H: 1", "body", None)
    assert all(r.body is None and r.error for r in found[1:])


def test_first_live_tenant(spark, server):
    for k in range(50):
        if k not in (0, 1, 2):
            server.files[f"/t{k}"] = b"ok"
    rows = [("v", k, f"t{k}", f"{server.address}/t{k}") for k in range(50)]
    rows += [("w", k, f"n{k}", f"{server.address}/n{k}") for k in range(50)] + [("v", None, "x", None)]
    frame = spark.createDataFrame(rows, "provider string, place int, token string, probe string")
    found = {r.provider: (r.token, r.asked) for r in evidence.live_tenants(frame).collect()}
    assert found == {"v": ("t3", 4), "w": (None, 40)}
    assert len(server.asked) == 44


def test_archived_copies_stop_early(spark, server):
    def record(text):
        return gzip.compress(f"W\r\n\r\nHTTP/1.1 200\r\n\r\n{text}".encode())

    archive = b""
    for c in range(6):
        lines = []
        for host, status in (("a", "200"), ("b", "404"), ("live", "200")):
            raw = record(f"User-agent: *\nDisallow: /{c}")
            body = {
                "url": f"https://{host}.v.com/robots.txt", "status": status, "filename": "arc",
                "offset": str(len(archive)), "length": str(len(raw)),
            }
            archive += raw
            lines.append(f"com,v,{host})/robots.txt 2025{c} {json.dumps(body)}")
        lines.append(f'com,v,z)/other 2025{c} {{"url": "https://z.v.com/other", "status": "200"}}')
        member = gzip.compress("\n".join(lines).encode())
        folder = f"/cc-index/collections/c{c}/indexes"
        if c != 1:
            server.files[f"{folder}/cluster.idx"] = f"com,v,a)/robots.txt 2025{c}\tb.gz\t0\t{len(member)}\n".encode()
            server.files[f"{folder}/b.gz"] = member
    server.files["/arc"] = archive
    targets = spark.createDataFrame(
        [("v", "com,v,", "live", 1), ("none", "com,nobody,", None, 1)], "provider string, prefix string, tenant string, other int"
    )
    names = [f"c{c}" for c in range(6)]
    rows = evidence.archived_copies(targets, server.address, names, wanted=2).collect()
    copies = [(r.crawl, r.url) for r in rows if r.kind == "copy"]
    assert copies == [("c0", "https://live.v.com/robots.txt"), ("c0", "https://a.v.com/robots.txt")]
    assert [(r.crawl, r.status) for r in rows if r.kind == "refused"] == [("c0", "404")]
    assert {r.provider: r.crawls_searched for r in rows if r.kind == "searched"} == {"v": 1, "none": 5}
    assert not any("Disallow: /2" in (r.body or "") for r in rows)
    three = evidence.archived_copies(targets.where("provider = 'v'"), server.address, names, most=2).collect()
    assert [r.crawls_searched for r in three if r.kind == "searched"] == [2]
    assert sum(r.kind == "copy" for r in three) == 2


def test_audit_of_evidence(spark):
    copies = [
        ("ok", "copy", "User-agent: *\nDisallow: /x"), ("ban", "copy", "User-agent: *\nDisallow: /"), ("ban", "copy", ""),
        ("shy", "refused", None), ("new", "searched", None), ("file", "copy", ""), ("stop", "copy", ""),
    ]
    live = [
        ("ok", "/jobs", 200, "User-agent: *\nAllow: /"), ("ban", "/jobs", 200, ""), ("shy", "/jobs", 404, None),
        ("new", "/jobs", 404, None), ("file", "/jobs", 404, None), ("stop", "/jobs", 200, "User-agent: *\nDisallow: /jobs"),
    ]
    found = robots.audit(
        spark.createDataFrame(live, "provider string, path string, http_status int, robots string"),
        spark.createDataFrame(copies, "provider string, kind string, body string"),
        "botty/1.0",
    )
    assert {r.provider: (r.status, r.copies, r.disallowing) for r in found.collect()} == {
        "ok": ("OK", 1, 0), "ban": ("STOP-ARCHIVE-DISALLOWS", 2, 1), "shy": ("OK-NEVER-SERVED", 0, 0),
        "new": ("UNVERIFIED-NO-ARCHIVE", 0, 0), "file": ("OK-NO-LIVE-FILE", 1, 0), "stop": ("STOP-LIVE-DISALLOWS", 1, 0),
    }


def test_stores(tmp_path):
    address = f"file://{tmp_path}/a/b"
    stores.write(address, b"0123456789")
    assert stores.size(address) == 10 and stores.read(address, 2, 5) == b"234" and stores.whole(address) == b"0123456789"
    stores.remove(address)
    stores.remove(address)
    assert stores.size(address) == 0 and stores.whole(address) is None


def test_counters_of_documents(spark, server):
    from postpulse.operators.readings import counter_changes
    from postpulse.sources import counters

    paths = {"runs": "$.data.stats.totalRuns", "users": "$.data.stats.totalUsers", "stars": "$.data.stars"}
    requests = spark.createDataFrame(
        [("a", f"{server.address}/a"), ("b", f"{server.address}/b"), ("gone", f"{server.address}/gone"), ("none", None)],
        "name string, url string",
    )
    readings = []
    for day in (1, 2):
        server.files |= {
            "/a": json.dumps({"data": {"stats": {"totalRuns": 10 * day, "totalUsers": 3}}}).encode(), "/b": b"not json",
        }
        replies = counters.read_documents(requests, 2, unit=0.0)
        replies = spark.createDataFrame(replies.collect(), replies.schema)
        assert {r.name: r.http for r in replies.collect()} == {"a": 200, "b": 200, "gone": 404}
        readings.append(counters.counters(replies, paths, F.lit(f"2026-01-0{day}")))
    both = readings[0].union(readings[1])
    named = both.select("read_at", F.concat_ws(".", "name", "counter").alias("name"), "value")
    found = {(r.name, r.read_at): (r.value, r.change) for r in counter_changes(named).collect()}
    assert found[("a.runs", "2026-01-02")] == (20.0, 10.0) and found[("a.users", "2026-01-02")] == (3.0, 0.0)
    assert found[("a.stars", "2026-01-01")] == (0.0, None) and len(found) == 6

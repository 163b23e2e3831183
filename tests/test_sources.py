"""Vendor bodies, tolerant readers, sinks and the history stream."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postpulse.functions.report import fixed, markdown_table
from postpulse.plans.documents import BODIES
from postpulse.sources import crawl, files, sinks, vendors
from postpulse.streaming import history


@pytest.fixture(scope="module")
def postings(spark):
    frame = spark.createDataFrame(BODIES, "source string, company string, body string")
    return {r.source: r for r in vendors.all_postings(frame).collect()}


def test_every_vendor_maps(postings):
    assert set(postings) == set(vendors.VENDORS)


def test_vendor_rules(postings):
    p = postings
    assert p["greenhouse"].title == "Senior Engineer" and p["greenhouse"].salary_max == 200000
    assert p["greenhouse"].posted_at == datetime(2026, 8, 1, 8)
    assert p["ashby"].workplace == "hybrid" and p["ashby"].salary_currency == "GBP"
    assert p["lever"].location is None and p["lever"].seniority == "executive"
    assert p["workable"].location == "Leeds, UK" and p["workable"].workplace == "remote"
    assert p["breezy"].location == "Oslo, Norway" and p["breezy"].description is None
    assert p["recruitee"].salary_min == 30000 and p["recruitee"].salary_currency == "EUR"
    assert p["teamtailor"].description == "Hot & busy" and p["teamtailor"].location == "Lund, SE"


def test_unexpected_shape(spark):
    frame = spark.createDataFrame(BODIES, "source string, company string, body string")
    odd = vendors.unexpected_shapes(frame.where("source = 'lever'"), "lever").collect()
    assert [r.company for r in odd] == ["broken"]


def test_torn_line_is_dropped(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"p":"a","t":"x","j":3}\n{"p":"a","t":"y"')
    rows = files.json_lines(spark, str(tmp_path), files.HISTORY).collect()
    assert [(r.p, r.t, r.j) for r in rows] == [("a", "x", 3)]


def test_roster_csv_drops_bad_rows(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "provider,token,open_postings,board_url,api_url\na,x,3,u,v\na,,4,u,v\nb,y,zz,u,v\nb,z,0,u,v\n"
    )
    path = str(tmp_path / "r.csv")
    assert [r.token for r in files.roster_csv(spark, path).orderBy("token").collect()] == ["x", "z"]
    assert files.roster_csv(spark, path, positive_only=True).count() == 1


def test_index_blocks_keep_the_one_before(spark):
    rows = [(k, "f", n, 1) for n, k in enumerate(["com,a", "com,b", "com,ca", "com,cb", "com,d"])]
    index = spark.createDataFrame(rows, "key string, file string, offset long, length long")
    assert sorted(r.key for r in crawl.blocks_for(index, "com,c").collect()) == [
        "com,b",
        "com,ca",
        "com,cb",
    ]


def test_records_and_payload(spark):
    line = 'com,a)/x 20260101 {"url": "https://a.com/x", "status": "200"}'
    frame = spark.createDataFrame([(line,), ("com,b)/ 1 {}",)], "value string")
    row = crawl.records(frame, "com,a)").first()
    assert (row.timestamp, row.url, row.status) == ("20260101", "https://a.com/x", "200")
    record = "W: 1\r\n\r\nHTTP/1.1 200\r\n\r\nbody\r\n\r\nmore"
    frame = spark.createDataFrame([(record,)], "r string")
    assert tuple(frame.select(crawl.payload(frame.r).alias("p")).first().p) == (
        "HTTP/1.1 200",
        "body\r\n\r\nmore",
    )


def test_issue_is_immutable(spark, tmp_path):
    frame = spark.range(3)
    sinks.issue(frame, str(tmp_path), "2026-09-03")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.issue(frame, str(tmp_path), "2026-09-03")
    sinks.issue(frame, str(tmp_path), "2026-09-03", force=True)
    rows = files.issues(spark, str(tmp_path), "id long, issue_date date")
    assert rows.count() == 3
    assert str(files.latest_before(rows, "2026-10-01").first().previous) == "2026-09-03"


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "series")
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.append_new(frame, path, ["k"])
    sinks.append_new(frame.union(spark.createDataFrame([("c", 3)], "k string, v int")), path, ["k"])
    assert spark.read.parquet(path).count() == 3


def test_budget_shares():
    assert sinks.budget_shares({"a": 1, "b": 100, "c": 100}, 20) == {"a": 1, "b": 10, "c": 9}


def test_history_stream_resumes(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    first = source / "snapshot_date=2026-09-01"
    first.mkdir(parents=True)
    (first / "a.jsonl").write_text(json.dumps({"p": "v", "t": "x", "j": 3}) + '\n{"p":"v","t"')

    def run():
        stream = history.history_stream(spark, str(source))
        query = history.append_series(stream, table, str(tmp_path / "state")).start()
        query.awaitTermination()

    run()
    second = source / "snapshot_date=2026-09-02"
    second.mkdir()
    (second / "b.jsonl").write_text(json.dumps({"p": "v", "t": "x", "j": 5}) + "\n")
    run()
    run()
    rows = spark.read.parquet(table).orderBy("snapshot_date").collect()
    assert [r.j for r in rows] == [3, 5]


def test_report(spark):
    assert fixed(1.005, 2) == "1.00" and fixed(2.5, 0) == "3"
    frame = spark.createDataFrame([("a|b", 1234, None)], "n string, c long, r double")
    assert markdown_table(frame, {"n": "Name", "c": "Count", "r": "Ratio"}).endswith(
        "| a\\|b | 1,234 | – |"
    )


def test_live_boards_retry_and_classify(spark):
    """A local server stands in for a vendor: refusals are retried, verdicts follow replies."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from postpulse.sources import boards

    asked: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.strip("/")
            asked[name] = asked.get(name, 0) + 1
            code = {"gone": 404, "busy": 429}.get(name, 200)
            if name == "shy" and asked[name] < 3:
                code = 503
            body = {"live": '[{"id": 1}]', "shy": "[]", "odd": '{"x": 1}'}.get(name, "")
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        names = ["live", "shy", "gone", "busy", "odd"]
        frame = spark.createDataFrame([("lever", n) for n in names], "source string, company string")
        address = {"lever": f"http://127.0.0.1:{server.server_port}/{{}}"}
        replies = boards.read_boards(frame, workers=1, endpoints=address, unit=0.01)
        found = {r.company: (r.status, r.jobs) for r in boards.probed(replies).collect()}
    finally:
        server.shutdown()
    assert found == {
        "live": ("live", 1),
        "shy": ("empty", 0),
        "gone": ("dead", None),
        "busy": ("blocked", None),
        "odd": ("dead", None),
    }
    assert asked["busy"] == 4 and asked["gone"] == 1


def test_feed_form_and_chosen_vendors(spark):
    frame = spark.createDataFrame(BODIES, "source string, company string, body string")
    rows = vendors.all_postings(frame, ("ashby", "lever"), feed=True)
    assert not set(vendors.FEED_DROPS) & set(rows.columns)
    found = {r.source: r for r in rows.collect()}
    assert set(found) == {"ashby", "lever"} and found["ashby"].updated_at == found["ashby"].posted_at


def test_archived_records_are_unpacked(spark):
    import gzip

    plain = b"WARC/1.0\r\na: b\r\n\r\nHTTP/1.1 200 OK\r\nc: d\r\n\r\nUser-agent: *\r\n\r\nrest"
    rows = [(1, gzip.compress(plain)), (2, plain), (3, gzip.compress(plain)[:20]), (4, None), (5, b"short")]
    frame = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "id int, content binary")
    found = {r.id: (r.headers, r.body) for r in crawl.payloads(frame).collect()}
    assert found[1] == found[2] == ("HTTP/1.1 200 OK\r\nc: d", "User-agent: *\r\n\r\nrest")
    assert found[3] == found[4] == found[5] == (None, None)


@pytest.mark.parametrize("probe", [16, 64, 4096])
def test_range_search_reads_little_and_finds_all(probe):
    keys = sorted(f"com,host{k:04d})/{j} {k}" for k in range(300) for j in range(k % 3 + 1))
    text = ("\n".join(keys) + "\n").encode()
    asked = []

    def read(low, high):
        asked.append(high - low)
        return text[low:high]

    for prefix in ("com,host0000", "com,host0123", "com,host0299", "com,host01", "com,zzz", "com,aaa"):
        asked.clear()
        found = crawl.index_range(read, len(text), prefix, probe=probe)
        wanted = [k for k in keys if k.startswith(prefix)]
        before = [k for k in keys if k < prefix][-1:]
        assert found == before + wanted
        if probe < 4096 and len(wanted) < 5:
            assert sum(asked) < len(text) / 2


@pytest.fixture(scope="module")
def index_server():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _reply(self, body: bytes, status: int = 200):
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        def do_GET(self):
            asked = urlparse(self.path)
            query = {k: v[0] for k, v in parse_qs(asked.query).items()}
            if asked.path == "/bytes":
                span = self.headers.get("Range")
                low, high = (int(x) for x in span.split("=")[1].split("-")) if span else (0, 9)
                self._reply(b"0123456789"[low : high + 1], 206 if span else 200)
            elif asked.path == "/c1-index" and "showNumPages" in query:
                self._reply(b'{"pages": 2}' if query["url"] == "a.example/*" else b"nonsense")
            elif asked.path == "/c1-index":
                self._reply(f'{{"url": "https://a.example/t{query["page"]}"}}\nnot json\n'.encode())
            else:
                self._reply(b"", 404)

        do_HEAD = do_GET

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_ranged_reads(index_server):
    assert crawl.fetch_range(f"{index_server}/bytes", 2, 4) == b"234"
    assert crawl.fetch_range(f"{index_server}/bytes") == b"0123456789"
    assert crawl.fetch_range(f"{index_server}/none") is None
    assert crawl.size_of(f"{index_server}/bytes") == 10 and crawl.size_of(f"{index_server}/none") == 0


def test_index_pages_survive_a_host_that_fails(spark, index_server):
    api = f"{index_server}/{{crawl}}-index"
    pages = crawl.index_pages(spark, ["c1"], ["a.example", "b.example"], api, workers=2)
    found = crawl.page_urls(pages, api).orderBy("page").collect()
    assert [(r.host, r.page, r.url) for r in found] == [
        ("b.example", None, None), ("a.example", 0, "https://a.example/t0"), ("a.example", 1, "https://a.example/t1")]
    assert found[0].error and not found[1].error


def test_token_checkpoint_unites_harvests(spark, tmp_path):
    path = str(tmp_path / "tokens")
    assert sinks.saved_tokens(spark, path).count() == 0
    for rows in ([("v", "b"), ("v", "a"), ("v", "a")], [("v", "b"), ("u", "z")]):
        sinks.save_tokens(spark.createDataFrame(rows, "provider string, token string"), path)
    assert [tuple(r) for r in sinks.saved_tokens(spark, path).collect()] == [("u", "z"), ("v", "a"), ("v", "b")]


def test_manifest_and_widened_readings(spark):
    rows = spark.createDataFrame([("b", "x", 1), ("a", "y", 2)], "p string, t string, j int")
    row = sinks.manifest(rows, "2026-01-01", "live", 3).first()
    assert tuple(row) == ("2026-01-01", 2, ["a", "b"], False, "live")
    wide = sinks.widened(rows, spark.createDataFrame([("c", 4)], "p string, gone int"))
    assert wide.columns == ["p", "t", "j", "gone"] and wide.count() == 3


def test_remote_tokens_and_sitemaps(spark, tmp_path):
    urls = ["https://x.example/Acme/1", "https://x.example/acme/2", "https://y.example/", None]
    spark.createDataFrame([(u, 1) for u in urls], "url string, other int").write.parquet(str(tmp_path / "u"))
    found = files.parquet_tokens(spark, str(tmp_path / "u"), r"x\.example/([^/]+)/")
    assert [tuple(r) for r in found.collect()] == [("acme", 2)]
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a/1 </loc></url>\n<url><loc>https://a/2</loc></url></urlset>")
    rows = files.sitemap_locations(spark, str(tmp_path / "s.xml")).collect()
    assert [r.location for r in rows] == ["https://a/1", "https://a/2"]


def test_boards_without_a_name_are_not_asked(spark):
    from postpulse.sources import boards

    frame = spark.createDataFrame([("lever", None), ("lever", ""), ("none", "x")], "source string, company string")
    assert boards.read_boards(frame).count() == 0


def test_signals_of_a_stream(spark, tmp_path):
    lines = [json.dumps({"source": "s", "company": c, "posted_at": f"2026-01-{d:02d} 00:00:00"}) for c in "ab" for d in (3, 20)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("source string, company string, posted_at timestamp_ntz").json(str(tmp_path / "in"))
    query = history.signal_stream(stream, "2026-01-31", str(tmp_path / "out"), str(tmp_path / "cp")).start()
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.company, r.open_postings, r.opened_30d, r.signal) for r in found} == {("a", 2, 2, "new_board"), ("b", 2, 2, "new_board")}


def test_phrases():
    from postpulse.functions.report import count_word, list_phrase

    assert [count_word(k) for k in (0, 7, 9)] == ["zero", "seven", "9"]
    assert [list_phrase(x) for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a and b", "a, b and c"]


def test_addresses_of_boards(spark):
    import urllib.parse

    from postpulse.sources import boards

    names = ["acme", "a b", "é/ü", "x!'()*~-_.", "a+b", "", None]
    rows = [(v, n) for v in [*vendors.VENDORS, "unknown"] for n in names]
    frame = spark.createDataFrame(rows, "source string, company string")
    found = frame.select(
        "source", "company", boards.api_url(F.col("source"), F.col("company")).alias("api"),
        vendors.board_url(F.col("source"), F.col("company")).alias("url"),
    )
    for r in found.collect():
        if r.source == "unknown" or not r.company:
            assert r.api is None and r.url is None
        else:
            name = urllib.parse.quote(r.company, safe="!'()*")
            assert r.api == boards.ENDPOINTS[r.source].format(name)
            assert r.url == vendors.VENDORS[r.source].board_url.format(name)


def test_a_range_of_days_reads_those_folders(spark, tmp_path):
    for day in range(1, 6):
        folder = tmp_path / f"snapshot_date=2026-01-0{day}"
        folder.mkdir()
        (folder / "x.json").write_text(f'{{"p": "a", "t": "t{day}", "j": {day}}}\n{{"p": "torn')
    found = files.history_days(spark, str(tmp_path), "2026-01-02", "2026-01-04")
    assert sorted(r.t for r in found.collect()) == ["t2", "t3", "t4"]
    assert len(found.inputFiles()) == 5 and "PartitionFilters: [isnotnull(snapshot_date" in (
        found._jdf.queryExecution().executedPlan().toString()
    )
    assert files.history_days(spark, str(tmp_path)).count() == 5


def test_draws_at_any_place(spark):
    from itertools import islice

    from postpulse.operators import sampling

    for seed in (7, 0, 0xFFFFFFFF, 20260903):
        rows = spark.range(500).select("id", sampling.uniform_at(seed, F.col("id")).alias("u")).collect()
        assert [r.u for r in sorted(rows)] == list(islice(sampling._uniform(seed), 500))
    far = 4_000_000_000
    one = spark.range(1).select(sampling.uniform_at(7, F.lit(far))).first()[0]
    assert one == next(sampling._uniform(7 + far * sampling._STEP))


def test_counter_samples(spark):
    from postpulse.operators import roster, sampling

    rows = [(f"p{k % 2}", f"t{k}") for k in range(400)] * 2 + [("small", "x"), (None, "y"), ("p0", None)]
    frame = spark.createDataFrame(rows, "provider string, token string")
    found = sampling.counter_samples(frame, "provider", "token", 30, 7, least=5)
    kept = sorted((r.provider, r.token) for r in found.collect())
    assert len(kept) == 60 == len(set(kept)) and {p for p, _ in kept} == {"p0", "p1"}
    again = sampling.counter_samples(frame.repartition(9), "provider", "token", 30, 7, least=5)
    assert kept == sorted((r.provider, r.token) for r in again.collect())
    other = sampling.counter_samples(frame, "provider", "token", 30, 8, least=5)
    assert kept != sorted((r.provider, r.token) for r in other.collect())
    pairs = roster.cross_pairs(found, ("p0", "p1", "p2")).collect()
    assert len(pairs) == 120 and all(r.source_provider != r.target_provider for r in pairs)


def test_feeds_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("b", 'x "y", z', 2), ("a", None, 1), ("c", "line\nend", 3)], "p string, t string, j int")
    sinks.feed(rows, str(tmp_path / "all"))
    sinks.feed(rows, str(tmp_path / "two"), most=2)
    assert spark.read.json(str(tmp_path / "all")).count() == 3 and spark.read.json(str(tmp_path / "two")).count() == 2
    sinks.csv_artifact(rows, str(tmp_path / "csv"), ["t", "p"])
    back = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["t", "p"] and sorted(r.p for r in back.collect()) == ["a", "b", "c"]
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("part-*"))
    assert text.startswith("t,p\n") and '"x \\"y\\", z",b' in text


def test_issues_are_immutable(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "c string, n int")
    sinks.issue(rows, str(tmp_path), "2026-01-01")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.issue(rows, str(tmp_path), "2026-01-01")
    sinks.issue(rows.withColumn("n", F.lit(2)), str(tmp_path), "2026-01-01", force=True)
    sinks.issue(rows, str(tmp_path), "2026-01-02")
    found = files.issues(spark, str(tmp_path), "c string, n int, issue_date date")
    assert sorted((str(r.issue_date), r.n) for r in found.collect()) == [("2026-01-01", 2), ("2026-01-02", 1)]
    assert str(files.latest_before(found, "2026-01-02").first().previous) == "2026-01-01"


def test_the_market_list_has_one_order(spark):
    from postpulse.operators import signals

    rows = [("s", "b", 3), ("s", "a", 3), ("r", "a", 3), ("s", "z", 9), ("s", "q", None)]
    frame = spark.createDataFrame(rows, "source string, company string, opened_30d int").repartition(3)
    found = [(r.source, r.company) for r in signals.by_recent_openings(frame).collect()]
    assert found == [("s", "z"), ("r", "a"), ("s", "a"), ("s", "b"), ("s", "q")]

"""Dedupe, repeats, diffs, rosters and sampling: invariants and small cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postpulse.operators import dedupe, diff, fanout, filters, ranking, robots, roster, sampling

ROWS = "board string, pos long, title string, location string"


def rows(spark, *items):
    return spark.createDataFrame([("b", k, *i) for k, i in enumerate(items)], ROWS)


def test_dedupe_keeps_the_first_and_never_merges_unstated(spark):
    frame = rows(
        spark,
        ("Nurse", "Leeds"),
        ("nurse!", "Leeds, Remote"),
        ("Nurse", "York"),
        ("Nurse", None),
        ("Nurse", "Remote"),
        ("", "Leeds"),
    )
    kept = {r.pos: r.duplicates_merged for r in dedupe.dedupe_rows(frame).collect()}
    assert kept == {0: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    assert dedupe.dedupe_rows(frame, apply=False).count() == 6


def test_repeat_buckets_add_up(spark):
    frame = rows(spark, *[("A", p) for p in ("x", "x", "y", None, None)], ("B", None), ("B", None))
    for r in dedupe.repeats_by_title(frame).collect():
        assert r.same_location + r.distinct_location + r.unstated == r.extra
    found = dedupe.analyse_boards(frame).first()
    assert (found.postings, found.repeated_extra, found.unstated_extra) == (7, 5, 3)


def test_fanout_bounds_bracket(spark):
    items = [(f"Driver - City{k}", f"City{k}" if k % 2 else None) for k in range(8)]
    frame = rows(spark, *items)
    places = spark.createDataFrame([("city2",)], "token string")
    row = fanout.fanout_bounds(
        fanout.stem_verdicts(fanout.verified_rows(fanout.split_titles(frame), places))
    ).first()
    assert row.lower == 4 and row.upper == 5 and row.postings == 8


def issue(spark, *items):
    return spark.createDataFrame(
        [("s", c, o, g) for c, o, g in items], "source string, company string, open long, signal string"
    )


def test_unread_boards_neither_appear_nor_go_quiet(spark):
    before = issue(spark, ("a", 5, "steady"), ("gone", 3, "steady"), ("lost", 2, "steady"))
    after = issue(spark, ("a", 9, "ramping"), ("new", 4, "steady"), ("back", 1, "steady"))
    unread = lambda *c: issue(spark, *[(x, 0, "") for x in c])
    found = diff.board_changes(before, after, unread("back"), unread("lost"))
    flags = {r.company: {c for c in diff.CLASSES if r[c]} for r in found.collect()}
    assert flags == {
        "a": {"grew", "became_ramping"},
        "gone": {"went_quiet"},
        "lost": set(),
        "new": {"appeared"},
        "back": set(),
    }
    totals = diff.gross_changes(found).first()
    assert totals.gross_up - totals.gross_down == totals.net == 4


def test_last_run_wins_and_upper_median(spark):
    runs = spark.createDataFrame(
        [("p", f"t{k}", r, r * 10 + k) for k in range(4) for r in (1, 2)],
        "provider string, token string, run int, jobs long",
    )
    last = roster.layered(runs, ("provider", "token"), "run")
    assert {r.run for r in last.collect()} == {2}
    assert roster.upper_median(last, "jobs", "provider").first().median == 22


def test_every_kth_takes_the_stated_places(spark):
    boards = spark.createDataFrame([(f"b{k:02}", 5) for k in range(23)], "board string, postings long")
    strata = (("all", 1, 7),)
    plan = sampling.strata_plan(boards, strata)
    found = sorted(r.board for r in sampling.every_kth(boards, plan, strata).collect())
    assert found == [f"b{k * 23 // 7:02}" for k in range(7)]
    assert plan.first().weight == 1.0


def test_bootstrap_equals_the_sequential_loop(spark):
    strata = [
        {"weight": 0.5, "census": True, "boards": [(100, 5), (50, 1)]},
        {"weight": 0.3, "census": False, "boards": [(10, 1), (20, 0), (30, 6)]},
        {"weight": 0.2, "census": False, "boards": [(2, 0), (1, 1)]},
    ]
    state, expected = sampling.SEED, []
    for _ in range(50):
        top = weight = 0.0
        for s in strata:
            boards = s["boards"]
            if not s["census"]:
                picked = []
                for _ in boards:
                    state = (state * sampling.LCG_A + sampling.LCG_C) % sampling.LCG_M
                    picked.append(boards[int(state / sampling.LCG_M * len(boards))])
                boards = picked
            posted, extra = np.sum(boards, axis=0)
            top, weight = top + s["weight"] * extra / posted, weight + s["weight"]
        expected.append(top / weight)
    found = sampling.bootstrap_draws(spark, strata, draws=50).orderBy("iteration").collect()
    assert np.allclose([r.rate for r in found], expected)


def test_rule_counters_are_independent_of_filters(spark):
    frame = spark.createDataFrame(
        [("Be your own boss",), ("Volunteer",), ("Cook",)], "title string"
    )
    counted, seen = filters.observed(frame)
    counted.where(filters.PostingFilter(drop_volunteer=True).condition()).count()
    assert seen.get == {"rows": 3, "recruitment_ads": 1, "volunteer_unpaid": 1}


ROBOTS = [
    (1, None, "/json"),
    (2, "User-agent: *\nDisallow: /json\nAllow: /json/public", "/json/public/1"),
    (3, "User-agent: *\nDisallow: /json", "/json?x=1"),
    (4, "User-agent: botty\nDisallow: /\n\nUser-agent: *\nDisallow:", "/a"),
    (5, "User-agent: other\nUser-agent: *\nDisallow: /*.json$", "/a.json.json"),
    (6, "User-agent: *\nDisallow: /a*b$ # none", "/axxbx"),
]


def test_robots(spark):
    frame = spark.createDataFrame(ROBOTS, "id int, robots string, path string")
    found = {r.id: r.allowed for r in robots.robots_verdicts(frame, "botty/1.0").collect()}
    assert found == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert robots.robots_verdicts(frame.limit(0), "botty/1.0").count() == 0
    rootless = spark.createDataFrame([(7, "User-agent: *\nDisallow: /$", None)], frame.schema)
    assert not robots.robots_verdicts(rootless, "botty/1.0").first().allowed
    merged = "User-agent: a\nDisallow: /x\nUser-agent: a\nDisallow: /y"
    assert not robots.verdict(merged, "/y", "a")[0] and not robots.verdict(merged, "/x", "a")[0]


def test_boards_asked_routes_bare_tokens_home(spark):
    asked = spark.createDataFrame([("v1:Acme",), ("beta",), ("new",)], "board string")
    homes = spark.createDataFrame([("v2", "beta")], "provider string, token string")
    found = filters.boards_asked(asked, homes, ["v1", "v2"]).collect()
    assert {tuple(r) for r in found} == {("v1", "acme"), ("v2", "beta"), ("v1", "new"), ("v2", "new")}


def test_filters_with_null_columns(spark):
    frame = spark.createDataFrame(
        [(None, None, None, None)], "title string, department string, team string, description string"
    )
    assert frame.where(filters.PostingFilter(keywords=("x",)).condition()).count() == 0
    assert frame.where(F.lit(True) & filters.PostingFilter().condition()).count() == 1


def test_seeded_samples_share_one_generator():
    lists = {"a": list(range(50)), "b": [1, 2], "c": list("uvwxyz")}
    first = sampling.seeded_samples(lists, 4, 42)
    assert first == sampling.seeded_samples(lists, 4, 42)
    assert first["b"] == [1, 2] and len(set(first["a"])) == 4
    assert sampling.seeded_samples({"c": lists["c"]}, 4, 42)["c"] != first["c"]


def test_generator_is_mulberry32():
    """Its well-known first numbers for seed 0."""
    draws = sampling._uniform(0)
    found = [round(next(draws) * 2**32) for _ in range(2)]
    assert found == [1144304738, 1416247]


def test_audit_ladder(spark):
    rows = [(False, True, 0, 0, 1), (True, True, 2, 1, 0), (True, False, 0, 0, 2), (True, True, 0, 0, 0), (True, False, 2, 0, 0), (True, True, 2, 0, 1)]
    names = ("allowed", "present", "archived", "banned", "refused")
    frame = spark.createDataFrame(rows, "allowed boolean, present boolean, archived long, banned long, refused long")
    found = [r.s for r in frame.select(robots.audit_status(*map(F.col, names)).alias("s")).collect()]
    assert found == [
        "STOP-LIVE-DISALLOWS", "STOP-ARCHIVE-DISALLOWS", "OK-NEVER-SERVED", "UNVERIFIED-NO-ARCHIVE", "OK-NO-LIVE-FILE", "OK"
    ]


def test_places_are_those_of_the_whole_order(spark, monkeypatch):
    """Many equal sizes, repeated names, null sizes; ranges of a few rows each."""
    draw = np.random.default_rng(1)
    items = [(f"b{k % 700:03d}", None if k % 97 == 0 else int(draw.integers(1, 6))) for k in range(1000)]
    frame = spark.createDataFrame(items, "board string, postings int")
    for bounds in (ranking.BOUNDS, 3):
        monkeypatch.setattr(ranking, "BOUNDS", bounds)
        rows = ranking.with_place(frame, "postings").collect()
        assert sorted(r.place for r in rows) == list(range(1000))
        wanted = sorted(items, key=lambda i: (-(i[1] or -1), i[0]))
        assert [(r.board, r.postings) for r in sorted(rows, key=lambda r: r.place)] == wanted
    assert ranking.with_place(frame.limit(0), "postings").count() == 0


def test_census_strata_count_as_sums(spark):
    strata = (("big", 50, None), ("small", 1, 3))
    boards = spark.createDataFrame([(f"c{k}", k + 1, k % 4) for k in range(60)], "board string, postings long, extra long")
    plan = sampling.strata_plan(boards, strata)
    sample = sampling.every_kth(boards, plan, strata)
    found = {s["name"]: s for s in sampling.drawn_boards(sample, plan)}
    assert found["big"]["boards"] == [(sum(range(50, 61)), sum(k % 4 for k in range(49, 60)))]
    assert len(found["small"]["boards"]) == 3
    planned = sample.withColumn("reason", F.when(F.col("postings") > 58, "timeout"))
    rates = {r.stratum: r for r in sampling.stratum_rates(sample.where("postings <= 58"), planned).collect()}
    assert (rates["big"].planned, rates["big"].failed, rates["big"].boards_read) == (11, 2, 9)
    assert [tuple(x) for x in rates["big"].reasons] == [("timeout", 2)] and rates["small"].failed == 0


def test_issues_without_a_roster_compare_their_tables(spark):
    named = lambda *c: spark.createDataFrame([("s", x) for x in c], "source string, company string")
    full = {"roster": issue(spark, ("a", 5, "steady")), "ramping": named("a", "b")}
    later = {"roster": issue(spark, ("a", 9, "steady")), "ramping": named("b", "c")}
    basis, rows = diff.compared(full, later)
    assert basis == "roster" and [(r["class"], r.delta) for r in rows.collect()] == [("grew", 4)]
    basis, rows = diff.compared({"ramping": full["ramping"]}, later)
    assert basis == "top_lists"
    assert {(r.table, r.change, r.company) for r in rows.collect()} == {("ramping", "entered", "c"), ("ramping", "left", "a")}


def test_change_order_and_hours(spark):
    frame = spark.createDataFrame([("s", "a", 3), ("s", "b", -9), ("s", "c", 4)], "source string, company string, delta int")
    assert [r.company for r in diff.by_change(frame).collect()] == ["b", "c", "a"]
    times = spark.createDataFrame([("2026-01-01 00:00:00", "2026-01-02 01:20:00")], "a string, b string")
    hours = diff.hours_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    assert times.select(hours.alias("h")).first().h == 25.3


def test_valid_postings_need_a_title_and_an_id(spark):
    rows = [("t", "1"), ("", "2"), (None, "3"), ("t", ""), ("t", None)]
    frame = spark.createDataFrame(rows, "title string, job_id string")
    assert [tuple(r) for r in filters.valid_postings(frame).collect()] == [("t", "1")]


def test_roster_order(spark):
    rows = [("v", "b", "live", 3), ("v", "a", "live", 3), ("v", "c", "empty", 0), ("v", "d", "live", 9)]
    frame = spark.createDataFrame(rows, "provider string, token string, status string, open_postings long")
    assert [r.token for r in roster.roster_order(frame).collect()] == ["d", "a", "b"]
    asked = roster.boards_to_read(frame, 10, with_empty=True).orderBy("place").collect()
    assert [r.token for r in asked] == ["d", "a", "b", "c"]


def test_free_prices(spark):
    from postpulse.operators import readings

    frame = spark.sql("SELECT map('x', named_struct('free', 1.0, 'flat', 2.0), 'y', named_struct('free', null, 'flat', 3.0)) AS e")
    assert frame.select(readings.free_prices(F.col("e")).alias("p")).first().p == {"x": 1, "y": 3}


@pytest.mark.parametrize("name", ["signal_tech_counts", "market_top_lists"])
def test_large_mentions_meet_in_sized_tasks(spark, sf_dir, monkeypatch, name):
    from postpulse.operators import staging
    from postpulse.plans import bindings, catalogue
    from tests.compare import canonical, connection

    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 10)
    wanted = staging.tasks_for(bindings.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"))
    assert wanted > 4
    assert bindings.mentions(spark, sf_dir).rdd.getNumPartitions() == wanted
    frame = catalogue.queries()[name](spark, sf_dir)
    answer = connection(sf_dir).execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(columns, answer.fetchall())
    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 40)
    assert staging.tasks_for(bindings.table(spark, sf_dir, "lineitem")) is None


def test_large_parts_meet_in_sized_tasks(spark, sf_dir, monkeypatch):
    from postpulse.operators import staging
    from postpulse.plans import bindings
    from tests.compare import canonical, connection

    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 8)
    frame = bindings.mentions(spark, sf_dir)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_partkey" in plan and "RepartitionByExpression [p_partkey" in plan
    answer = connection(sf_dir).execute(bindings.with_ctes(("mentions",), "SELECT * FROM mentions"))
    columns = [c[0] for c in answer.description]
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(columns, answer.fetchall())

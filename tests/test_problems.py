"""The general problem operators on small fixtures, against brute force."""

import random
import zoneinfo
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.functions import instants, zones
from quadloom.functions.values import with_plain_text
from quadloom.operators import changes, intervals, pivot, skew
from quadloom.sources import lines
from tests.conftest import rows

APP = "row_id long, hid string, stime string, etime string, key string, lo long, first string, kind int"


def app(spark, data):
    return spark.createDataFrame([(i, *x, "k", 1, "f", 2) for i, x in enumerate(data)], APP)


def test_dyadic_blocks_cover_exactly(spark):
    random.seed(1)
    data = [(i, a, a + random.randint(0, random.choice([3, 70, 5000]))) for i, a in enumerate(random.randint(0, 40000) for _ in range(60))]
    data += [(95, 64, 127), (96, 63, 64), (97, 128, 64 * 7 - 1), (98, 0, intervals.OPEN), (99, intervals.OPEN, intervals.OPEN)]
    blocks = intervals.dyadic_blocks(spark.createDataFrame(data, "i int, lo long, hi long"), ["i"]).collect()
    for i, lo, hi in data:
        spans, partial = [], 0
        for b in (b for b in blocks if b.i == i):
            first = b.idx << b.level
            if b.mask == -1:
                spans.append((first, ((b.idx + 1) << b.level) - 1))
            else:
                assert b.level in (intervals.WORD_BITS, intervals.TILE_BITS)
                unit = 1 << b.level - intervals.WORD_BITS
                partial += 1
                spans += [(first + k * unit, first + (k + 1) * unit - 1) for k in range(64) if b.mask >> k & 1]
        spans.sort()
        assert spans[0][0] == lo and spans[-1][1] == hi and partial <= 4
        assert all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:], strict=False))
        whole = [x for x in spans if x[1] - x[0] >= 1 << intervals.TILE_BITS]
        assert len(whole) <= 2 * intervals.BITS and all(((n := b - a + 1) & (n - 1)) == 0 and a % n == 0 for a, b in whole)


def test_runs_of_any_integers(spark):
    random.seed(11)
    data = []
    for key, low, high in (("a", -300, 300), ("b", 10**12, 10**12 + 20_000), ("c", -(10**9), -(10**9) + 5000)):
        data += [(key, x, x + random.choice([0, 1, 5, 63, 64, 200, -1])) for x in (random.randint(low, high) for _ in range(50))]
    want = []
    for key in "abc":
        points = sorted({p for k, lo, hi in data if k == key for p in range(lo, hi + 1)})
        for p in points:
            if want and want[-1][0] == key and want[-1][2] == p - 1:
                want[-1][2] = p
            else:
                want.append([key, p, p])
    df = spark.createDataFrame(data, "key string, lo long, hi long")
    assert rows(intervals.covered_runs(df, "key", "lo", "hi", bits=None)) == sorted(map(tuple, want), key=repr)
    assert rows(intervals.covered_runs(df.limit(0), "key", "lo", "hi", bits=None)) == []
    with pytest.raises(Exception, match="outside"):
        intervals.covered_runs(df, "key", "lo", "hi").collect()


def test_periods_and_gaps_brute_force(spark):
    random.seed(2)
    base = date(2019, 12, 1)
    data = []
    for _ in range(300):
        a = base + timedelta(random.randint(0, 3000) if random.random() < 0.3 else random.randint(0, 200))
        b = a + timedelta(random.randint(-3, 40))
        data.append((f"hid{random.randint(0, 12)}", a.isoformat(), "null" if random.random() < 0.02 else b.isoformat()))
    data += data[:40] + [("hid0", "2020-02-30", "2020-03-01"), ("hid1", None, "null"), (None, "2020-01-01", "2020-01-02"), ("hid77", "2020-01-01", "no")]
    want = []
    for hid in {h for h, _, _ in data if h}:
        days, open_from = set(), None
        for h, a, b in data:
            try:
                lo = date.fromisoformat(a or "")
                hi = None if b == "null" else date.fromisoformat(b)
            except ValueError:
                continue
            if h != hid or (hi and hi < lo):
                continue
            if hi is None:
                open_from = min(open_from or lo, lo)
            else:
                days.update(range(lo.toordinal(), hi.toordinal() + 1))
        if open_from:
            days = {x for x in days if x < open_from.toordinal()} | {open_from.toordinal()}
        runs = []
        for x in sorted(days):
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        text = lambda n: date.fromordinal(n).isoformat()
        for i, (lo, hi) in enumerate(runs):
            last = open_from and i == len(runs) - 1
            want.append((hid, "period", text(lo), "null" if last else text(hi)))
            if i + 1 < len(runs):
                want.append((hid, "gap", text(hi + 1), text(runs[i + 1][0] - 1)))
    assert rows(intervals.periods_and_gaps(app(spark, data))) == sorted(want, key=repr)


def test_periods_of_nothing(spark):
    assert rows(intervals.periods_and_gaps(app(spark, []))) == []
    assert rows(intervals.periods_and_gaps(app(spark, [("h", "no", "n/a"), ("h", "2020-01-02", "2020-01-01")]))) == []


PAGES = "pid int, page_no long, triple_count int, update_count int, n string, _salt int"


def test_page_figures(spark):
    data = [(1, 1, 5, 0), (1, 1, 9, 2), (1, 1, 9, 2), (1, 2, None, 0), (2, 3, 7, 1), (2, 3, 8, 1), (None, 4, 5, 0), (3, None, 5, 0), (2, 5, 1, None)]
    data += [(7, 100 + i, i % 10, 0) for i in range(3000)]
    got = rows(skew.page_figures(spark.createDataFrame([(*x, "n", 1) for x in data], PAGES)))
    assert got == [(1, 2, 9, 9), (2, 2, 9, 8), (7, 3000, 13500, 9)]
    assert rows(skew.page_figures(spark.createDataFrame([], PAGES))) == []


def test_heavy_keys_are_salted(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).cast("int").alias("pid"), F.col("id").alias("page_no"))
    assert rows(skew.heavy_keys(df, "pid")) == [(1,)]
    out = skew.salted_aggregate(df, "pid", {"c": F.count(F.lit(1))}, {"n": F.sum("c")}, "page_no")
    assert out.where("pid = 1").first().n == 4000 and out.count() == 1001


@pytest.mark.parametrize("limit", [0, 1000])
def test_look_up_of_heavy_keys(spark, limit):
    df = spark.range(3000).select(F.when(F.col("id") < 1500, "hot").when(F.col("id") < 2000, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    right = spark.createDataFrame([("hot", 1.0), *[(f"k{i}", float(i)) for i in range(40)], ("unused", 9.0)], "key string, w double")
    got = skew.look_up(df, right, "key", limit)
    weight = {r.key: r.w for r in right.collect()}
    assert got.columns == ["key", "id", "w"] and rows(got) == sorted(((r.key, r.id, weight.get(r.key)) for r in df.collect()), key=repr)


LOG = "recv_no long, page_no long, pid int, min_t timestamp, log_count long, operation_type string, s string, o string, t string, _seq int"


def fold_by_hand(log):
    starts = {}
    for r in log:
        if r[3] is not None:
            starts[r[1]] = r[3]
    seen, state = {}, {}
    for r in log:
        seen[(starts.get(r[1], datetime.min), r[4], r[1])] = r
    for _, r in sorted(seen.items()):
        key, op = (r[2], r[6]), r[5].strip().lower()[0]
        if op == "i":
            state[key] = [r[7], r[8]]
        elif op == "d":
            state.pop(key, None)
        elif key in state:
            state[key] = [r[7] if r[7] is not None else state[key][0], r[8] if r[8] is not None else state[key][1]]
    return sorted(((*k, *v) for k, v in state.items()), key=repr)


def test_current_triples_brute_force(spark):
    random.seed(3)
    log = []
    for page in range(30):
        start, pid = datetime(2024, 1, 1) + timedelta(hours=page // 2), page % 2
        for n in range(20):
            op = random.choice(["INSERT", "ins", "U", "update", "D", "delete_data", " upd"])
            o, t = (None, None) if op[0] in "Dd" else (random.choice([None, f"v{random.random()}"]), random.choice([None, "no"]))
            subject = random.choice(["a", "b", "c", None])
            log.append((0, page, pid, start if random.random() > 0.2 or n == 0 else None, n + 20 * (page % 5 > 2), op, subject, o, t))
    log += random.sample(log, 100)
    random.shuffle(log)
    df = spark.createDataFrame([(*r, 1) for r in log], LOG)
    assert rows(changes.current_triples(df)) == fold_by_hand(log)
    assert rows(changes.current_triples(df.limit(0))) == []


def test_fold_with_base_rows_and_unknown_operations(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    feed = spark.createDataFrame([("a", 5, "D", None), ("b", 1, "U", "9"), ("c", 1, "U", "7"), ("d", 1, "?", "7")], "k string, q int, op string, v string")
    got = changes.fold_changes(feed, ["k"], F.col("q"), changes.operation(F.col("op")), ["v"], base)
    assert rows(got) == [("b", "9")]


def test_tombstones_outlive_a_fold(spark):
    schema = "k int, q int, op string, v string"
    spec = (["k"], F.col("q"), changes.operation(F.col("op")), ["v"])
    first = spark.createDataFrame([(1, 1, "i", "A"), (1, 10, "d", None), (2, 10, "i", "NEW"), (3, 7, "u", "U")], schema)
    late = spark.createDataFrame([(1, 5, "i", "LATE"), (2, 5, "u", "OLD"), (3, 6, "i", "B")], schema)
    state = changes.fold_state(late, *spec, state=changes.fold_state(first, *spec))
    assert rows(changes.current_rows(state, ["k"], ["v"])) == [(2, "NEW"), (3, "U")]
    assert state.count() == 3


def test_any_split_of_a_feed_folds_alike(spark):
    random.seed(8)
    feed = [(random.randint(0, 9), q, random.choice("iud"), random.choice([None, f"v{q}"]), random.choice([None, f"w{q}"])) for q in range(160)]
    schema = "k int, q int, op string, v string, w string"
    spec = (["k"], F.col("q"), changes.operation(F.col("op")), ["v", "w"])
    table = {}
    for k, _, op, v, w in feed:
        if op == "i":
            table[k] = (v, w)
        elif op == "d":
            table.pop(k, None)
        elif k in table:
            table[k] = (table[k][0] if v is None else v, table[k][1] if w is None else w)
    want = sorted(((k, *x) for k, x in table.items()), key=repr)
    whole = changes.fold_state(spark.createDataFrame(feed, schema), *spec)
    assert rows(changes.current_rows(whole, ["k"], ["v", "w"])) == want
    for n in (2, 3, 5):
        random.shuffle(feed)
        batches = [feed[i::n] for i in range(n)] + [feed[:20]]  # some come again
        state = None
        for b in batches:
            state = changes.fold_state(spark.createDataFrame(b, schema), *spec, state=state).checkpoint()
        assert rows(state) == rows(whole)


MAP = "pid int, pred_name string, used int, value_type string, multi boolean"
ATTRS = [(1, "name", 1, "string", False), (2, "size", 1, "integer", False), (3, "cap", 1, "decimal", False), (4, "born", 1, "date", False),
         (5, "open", 1, "boolean", False), (6, "rel", 1, "ref", True), (7, "7", 0, None, None)]
FACTS = "fact_id long, s string, p string, o string, t string, src string, loaded_at timestamp, v string, a string"


def facts(spark, data):
    return spark.createDataFrame([(i, s, p, o, "no", "x", None, "v", "a") for i, (s, p, o) in enumerate(data)], FACTS)


@pytest.mark.parametrize("block", [1, 2, 8])
def test_filled_cells(spark, block):
    data = [("company/1", "name", " x "), ("company/1", "NAME ", "y\t"), ("company/1", "name", "  "), ("company/1", "size", "3.0"), ("company/1", "size", "about"),
            ("company/2", "rel", "z"), ("office/1", "name", "n"), (None, "name", "n"), ("company/3", "size", None), ("company/4", "open", "是"), ("company/4", None, "q"),
            ("company/4", "cap", "1,234.5"), ("company/4", "born", "3 Mar 2020"), ("company/1", "size", "3.0")]
    pm = spark.createDataFrame(ATTRS, MAP)
    want = [("company/1", "name", "y"), ("company/1", "size", "3"), ("company/4", "open", "true"), ("company/4", "cap", "1234.50"), ("company/4", "born", "2020-03-03")]
    assert rows(pivot.filled_cells(facts(spark, data), pm, block)) == sorted(want, key=repr)
    wide, _ = pivot.company_table(facts(spark, data), pm, block)
    assert dict(wide.dtypes) == {"s": "string", "name": "string", "size": "decimal(38,0)", "cap": "decimal(38,2)", "born": "date", "open": "boolean"}
    assert rows(wide.select("s")) == [("company/1",), ("company/3",), ("company/4",)]
    assert rows(pivot.filled_cells(facts(spark, []), pm, block)) == []


@pytest.mark.parametrize("n", [1, 16, 200, 2000])
def test_scans_and_shuffles_do_not_grow_with_attributes(spark, tmp_path, n):
    attributes = [pivot.Attribute(f"a{i}", "string") for i in range(n)]
    data = [(f"e{e}", f"a{(e * 7 + j) % n}", f"v{e}-{j}", e * 100 + j) for e in range(5) for j in range(30)] + [("none", "other", "x", 1), ("none", "a0", None, 2), (None, "a0", "x", 3)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(data, "s string, a string, v string, fact_id long").write.parquet(path)
    wide = pivot.wide_rows(spark.read.parquet(path), attributes)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("Exchange hashpartitioning")) == (1, 2)
    want = {}
    for e, a, v, k in data:
        if e is not None:
            row = want.setdefault(e, {})
            if v is not None and a != "other" and row.get(a, (-1,))[0] < k:
                row[a] = (k, v)
    got = {r.s: {c: r[c] for c in wide.columns[1:] if r[c] is not None} for r in wide.collect()}
    assert got == {e: {a: v for a, (_, v) in row.items()} for e, row in want.items()}


def test_plain_text(spark):
    cases = {
        "integer": {"7": "7", " +105 ": "105", "1,422": "1422", "302.0": "302", "３４": "34", "٣٤": "34", "2e3": "2000", "-0": "0", "3.5": None, "12..15": None, "--4": None,
                    "1,42": None, "about ten": None, "": None, "1 234 567": "1234567", "1.234.567": "1234567", "−4": "-4", "9" * 60: None, ".": None, "e5": None},
        "decimal": {"245974800e-2": "2459748.00", "735 740.00": "735740.00", "12,723,786.99": "12723786.99", "1.2.3,4": None, "12,5O0.00": None, "EUR": None,
                    "379335": "379335.00", "2.345": "2.35", "-.5": "-0.50", "1.234,56": "1234.56", None: None},
        "date": {"1995-10-09": "1995-10-09", "1991年12月1日": "1991-12-01", "2004/06/16": "2004-06-16", "20220214": "2022-02-14", "1995.10.16": "1995-10-16", "29 Apr 1993": "1993-04-29",
                 "2023-02-29": None, "spring 2011": None, "April 3, 2001": "2001-04-03", "31 Apr 2001": None, "0000-01-01": None, "2020-1/2": None, "3 Foo 2001": None},
        "boolean": {"TRUE": "true", "Y": "true", "否": "false", "0": "false", "-1": None, "maybe": None, "yes/no": None, "\tno ": "false"},
        "string": {" a b ": "a b", "　": None, "n/a": "n/a"},
        "ref": {"x": None},
    }
    data = [(k, o, want) for k, d in cases.items() for o, want in d.items()]
    for r in with_plain_text(spark.createDataFrame(data, "k string, o string, want string"), "o", "k", "got").collect():
        assert r.got == r.want, r


def test_long_numbers(spark):
    cases = {
        "integer": {"9" * 38: "9" * 38, "-1" + "0" * 29: "-1" + "0" * 29, "9" * 39: None, "5.00000000001": None, "5.0000000000000": "5", "1.5e1": "15", "15e-1": None, "150e-1": "15",
                    "0e-9": "0", "1e37": "1" + "0" * 37, ".5e1": "5", "1" + "0" * 12 + "e-12": "1"},
        "decimal": {"9" * 36: "9" * 36 + ".00", "9" * 37: None, "0.00499999999999": "0.00", "0.005": "0.01"},
    }
    data = [(k, o, want) for k, d in cases.items() for o, want in d.items()]
    for r in with_plain_text(spark.createDataFrame(data, "k string, o string, want string"), "o", "k", "got").collect():
        assert r.got == r.want, r


LINES = {
    "<a> <b> <c> <2020-01-01> .": None,
    "  <a>\t<b>  \"x \\\" y\"@zh-Hans <no>": None,
    "<a> <b> \"-4\"^^<xsd:integer>.": None,
    "<a> <b> \"a > b # {\" .": None,
    "{p,s,2020-01-01,null,{o 1,o2}}.": None,
    "": None, " \t": None, "# <a": None, None: None,
    "<a> <b> <c": "quoting", "<a> <b> c> .": "quoting", "<a> <b> \"x .": "quoting", "<a> <b> \"x\\\" .": "quoting", "<a> <b> \"x \"y\" .": "quoting",
    "<a> <b> say \\\"hi\\\" you\" <no> .": "quoting", "{p,s,no,no,{o}.": "quoting", "{p,s,no,no,{o.": "quoting",
    "<a> <b> .": "columns", "<a>": "columns", "<a> <b> <c> <no> <d> .": "columns", "<a> <b> <c> .<d> <e> <f> .": "columns", "plain words": "columns",
    "{p,s}.": "columns", "{p,s,no,{o}}.": "columns", "{p,s,no,no,{}}.": "columns",
    "<> <b> <c> .": "value", "<a> <b> <  > .": "value", "\"a\" <b> <c> .": "value", "<a> <b> \"4,7\"^^<xsd:integer> .": "value", "<a> <b> \"\"^^<xsd:integer> .": "value",
    "<a> <b> \"1.5.2\"^^<xsd:decimal>": "value", "<a> <b> \"2019-04-31\"^^<xsd:date>": "value", "<a> <b> \"perhaps\"^^<xsd:boolean>": "value", "<a> <b> <c> <2020-02-30> .": "value",
    "<a> <b> <c> <1e9> .": "value", "{p,s,nope,no,{o}}.": "value", "<a> <b> \"x\"^^<xsd:string> .": "value",
}


def test_lines(spark):
    data = [(i, t, want, "r", 1) for i, (t, want) in enumerate(LINES.items())]
    df = spark.createDataFrame(data, "line_id long, line_text string, want string, rec string, _t int")
    got = {r.line_id: r.reason for r in lines.bad_lines(df).collect()}
    for i, text, want, *_ in data:
        assert got.get(i) == want, text
    good = {r.line_id: r for r in lines.good_lines(df).collect()}
    assert set(good) == {0, 1, 2, 3, 4}
    assert (good[1].o, good[1].lang, good[1].t) == ('x " y', "zh-Hans", "no")
    assert good[4].objects == ["o 1", "o2"] and good[4].t_end == "null"


def test_very_long_lines_do_not_crash(spark):
    long = ['<a> <b> "' + 'x\\"' * 200_000 + '" .', "<a> <b> <" + "x" * 500_000 + ">", "{p,s,no,no,{" + "o," * 100_000 + "o}}.", '"' * 100_001]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(long)], "line_id long, line_text string")
    assert {r.line_id: r.reason for r in lines.bad_lines(df).collect()} == {3: "quoting"}


def test_zone_tables_agree_with_zoneinfo():
    tables = zones.load_tables()
    random.seed(4)
    for key in random.sample(sorted(tables.zones), 120):
        z, info = tables.zones[key], zoneinfo.ZoneInfo(key)
        for _ in range(40):
            second = random.randint(0, 4_000_000_000)
            wall = datetime(1970, 1, 1) + timedelta(seconds=second)
            assert z.offset_at(np.array([second]))[0] == wall.replace(tzinfo=info).utcoffset().total_seconds(), (key, wall)
    for key in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Africa/Casablanca", "America/Santiago", "Europe/Dublin", "Asia/Gaza"):
        z, info = tables.zones[key], zoneinfo.ZoneInfo(key)
        for _ in range(200):
            wall = datetime(random.choice([2038, 2100, 2499, 2500, 2899, 2900, random.randint(2101, 9998)]), 1, 1) + timedelta(seconds=random.randint(0, 366 * 86400))
            second = (wall - datetime(1970, 1, 1)) // timedelta(seconds=1)
            assert z.offset_at(np.array([second]))[0] == wall.replace(tzinfo=info).utcoffset().total_seconds(), (key, wall)
    assert tables.version != "" and zones.load_tables(tables.version) is tables
    with pytest.raises(ValueError):
        zones.load_tables("1970a")


TIMES = [
    ("2016-10-30 02:30:00", "harbor", "2016-10-30T00:30:00.000000Z"),  # occurs twice: the first
    ("2016-03-27 02:30:00", "harbor", "2016-03-27T01:30:00.000000Z"),  # skipped: the offset before
    ("2024-12-15T18:26", "mirror", "2024-12-15T10:26:00.000000Z"),
    ("06/08/2022 18:26", "monsoon", "2022-08-06T12:56:00.000000Z"),
    ("12/06/2013 06:25 AM", "ledger", "2013-12-06T11:25:00.000000Z"),
    ("21 Feb 2011, 7:33:55 pm", "relay", "2011-02-21T19:33:55.000000Z"),
    ("29 May 2017, 12:20:15 am", "relay", "2017-05-29T00:20:15.000000Z"),
    ("2010-09-19T21:33:01.812598762Z", "relay", "2010-09-19T21:33:01.812598Z"),
    ("2025-08-11 07:58:56.9", "relay", "2025-08-11T07:58:56.900000Z"),
    ("1489935127", "mirror", "2017-03-19T14:52:07.000000Z"),
    ("1314856007481", "mirror", "2011-09-01T05:46:47.481000Z"),
    ("-1", "mirror", "1969-12-31T23:59:59.000000Z"),
    ("2014-10-14 12:28:37 UTC+2", "harbor", "2014-10-14T10:28:37.000000Z"),
    ("2013-02-03 21:57:08 UTC+05:30", "harbor", "2013-02-03T16:27:08.000000Z"),
    ("2013-06-27 07:57:06 EDT", "ledger", "2013-06-27T11:57:06.000000Z"),
    ("2013-06-27 07:57:06 CST", "mirror", "2013-06-26T23:57:06.000000Z"),
    ("2024-12-22T21:43:36[Asia/Shanghai]", "relay", "2024-12-22T13:43:36.000000Z"),
    ("Sun, 9 May 2021 02:58:26 GMT", "tagus", "2021-05-09T02:58:26.000000Z"),
    ("Tue, 23 Sep 2025 02:41:26 -0400", "ledger", "2025-09-23T06:41:26.000000Z"),
    ("2012年10月14日 13时9分5秒", "mirror", "2012-10-14T05:09:05.000000Z"),
    ("20210723T070809Z", "coral", "2021-07-23T07:08:09.000000Z"),
    ("2020-01-01 00:00:00", "unknown", "2020-01-01T00:00:00.000000Z"),
    ("2150-07-01 12:00:00", "harbor", "2150-07-01T10:00:00.000000Z"),
    ("2150-01-01 12:00:00", "harbor", "2150-01-01T11:00:00.000000Z"),
    ("9999-07-01 12:00:00", "ledger", "9999-07-01T16:00:00.000000Z"),
    ("2020-01-01 00:00:00+18:00", "relay", "2019-12-31T06:00:00.000000Z"),
    ("2020-01-01 00:00:00+18:01", "relay", None), ("2020-01-01 00:00:00-12:60", "relay", None), ("2020-01-01 00:00:00+99:99", "relay", None), ("2020-01-01 00:00:00 UTC+19", "relay", None),
    ("1489935127123456789", "relay", "2017-03-19T14:52:07.123456Z"), ("9999999999999999999", "relay", "2286-11-20T17:46:39.999999Z"),
    ("2020-02-30 00:00:00", "relay", None), ("2020-01-01 25:00:00", "relay", None), ("2020-01-01T00:00:00[No/Where]", "relay", None), ("soon", "relay", None),
    ("2020-01-01", "relay", None), ("no", "relay", None), ("null", "relay", None), (None, "relay", None), ("x" * 5000, None, None),
]


def test_utc_instants(spark):
    feeds = spark.createDataFrame(
        [("harbor", "Europe/Berlin", True), ("ledger", "America/New_York", False), ("mirror", "Asia/Shanghai", False), ("relay", "UTC", True),
         ("coral", "Australia/Sydney", True), ("monsoon", "Asia/Kolkata", True), ("tagus", "Europe/Lisbon", True), (None, "UTC", None)],
        "src string, zone_id string, day_first boolean",
    )
    df = spark.createDataFrame([(i, t, src, "m") for i, (t, src, _) in enumerate(TIMES)], "fact_id long, t string, src string, mask string")
    got = {r.fact_id: r.t_utc for r in instants.utc_instants(df, feeds).collect()}
    for i, (t, _, want) in enumerate(TIMES):
        assert got.get(i) == want, t
    assert rows(instants.utc_instants(df.limit(0), feeds)) == []
    assert len(rows(instants.utc_instants(df.unionByName(df), feeds))) == 2 * len(got)


def test_instants_against_datetime():
    tables = zones.load_tables()
    random.seed(5)
    import pandas as pd

    for key in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Europe/Lisbon"):
        moments = [datetime(2010, 1, 1) + timedelta(seconds=random.randint(0, 500_000_000)) for _ in range(300)]
        texts = pd.Series([m.strftime("%d.%m.%Y %H:%M:%S") for m in moments])
        masks = texts.str.replace(r"\d", "9", regex=True)
        got = instants.convert_batch(texts, masks, pd.Series([key] * 300), pd.Series([True] * 300), tables)
        want = [m.replace(tzinfo=zoneinfo.ZoneInfo(key)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.000000Z") for m in moments]
        assert got.tolist() == want

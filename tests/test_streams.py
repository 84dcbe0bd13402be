import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import corpus, sinks
from tidemark.streaming import streams
from tidemark.streaming.milestones import Milestones

SCHEMA = "event_id string, token string, ts timestamp, trader bigint, side string, quote bigint"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of Parquet files, one for each list of rows."""

    def make(*batches):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        return f"{tmp_path}/in/*"

    return make


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_redelivered_events_pass_once(spark, folder):
    rows = [(f"e{k}", "a", at(k), 1, "buy", 5) for k in range(10)]
    src = corpus.read_event_stream(spark, folder(rows, rows[5:] + [("e10", "a", at(10), 1, "sell", 5)]), SCHEMA, files_per_trigger=1)
    got = run(streams.deduplicated(src), spark, "dedup")
    assert sorted(r.event_id for r in got) == sorted(f"e{k}" for k in range(11))


def test_rolling_flow_equals_batch(spark, folder):
    rows = [(f"e{k}", "ab"[k % 2], at(3 * k), k % 4, "buy" if k % 3 else "sell", k) for k in range(30)]
    src = corpus.read_event_stream(spark, folder(rows), SCHEMA)
    got = run(streams.rolling_flow(src), spark, "flow", "complete")
    want = streams.rolling_flow(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_milestones_fire_without_trades(spark, folder):
    first = [("l1", "dead", at(0), None, "launch", 0), ("l2", "live", at(0), None, "launch", 0), ("t1", "live", at(4), 7, "buy", 1), ("t2", "live", at(5), 8, "sell", 1), ("t3", "live", at(9), 7, "buy", 1)]
    ticks = [[(f"k{k}", "clock", at(60 + k), None, "tick", 0)] for k in range(3)]
    src = corpus.read_event_stream(spark, folder(first, *ticks), SCHEMA, files_per_trigger=1)
    got = run(streams.milestones(src, ages=(5_000, 15_000)), spark, "miles")
    assert sorted(tuple(r) for r in got) == [("dead", 5000, 0, 0, 0), ("dead", 15000, 0, 0, 0), ("live", 5000, 1, 1, 2), ("live", 15000, 2, 1, 2)]


def test_milestones_come_once(spark, folder):
    clock = lambda n, s: (f"k{n}", "clock", at(s), None, "tick", 0)
    batches = [
        [("l1", "a", at(0), None, "launch", 0), ("t1", "a", at(1), 7, "buy", 1), ("o1", "orphan", at(1), 7, "buy", 1)],
        [clock(1, 30)],
        [clock(2, 31), ("t2", "a", at(32), 8, "buy", 1)],  # after the last milestone
        [clock(3, 90)],
        [clock(4, 300)],
        [clock(5, 301), ("t3", "a", at(302), 8, "buy", 1)],  # after the mark has gone
        [clock(6, 400)],
        [clock(7, 500)],
    ]
    src = corpus.read_event_stream(spark, folder(*batches), SCHEMA, files_per_trigger=1)
    got = run(streams.milestones(src, ages=(5_000, 15_000), evict_ms=120_000), spark, "once")
    assert sorted(tuple(r) for r in got) == [("a", 5000, 1, 0, 1), ("a", 15000, 1, 0, 1)]


def test_trades_wait_for_their_launch(spark, folder):
    batches = [[("t1", "a", at(2), 7, "buy", 1), ("k0", "clock", at(2), None, "tick", 0)], [("l1", "a", at(1), None, "launch", 0), ("k1", "clock", at(3), None, "tick", 0)], [("k2", "clock", at(60), None, "tick", 0)], [("k3", "clock", at(61), None, "tick", 0)]]
    src = corpus.read_event_stream(spark, folder(*batches), SCHEMA, files_per_trigger=1)
    got = run(streams.milestones(src, ages=(5_000,), delay="10 seconds"), spark, "waits")
    assert [tuple(r) for r in got] == [("a", 5000, 1, 0, 1)]


class _State:
    """A value or list state in memory that counts its calls."""

    def __init__(self):
        self.calls, self.kept, self.keyed = 0, None, {}

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear", "appendList", "put", "getValue", "updateValue", "removeKey"):
            self.calls += 1
        return object.__getattribute__(self, name)

    exists = lambda self: self.kept is not None
    get = lambda self: self.kept
    getValue = lambda self, k: self.keyed.get(k)
    removeKey = lambda self, k: self.keyed.pop(k, None)

    def update(self, x):
        self.kept = x

    put = update

    def clear(self):
        self.kept, self.keyed = None, {}

    def updateValue(self, k, x):
        self.keyed[k] = x

    def appendList(self, x):
        self.kept = [*(self.kept or []), *x]


class _Handle:
    def __init__(self):
        self.states, self.timers = [], []

    def _new(self, *_):
        self.states.append(_State())
        return self.states[-1]

    getValueState = getListState = getMapState = _new

    def registerTimer(self, t):
        self.timers.append(t)


def _batch(rows):
    """Rows (ms, trader, side) in the columns that the operator gets, and as events."""
    kinds = {"tick": 0, "buy": 1, "sell": 2, "launch": 3}
    return pd.DataFrame([(pd.Timestamp(t, unit="ms"), t, -1 if x is None else x, s, kinds[s]) for t, x, s in rows], columns=["ts", "ms", "trader", "side", "kind"])


def _milestone_calls(traders):
    p, handle = Milestones((5_000, 15_000), 60_000), _Handle()
    p.init(handle)
    now = type("now", (), {"getCurrentWatermarkInMs": lambda self: 30_000, "getExpiryTimeInMs": lambda self: 5_001})()
    list(p.handleInputRows(("a",), iter([_batch([(0, None, "launch")]), _batch([(1_000 * (x % 12), x, "buy") for x in range(traders)])]), now))
    list(p.handleInputRows(("a",), iter([_batch([(9_000, x, "sell") for x in range(traders)])]), now))
    (out,) = p.handleExpiredTimer(("a",), now, now)
    assert out.values.tolist() == [["a", 5_000, sum(x % 12 <= 5 for x in range(traders)), 0, sum(x % 12 <= 5 for x in range(traders)), 5_000], ["a", 15_000, traders, traders, traders, 15_000]]
    return sum(s.calls for s in handle.states)


def test_calls_to_the_state_do_not_grow_with_traders():
    assert _milestone_calls(3_000) == _milestone_calls(300) < 50


def test_many_traders_are_logged_in_pieces(monkeypatch):
    monkeypatch.setattr("tidemark.streaming.milestones.PIECE", 64)
    assert _milestone_calls(1_000) < 50


def test_milestones_one_by_one_and_trades_that_wait_in_pieces(monkeypatch):
    monkeypatch.setattr("tidemark.streaming.milestones.PIECE", 2)
    p, handle, out = Milestones((5_000, 15_000, 30_000), 90_000), _Handle(), []
    p.init(handle)
    at = lambda t: type("now", (), {"getCurrentWatermarkInMs": lambda self: t, "getExpiryTimeInMs": lambda self: t})()
    for rows, t in (
        ([(1_000 + x, x, "buy") for x in range(5)], None),  # before their launch
        ([(1_000, None, "launch"), (12_000, 9, "sell"), (12_000, 0, "sell"), (26_000, 11, "buy")], 6_001),
        ([(2_000, 8, "buy"), (11_000, 11, "buy"), (20_000, 8, "sell")], 16_001),  # the first comes late, for the next milestone
        ([(31_000, 12, "buy"), (31_001, 13, "buy")], 31_001),
    ):
        list(p.handleInputRows(("a",), iter([_batch(rows)]), at(0)))
        out += [x for b in (p.handleExpiredTimer(("a",), at(t), at(t)) if t else ()) for x in b.values.tolist()]
    assert [x[1:5] for x in out] == [[5_000, 5, 0, 5], [15_000, 7, 2, 8], [30_000, 9, 3, 9]]


def test_long_trader_ids_stay_apart(spark, folder):
    first = [("l1", "a", at(0), None, "launch", 0), ("t1", "a", at(1), 2**60, "buy", 1), ("t2", "a", at(2), 2**60 + 1, "sell", 1)]
    ticks = [[(f"k{k}", "clock", at(60 + k), None, "tick", 0)] for k in range(2)]
    src = corpus.read_event_stream(spark, folder(first, *ticks), SCHEMA, files_per_trigger=1)
    assert [tuple(r) for r in run(streams.milestones(src, ages=(5_000,)), spark, "long")] == [("a", 5000, 1, 1, 2)]


def test_late_events_are_routed_and_stored_once(spark, folder, tmp_path):
    src = folder([("e1", "a", at(100), 1, "buy", 5)], [("e2", "a", at(10), 1, "buy", 5), ("e3", "a", at(101), 1, "buy", 5), ("e1", "a", at(100), 1, "buy", 5)])
    touched = []
    for k in range(2):  # the second start finds nothing new
        s = corpus.read_event_stream(spark, src, SCHEMA, files_per_trigger=1)
        streams.route_late(s, f"{tmp_path}/store", f"{tmp_path}/late", f"{tmp_path}/check", 30_000, lambda _, t: touched.extend(r.token for r in t.collect())).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/store").collect()) == ["e1", "e2", "e3"]
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/late").collect()] == ["e2"]
    assert touched == ["a"]


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "a", at(1), 1, "buy", 5)] * 100, SCHEMA)
    for _ in range(2):
        sinks.append_events(rows, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 1


def test_shards_resume(spark, folder, tmp_path):
    src = folder([("e1", "a", at(1), 1, "buy", 5)], [("e2", "b", at(1), 1, "buy", 7)])
    for _ in range(2):
        s = corpus.read_event_stream(spark, src, SCHEMA).withColumn("shard", F.input_file_name())
        streams.shard_statistics(s, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert sorted((r.n_rows, r.volume) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 5), (1, 7)]


def test_milestones_restart_from_the_checkpoint(spark, folder, tmp_path):
    clock = lambda n, s: (f"k{n}", "clock", at(s), None, "tick", 0)
    first = [[("t0", "late", at(1), 5, "buy", 1), ("l1", "a", at(0), None, "launch", 0), ("t1", "a", at(3), 7, "buy", 1)], [("t2", "a", at(4), 8, "sell", 1), clock(1, 4)]]
    more = [[("l2", "late", at(2), None, "launch", 0), ("t3", "a", at(9), 7, "sell", 1), ("t4", "a", at(8), 9, "buy", 1)], [clock(2, 200)], [clock(3, 201)], [clock(4, 202)]]
    out = f"{tmp_path}/out"

    def once():
        src = corpus.read_event_stream(spark, f"{tmp_path}/in/*", SCHEMA, files_per_trigger=1)
        q = streams.milestones(src, ages=(5_000, 15_000), evict_ms=60_000, delay="4 seconds", due=True)
        q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    folder(*first)
    assert once() == []
    for k, rows in enumerate(more):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/more{k}")
    due = int(T0.timestamp()) * 1000
    want = [("a", 5000, 1, 1, 2, due + 5000), ("a", 15000, 2, 2, 3, due + 15000), ("late", 5000, 1, 0, 1, due + 7000), ("late", 15000, 1, 0, 1, due + 17000)]
    assert once() == want
    assert once() == want


def test_milestones_of_random_trades_as_batch(spark, folder):
    rng = random.Random(6)
    batches, launched = [], {t: rng.randint(0, 20) for t in "abcdef"}
    for lo in range(0, 100, 5):
        rows = [(f"l{t}", t, at(s), None, "launch", 0) for t, s in launched.items() if lo <= s < lo + 5]
        rows += [(f"t{lo}-{k}", rng.choice("abcdefgh"), at(lo + 5 * rng.random()), rng.randint(1, 6), rng.choice(["buy", "sell"]), 1) for k in range(40)]
        batches.append(rows)
    batches += [[(f"k{k}", "clock", at(300 + k), None, "tick", 0)] for k in range(3)]
    src = corpus.read_event_stream(spark, folder(*batches), SCHEMA, files_per_trigger=1)
    ages = (5_000, 15_000, 30_000, 60_000)
    got = run(streams.milestones(src, ages=ages, evict_ms=100_000, delay="6 seconds"), spark, "random")
    want = []
    for token, s in launched.items():
        for age in ages:
            upto = [r for b in batches for r in b if r[1] == token and r[4] in ("buy", "sell") and (r[2] - at(s)).total_seconds() * 1000 // 1 <= age]
            want.append((token, age, sum(r[4] == "buy" for r in upto), sum(r[4] == "sell" for r in upto), len({r[3] for r in upto})))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_batch_reads_what_it_can_repeat(spark, tmp_path):
    store = f"{tmp_path}/store"
    batch = spark.createDataFrame([(f"e{k}", "a", at(k), 1, "buy", 5) for k in range(40)], SCHEMA)
    sinks.append_events(batch, store)
    files = sinks.stored_like(batch, store).inputFiles()
    for day in range(1, 6):
        sinks.append_events(spark.createDataFrame([(f"d{day}-{k}", "a", at(86_400 * day + k), 1, "buy", 5) for k in range(40)], SCHEMA), store)
    assert sorted(sinks.stored_like(batch, store).inputFiles()) == sorted(files)
    sinks.append_events(batch.union(spark.createDataFrame([("new", "a", at(50), 1, "buy", 5), ("no day", "a", None, 1, "buy", 5)], SCHEMA)), store)
    sinks.append_events(spark.createDataFrame([("no day", "a", None, 1, "buy", 5)], SCHEMA), store)
    got = sinks.read_store(spark, store, batch.schema)
    assert got.count() == 242 and got.select("event_id").distinct().count() == 242
    assert len(sinks.stored_like(batch.where("event_id = 'e3'"), store).inputFiles()) == 1


MARKETS = "chain string, token string, pool string, curve string, seen bigint"


def current(spark, path, where="true"):
    return sorted(tuple(r) for r in spark.read.parquet(path).where(where).select("chain", "token", "pool", "curve", "seen").collect())


def test_upsert_keeps_old_values(spark, tmp_path):
    path = f"{tmp_path}/markets"
    first = spark.createDataFrame([("c", "a", "p1", None, 1), ("c", "b", None, "k2", 1), ("c", "a", None, "k1", 2)], MARKETS)
    second = spark.createDataFrame([("c", "a", None, "k9", 5), ("c", "b", "p2", None, 0), ("c", None, "p3", None, 1)], MARKETS)
    sinks.upsert(first, path, ["chain", "token"], "seen")
    assert current(spark, path) == [("c", "a", "p1", "k1", 2), ("c", "b", None, "k2", 1)]
    want = [("c", "a", "p1", "k9", 5), ("c", "b", "p2", "k2", 1)]
    for _ in range(2):  # a repeated batch changes nothing
        sinks.upsert(second, path, ["chain", "token"], "seen")
        assert current(spark, path, "token is not null") == want
        assert current(spark, path, "token is null") == [("c", None, "p3", None, 1)]


def test_upsert_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/current"
    rows = lambda k: spark.createDataFrame([("c", str(x), f"p{k}", None, k) for x in range(50)], MARKETS)
    sinks.upsert(rows(1), path, ["chain", "token"], "seen")
    with monkeypatch.context() as m:
        m.setattr(sinks, "_publish", lambda *_: None)
        sinks.upsert(rows(2), path, ["chain", "token"], "seen")  # ends when the stage is complete
    assert {r.pool for r in spark.read.parquet(path).collect()} == {"p1"}
    sinks.upsert(spark.createDataFrame([("c", "0", None, "k", 3)], MARKETS), path, ["chain", "token"], "seen")
    got = current(spark, path)
    assert len(got) == 50 and {x[2] for x in got} == {"p2"} and got[0][3] == "k"


def test_late_events_give_new_versions_once(spark, folder, tmp_path):
    """A driver that dies between its writes and the commit of the batch starts again with the same rows in the end."""
    src = folder(
        [("e1", "a", at(100), 1, "buy", 5), ("f1", "b", at(100), 1, "buy", 5)],
        [("e2", "a", at(10), 1, "buy", 7)],
        [("e3", "a", at(20), 1, "buy", 9), ("f2", "b", at(101), 2, "buy", 1)],
    )
    schema = spark.createDataFrame([], SCHEMA).schema
    out, store, late = (f"{tmp_path}/{x}" for x in ("snaps", "store", "late"))

    def snapshots(events):
        return events.groupBy("token").agg(F.lit(60_000).cast("bigint").alias("age"), F.count("*").alias("n"), F.sum("quote").alias("quote"))

    into = streams.rebuild_into(out, store, schema, snapshots)
    failures = {1, 2}

    def dying(tokens, number):
        into(tokens, number)
        if number in failures:
            failures.discard(number)
            raise RuntimeError("the driver dies here")

    for _ in range(4):
        s = corpus.read_event_stream(spark, src, SCHEMA, files_per_trigger=1)
        q = streams.route_late(s, store, late, f"{tmp_path}/check", 30_000, versions=dying)
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert "dies here" in str(e)
    assert not failures
    rows = sinks.committed(spark, out, spark.createDataFrame([], "token string, age bigint, n bigint, quote bigint, version int, batch int").schema).collect()
    assert sorted((r.token, r.n, r.quote, r.version) for r in rows) == [("a", 2, 12, 1), ("a", 3, 21, 2)]
    kind = spark.createDataFrame([], "token string, age bigint, n bigint, quote bigint, version int").schema
    assert [(r.token, r.n, r.version) for r in streams.current_version(spark, out, kind).collect()] == [("a", 3, 2)]
    assert sorted(r.event_id for r in sinks.read_store(spark, store, schema).collect()) == ["e1", "e2", "e3", "f1", "f2"]
    assert sorted(r.event_id for r in spark.read.parquet(late).collect()) == ["e2", "e3"]


def test_half_written_batches_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    for k in range(3):
        sinks.write_batch(rows, f"{tmp_path}/out", k)
    sinks.write_batch(rows, f"{tmp_path}/out", 2)
    (tmp_path / "out/batch=1/_SUCCESS").unlink()
    schema = rows.withColumn("batch", F.lit(0)).schema
    assert sorted(tuple(r) for r in sinks.committed(spark, f"{tmp_path}/out", schema).collect()) == [(1, 0), (1, 2)]
    assert sinks.committed(spark, f"{tmp_path}/none", schema).count() == 0


def test_counters_of_running_streams(spark, folder):
    rows = [[(f"e{k}-{j}", "a", at(k), 1, "buy", 5) for j in range(3)] for k in range(2)]
    src = corpus.read_event_stream(spark, folder([("l", "a", at(0), None, "launch", 0)], *rows, [("k", "c", at(50), None, "tick", 0)], [("k2", "c", at(51), None, "tick", 0)]), SCHEMA, files_per_trigger=1)
    counters = streams.Counters()
    spark.streams.addListener(counters)
    try:
        run(streams.observed(src, "raw"), spark, "counted")
        run(streams.observed_milestones(streams.milestones(src, ages=(5_000, 15_000), due=True)), spark, "lateness")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if counters.totals.get("milestones", {}).get("milestones") == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals["raw"]["events"] == 9 and counters.totals["raw"]["late"] == 9
    assert counters.totals["raw"]["max_lag_ms"] > 1_000_000
    assert counters.totals["milestones"]["milestones"] == counters.totals["milestones"]["missed"] == 2


def test_health(spark):
    rows = spark.createDataFrame([("s", 1, at(0), at(1)), ("s", 4, at(0), at(5))], "stream string, seq bigint, ts timestamp, seen timestamp")
    h = streams.health(rows, "stream", "seq")
    assert h["counts"].first().late == 1
    assert tuple(h["gaps"].first()) == ("s", 2, 3)


def test_records_and_logs(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/x.jsonl").write_text('{"event_type":"trade","mint":"m","trader":"w","side":"buy","sol_amount":"12","token_amount":"5","amount_quality":"ONCHAIN_INTEGER","timestamp":"2024-01-01T00:00:01Z","dataset_id":"d","source_file":"f","source_row":1,"order_seq":0}\n\n{"event_type":"launch","mint":"m","creator":"c","timestamp":"2024-01-01T00:00:00Z"}\n')
    found = corpus.canonical(corpus.read_records(spark, str(tmp_path / "r")))
    assert [(r.token, r.quote, r.base) for r in found["trades"].collect()] == [("m", 12, 5)]
    assert [r.creator for r in found["launches"].collect()] == ["c"]
    (tmp_path / "l").mkdir()
    word = lambda n: f"{n % (1 << 256):064x}"
    log = '{{"chain":"base","chain_id":8453,"address":"0xAB","topics":["{t}","0x{a}","0x{b}"],"data":"0x{d}","block_number":1,"transaction_index":0,"log_index":{k},"transaction_hash":"0xFF","removed":false}}'
    docs = [("0xbuy", word(10**20) + word(7)), ("0xswap", word(-5) + word(-(10**30))), ("0xother", word(1) + word(1)), ("0xbuy", "f" * 64 + word(3))]
    for k, (t, d) in enumerate(docs):
        (tmp_path / f"l/{k}.json").write_text(log.format(t=t, a=word(1), b=word(2), d=d, k=k))
    (tmp_path / "l/again.json").write_text(log.format(t="0xbuy", a=word(1), b=word(2), d=docs[0][1], k=0))
    logs = corpus.read_logs(spark, str(tmp_path / "l"))
    assert logs.count() == 4
    rows = {r.log_index: r for r in corpus.decode_logs(logs, {"0xbuy": "CURVE_BUY", "0xswap": "SWAP"}).collect()}
    assert (rows[0].quote, rows[0].base, rows[0].side, rows[0].token) == (10**20, 7, "buy", "0x" + "0" * 39 + "1")
    assert (rows[1].quote, rows[1].base, rows[1].side) == (5, 10**30, "buy")
    assert rows[3].quote is None and rows[3].quote_word == "f" * 64 and set(rows) == {0, 1, 3}


def test_logs_by_their_own_layouts(spark):
    word = lambda n: f"{n % (1 << 256):064x}"
    by_kind = {v: k for k, v in corpus.TOPICS.items()}
    big = (1 << 255) + 12345
    rows = []

    def log(kind, topics, words, removed=False):
        rows.append(("base", 8453, " 0XAB ", [by_kind.get(kind, kind).upper().replace("0X", "0x"), *("0x" + word(t) for t in topics)], "0x" + "".join(map(word, words)), len(rows), 0, 0, None, "0xFF", None, 5, removed))

    log("TOKEN_LAUNCHED", [1, 2, 3], [4, 5, big])
    log("TOKEN_CREATED", [1, 2], [9, 0, 0, 0, 0, 0, -200, 7, big, 4, 5, 6, 10, 0])
    log("LAUNCH_SWEPT", [1], [big, 3])
    log("POOL_GRADUATED", [1], [77, 10**30, 2])
    log("CURVE_BUY", [3, 4], [10**40, 5, 1, 2])
    log("CURVE_SELL", [3, 4], [5, 10**40, 1, 2], True)
    log("SNIPE_TAX_CHARGED", [3], [42])
    log("CURVE_COMPLETED", [], [3, 8, 9])
    log("SWAP", [big, 3], [-(10**35), 10**36, 79228162514264337593543950336, 5, -887272, 3000])
    log("INITIALIZE", [big, 1, 2], [3000, -60, 7, 79228162514264337593543950336, -5])
    log("0x" + "1" * 64, [], [1])
    log("CURVE_BUY", [3], [10])
    got = {r.block_number: r for r in corpus.typed_logs(spark.createDataFrame(rows, corpus.LOG)).collect()}
    a = lambda n: "0x" + f"{n:040x}"
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11}
    assert [got[k].kind for k in range(10)] == ["TOKEN_LAUNCHED", "TOKEN_CREATED", "LAUNCH_SWEPT", "POOL_GRADUATED", "CURVE_BUY", "CURVE_SELL", "SNIPE_TAX_CHARGED", "CURVE_COMPLETED", "SWAP", "INITIALIZE"]
    assert [got[k].family for k in range(10)] == ["launch", "launch", "lifecycle", "lifecycle", "trade", "trade", "lifecycle", "lifecycle", "trade", "lifecycle"]
    assert (got[0].token, got[0].curve, got[0].trader, got[0].quote_asset, got[0].metadata) == (a(1), a(2), a(3), a(4), {"launchConfigId": "5", "graduationThreshold": str(big)})
    assert (got[1].token, got[1].trader, got[1].pool, got[1].metadata["startingTick"], got[1].metadata["tokenAdmin"], got[1].metadata["extensionsSupply"]) == (a(1), a(9), "0x" + word(big), "-200", a(2), "10")
    assert (got[2].token, got[2].metadata) == (a(1), {"quoteOut": str(big), "tokenOut": "3"})
    assert got[3].metadata == {"positionId": "77", "tokenAmount": str(10**30), "pairTokenAmount": "2"}
    assert (got[4].trader, got[4].side, got[4].quote, got[4].base, got[4].curve, got[4].removed, got[4].metadata) == (a(3), "buy", str(10**40), "5", "0xab", False, {"recipient": a(4), "fee": "1", "tax": "2"})
    assert (got[5].side, got[5].quote, got[5].base, got[5].removed) == ("sell", str(10**40), "5", True)
    assert (got[6].trader, got[6].curve, got[6].metadata) == (a(3), "0xab", {"amount": "42"})
    assert (got[7].trader, got[7].metadata) == (a(3), {"quoteOut": "8", "tokenOut": "9"})
    assert (got[8].pool, got[8].side, got[8].quote, got[8].base) == ("0x" + word(big), "sell", str(10**35), str(10**36))
    assert got[8].metadata == {"amount0": str(-(10**35)), "amount1": str(10**36), "sqrtPriceX96": str(1 << 96), "liquidity": "5", "tick": "-887272", "fee": "3000"}
    assert (got[9].metadata["tick"], got[9].metadata["currency1"], got[9].metadata["sqrtPriceX96"]) == ("-5", a(2), str(1 << 96))
    assert (got[11].quote, got[11].base, got[11].metadata["tax"]) == ("10", None, None)

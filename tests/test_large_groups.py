"""Steps that must grow no faster than their input, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hexwords
from tidemark.operators import outcomes

MARKS = "token string, a bigint, id bigint, side string, px bigint, mine boolean"


def random_marks(rng, tokens, n, span, low=0):
    return [(f"t{k}", rng.randrange(span), k * n + i, rng.choice(("buy", "sell")), rng.randint(low, 400), rng.choice((True, False, None))) for k in range(tokens) for i in range(n)]


def test_flow_as_brute_force(spark):
    rows = random_marks(random.Random(3), 3, 60, 70)
    q = outcomes.with_flow(spark.createDataFrame(rows, MARKS), 15)
    assert "RangeFrame, -" not in q._jdf.queryExecution().optimizedPlan().toString()  # no frame is scanned for each row
    got = {(r.token, r.id): (r.buyer_accel, r.seller_accel, r.net_flow, r.creator_sells) for r in q.collect()}
    assert len(got) == len(rows)
    for token, a, i, *_ in rows:
        own = [r for r in rows if r[0] == token]
        within = lambda x, y, side: sum(x < r[1] <= y and r[3] == side for r in own)  # noqa: B023, E731
        accel = [within(a - 15, a, s) - within(a - 30, a - 15, s) for s in ("buy", "sell")]
        net = sum(r[4] if r[3] == "buy" else -r[4] for r in own if a - 15 < r[1] <= a)
        assert got[token, i] == (*accel, net, sum(bool(r[5]) and r[3] == "sell" and r[1:3] <= (a, i) for r in own)), (token, a, i)


def folded(marks, entry, levels, share, trail, cap):
    """Stage, rest, proceeds and reason of a staged exit, mark by mark."""
    at, price, sold = entry
    stage, left, top, got, reason, seen = 0, 10_000, 0, 0, None, False
    for a, _, px, ba, sa, net, sells in sorted(marks):
        if a <= at:
            continue
        seen = True
        r = None if price == 0 else int((px - price) * 10_000 / price)
        top = max(top, r or 0)
        if left == 0:
            continue
        step = r is not None and stage < len(levels) and r >= levels[stage]
        leave = None
        if cap is not None:
            leave = "MOMENTUM_DECAY" if ba <= -2 or (sa >= 2 and net < 0) else "CREATOR_SELL" if sells > sold else "TIME_STOP" if a - at >= cap else None
        if leave or (not step and stage >= len(levels) and r is not None and top > 0 and top - r >= trail):
            got, left, reason = got + left * px // 10_000, 0, leave or "TRAIL"
        elif step:
            part = left * share // 10_000
            stage, left, got = stage + 1, left - part, got + part * px // 10_000
    return (stage, left, got, reason) if seen else None


@pytest.mark.parametrize("cap", [None, 40])
@pytest.mark.parametrize("share", [2_000, 10_000])
def test_staged_exits_as_a_fold(spark, cap, share):
    rng = random.Random(5)
    rows = [(f"t{k}", rng.randrange(60), i, rng.randint(0, 400), rng.choice((0, 0, 0, 0, 0, 0, -2)), rng.randint(0, 1), rng.randint(-5, 5), i // 20) for k in range(60) for i in range(25)]
    entries = [(f"t{k}", rng.randrange(20), rng.choice((0, 100, 100, 150)), 1) for k in range(61)]
    m = spark.createDataFrame(rows, "token string, a bigint, id bigint, px bigint, buyer_accel bigint, seller_accel bigint, net_flow bigint, creator_sells bigint")
    e = spark.createDataFrame(entries, "token string, entry_age bigint, entry_px bigint, entry_creator_sells bigint")
    q = outcomes.scaled_out(e, m, share=share, cap_ms=cap)
    assert "collect_list" not in q._jdf.queryExecution().optimizedPlan().toString()  # no token is one value
    got = {r.token: (r.stage, r.remaining_bps, r.realized, r.reason) for r in q.collect()}
    want = {t: folded([r[1:] for r in rows if r[0] == t], x, (4_000, 8_000, 20_000), share, 3_000, cap) for t, *x in entries}
    assert got == {t: x for t, x in want.items() if x}
    assert cap or share < 10_000 or {x[3] for x in got.values()} == {None}


def test_short_words_need_no_limbs(spark):
    numbers = [0, 1, 999, (1 << 60) - 1, 1 << 60, (1 << 64) + 5, (1 << 255) - 1, 1 << 255, (1 << 256) - (1 << 60), (1 << 256) - (1 << 60) - 1, (1 << 256) - 1]
    words = [format(n, "064x") for n in numbers]
    w = F.col("w")
    rows = spark.createDataFrame([(x,) for x in [*words, "0" * 63 + "g", None]], "w string").select("w", hexwords.unsigned_text(w).alias("u"), hexwords.signed_text(w).alias("s"), hexwords.signed_text(w, absolute=True).alias("z"))
    got = {r.w: (r.u, r.s, r.z) for r in rows.collect()}
    for n, word in zip(numbers, words):
        signed = n - (1 << 256) if n >> 255 else n
        assert got[word] == (str(n), str(signed), str(abs(signed)))
    assert got["0" * 63 + "g"] == (None,) * 3 and got[None] == (None,) * 3


def test_bootstrap_weights_as_numbers(spark):
    rows = [("g", i, float(i * i % 37)) for i in range(60)]
    q = outcomes.bootstrap(spark.createDataFrame(rows, "g string, id bigint, value double"), "g", 40)
    assert "conv(" not in q._jdf.queryExecution().optimizedPlan().toString()
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += p
        cuts.append(total)
        p /= k
    means = []
    for rep in range(1, 41):
        w = [sum((int(hashlib.md5(f"{i}|{rep}".encode()).hexdigest()[:7], 16) + 0.5) / (1 << 28) > c for c in cuts) for _, i, _ in rows]
        means.append(sum(x * r[2] for x, r in zip(w, rows)) / sum(w))
    means.sort()
    b = q.first()
    assert (b.p5, b.p95) == pytest.approx((means[39 * 5 // 100], means[39 * 95 // 100]))

"""The full simulation against a literal state machine over random trades."""

import random

from quantloom.operators import simulate as T

PIP = 0.01


def literal(t, bars, subs, slip=0.5, comm=0.7):
    """One trade, sub-bar by sub-bar; stop moves take effect on the next sub-bar."""
    d, b0 = t["direction"], t["bar_idx"]
    own = [s for s in subs if s["bar_idx"] == b0]
    spread0 = (own[0]["spread"] or 0.0) if own else 0.0
    fill = t["entry_price"] + slip * PIP + spread0 if d > 0 else t["entry_price"] - slip * PIP
    sl, pending, be, trail, partial = t["sl"], t["sl"], False, False, None
    be_tried = False
    flags = (False, False)
    end, last = None, None
    for bar in bars:
        b = bar["bar_idx"]
        if b <= b0:
            continue
        held = b - b0
        if t["max_bars"] and held >= t["max_bars"]:
            end = ("max_bars", b, bar["close"] - d * slip * PIP, bar["spread"])
            break
        n = int(t["stale_bars"] or 0)
        if n and held >= n:
            wide = max(x["high"] - x["low"] for x in bars if b - n < x["bar_idx"] <= b)
            if wide < t["stale_thr"] * t["atr"]:
                end = ("stale", b, bar["close"] - d * slip * PIP, bar["spread"])
                break
        for s in (s for s in subs if s["bar_idx"] == b):
            sl, (be_on, trail_on) = pending, flags
            best, worst = (s["high"], s["low"]) if d > 0 else (s["low"], s["high"])
            gain = d * (best - fill) / PIP
            if t["partial_trigger"] is not None and partial is None and gain >= t["partial_trigger"]:
                partial = (s["close"] - d * slip * PIP, s["spread"])
            if d * worst <= d * sl:
                end = ("trailing" if trail_on else "breakeven" if be_on else "sl", b, sl - d * slip * PIP, s["spread"])
                break
            if d * best >= d * t["tp"]:
                end = ("tp", b, t["tp"], s["spread"])
                break
            if t["be_trigger"] is not None and not be_tried and gain >= t["be_trigger"]:
                be_tried = True
                price = fill + d * t["be_offset"] * PIP
                if d * price > d * pending:
                    pending, be = price, True
            if t["trail_activate"] is not None and gain >= t["trail_activate"]:
                trail = True
            if trail:
                price = best - d * t["trail_pips"] * PIP
                if d * price > d * pending:
                    pending = price
            flags = (be, trail)
            last = s
        if end:
            break
    if end is None:
        if last is None:
            bar = next(x for x in bars if x["bar_idx"] == b0)
            end = ("none", b0, bar["close"] - d * slip * PIP, bar["spread"])
        else:
            end = ("none", last["bar_idx"], last["close"] - d * slip * PIP, last["spread"])
    cost = lambda sp: (sp or 0.0) if d < 0 else 0.0
    share = t["partial_pct"] / 100 if partial else 0.0
    pnl = (1 - share) * (d * (end[2] - fill) - cost(end[3])) / PIP - comm
    if partial:
        pnl += share * (d * (partial[0] - fill) - cost(partial[1])) / PIP
    return end[0], end[1], pnl, bool(partial)


def test_full_simulation_matches_a_state_machine(spark):
    rng = random.Random(3)
    price, bars, subs, seq = 100.0, [], [], 0
    for b in range(120):
        ticks = []
        for _ in range(rng.randint(1, 5)):
            c = price + rng.gauss(0, 0.4)
            h, l = max(price, c) + rng.random() * 0.2, min(price, c) - rng.random() * 0.2
            seq += 1
            ticks.append({"pair": "x", "bar_idx": b, "sub_seq": seq, "high": h, "low": l, "close": c, "spread": rng.choice([0.01, 0.02, None])})
            price = c
        subs += ticks
        bars.append({"pair": "x", "bar_idx": b, "open": ticks[0]["close"], "high": max(t["high"] for t in ticks), "low": min(t["low"] for t in ticks), "close": price, "spread": rng.choice([0.01, 0.03])})
    trades = []
    maybe = lambda *v: rng.choice([None, *v])
    for i in range(400):
        b = rng.randrange(120)
        d = rng.choice([1, -1])
        e = bars[b]["close"]
        trades.append({"trade_id": i, "pair": "x", "bar_idx": b, "direction": d, "entry_price": e, "sl": e - d * rng.uniform(0.3, 2.5), "tp": e + d * rng.uniform(0.5, 4), "max_bars": rng.choice([0.0, 5.0, 20.0]), "stale_bars": rng.choice([0.0, 4.0]), "stale_thr": 1.5, "atr": 0.8, "be_trigger": maybe(30.0, 80.0), "be_offset": rng.choice([0.0, 10.0]), "trail_activate": maybe(0.0, 50.0), "trail_pips": 60.0, "partial_trigger": maybe(40.0), "partial_pct": 50.0})
    bar_df = spark.createDataFrame([tuple(x.values()) for x in bars], "pair string, bar_idx long, open double, high double, low double, close double, spread double")
    sub_df = spark.createDataFrame([tuple(x.values()) for x in subs], "pair string, bar_idx long, sub_seq long, high double, low double, close double, spread double")
    kinds = {"trade_id": "long", "pair": "string", "bar_idx": "long", "direction": "int"}
    schema = ", ".join(f"{k} {kinds.get(k, 'double')}" for k in trades[0])
    got = {r["trade_id"]: r for r in T.simulate_full(spark.createDataFrame([tuple(x.values()) for x in trades], schema), bar_df, sub_df, PIP).collect()}
    reasons = set()
    for t in trades:
        reason, at, pnl, partial = literal(t, bars, subs)
        r = got[t["trade_id"]]
        reasons.add(reason)
        assert (r["reason"], r["exit_bar"], r["partial"]) == (reason, at, partial), (t, r, reason, at, partial)
        assert abs(r["pnl"] - pnl) < 1e-6, (t, r, pnl)
    assert reasons == {"sl", "tp", "trailing", "breakeven", "max_bars", "stale", "none"}


def test_full_simulation_goes_on_after_the_horizon(spark):
    """A calm series: one target after bar 64, one stop after 256 bars, one stale exit behind a stop, one trade without an end."""
    bars, subs = [], []
    for b in range(400):
        top, low = 100.1 + 2 * (b == 150), 99.9 - 2 * (b == 300)
        bars.append(("x", b, 100.0, top, low, 100.0 + b / 10_000, 0.01))
        subs.append(("x", b, b, top, low, 100.0 + b / 10_000, 0.01))
    base = {"pair": "x", "bar_idx": 10, "direction": 1, "entry_price": 100.0, "sl": 90.0, "tp": 110.0, "max_bars": 0.0, "stale_bars": 0.0, "stale_thr": 0.0, "atr": 1.0, "be_trigger": None, "be_offset": 0.0, "trail_activate": None, "trail_pips": None, "partial_trigger": None, "partial_pct": 50.0}
    trades = [{"trade_id": i, **base, **more} for i, more in enumerate(({"tp": 101.5}, {"sl": 98.5}, {"sl": 98.5, "max_bars": 350.0}, {"max_bars": 100.0}, {"partial_trigger": 100.0}, {"direction": -1, "sl": 101.5, "tp": 97.0}, {"bar_idx": 399}))]
    kinds = {"trade_id": "long", "pair": "string", "bar_idx": "long", "direction": "int"}
    schema = ", ".join(f"{k} {kinds.get(k, 'double')}" for k in trades[0])
    bar_df = spark.createDataFrame(bars, "pair string, bar_idx long, open double, high double, low double, close double, spread double")
    sub_df = spark.createDataFrame(subs, "pair string, bar_idx long, sub_seq long, high double, low double, close double, spread double")
    got = {r["trade_id"]: r for r in T.simulate_full(spark.createDataFrame([tuple(t.values()) for t in trades], schema), bar_df, sub_df, PIP, horizon=64).collect()}
    rows = [dict(zip(("pair", "bar_idx", "open", "high", "low", "close", "spread"), b, strict=True)) for b in bars]
    low = [dict(zip(("pair", "bar_idx", "sub_seq", "high", "low", "close", "spread"), x, strict=True)) for x in subs]
    for t in trades:
        reason, at, pnl, partial = literal(t, rows, low)
        r = got[t["trade_id"]]
        assert (r["reason"], r["exit_bar"], r["partial"]) == (reason, at, partial) and abs(r["pnl"] - pnl) < 1e-6, (t, r, reason, at)
    assert [got[i]["exit_bar"] for i in range(7)] == [150, 300, 300, 110, 399, 150, 399]

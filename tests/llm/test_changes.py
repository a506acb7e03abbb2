"""The change applier against a plain loop over its rules."""

import random
import zlib
from datetime import datetime, timedelta

from netloom.llm import changes


def by_rules(rows, batches, patience=5):
    """(change_id, client, status, batch, missed, city, balance, current) by the rules as stated, a row at a time."""
    out, clients = [], {}
    days = {}
    for r in rows:
        days[r["batch"]] = max(days.get(r["batch"], r["day"]), r["day"])
    for c in {r["client_id"] for r in rows}:
        clients[c] = {"next": 1, "held": {}, "city": None, "balance": None, "final": None}

    def step(c, s, batch, missed):
        while s["next"] in s["held"]:
            r = s["held"].pop(s["next"])
            s["next"] += 1
            if r["op"] == "D":
                s["city"] = s["balance"] = None
            for k in ("city", "balance"):
                if r["op"] == "I" or (r["op"] == "U" and r[k] is not None):
                    s[k] = r[k]
            s["final"] = [r["change_id"], c, "applied", batch, missed, s["city"], s["balance"], False]
            s["deleted"] = r["op"] == "D"
            out.append(s["final"])
            missed = 0

    for batch in range(1, batches + 2):
        latest = max((d for b, d in days.items() if b < batch), default=None)
        for c, s in clients.items():
            while s["held"] and (batch > batches or (latest is not None and min(r["day"] for r in s["held"].values()) + patience <= latest)):
                least = min(s["held"])
                missed, s["next"] = least - s["next"], least
                step(c, s, batch, missed)
        mine = [r for r in rows if r["batch"] == batch]
        for r in sorted(mine, key=lambda r: (r["day"], r["change_id"])):
            s = clients[r["client_id"]]
            if r["n"] in s["held"] or r["n"] < s["next"]:
                out.append([r["change_id"], r["client_id"], "rejected", batch, 0, None, None, False])
                continue
            s["held"][r["n"]] = r
            step(r["client_id"], s, batch, 0)
    for s in clients.values():
        if s["final"] and not s["deleted"]:
            s["final"][-1] = True
    return sorted(map(tuple, out), key=repr)


def made(seed, batches):
    """Clients with gaps, repeats and late rows; one with many, one null, one whose first row never comes, an empty batch."""
    rng, rows, change = random.Random(seed), [], 0
    for client, many in ((1, 400), (2, 60), (3, 5), (None, 8), (4, 30)):
        for n in range(1, many + 1):
            if (client == 4 and n == 1) or rng.random() < 0.1:
                continue
            for _ in range(rng.choice((1, 1, 1, 2, 3))):
                day = 100 + n * 30 * batches // 400 // 3 + rng.choice((0, 0, 2, 7))
                rows.append({"client_id": client, "n": n, "day": day, "change_id": change, "op": rng.choice("IUUUD"), "city": rng.choice(("a", "b", None)), "balance": rng.choice((1.5, -2.25, None))})
                change += 1
    for r in rows:
        batch = min(batches, 1 + (r["day"] - 100) * batches // 35)
        r["batch"] = 3 if batch == 2 else max(1, batch)
    rng.shuffle(rows)
    return rows


def test_applied_equals_a_plain_loop(spark):
    rows = made(3, 4)
    schema = "client_id long, n long, day int, change_id long, op string, city string, balance double, batch int"
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema).selectExpr("*", "'x' AS status", "1L AS missed", "2 AS lane")
    done = changes.with_last(changes.applied(table, 4, ("city", "balance")))
    got = [tuple(r) for r in done.select("change_id", "client_id", "status", "batch", "missed", "city", "balance", changes.current(done)).collect()]
    want = by_rules(rows, 4)
    assert sorted(got, key=repr) == want
    # the client of 400 held more than its own state takes, jumps passed numbers, and nothing came in the second batch
    assert {r[3] for r in want if r[2] == "rejected"} == {1, 3, 4} and any(r[4] > 0 and r[3] == 2 for r in want) and any(r[3] == 5 for r in want)
    held = [r for r in rows if r["client_id"] == 1 and r["batch"] == 1]
    assert len(held) > changes.FEW


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice((1, 1, 1, 2, None)), rng.choice((None, 5, 7, 7, 100, 3000, 10**12, *range(200, 400)))) for _ in range(2000)]
    got = changes.numbered(spark.createDataFrame(rows, "client_id long, seq long").repartition(7)).collect()
    assert len(got) == len(rows)
    for c in (1, 2, None):
        ranks = sorted({s for k, s in rows if k == c}, key=lambda s: (s is not None, s))
        assert {(r["seq"], r["n"]) for r in got if r["client_id"] == c} == {(s, k + 1) for k, s in enumerate(ranks)}


def test_shop_changes(spark):
    at = datetime(2024, 1, 1)
    rows = [(k, k % 3, k // 6, "U", at + timedelta(days=k % 150) if k % 7 else None, "c", 1.0) for k in range(300)]
    schema = "change_id long, client_id long, seq long, op string, valid_at timestamp, city string, balance double"
    got = changes.shop_changes(spark.createDataFrame(rows + rows[:40], schema)).collect()
    h = {k: zlib.crc32(str(k).encode()) for k in range(300)}
    assert {r["change_id"] for r in got} == {k for k in range(300) if k % 7 and h[k] % 11} and len(got) == len({r["change_id"] for r in got})
    for r in got:
        day = 19_723 + r["change_id"] % 150 + 2 * (h[r["change_id"]] % 4)
        assert (r["day"], r["batch"], r["n"]) == (day, min(8, 1 + (day - 19_723) * 8 // 160), r["seq"] + 1)


def test_nothing_to_apply(spark):
    table = spark.createDataFrame([], "client_id long, n long, day int, change_id long, op string, batch int")
    done = changes.applied(table, 1, ())
    assert done.count() == 0 and done.columns == ["client_id", "n", "day", "change_id", "op", "status", "batch", "missed"]
    odd = spark.createDataFrame([(1, float("nan")), (2, 1e300), (3, None), (4, -0.005)], "n long, balance double")
    cents = changes.digest(odd.selectExpr("1L AS client_id", "n", "n AS change_id", "'I' AS op", "'applied' AS status", "1 AS batch", "0L AS missed", "'c' AS city", "balance"))
    assert {r["change_id"]: (r["cents"], r["current"]) for r in cents.collect()} == {1: (None, False), 2: (None, False), 3: (None, False), 4: (0, True)}

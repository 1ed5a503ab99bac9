"""Balances of sums far beyond 38 digits, against whole numbers of any size."""

import random
from collections import Counter
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tests.helpers import at, event, events
from wayline.plans.holdings import ZERO_ADDRESS, balances, holders

KINDS = "chain string, entity_id string, counterparty string, token_out string, amount_out_raw string, timestamp timestamp"


def transfers(spark, rows):
    return spark.createDataFrame(rows, KINDS).withColumn("amount_out", F.lit(None).cast("decimal(38,0)"))


def test_equals_whole_numbers(spark):
    r = random.Random(4)
    wallets = ["hot", "hot", *[f"w{i}" for i in range(12)], ZERO_ADDRESS, None]
    amount = lambda: r.choice([0, 1, 10**9 - 1, 10**9, r.getrandbits(60), r.getrandbits(256), 2**256 - 1])
    rows = [(r.choice(["a", "b"]), r.choice(wallets), r.choice(wallets), r.choice(["t", "u", None]), str(amount()), at("2024-01-01") + timedelta(hours=i)) for i in range(600)]
    rows += [("a", "w1", "w2", "t", odd, at("2024-01-01")) for odd in (None, "", "-5", "1e3", "x", "9" * 82)]
    for as_of in (None, at("2024-01-10")):
        want, n = Counter(), Counter()
        for chain, giver, taker, token, digits, ts in rows:
            if token is None or not (digits or "").isdecimal() or len(digits) > 81 or (as_of and ts > as_of):
                continue
            for wallet, sign in ((giver, -1), (taker, 1)):
                if wallet not in (None, ZERO_ADDRESS):
                    want[chain, token, wallet] += sign * int(digits)
                    n[chain, token, wallet] += 1
        got = balances(transfers(spark, rows), as_of).collect()
        assert {(x.chain, x.token_address, x.entity_id): (x.balance, x.n_transfers) for x in got} == {k: (str(want[k]), n[k]) for k in n}
        assert len(got) == len(n) and any(abs(v) > 10**77 for v in want.values()) and any(v < 0 for v in want.values())
        for least in (1, 10**60):
            held = {x.entity_id: int(x.balance) for x in holders(transfers(spark, rows), "t", "a", least, as_of).collect()}
            assert held == {w: v for (c, t, w), v in want.items() if (c, t) == ("a", "t") and v >= least}


def test_decoded_events_without_exact_digits(spark):
    df = events(spark, event("1", "transfer_out", "2024-01-01", entity="0xa", counterparty="0xb", token_out="t", amount_out=Decimal(7)))
    assert {(x.entity_id, x.balance) for x in balances(df).collect()} == {("0xa", "-7"), ("0xb", "7")}
    assert balances(df.limit(0)).collect() == [] and holders(df, "no such").collect() == []

import json
import random
from datetime import datetime
from decimal import Decimal
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from wayline.functions import hexwords as H
from wayline.operators import decode as D
from wayline.sources import chain_logs as C

T0 = datetime(2024, 1, 1, 12)
A, B, X = "0x" + "aa" * 20, "0x" + "bb" * 20, "0x" + "cc" * 20
LOG_SCHEMA = (
    "source_system string, chain string, block_number bigint, block_time timestamp, tx_hash string, "
    "log_index bigint, address string, topic0 string, topic1 string, topic2 string, topic3 string, data string"
)


def w(value):
    if isinstance(value, str):
        return value[2:].rjust(64, "0")
    return f"{value % 2**256:064x}"


def log(topics, data, index=0, address=X, tx="0xdead"):
    topics = list(topics) + [None] * (4 - len(topics))
    return ("evm_base", "base", 100, T0, tx, index, address, *topics, data)


def t(value):
    return "0x" + w(value)


def decode(spark, logs, registry=None):
    rows = D.decode_logs(spark.createDataFrame(logs, LOG_SCHEMA), registry).collect()
    return {r.log_index: r for r in rows}


def test_wide_integers_are_exact(spark):
    rng = random.Random(5)
    values = [0, 1, 2**255, 2**256 - 1, 10**18, 10**38 - 1, 10**38, 2**124, 2**128]
    values += [rng.getrandbits(rng.randint(1, 256)) for _ in range(500)]
    df = spark.createDataFrame([(f"{v:064x}",) for v in values], "h string")
    df = df.withColumn("neg", H.is_negative("h").cast("int"))
    df = df.withColumn("m", F.when(F.col("neg") == 1, H.inverted("h")).otherwise(F.col("h")))
    out = H.with_digits(df, {"u": "h", "mag": "m"}, {"mag": "neg"})
    for row in out.collect():
        value = int(row.h, 16)
        signed = value - 2**256 if value >= 2**255 else value
        assert row.u == str(value)
        assert row.mag == str(abs(signed))


def test_token_events(spark):
    big = 2**256 - 1
    out = decode(
        spark,
        [
            log([D.TRANSFER, t(A), t(B)], "0x" + w(1000), 0),
            log([D.APPROVAL, t(A), t(B)], "0x" + w(big), 1),
            log([D.WETH_DEPOSIT, t(A)], "0x" + w(7), 2),
            log([D.WETH_WITHDRAWAL, t(A)], "0x" + w(8), 3),
            log([D.TRANSFER, t(A), t(B), t(5)], "0x", 4),
            log([D.TRANSFER, t(A)], "0x" + w(1), 5),
            log(["0x99", t(A)], "0x" + w(1), 6),
            log([D.TRANSFER, t(A), t(B)], "", 7),
            log([D.TRANSFER, t(A), t(B)], "0x3e8", 8),
        ],
    )
    assert sorted(out) == [0, 1, 2, 3, 4, 7, 8]
    r = out[0]
    assert (r.event_type, r.entity_id, r.counterparty, r.token_out, r.amount_out) == (
        "transfer_out", A, B, X, Decimal(1000),
    )
    assert (r.entity_type, r.event_category, r.protocol, r.venue) == ("wallet", "transaction", "erc20", X)
    assert r.source_event_id == "0xdead:0"
    assert r.event_id == sha256(b"evm_base:0xdead:0").hexdigest()
    assert json.loads(r.extra) == {"receiver": B}
    assert r.timestamp == r.block_time == T0
    assert out[1].amount_out is None and out[1].amount_out_raw == str(big)
    assert json.loads(out[1].extra) == {"spender": B}
    assert (out[2].token_out, json.loads(out[2].extra)) == ("ETH", {"action": "wrap_eth"})
    assert (out[3].token_out, json.loads(out[3].extra)) == (X, {"action": "unwrap_eth"})
    assert out[4].amount_out == 0 and out[7].amount_out == 0
    assert out[8].amount_out == 1000


def test_swaps(spark):
    v3 = [0, 0, 0]
    out = decode(
        spark,
        [
            log([D.UNISWAP_V2_SWAP, t(A), t(B)], "0x" + w(0) + w(5) + w(9) + w(0), 0),
            log([D.UNISWAP_V3_SWAP, t(A), t(B)], "0x" + "".join(map(w, [-(10**30), 20, *v3])), 1),
            log([D.UNISWAP_V3_SWAP, t(A), t(B)], "0x" + "".join(map(w, [30, -40, *v3])), 2),
            log([D.UNISWAP_V3_SWAP, t(A), t(B)], "0x" + "".join(map(w, [0, -40, *v3])), 3),
            log([D.UNISWAP_V2_SWAP, t(A), t(B)], "0x" + w(1), 4),
            log([D.UNISWAP_V3_SWAP, t(A), t(B)], "0x", 5),
        ],
    )
    assert sorted(out) == [0, 1, 2, 3]
    assert (out[0].amount_in, out[0].amount_out) == (5, 9)
    assert json.loads(out[0].extra) == {
        "amount0_in": "0", "amount1_in": "5", "amount0_out": "9", "amount1_out": "0", "to": B,
    }
    assert (out[1].amount_in, out[1].amount_out) == (20, 10**30)
    assert json.loads(out[1].extra) == {"amount0": str(-(10**30)), "amount1": "20", "recipient": B}
    assert (out[2].amount_in, out[2].amount_out) == (30, 40)
    assert (out[3].amount_in, out[3].amount_out) == (-40, 40)
    assert out[0].token_in is None and out[0].token_out is None


def test_bridges(spark):
    receiver = "ab" * 20
    stargate = "0x" + w(101) + w(96) + w(5000) + w(20) + receiver.ljust(64, "0")
    short = "0x" + w(102) + w(96) + w(5) + w(4) + "abcdef01".ljust(64, "0")
    across = "0x" + "".join(map(w, [A, B, 10**20, 3 * 10**20, 1, 2, 3, A, B, 0, 0]))
    out = decode(
        spark,
        [
            log([D.STARGATE_SEND], stargate, 0),
            log([D.STARGATE_SEND], short, 1),
            log([D.ACROSS_DEPOSITED, t(8453), t(123), t(A)], across, 2),
            log([D.BASE_ETH_BRIDGE, t(A), t(B)], "0x" + w(77) + w(64) + w(0), 3),
            log([D.BASE_ERC20_BRIDGE, t(X), t(B), t(A)], "0x" + w(B) + w(88) + w(96) + w(0), 4),
            log([D.ACROSS_DEPOSITED, t(8453), t(123)], across, 5),
        ],
    )
    assert sorted(out) == [0, 1, 2, 3, 4]
    assert all(r.event_type == "bridge_out" for r in out.values())
    assert (out[0].entity_id, out[0].amount_out, out[0].link_key) == (X, 5000, "101")
    assert json.loads(out[0].extra) == {"dst_chain_id": 101, "to": "0x" + receiver, "qty": "5000"}
    assert json.loads(out[1].extra)["to"] == ""
    r = out[2]
    assert (r.entity_id, r.token_in, r.token_out) == (A, A, B)
    assert (r.amount_in, r.amount_out, r.link_key) == (10**20, 3 * 10**20, "123")
    assert json.loads(r.extra) == {
        "destination_chain_id": 8453, "deposit_id": 123, "input_token": A, "output_token": B,
    }
    assert (out[3].token_out, out[3].amount_out, out[3].link_key) == ("ETH", 77, "0xdead:eth")
    assert (out[4].token_out, out[4].counterparty, out[4].amount_out) == (X, B, 88)
    assert json.loads(out[4].extra) == {"remote_token": B, "receiver": B, "amount": "88"}


def test_registry_patterns(spark):
    import dataclasses

    transfer = D.DEFAULT_DECODERS[0]
    special = dataclasses.replace(transfer, name="Special", protocol="special")
    prefixed = dataclasses.replace(transfer, name="Prefixed", protocol="prefixed")
    registry = D.DecoderRegistry()
    registry.register(D.RegistryEntry(special, address_pattern=X.upper().replace("0X", "0x")))
    registry.register(D.RegistryEntry(prefixed, address_pattern="0xDD*"))
    rows = [
        log([D.TRANSFER, t(A), t(B)], "0x01", 0, address=X),
        log([D.TRANSFER, t(A), t(B)], "0x01", 1, address="0xdd01"),
        log([D.TRANSFER, t(A), t(B)], "0x01", 2, address="0xee"),
        log([D.TRANSFER, t(A), t(B)], "0x01", 3, address=None),
    ]
    df = spark.createDataFrame(rows, LOG_SCHEMA).select("log_index", registry.lookup().alias("d"))
    assert {r.log_index: r.d for r in df.collect()} == {0: "Special", 1: "Prefixed", 2: None, 3: "Special"}
    single = D.DecoderRegistry([D.RegistryEntry(special, address_pattern="0x01")])
    assert decode(spark, rows[2:3], single)[2].protocol == "special"
    registry.register(D.RegistryEntry(special, address_pattern="0xdd*"))
    assert len(registry.decoders()) == 3 and registry.topic0s() == [D.TRANSFER]
    assert registry.frame(spark).count() == 3


def test_unknown_topics(spark):
    rows = [log(["0x" + "99" * 32], "0x", 0), log([D.TRANSFER, t(A), t(B)], "0x", 1), log([None], "0x", 2)]
    out = D.unknown_topics(spark.createDataFrame(rows, LOG_SCHEMA)).collect()
    assert [(r.topic0, r.n_logs) for r in out] == [("0x" + "99" * 32, 1)]


def test_landed_log_is_normalised_and_decoded(spark):
    landed = spark.createDataFrame(
        [
            (
                "evm_base", "0x4200000000000000000000000000000000000006", "0x2afec00", "0x0",
                "0xdeadbeef", "0x" + w(1000), [D.TRANSFER, t(A), t(B)], T0,
            ),
            ("evm_base", X, "0x10", "0x1", "0x1", None, [], None),
        ],
        C.LANDED_LOG_SCHEMA,
    )
    logs = C.normalise_logs(landed)
    rows = {r.block_number: r for r in logs.collect()}
    assert rows[45083648].chain == "base" and rows[16].data == "0x" and rows[16].topic0 is None
    event = D.decode_logs(logs).collect()
    assert len(event) == 1 and event[0].amount_out == 1000 and event[0].block_number == 45083648
    blocks = spark.createDataFrame([("base", 16, hex(1704110400))], "chain string, number bigint, timestamp_hex string")
    timed = {r.block_number: r.block_time for r in C.attach_block_times(logs, blocks).collect()}
    assert timed == {45083648: T0, 16: datetime(2024, 1, 1, 12)}
    bounds = C.block_bounds(blocks, datetime(2024, 1, 1), datetime(2024, 1, 2)).collect()
    assert [(r.chain, r.start_block, r.end_block) for r in bounds] == [("base", 16, 16)]


def test_internal_swaps(spark):
    rows = [
        ("e1", "swap", "0x1", "base", ""), ("e2", "swap", "0x1", "base", "1inch"), ("e3", "swap", "0x2", "base", None),
        ("e4", "transfer_out", "0x1", "base", None), ("e5", "pageview", None, None, None),
    ]
    df = spark.createDataFrame(rows, "event_id string, event_type string, tx_hash string, chain string, aggregator string")
    out = {r.event_id: r.event_type for r in D.mark_internal_swaps(df).collect()}
    assert out == {"e1": "swap_internal", "e2": "swap", "e3": "swap", "e4": "transfer_out", "e5": "pageview"}


@pytest.mark.parametrize("n", [1])
def test_decode_has_no_shuffle_and_no_python(spark, n):
    df = spark.createDataFrame([log([D.TRANSFER, t(A), t(B)], "0x01")], LOG_SCHEMA)
    plan = D.decode_logs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_signature_is_read_once_and_digits_take_one_projection(spark):
    # the optimizer puts the whole of topic0 wherever it is named, and long generated methods run uncompiled
    assert D.default_registry().lookup_sql().count("topic0") == 1
    words = spark.createDataFrame([("f" * 64,)], "w string")
    plan = H.with_digits(words, {"a": "w", "b": "w"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1

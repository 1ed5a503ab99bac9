"""Raw chain logs to canonical events, in one projection.

A decoder is a name, an event signature and Column expressions over the topics
and data words of a log.  Decoding picks the decoder of each row with CASE
expressions, so it adds no shuffle and no Python worker, and it runs unchanged
on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions import hexwords as H
from wayline.schema import CANONICAL_EVENTS, EXACT_AMOUNTS, conform
from wayline.session import constant_frame

SLOTS = 4  # numbers a decoder may read from one log


@dataclass(frozen=True)
class Decoder:
    """One event signature, as SQL over the columns of a log.

    Besides the log columns the SQL may use ``t1``-``t3`` (topics without gaps),
    ``ta1``-``ta3`` (the addresses in them), ``w0``-``w4`` (data words, null when
    cut short), ``wa0``, ``wa1`` (the addresses in them), ``tw1``, ``tw2`` (topics
    as words) and ``whole`` (all data as one word; empty data
    is zero, more than 32 significant bytes are null).

    ``numbers`` names up to four words to read as integers, ``signed_slots``
    those that are int256.  ``fields`` and ``extra`` may then use ``n0``-``n3``,
    the exact digits of the magnitudes, ``s0``-``s3``, the digits with their
    sign, and ``neg0``-``neg3``, 1 when negative.  ``numeric_extra`` are the
    properties written as JSON numbers.

    A row with fewer topics or whole data words than given is not an event.
    """

    name: str
    topic0: str
    protocol: str
    event_type: str
    signature: str
    min_topics: int
    numbers: list[str]
    fields: dict[str, str]
    extra: dict[str, str]
    min_words: int = 0
    signed_slots: tuple[int, ...] = ()
    numeric_extra: tuple[str, ...] = ()


# Event signatures and their topic hashes.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
APPROVAL = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
WETH_DEPOSIT = "0xe1fffcc4923d04b559f4d29a8bfc6cda04eb5b0d3c460751c2402c5c5cc9109c"
WETH_WITHDRAWAL = "0x7fcf532c15f0a6db0bd6d0e038bea71d30d808c7d98cb3bf7268a95bf5081b65"
UNISWAP_V2_SWAP = "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822"
UNISWAP_V3_SWAP = "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"
STARGATE_SEND = "0x664e26797cde1146ddfcb9a5d3f4de61179f9c11b2698599bb09e686f442172b"
ACROSS_DEPOSITED = "0xa123dc29aebf7d0c3322c8eeb5b999e859f39937950ed31056532713d0de396f"
BASE_ETH_BRIDGE = "0x2849b43074093a05396b6f2a937dee8565b15a48a7b3d4bffb732a5017380af5"
BASE_ERC20_BRIDGE = "0x7ff126db8024424bbfd9826e8ab82ff59136289ea440b04b39a0df1b03b9cabf"

# the receiver of a Stargate transfer: word 1 is the offset of a length word and
# the bytes after it; their last 20 are an address when there are that many
_OFFSET = "CAST(conv(right(w1, 15), 16, 10) AS INT)"
_LENGTH = f"CAST(conv(right(substr(data, {_OFFSET} * 2 + 3, 64), 15), 16, 10) AS INT)"
_STARGATE_RECEIVER = (
    f"if({_LENGTH} >= 20, concat('0x', lower(substr(data, ({_OFFSET} + 32 + {_LENGTH}) * 2 - 37, 40))), '')"
)

_TOKEN_FIELDS = {"entity_id": "ta1", "token_out": "address", "amount_out": "n0"}

DEFAULT_DECODERS = [
    Decoder(
        "Transfer", TRANSFER, "erc20", "transfer_out",
        "Transfer(address indexed from, address indexed to, uint256 value)",
        min_topics=3,
        numbers=["whole"],
        fields=_TOKEN_FIELDS | {"counterparty": "ta2"},
        extra={"receiver": "ta2"},
    ),
    Decoder(
        "Approval", APPROVAL, "erc20", "approval",
        "Approval(address,address,uint256)",
        min_topics=3,
        numbers=["whole"],
        fields=_TOKEN_FIELDS | {"counterparty": "ta2"},
        extra={"spender": "ta2"},
    ),
    Decoder(
        "WETHDeposit", WETH_DEPOSIT, "weth", "deposit",
        "Deposit(address,uint256)",
        min_topics=2,
        numbers=["whole"],
        fields=_TOKEN_FIELDS | {"token_out": "'ETH'"},
        extra={"action": "'wrap_eth'"},
    ),
    Decoder(
        "WETHWithdrawal", WETH_WITHDRAWAL, "weth", "withdrawal",
        "Withdrawal(address,uint256)",
        min_topics=2,
        numbers=["whole"],
        fields=_TOKEN_FIELDS,
        extra={"action": "'unwrap_eth'"},
    ),
    Decoder(
        "UniswapV2Swap", UNISWAP_V2_SWAP, "uniswap_v2", "swap",
        "Swap(address indexed sender, uint amount0In, uint amount1In, uint amount0Out, "
        "uint amount1Out, address indexed to)",
        min_topics=3,
        min_words=4,
        numbers=["w0", "w1", "w2", "w3"],
        fields={
            "entity_id": "ta1",
            "amount_in": "if(n0 != '0', n0, n1)",
            "amount_out": "if(n2 != '0', n2, n3)",
        },
        extra={"amount0_in": "n0", "amount1_in": "n1", "amount0_out": "n2", "amount1_out": "n3", "to": "ta2"},
    ),
    Decoder(
        "UniswapV3Swap", UNISWAP_V3_SWAP, "uniswap_v3", "swap",
        "Swap(address indexed sender, address indexed recipient, int256 amount0, "
        "int256 amount1, uint160 sqrtPriceX96, uint128 liquidity, int24 tick)",
        min_topics=3,
        min_words=5,
        numbers=["w0", "w1"],
        fields={
            "entity_id": "ta1",
            "amount_in": "if(neg0 = 0 AND n0 != '0', n0, s1)",
            "amount_out": "if(neg0 = 1, n0, n1)",
        },
        extra={"amount0": "s0", "amount1": "s1", "recipient": "ta2"},
        signed_slots=(0, 1),
    ),
    Decoder(
        "StargateSendToChain", STARGATE_SEND, "stargate", "bridge_out",
        "SendToChain(uint16 dstChainId, bytes to, uint256 qty)",
        min_topics=0,
        min_words=4,
        numbers=["w0", "w2"],
        fields={
            "entity_id": "address",
            "amount_out": "n1",
            "link_key": "n0",
            "link_key_type": "'stargate_dst_chain'",
        },
        extra={"dst_chain_id": "n0", "to": _STARGATE_RECEIVER, "qty": "n1"},
        numeric_extra=("dst_chain_id",),
    ),
    Decoder(
        "AcrossV3FundsDeposited", ACROSS_DEPOSITED, "across", "bridge_out",
        "V3FundsDeposited(address inputToken, address outputToken, uint256 inputAmount, "
        "uint256 outputAmount, uint256 indexed destinationChainId, uint32 indexed depositId, "
        "uint32 quoteTimestamp, uint32 fillDeadline, uint32 exclusivityDeadline, "
        "address indexed depositor, address recipient, address exclusiveRelayer, bytes message)",
        min_topics=4,
        min_words=4,
        numbers=["w2", "w3", "tw1", "tw2"],
        fields={
            "entity_id": "ta3",
            "token_in": "wa0",
            "token_out": "wa1",
            "amount_in": "n0",
            "amount_out": "n1",
            "link_key": "n3",
            "link_key_type": "'across_deposit_id'",
        },
        extra={"destination_chain_id": "n2", "deposit_id": "n3", "input_token": "wa0", "output_token": "wa1"},
        numeric_extra=("destination_chain_id", "deposit_id"),
    ),
    Decoder(
        "BaseETHBridgeInitiated", BASE_ETH_BRIDGE, "base_native", "bridge_out",
        "ETHBridgeInitiated(address indexed from, address indexed to, uint256 amount, bytes extraData)",
        min_topics=3,
        min_words=1,
        numbers=["w0"],
        fields={
            "entity_id": "ta1",
            "token_out": "'ETH'",
            "amount_out": "n0",
            "counterparty": "ta2",
            "link_key": "concat(tx_hash, ':eth')",
            "link_key_type": "'base_bridge_tx'",
        },
        extra={"receiver": "ta2", "amount": "n0"},
    ),
    Decoder(
        "BaseERC20BridgeInitiated", BASE_ERC20_BRIDGE, "base_native", "bridge_out",
        "ERC20BridgeInitiated(address indexed localToken, address indexed remoteToken, "
        "address indexed from, address to, uint256 amount, bytes extraData)",
        min_topics=4,
        min_words=2,
        numbers=["w1"],
        fields={
            "entity_id": "ta3",
            "token_out": "ta1",
            "amount_out": "n0",
            "counterparty": "wa0",
            "link_key": "concat(tx_hash, ':erc20')",
            "link_key_type": "'base_bridge_tx'",
        },
        extra={"remote_token": "ta2", "receiver": "wa0", "amount": "n0"},
    ),
]


@dataclass(frozen=True)
class RegistryEntry:
    """Where a decoder applies: a signature and an address pattern."""

    decoder: Decoder
    address_pattern: str = "*"
    version: str = "1"
    chain: str = "*"


@dataclass
class DecoderRegistry:
    """Entries in registration order; the order breaks ties between patterns."""

    entries: list[RegistryEntry] = field(default_factory=list)

    def register(self, entry: RegistryEntry) -> None:
        self.entries.append(entry)

    def topic0s(self) -> list[str]:
        return list(dict.fromkeys(e.decoder.topic0 for e in self.entries))

    def decoders(self) -> list[Decoder]:
        """One decoder per distinct (signature, pattern)."""
        found = {}
        for entry in self.entries:
            found.setdefault((entry.decoder.topic0, entry.address_pattern), entry.decoder)
        return list(found.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a table."""
        names = ("protocol", "version", "chain", "topic0", "address_pattern", "event_name", "event_signature")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        schema = schema.add("priority", T.IntegerType())
        rows = [
            {
                "protocol": e.decoder.protocol,
                "version": e.version,
                "chain": e.chain,
                "topic0": e.decoder.topic0,
                "address_pattern": e.address_pattern,
                "event_name": e.decoder.name,
                "event_signature": e.decoder.signature,
                "priority": i,
            }
            for i, e in enumerate(self.entries)
        ]
        return constant_frame(spark, rows, schema)

    def lookup_sql(self) -> str:
        """SQL for the name of the decoder of a log, null when none applies.

        A signature with a single entry, or a log without an address, takes the
        first entry whatever its pattern; otherwise the first matching pattern.
        """
        by_topic: dict[str, list[RegistryEntry]] = {}
        for entry in self.entries:
            by_topic.setdefault(entry.decoder.topic0, []).append(entry)
        single, branches = {}, []
        for signature, entries in by_topic.items():
            name = repr(entries[0].decoder.name)
            if len(entries) > 1:
                cases = [f"WHEN {_matches(e.address_pattern)} THEN {e.decoder.name!r}" for e in entries]
                branches.append(f"WHEN {signature!r} THEN CASE WHEN address IS NULL THEN {name} {' '.join(cases)} END")
            else:
                single[signature] = name
        found = _constant(single, "topic0") if single else "CAST(NULL AS STRING)"
        return f"CASE topic0 {' '.join(branches)} ELSE {found} END" if branches else found

    def lookup(self) -> Column:
        """``lookup_sql`` as a Column over ``topic0`` and ``address``."""
        return F.expr(self.lookup_sql())


def _constant(values: dict[str, str], key: str) -> str:
    """SQL for the constant of a key, null for other keys.

    A CASE would repeat the key in each branch, with all that the optimizer puts in its place.
    """
    return f"try_element_at(map({', '.join(f'{name!r}, {value}' for name, value in values.items())}), {key})"


def _matches(pattern: str) -> str:
    """SQL test of ``address`` against ``*``, an address, or a prefix and ``*``."""
    if pattern == "*":
        return "true"
    exact = f"lower(address) = {pattern.lower()!r}"
    if pattern.endswith("*"):
        return f"({exact} OR startswith(lower(address), {pattern[:-1].lower()!r}))"
    return exact


def default_registry() -> DecoderRegistry:
    return DecoderRegistry([RegistryEntry(decoder) for decoder in DEFAULT_DECODERS])


# topics without gaps: an empty topic counts as absent
_TOPICS = {
    "t1": "coalesce(nullif(topic1, ''), nullif(topic2, ''), nullif(topic3, ''))",
    "t2": "CASE WHEN topic1 != '' THEN coalesce(nullif(topic2, ''), nullif(topic3, '')) "
    "WHEN topic2 != '' THEN nullif(topic3, '') END",
    "t3": "if(topic1 != '' AND topic2 != '', nullif(topic3, ''), NULL)",
}
_TOPIC_COUNT = "(1 + if(topic1 != '', 1, 0) + if(topic2 != '', 1, 0) + if(topic3 != '', 1, 0))"
_WORDS = {
    **{f"ta{i}": f"concat('0x', lower(right(t{i}, 40)))" for i in (1, 2, 3)},
    **{f"w{i}": f"if(length(data) >= {66 + 64 * i}, substr(data, {3 + 64 * i}, 64), NULL)" for i in range(5)},
    **{f"wa{i}": f"concat('0x', lower(substr(data, {27 + 64 * i}, 40)))" for i in (0, 1)},
    **{f"tw{i}": f"lpad(substr(t{i}, 3), 64, '0')" for i in (1, 2)},
    "__digits": "ltrim('0', substr(coalesce(data, ''), 3))",
}


def _by_decoder(values: dict[str, str], otherwise: str = "NULL") -> str:
    """SQL CASE over the decoder name; equal values share a branch."""
    by_value: dict[str, list[str]] = {}
    for name, value in values.items():
        by_value.setdefault(value, []).append(name)
    branches = [
        f"WHEN __decoder IN ({', '.join(repr(n) for n in names)}) THEN {value}" for value, names in by_value.items()
    ]
    return f"CASE {' '.join(branches)} ELSE {otherwise} END" if branches else otherwise


def _add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{sql} AS `{name}`" for name, sql in columns.items()])


def decode_logs(
    logs: DataFrame, registry: DecoderRegistry | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Canonical events of the logs whose signature the registry knows.

    The result has the canonical columns plus the exact amounts as digits, and
    any columns of ``logs`` named in ``keep``.
    """
    registry = registry or default_registry()
    decoders = {d.name: d for d in registry.decoders()}
    slots = range(SLOTS)
    # all filters are tests of log columns, which keeps them small where the
    # optimizer pushes them to the scan
    topics = ", ".join(map(repr, registry.topic0s())) or "NULL"
    rows = _add(logs.where(f"topic0 IN ({topics})"), {"__decoder": registry.lookup_sql()}).where("__decoder IS NOT NULL")
    if decoders:
        least_topics = {n: str(d.min_topics) for n, d in decoders.items()}
        least_chars = {n: str(64 * d.min_words + 2 if d.min_words else 0) for n, d in decoders.items()}
        rows = rows.where(
            f"{_TOPIC_COUNT} >= {_constant(least_topics, '__decoder')} "
            f"AND length(coalesce(data, '')) >= {_constant(least_chars, '__decoder')}"
        )
    rows = _add(rows, _TOPICS)
    rows = _add(rows, _WORDS)
    rows = _add(rows, {"whole": "if(length(__digits) <= 64, lpad(__digits, 64, '0'), NULL)"})

    words = {
        f"__w{i}": _by_decoder({n: d.numbers[i] for n, d in decoders.items() if i < len(d.numbers)})
        for i in slots
    }
    rows = _add(rows, words)
    signs = {
        f"neg{i}": _by_decoder(
            {n: f"if(lower(left(__w{i}, 1)) >= '8', 1, 0)" for n, d in decoders.items() if i in d.signed_slots}, "0"
        )
        for i in slots
    }
    rows = _add(rows, signs)
    inverted = "translate(lower(__w{i}), '0123456789abcdef', 'fedcba9876543210')"
    rows = _add(rows, {f"__m{i}": f"if(neg{i} = 1, {inverted.format(i=i)}, CAST(__w{i} AS STRING))" for i in slots})
    rows = H.with_digits(rows, {f"n{i}": f"__m{i}" for i in slots}, {f"n{i}": f"neg{i}" for i in slots})
    rows = _add(rows, {f"s{i}": f"if(neg{i} = 1, concat('-', n{i}), n{i})" for i in slots})

    def field_of(column: str) -> str:
        return _by_decoder({n: d.fields[column] for n, d in decoders.items() if column in d.fields})

    # null properties are left out of the JSON, so one struct serves all decoders
    properties = dict.fromkeys(p for d in decoders.values() for p in d.extra)
    numeric = {p for d in decoders.values() for p in d.numeric_extra}
    extra = []
    for name in properties:
        value = _by_decoder({n: d.extra[name] for n, d in decoders.items() if name in d.extra})
        kind = "DECIMAL(38, 0)" if name in numeric else "STRING"
        extra.append(f"'{name}', try_cast({value} AS {kind})")
    columns = {
        name: field_of(name)
        for name in ("entity_id", "token_in", "token_out", "counterparty", "link_key", "link_key_type")
    }
    columns |= {f"{name}_raw": field_of(name) for name in ("amount_in", "amount_out")}
    columns["event_type"] = _by_decoder({n: repr(d.event_type) for n, d in decoders.items()})
    columns["protocol"] = _by_decoder({n: repr(d.protocol) for n, d in decoders.items()})
    columns |= {
        "entity_type": "'wallet'",
        "event_category": "'transaction'",
        "timestamp": "block_time",
        "source_event_id": "concat_ws(':', tx_hash, CAST(log_index AS STRING))",
        "venue": "nullif(address, '')",
        "extra": f"to_json(named_struct({', '.join(extra)}))",
    }
    carried = ["source_system", "chain", "block_number", "block_time", "tx_hash", "log_index", *(keep or [])]
    events = rows.selectExpr(*carried, *[f"CAST({sql} AS STRING) AS `{n}`" if n != "timestamp" else f"{sql} AS `{n}`" for n, sql in columns.items()])
    events = _add(
        events,
        {
            "event_id": "sha2(concat_ws(':', source_system, source_event_id), 256)",
            **{n: f"try_cast({n}_raw AS DECIMAL(38, 0))" for n in ("amount_in", "amount_out")},
        },
    )
    return conform(events, CANONICAL_EVENTS, keep=[*EXACT_AMOUNTS, *(keep or [])])


def unknown_topics(logs: DataFrame, registry: DecoderRegistry | None = None) -> DataFrame:
    """How many logs carry a signature no registry entry covers, per signature."""
    registry = registry or default_registry()
    return (
        logs.where((F.col("topic0") != "") & registry.lookup().isNull())
        .groupBy("topic0")
        .agg(F.count(F.lit(1)).alias("n_logs"))
    )


def mark_internal_swaps(events: DataFrame) -> DataFrame:
    """Turn a plain ``swap`` of a transaction that has an aggregator event into ``swap_internal``.

    Only swaps look the transaction up; all other rows keep a key of their own.
    """
    routed = (
        events.where((F.col("aggregator") != "") & F.col("tx_hash").isNotNull())
        .select(F.col("chain").alias("__chain"), F.col("tx_hash").alias("__tx"))
        .distinct()
    )
    plain_swap = (F.col("event_type") == "swap") & (F.coalesce("aggregator", F.lit("")) == "")
    own = F.concat(F.lit("\u0000"), F.coalesce("event_id", F.lit("")))
    key = F.when(plain_swap, F.col("tx_hash")).otherwise(own)
    joined = events.withColumn("__key", F.coalesce(key, own)).join(
        routed, (F.col("__key") == F.col("__tx")) & (F.col("chain").eqNullSafe(F.col("__chain"))), "left"
    )
    return joined.withColumn(
        "event_type",
        F.when(F.col("__tx").isNotNull(), F.lit("swap_internal")).otherwise(F.col("event_type")),
    ).drop("__key", "__chain", "__tx")

"""Identity graph over customers, suppliers, nations and regions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wayline.operators import identity as G
from wayline.operators import resolvers as R
from workload.registry import query
from workload.standins import load

EDGES_SQL = """
edges AS (
  SELECT 'customer' AS ft, CAST(c_custkey AS VARCHAR) AS fi, 'nation' AS tt, CAST(c_nationkey AS VARCHAR) AS ti, 0.9::DOUBLE AS conf, 0 AS ord FROM customer
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment, CASE WHEN c_acctbal > 0 THEN 0.6 ELSE 0.4 END, 1 FROM customer
  UNION ALL SELECT 'segment', c_mktsegment, 'wallet', 'w' || min(c_nationkey), 0.95, 0 FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR), 0.9, 0 FROM supplier
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR), 0.8, 0 FROM nation
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'nation', CAST((n_nationkey + 1) % 25 AS VARCHAR), 0.75, 1 FROM nation
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'wallet', 'w' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 0.7 ELSE 0.2 END, 2 FROM nation
  UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 'customer', CAST(r_regionkey AS VARCHAR), 0.9, 0 FROM region
)"""


def edges(spark, sf):
    def edge(df, ft, fi, tt, ti, conf, ord):
        return df.select(
            F.lit(ft).alias("from_entity_type"), fi.cast("string").alias("from_entity"),
            F.lit(tt).alias("to_entity_type"), ti.cast("string").alias("to_entity"),
            F.lit("linked").alias("relationship_type"), F.lit("table").alias("source"),
            (F.lit(conf) if isinstance(conf, float) else conf).alias("confidence_score"), F.lit(ord).alias("edge_ord"),
        )

    c, s = load(spark, sf, "customer"), load(spark, sf, "supplier")
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    key = F.col("n_nationkey")
    wallet = F.concat(F.lit("w"), key)
    segments = c.groupBy("c_mktsegment").agg(F.concat(F.lit("w"), F.min("c_nationkey")).alias("w"))
    strength = F.when(F.col("c_acctbal") > 0, 0.6).otherwise(0.4)
    frames = [
        edge(c, "customer", F.col("c_custkey"), "nation", F.col("c_nationkey"), 0.9, 0),
        edge(c, "customer", F.col("c_custkey"), "segment", F.col("c_mktsegment"), strength, 1),
        edge(segments, "segment", F.col("c_mktsegment"), "wallet", F.col("w"), 0.95, 0),
        edge(s, "supplier", F.col("s_suppkey"), "nation", F.col("s_nationkey"), 0.9, 0),
        edge(n, "nation", key, "region", F.col("n_regionkey"), 0.8, 0),
        edge(n, "nation", key, "nation", (key + 1) % 25, 0.75, 1),
        edge(n, "nation", key, "wallet", wallet, F.when(key % 2 == 0, 0.7).otherwise(0.2), 2),
        edge(r, "region", F.col("r_regionkey"), "customer", F.col("r_regionkey"), 0.9, 0),
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def customers(spark, sf):
    return load(spark, sf, "customer").select(
        F.lit("customer").alias("entity_type"), F.col("c_custkey").cast("string").alias("entity_id")
    )


def bfs_sql(roots: str, min_conf: float, edges_sql: str = EDGES_SQL) -> str:
    """Three levels of breadth-first search, unrolled."""
    levels = [f"""{edges_sql}, r AS ({roots}),
l0 AS (SELECT rt, ri, rt AS nt, ri AS ni, 1.0::DOUBLE AS conf, CAST([] AS INTEGER[]) AS ords, rt || ':' || ri AS path, 0 AS depth FROM r)"""]
    for d in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT rt, ri, nt, ni FROM l{i}" for i in range(d))
        levels.append(f"""
s{d} AS (SELECT l.rt, l.ri, e.tt AS nt, e.ti AS ni, l.conf * e.conf AS conf, list_append(l.ords, e.ord) AS ords,
           l.path || '>' || e.tt || ':' || e.ti AS path, {d} AS depth
         FROM l{d - 1} l JOIN edges e ON e.ft = l.nt AND e.fi = l.ni WHERE l.conf * e.conf >= {min_conf}),
l{d} AS (SELECT rt, ri, nt, ni, conf, ords, path, depth FROM (
           SELECT *, row_number() OVER (PARTITION BY rt, ri, nt, ni ORDER BY ords) AS rn FROM s{d}) x
         WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.rt = x.rt AND v.ri = x.ri AND v.nt = x.nt AND v.ni = x.ni))""")
    union = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in (1, 2, 3))
    return "WITH " + ",".join(levels) + f", found AS ({union})"


CUSTOMER_ROOTS = "SELECT 'customer' AS rt, CAST(c_custkey AS VARCHAR) AS ri FROM customer"
FOUND = "SELECT rt AS root_type, ri AS root_id, nt AS entity_type, ni AS entity_id, round(conf, 4) AS confidence, depth, path FROM found"


def _shown(found):
    return found.select(
        "root_type", "root_id", "entity_type", "entity_id", "confidence", "depth", F.array_join("path", ">").alias("path")
    )


@query("identities_resolved", bfs_sql(CUSTOMER_ROOTS, 0.5) + FOUND)
def identities_resolved(spark, sf):
    return _shown(G.resolve(customers(spark, sf), edges(spark, sf)))


@query("identities_of_type", bfs_sql(CUSTOMER_ROOTS, 0.3) + FOUND + " WHERE nt = 'wallet'")
def identities_of_type(spark, sf):
    return _shown(G.resolve(customers(spark, sf), edges(spark, sf), target_type="wallet", min_confidence=0.3))


LIVE_EDGES = EDGES_SQL.replace("edges AS (", "edges AS (SELECT * FROM (", 1).rstrip()[:-1] + ") WHERE NOT (tt = 'region' AND CAST(ti AS INTEGER) < 2))"


@query("identities_above", bfs_sql(CUSTOMER_ROOTS, 0.7, LIVE_EDGES) + FOUND)
def identities_above(spark, sf):
    gone = (F.col("to_entity_type") == "region") & (F.col("to_entity").try_cast("int") < 2)
    expires = F.when(gone, F.lit(datetime(2023, 1, 1))).otherwise(F.lit(datetime(2030, 1, 1)))
    dated = edges(spark, sf).withColumn("expires_at", expires.cast("timestamp"))
    return _shown(G.resolve(customers(spark, sf), dated, min_confidence=0.7, as_of=datetime(2024, 1, 1)))


@query(
    "typed_walk",
    f"""WITH {EDGES_SQL}
SELECT 'customer' AS root_type, a.fi AS root_id, 'wallet' AS entity_type, c.ti AS entity_id, round(a.conf * b.conf * c.conf, 4) AS confidence,
  'customer:' || a.fi || '>nation:' || a.ti || '>nation:' || b.ti || '>wallet:' || c.ti AS path
FROM edges a JOIN edges b ON b.ft = 'nation' AND b.fi = a.ti AND b.tt = 'nation' JOIN edges c ON c.ft = 'nation' AND c.fi = b.ti AND c.tt = 'wallet'
WHERE a.ft = 'customer' AND a.tt = 'nation'""",
)
def typed_walk(spark, sf):
    paths = G.walk(customers(spark, sf), edges(spark, sf), ["customer", "nation", "nation", "wallet"])
    return paths.select("root_type", "root_id", "entity_type", "entity_id", "confidence", F.array_join("path", ">").alias("path"))


@query(
    "graph_stats",
    f"WITH {EDGES_SQL} SELECT count(DISTINCT ft || ':' || fi) AS entities, count(*) AS relationships FROM edges",
)
def graph_stats(spark, sf):
    return G.graph_stats(edges(spark, sf))


@query(
    "entity_keys",
    "SELECT 'customer:' || c_name || ':' || c_mktsegment AS key, 'customer' AS entity_type, c_name || ':' || c_mktsegment AS entity_id FROM customer",
)
def entity_keys(spark, sf):
    names = load(spark, sf, "customer").select(F.concat_ws(":", "c_name", "c_mktsegment").alias("id"))
    keyed = names.select(G.entity_key(F.lit("customer"), "id").alias("key"))
    kind, ident = G.split_key("key")
    return keyed.select("key", kind.alias("entity_type"), ident.alias("entity_id"))


WALLET_SQL = f"""{bfs_sql(CUSTOMER_ROOTS, 0.5)}, w AS (
  SELECT rt, ri, ni, row_number() OVER (PARTITION BY rt, ri ORDER BY round(conf, 4) DESC, depth, ords) AS rn FROM found WHERE nt = 'wallet'),
best AS (SELECT r.ri AS entity_id, coalesce(w.ni, r.ri) AS wallet FROM r LEFT JOIN w ON w.ri = r.ri AND w.rn = 1)"""


@query("wallet_resolution", f"{WALLET_SQL} SELECT 'customer' AS entity_type, entity_id, wallet FROM best")
def wallet_resolution(spark, sf):
    return G.resolve_to_wallet(customers(spark, sf), edges(spark, sf))


@query(
    "stitched_events",
    f"""{WALLET_SQL}
SELECT 'o:' || o_orderkey AS event_id, wallet AS entity_id, CASE WHEN wallet <> entity_id THEN 'wallet' ELSE 'customer' END AS entity_type,
  entity_id AS original_entity_id, 'customer' AS original_entity_type
FROM orders JOIN best ON best.entity_id = CAST(o_custkey AS VARCHAR)""",
)
def stitched_events(spark, sf):
    events = load(spark, sf, "orders").select(
        F.concat(F.lit("o:"), "o_orderkey").alias("event_id"),
        F.lit("customer").alias("entity_type"),
        F.col("o_custkey").cast("string").alias("entity_id"),
    )
    return G.stitch_events(events, edges(spark, sf))


def _mappings(spark, sf):
    """Two resolvers: rich customers by name, customers of two segments by nation."""
    c = load(spark, sf, "customer")

    def mapping(df, to, kind, conf, source):
        return df.select(
            F.lit("wallet").alias("entity_type"), F.col("c_custkey").cast("string").alias("entity_id"), to.alias("to_entity"),
            F.lit(kind).alias("to_type"), F.lit("resolved_to").alias("relationship_type"), F.lit(conf).alias("confidence"),
            F.lit(source).alias("source"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("extra"),
        )

    return [
        mapping(c.where("c_acctbal > 5000"), F.col("c_name"), "name", 0.9, "names"),
        mapping(c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), F.col("c_nationkey").cast("string"), "nation", 0.8, "nations"),
    ]


BATCH_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS from_entity, 'wallet' AS from_entity_type,
  CASE WHEN c_acctbal > 5000 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS to_entity,
  CASE WHEN c_acctbal > 5000 THEN 'name' ELSE 'nation' END AS to_entity_type, 'resolved_to' AS relationship_type,
  CASE WHEN c_acctbal > 5000 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence_score,
  CASE WHEN c_acctbal > 5000 THEN 'names' ELSE 'nations' END AS source{more}
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000 OR c_mktsegment IN ('BUILDING', 'MACHINERY')"""


@query("batch_resolution", BATCH_SQL.format(more=""", '{"segment":"' || c_mktsegment || '"}' AS extra"""))
def batch_resolution(spark, sf):
    # one input row per order: repeated entities stay repeated
    wallets = load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("address"))
    return G.resolve_wallets(wallets, _mappings(spark, sf))


@query(
    "relationship_rows",
    BATCH_SQL.format(more=", TIMESTAMP '2024-01-01' AS detected_at, NULL::TIMESTAMP AS expires_at"),
)
def relationship_rows(spark, sf):
    wallets = load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("address"))
    return G.relationship_rows(G.resolve_wallets(wallets, _mappings(spark, sf)), datetime(2024, 1, 1))


@query(
    "name_mapping",
    """SELECT 'wallet' AS entity_type, CAST(c_custkey AS VARCHAR) AS entity_id, lower(c_name) || '.eth' AS to_entity, 'ens' AS to_type,
  'resolved_to' AS relationship_type, 0.95::DOUBLE AS confidence, 'ens' AS source, c_mktsegment AS avatar FROM customer WHERE c_nationkey <> 3""",
)
def name_mapping(spark, sf):
    name = F.when(F.col("c_nationkey") != 3, F.concat(F.lower("c_name"), F.lit(".eth")))
    bodies = load(spark, sf, "customer").select(
        F.to_json(
            F.struct(
                F.col("c_custkey").cast("string").alias("address"), name.alias("name"), F.col("c_mktsegment").alias("avatar")
            )
        ).alias("body")
    )
    landed = bodies.select(F.from_json("body", "address string, name string, avatar string").alias("b")).select("b.*")
    return G.name_mapping(landed).select("*", F.col("extra")["avatar"].alias("avatar")).drop("extra")


LOGINS_SQL = """logins AS (SELECT 'cl' || o_custkey % 500 AS client, 'w' || o_custkey AS wallet, o_orderdate::TIMESTAMP AS ts FROM orders),
held AS (SELECT client, ts, max(wallet) AS wallet FROM logins GROUP BY 1, 2)"""


def _logins(spark, sf):
    """Every order is a login: customers share clients, so a client's wallet changes often."""
    return R.client_wallets(
        load(spark, sf, "orders").select(
            F.concat(F.lit("cl"), F.col("o_custkey") % 500).alias("client_id"), F.concat(F.lit("w"), "o_custkey").alias("wallet"),
            F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        )
    )


@query(
    "client_wallets_as_of",
    f"""WITH {LOGINS_SQL}, e AS (SELECT event_id, 'cl' || user_id % 600 AS client, TIMESTAMP '1996-01-01' + to_days(CAST(event_id % 1500 AS INTEGER)) AS ts FROM events)
SELECT CAST(e.event_id AS VARCHAR) AS event_id, held.wallet, held.ts AS valid_from FROM e ASOF LEFT JOIN held ON held.client = e.client AND e.ts >= held.ts""",
)
def client_wallets_as_of(spark, sf):
    events = load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("client_id").alias("entity_type"), F.concat(F.lit("cl"), F.col("user_id") % 600).alias("entity_id"),
        (F.lit("1996-01-01").cast("timestamp") + F.make_interval(days=(F.col("event_id") % 1500).cast("int"))).alias("timestamp"),
    )
    found = R.resolve_as_of(events, _logins(spark, sf), bucket=timedelta(days=30))
    return found.select("event_id", F.col("to_entity").alias("wallet"), "valid_from")


@query(
    "client_wallets_at",
    f"""WITH {LOGINS_SQL} SELECT client AS entity_id, max_by(wallet, ts) AS wallet FROM held WHERE ts <= TIMESTAMP '1997-06-01' GROUP BY 1""",
)
def client_wallets_at(spark, sf):
    at = datetime(1997, 6, 1)
    return R.mapping_at(_logins(spark, sf), F.lit(at.isoformat(" ")).cast("timestamp")).select("entity_id", F.col("to_entity").alias("wallet"))

"""Mixing sources to target weights: budgets handed down a domain-language-source tree.

A budget of tokens is shared among the domains by weight, a domain's share among its languages
and a language's among its sources (the leaves). No node gets more than its capacity, the
tokens below it times `max_epochs`. What a node can't take goes to its siblings by weight (a
water level found with running sums in order of capacity per weight). As a node's capacity is
all that its subtree can take, a shortage leaves the subtree only when no sibling has room:
siblings come before ancestors.

A leaf's share is whole epochs of all its documents, and a prefix of one more epoch: its
documents in the order of a seeded hash, as many tokens as are left. The prefix is found digit
by digit: token sums of 256 buckets a leaf name the one that the prefix ends in, whose own 256
buckets are summed next. After three rounds a bucket is a 16-millionth of its leaf, and a running
sum within it finds the end. So no task holds a whole leaf, however hot. Integers throughout; a level may
leave fewer tokens than it has nodes to rounding. DataFrame functions only.

Defined results: null tree columns are the node ''; a null or empty text has 0 tokens and
comes with each whole epoch; nodes without a weight have weight 1, a weight of 0 leaves a node and
all below it out; a text of any length is counted in one row, by the engine; rows of equal id follow by
their tokens; repeated rows are taken each; no rows give none. Extra columns are kept by
`mix_documents` and not read by `select_documents`; they are held in one struct, so names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import materialize

TREE = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash in a round, and rounds.
DIGITS, ROUNDS = 2, 3
BUCKET_DIGITS = DIGITS * ROUNDS


@dataclass(frozen=True)
class Mix:
    #: node (values joined by /, as "d0", "d0/en", "d0/en/src4"; "*" stands for any) → whole weight
    weights: dict[str, int] = field(default_factory=dict)
    budget_pct: int = 100
    max_epochs: int = 4
    seed: int = 17

    def __post_init__(self) -> None:
        if any(w != int(w) or w < 0 for w in self.weights.values()):
            raise ValueError("weights are whole numbers from 0")


def domain_of(source: Column) -> Column:
    """The given tables name no domain: sources are dealt to four by their number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.substring(number, -9, 9).cast("int") % 4).cast("string")))


def _weight(mix: Mix, depth: int) -> Column:
    """Weight of a node of this depth: its own entry, else that of its last part under '*', else 1."""
    rules = [(k.split("/"), w) for k, w in mix.weights.items() if len(k.split("/")) == depth]
    out = F.lit(1)
    for parts, weight in sorted(rules, key=lambda x: -x[0].count("*")):
        hit = F.lit(True)
        for level, part in zip(TREE, parts):
            hit = hit & (F.lit(True) if part == "*" else F.col(level) == part)
        out = F.when(hit, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to nodes with their capacity, weight and the parent's budget `above`."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = nodes.withColumn("level_at", F.expr("(cast(capacity as decimal(19,0)) * 1000000) div weight"))
    order = Window.partitionBy(*parent).orderBy("level_at", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(*parent)
    ranked = ranked.withColumns(
        {
            "full_before": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(after),
        }
    )
    fits = big("capacity") * big("weight_left") <= (F.col("above") - F.col("full_before")).cast("decimal(19,0)") * big("weight")
    ranked = ranked.withColumn("fits", fits)
    ranked = ranked.withColumns(
        {
            "full": F.coalesce(F.sum(F.when(F.col("fits"), F.col("capacity"))).over(everyone), F.lit(0)),
            "open_weight": F.coalesce(F.sum(F.when(~F.col("fits"), F.col("weight"))).over(everyone), F.lit(1)),
        }
    )
    rest = F.expr("cast((cast(above - full as decimal(19,0)) * cast(weight as decimal(19,0))) div open_weight as bigint)")
    return ranked.withColumn("budget", F.when(F.col("fits"), F.col("capacity")).otherwise(F.least("capacity", rest)))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf, from leaves with their tokens."""
    weights = [_weight(mix, depth) for depth in range(1, len(TREE) + 1)]
    wanted = F.least(*weights) > 0
    leaves = leaves.withColumn("capacity", F.when(wanted, F.col("tokens") * mix.max_epochs).otherwise(0))
    tokens, most = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("capacity"), F.lit(0))).first()
    above = F.lit(min(tokens * mix.budget_pct // 100, most)).cast("long")
    level = None
    for depth in range(1, len(TREE) + 1):
        path, parent = list(TREE[:depth]), list(TREE[: depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        # a node of weight 0 has nothing to take, whatever its weight counts as
        nodes = nodes.withColumn("weight", F.greatest(weights[depth - 1], F.lit(1)))
        nodes = nodes.withColumn("above", above) if level is None else nodes.join(level, parent)
        level = _share(nodes, parent or [F.lit(0)], TREE[depth - 1]).select(*path, F.col("budget").alias("above"))
    return leaves.join(level, list(TREE)).select(*TREE, "tokens", F.col("above").alias("budget"))


def _tree(docs: DataFrame, lang: str, source: str) -> list[Column]:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return [domain_of(docs[f"`{source}`"].cast("string")), text(docs[f"`{lang}`"]), text(docs[f"`{source}`"])]


def _hash(mix: Mix, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def leaf_plan(docs: DataFrame, mix: Mix, doc_id: str, text: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The documents without texts (doc_id, TREE, n_tokens), and per leaf: epochs (whole ones),
    rest (tokens of the prefix), cut (the bucket it ends in, null if none) and cut_start (tokens before that bucket)."""
    tree = [c.alias(name) for name, c in zip(TREE, _tree(docs, lang, source))]
    tokens = F.coalesce(F.regexp_count(docs[f"`{text}`"], F.lit(WORD)), F.lit(0)).cast("long")
    narrow = materialize(docs.select(docs[f"`{doc_id}`"].alias("doc_id"), *tree, tokens.alias("n_tokens")), "mix-tokens")
    leaves = materialize(narrow.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    shares = budgets(leaves, mix)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    shares = shares.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    shares = materialize(shares, "mix-budgets")
    h = _hash(mix, F.col("epochs"), F.col("doc_id"))
    cuts = shares.where("rest > 0").select(*TREE, "epochs", "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("cut_start"))
    for i in range(ROUNDS):
        held = narrow.join(cuts, list(TREE)).where(F.substring(h, 1, DIGITS * i) == F.col("cut"))
        digits = F.substring(h, DIGITS * i + 1, DIGITS)
        sums = held.groupBy(*TREE, "epochs", "rest", "cut", "cut_start", digits.alias("digits")).agg(F.sum("n_tokens").alias("in_cut"))
        running = Window.partitionBy(*TREE).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("cut_start") + F.coalesce(F.sum("in_cut").over(running), F.lit(0)))
        ends = sums.where("start < rest and rest <= start + in_cut")
        cuts = materialize(ends.select(*TREE, "epochs", "rest", F.concat("cut", "digits").alias("cut"), F.col("start").alias("cut_start")), "mix-cuts")
    return narrow, materialize(shares.join(cuts.drop("epochs", "rest"), list(TREE), "left"), "mix-leaves")


def select_documents(docs: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per taken document and epoch: doc_id, TREE, epoch, n_tokens, take_tokens."""
    narrow, leaves = leaf_plan(docs, mix, doc_id, text, lang, source)
    rows = narrow.join(leaves, list(TREE)).withColumn("h", _hash(mix, F.col("epochs"), F.col("doc_id")))
    rows = rows.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    copies = F.col("epochs") + F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("long")
    full = rows.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    full = full.withColumn("take_tokens", F.col("n_tokens"))
    edge = _edge(rows, "bucket", "h", "doc_id", "n_tokens").withColumn("epoch", F.col("epochs"))
    edge = edge.withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("start")))
    out = ["doc_id", *TREE, "epoch", "n_tokens", "take_tokens"]
    return full.select(*out).unionByName(edge.select(*out))


def _edge(rows: DataFrame, bucket: str, h: str, doc_id: str, tokens: str) -> DataFrame:
    """Documents of the bucket that a leaf's prefix ends in, as far as they start before its end."""
    order = Window.partitionBy(*TREE).orderBy(h, doc_id, tokens).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(F.col(bucket) == F.col("cut"))
    edge = edge.withColumn("start", F.col("cut_start") + F.coalesce(F.sum(tokens).over(order), F.lit(0)))
    return edge.where(F.col("start") < F.col("rest"))


def mix_documents(docs: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The taken documents with all their columns, once per epoch. The document that a leaf's
    prefix ends in comes whole. No text is shuffled but those of the buckets prefixes end in."""
    _, leaves = leaf_plan(docs, mix, doc_id, text, lang, source)
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"), *[c.alias(n) for n, c in zip(TREE, _tree(docs, lang, source))])
    held = held.join(leaves.drop("tokens", "budget"), list(TREE)).withColumn("h", _hash(mix, F.col("epochs"), F.col("doc_id")))
    held = held.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    copies = F.col("epochs") + F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("long")
    full = held.where(copies > 0).select("row", F.explode(F.sequence(F.lit(0), copies - 1)))
    counted = held.where(F.col("bucket") == F.col("cut")).withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    edge = _edge(counted, "bucket", "h", "doc_id", "n_tokens")
    return full.select("row").unionByName(edge.select("row")).select("row.*")

"""A ledger made of order tables: orders are transactions, their lines outputs, customers addresses, parts tokens.

| ledger | tables |
|---|---|
| tx_id, vout, address | order, line number, customer |
| amount_sat, block_time, height | price in cents, ship date, days since 1995-01-01 |
| confirmed or not | line status F or O |
| spent confirmed, spent unconfirmed, unspent | return flag R, A, N |
| spending transaction | the customer's next order; unknown for the last one |
| token, NFT collection | brand and type of the part; the part is the NFT's index |
| genesis row of a token (lineage only) | its first line without a discount, known if that line is confirmed |
| authority that a genesis transaction makes (lineage only) | its lines without tax |
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import reversed_hex
from ..operators.ledger import Ledger, first_per
from ..operators.tokens import TOKEN, TokenLedger, genesis_outputs, genesis_rows
from ..plans.nft import Listings
from ..schemas import ZERO_SENSIBLE_ID

SPEND_DAYS = 30


class StarLedger:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def heights(self) -> Row:
        """lo, hi: bounds of the blocks' heights; of lines that repeat an outpoint all count."""
        height = self._height()
        return self.table("lineitem").filter("l_linestatus = 'F'").agg(F.min(height).alias("lo"), F.max(height).alias("hi")).first()

    @staticmethod
    def _height() -> Column:
        return F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint")

    @cached_property
    def raw_lines(self) -> DataFrame:
        """Every line with its transaction; outpoints may repeat."""
        following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("address"), following.cast("string").alias("spend_tx_id"))
        lines = self.table("lineitem").select(
            "l_orderkey", F.col("l_linenumber").cast("int").alias("vout"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_sat"),
            F.col("l_shipdate").alias("block_time"), self._height().alias("height"),
            "l_linestatus", "l_returnflag", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity"), "l_discount", "l_tax",
        )
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("tx_id", F.col("l_orderkey").cast("string")).drop("o_orderkey")

    @cached_property
    def lines(self) -> DataFrame:
        """The first line of each outpoint, among confirmed and among unconfirmed ones."""
        order = [F.col(c) for c in ("block_time", "amount_sat", "l_partkey", "l_suppkey", "l_returnflag")]
        rows = self.raw_lines.drop("tx_id")  # made again from the key, so that the sort doesn't hold it
        return first_per(rows, ["l_orderkey", "vout", "l_linestatus"], order).withColumn("tx_id", F.col("l_orderkey").cast("string"))

    def _spent(self, flag: str) -> DataFrame:
        order = [F.col(c) for c in ("block_time", "amount_sat", "l_partkey", "l_suppkey", "l_linestatus")]
        rows = first_per(self.lines.filter(F.col("l_returnflag") == flag), ["l_orderkey", "vout"], order)
        later = (F.col("block_time") + F.expr(f"INTERVAL {SPEND_DAYS} DAYS")).cast("timestamp_ntz")
        rows = rows.withColumns({"block_time": later, "height": F.col("height") + SPEND_DAYS})
        return rows.withColumnsRenamed({"tx_id": "prev_tx_id", "vout": "prev_vout"})

    @cached_property
    def ledger(self) -> Ledger:
        out, spend = ("tx_id", "vout", "address", "amount_sat"), ("prev_tx_id", "prev_vout", "address", "spend_tx_id")
        of = lambda status: self.lines.filter(F.col("l_linestatus") == status)
        return Ledger(
            of("F").select(*out, "block_time", "height"),
            self._spent("R").select(*spend, "block_time", "height"),
            of("O").select(*out, F.col("block_time").alias("seen_time")),
            self._spent("A").select(*spend, F.col("block_time").alias("seen_time")),
        )

    def _with_tokens(self, rows: DataFrame) -> DataFrame:
        parts = self.table("part").select("p_partkey", F.col("p_brand").alias("code_hash"), F.col("p_type").alias("genesis"))
        joined = rows.join(parts, rows.l_partkey == parts.p_partkey)
        kind = F.when(F.col("l_partkey") % 7 == 0, "unique").otherwise("ft")
        return joined.withColumns(
            {
                "contract_type": kind,
                "sensible_id": F.concat_ws("/", "code_hash", "genesis"),
                "name": F.col("genesis"),
                "symbol": F.col("code_hash"),
                "decimals": F.lit(8).cast("smallint"),
                "amount": F.col("quantity").cast("decimal(20,0)"),
                "value_sat": F.col("amount_sat"),
                "custom_data": F.col("l_partkey").cast("string"),
                "block_time_ms": F.unix_millis(F.col("block_time").cast("timestamp")),
            }
        )

    @cached_property
    def tokens(self) -> TokenLedger:
        out = ("tx_id", "vout", "contract_type", "address", *TOKEN, "sensible_id", "name", "symbol", "decimals", "amount", "value_sat", "custom_data", "height", "block_time_ms")
        gone = ("prev_tx_id", "prev_vout", F.col("spend_tx_id").alias("used_tx_id"), "contract_type", "address", *TOKEN, "sensible_id", "amount", "value_sat", "height", "block_time_ms")
        made = self._with_tokens(self.lines)
        parts = self.table("part").select(F.col("p_brand").alias("code_hash"), F.col("p_type").alias("genesis")).distinct()
        info = parts.select(*TOKEN, F.concat_ws("/", *TOKEN).alias("sensible_id"), F.col("genesis").alias("name"), F.col("code_hash").alias("symbol"), F.lit(8).cast("smallint").alias("decimals"))
        return TokenLedger(
            made.filter("l_linestatus = 'F'").select(*out),
            self._with_tokens(self._spent("R")).select(*gone),
            made.filter("l_linestatus = 'O'").select(*out),
            self._with_tokens(self._spent("A")).select(*gone),
            info,
        )

    def token_lines(self, test: Column) -> DataFrame:
        """Token columns of all lines, repeated ones too, that pass a test (issues: no discount; burns: tax 0.08)."""
        return self._with_tokens(self.raw_lines.filter(test)).select("tx_id", "vout", *TOKEN, "amount")

    @property
    def issues(self) -> DataFrame:
        return self.token_lines(F.col("l_discount") == 0)

    @property
    def burns(self) -> DataFrame:
        return self.token_lines(F.round("l_tax", 2) == 0.08)

    @cached_property
    def lineage(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Token outputs and spends whose sensible ids name a genesis outpoint, the genesis rows, and what those made.

        Sensible ids hold hashes, so transaction ids are padded to their 64 digits. A genesis row has the zero id. The
        genesis row of some tokens is unconfirmed; tokens without any keep an id that can't be read.
        """
        padded = lambda c: F.lpad(c, 64, "0")
        lines = self._with_tokens(self.lines)
        begins = F.min(F.struct("height", padded("tx_id").alias("tx"), "vout", "l_linestatus"))
        starts = lines.filter("l_discount = 0").groupBy(*TOKEN).agg(begins.alias("_start"))
        number = F.lpad(F.hex(F.col("_start.vout").cast("bigint")), 8, "0")
        starts = starts.withColumn("_id", F.lower(F.concat(reversed_hex(F.col("_start.tx")), reversed_hex(number))))

        def named(rows: DataFrame, tx: str, vout: str) -> DataFrame:
            """Rows with padded ids and the sensible id of their token, or the zero id for its genesis row."""
            rows = rows.withColumn(tx, padded(tx)).join(starts, list(TOKEN), "left")
            first = (F.col("_start.tx") == F.col(tx)) & (F.col("_start.vout") == F.col(vout)) & (F.col("_start.l_linestatus") == F.col("l_linestatus"))
            return rows.withColumn("sensible_id", F.when(first, ZERO_SENSIBLE_ID).otherwise(F.coalesce("_id", "sensible_id"))).drop("_start", "_id")

        made = named(lines.filter("l_linestatus = 'F'"), "tx_id", "vout")
        gone = named(self._with_tokens(self._spent("R")), "prev_tx_id", "prev_vout").withColumn("used_tx_id", padded("spend_tx_id"))
        outputs = made.select(*self.tokens.outputs.columns)
        spends = gone.select(*self.tokens.spends.columns)
        return outputs, spends, genesis_rows(outputs), genesis_outputs(self._untaxed(made).select(*outputs.columns), spends)

    @staticmethod
    def _untaxed(made: DataFrame) -> DataFrame:
        """Lines without tax carry the right to issue: their amount is 0."""
        return made.withColumn("amount", F.when(F.col("l_tax") == 0, F.lit(0)).otherwise(F.col("amount")).cast("decimal(20,0)"))

    @property
    def with_authorities(self) -> tuple[DataFrame, DataFrame]:
        """Token outputs with authorities among them, and the confirmed spends."""
        made = self._untaxed(self._with_tokens(self.lines.filter("l_linestatus = 'F'")))
        return made.select(*self.tokens.outputs.columns), self.tokens.spends

    def _nft(self, rows: DataFrame) -> DataFrame:
        return self._with_tokens(rows).withColumns(
            {
                "address": F.col("l_suppkey").cast("string"),
                "token_index": F.col("l_partkey").cast("decimal(20,0)"),
                "token_supply": F.lit(1000).cast("decimal(20,0)"),
                "meta_tx_id": F.concat(F.lit("m"), F.col("l_partkey").cast("string")),
                "meta_vout": F.lit(0).cast("bigint"),
            }
        )

    @cached_property
    def nfts(self) -> TokenLedger:
        out = ("tx_id", "vout", "address", *TOKEN, "sensible_id", "token_index", "token_supply", "meta_tx_id", "meta_vout", "value_sat", "height", "block_time_ms")
        gone = ("prev_tx_id", "prev_vout", F.col("spend_tx_id").alias("used_tx_id"), "address", *TOKEN, "token_index", "height", "block_time_ms")
        made = self._nft(self.lines)
        return TokenLedger(
            made.filter("l_linestatus = 'F'").select(*out),
            self._nft(self._spent("R")).select(*gone),
            made.filter("l_linestatus = 'O'").select(*out),
            self._nft(self._spent("A")).select(*gone),
            self.tokens.info,
        )

    @cached_property
    def sales(self) -> Listings:
        """Lines from the sixth on are listings: the customer sells, the supplier's address holds."""
        price = F.col("amount_sat").cast("decimal(20,0)")
        out = ("tx_id", "vout", F.col("address").alias("seller"), F.col("l_suppkey").cast("string").alias("contract_address"), *TOKEN, F.col("l_partkey").cast("decimal(20,0)").alias("token_index"), price.alias("price"), "value_sat", "height")
        made = self._with_tokens(self.lines.filter("vout >= 6"))
        gone = lambda flag: self._spent(flag).filter("prev_vout >= 6").select("prev_tx_id", "prev_vout")
        return Listings(made.filter("l_linestatus = 'F'").select(*out), gone("R"), made.filter("l_linestatus = 'O'").select(*out), gone("A"))

    @cached_property
    def raw_blocks(self) -> DataFrame:
        """Blocks of one day each: an order's confirmed lines of that day are a transaction, and its inputs are the
        outpoints whose spends name it."""
        outs = self.lines.filter("l_linestatus = 'F'").groupBy("height", "tx_id").agg(
            F.min("block_time").alias("t"), F.sort_array(F.collect_list(F.struct("vout", "address", "amount_sat"))).alias("o")
        )
        ins = self._spent("R").filter("spend_tx_id is not null").groupBy(F.col("spend_tx_id").alias("tx_id")).agg(F.sort_array(F.collect_list(F.struct("prev_tx_id", "prev_vout"))).alias("inputs"))
        txs = outs.join(ins, "tx_id", "left")
        none = F.array().cast("array<struct<prev_tx_id: string, prev_vout: int>>")
        outputs = F.transform("o", lambda x: F.struct(x["address"].alias("address"), x["amount_sat"].alias("amount_sat")))
        tx = F.struct("tx_id", F.coalesce("inputs", none).alias("inputs"), outputs.alias("outputs"))
        blocks = txs.groupBy("height").agg(F.min("t").alias("block_time"), F.sort_array(F.collect_list(tx)).alias("transactions"))
        return blocks.select("height", F.sha2(F.col("height").cast("string").cast("binary"), 256).alias("block_hash"), "block_time", "transactions")

    @cached_property
    def blocks(self) -> DataFrame:
        """One header per day with confirmed lines."""
        rows = self.lines.filter("l_linestatus = 'F'").groupBy("height").agg(F.count_distinct("tx_id").alias("tx_count"), F.sum("amount_sat").alias("reward_sat"))
        return rows.select("height", F.sha2(F.col("height").cast("string").cast("binary"), 256).alias("block_hash"), F.col("tx_count").cast("int").alias("tx_count"), F.col("reward_sat").cast("bigint").alias("reward_sat"))
